"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. A bidirectional LSTM, in numpy, reads for every block a
hashed vector of its tag path, a hashed vector of its words and a few figures, and labels
every block as main text or not in the light of the whole page. It is trained here, on
pages made by ``training_page`` from a seed: layouts of many kinds with known labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_batches
from .html_blocks import Block, blocks

PATH, WORDS, FIGURES, HIDDEN = 64, 32, 6, 24
TRAINING_PAGES, EPOCHS, SEED = 1000, 7, 5
_paths: dict[tuple[str, ...], np.ndarray] = {}
_words: dict[str, int] = {}


def _hashed(names: list[str], size: int) -> np.ndarray:
    v = np.zeros(size, np.float32)
    for n in names:
        h = crc32(n.encode("utf-8", "surrogatepass"))
        v[h % size] += 1 if h >> 16 & 1 else -1
    return v


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed elements and names of the path; the innermost also by themselves."""
    got = _paths.get(path)
    if got is None:
        if len(_paths) > 50_000:
            _paths.clear()
        names = []
        for label in path:
            tag, *rest = label.split(".")
            names += [tag, *(f".{n}" for n in rest)]
        last = path[-1].split(".")[0] if path else ""
        got = _paths[path] = np.clip(_hashed([*dict.fromkeys(names), f"last {last}"], PATH), -2, 2)
    return got


def word_vector(text: str) -> np.ndarray:
    words = re.findall(r"\w+", text.lower())
    slots = []
    for w in words:
        h = _words.get(w)
        if h is None:
            if len(_words) > 200_000:
                _words.clear()
            h = _words[w] = crc32(w.encode("utf-8", "surrogatepass"))
        slots.append(h)
    if not slots:
        return np.zeros(WORDS, np.float32)
    h = np.array(slots, np.int64)
    v = np.bincount(h % WORDS, np.where(h >> 16 & 1, 1.0, -1.0), WORDS)
    return (v / (np.linalg.norm(v) + 1e-9)).astype(np.float32)


def inputs(page: list[Block]) -> np.ndarray:
    """One row a block."""
    out = np.zeros((len(page), PATH + WORDS + FIGURES), np.float32)
    for i, b in enumerate(page):
        out[i, :PATH] = path_vector(b.path)
        out[i, PATH:PATH + WORDS] = 0.5 * word_vector(b.text)
        out[i, PATH + WORDS:] = (np.log1p(len(b.text)) / 5, b.linked / len(b.text), b.text[-1] in ".!?:;\"'", i / len(page), i == 0, 1)
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output for every block."""

    def __init__(self, rng: np.random.Generator):
        wide = PATH + WORDS + FIGURES
        self.w = {}
        for d in ("f", "b"):
            self.w[f"x{d}"] = (rng.normal(size=(wide, 4 * HIDDEN)) / np.sqrt(wide)).astype(np.float32)
            self.w[f"h{d}"] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.w["o"] = (rng.normal(size=(2 * HIDDEN, 1)) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """x: steps x pages x inputs, already in the order of direction ``d``."""
        steps, n, _ = x.shape
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((steps, n, HIDDEN), np.float32)
        fed = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        for t in range(steps):
            z = fed[t] + h @ self.w[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            old_h, old_c = h, c
            c = np.where(m, f * c + i * g, c)
            th = np.tanh(c)
            h = np.where(m, o * th, h)
            out[t] = h
            if keep is not None:
                keep.append((i, f, o, g, old_c, th, old_h, m))
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        hf = self._run(x, mask, "f", keep and keep[0])
        hb = self._run(x[::-1], mask[::-1], "b", keep and keep[1])[::-1]
        both = np.concatenate([hf, hb], axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["ob"])[:, :, 0])), both

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: tuple[list, list] = ([], [])
        p, both = self.scores(x, mask, keep)
        n = mask.sum()
        loss = -(np.log(np.where(y, p, 1 - p) + 1e-9) * mask).sum() / n
        dz = ((p - y) * mask / n)[:, :, None].astype(np.float32)
        g = {"o": np.einsum("tnh,tno->ho", both, dz), "ob": dz.sum(axis=(0, 1))}
        back = dz @ self.w["o"].T
        for d, kept, dh_all, xs in (("f", keep[0], back[:, :, :HIDDEN], x), ("b", keep[1], back[::-1, :, HIDDEN:], x[::-1])):
            gx, gh, gc = (np.zeros_like(self.w[k + d]) for k in ("x", "h", "c"))
            dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
            for t in range(len(xs) - 1, -1, -1):
                i, f, o, gg, old_c, th, old_h, m = kept[t]
                dh = dh + dh_all[t]
                live = dh * m
                dct = dc * m + live * o * (1 - th * th)
                z = np.concatenate([dct * gg * i * (1 - i), dct * old_c * f * (1 - f), live * th * o * (1 - o), dct * i * (1 - gg * gg)], axis=1)
                gx += xs[t].T @ z
                gh += old_h.T @ z
                gc += z.sum(axis=0)
                dh = z @ self.w[f"h{d}"].T + dh * ~m
                dc = dct * f + dc * ~m
            g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        return float(loss), g

    def label(self, pages: list[list[Block]], group: int = 128) -> list[np.ndarray]:
        """Whether each block of each page is main text. Pages of like length are run together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            now = order[:max(1, min(group, 20_000 // len(pages[order[0]])))]
            order = order[len(now):]
            x, mask = stacked([inputs(pages[i]) for i in now])
            p, _ = self.scores(x, mask)
            for k, i in enumerate(now):
                out[i] = p[:len(pages[i]), k] > 0.5
        return out


def stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, rows)), len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for k, r in enumerate(rows):
        x[:len(r), k], mask[:len(r), k] = r, True
    return x, mask


# --- training pages -------------------------------------------------------------------------

#: What pages say outside their main text, by kind of section.
PHRASES = {
    "menu": "home about contact products services news blog login register sitemap search archive help".split(),
    "notice": ["we use cookies to improve your experience", "accept all cookies", "subscribe to our newsletter", "this site is best viewed with a new browser"],
    "advert": ["sponsored", "buy now", "advertisement", "special offer for you", "save today"],
    "sidebar": ["related articles", "most read", "popular posts", "follow us", "recent comments", "tags"],
    "footer": ["all rights reserved", "privacy policy", "terms of use", "copyright", "imprint"],
    "form": ["your name", "email", "submit", "search", "password", "send"],
    "comment": ["reply", "posted by", "report", "great post thanks", "i disagree"],
}
SYLLABLES = "an be ter lo mi sa ve ron tis que ment eau ung sch ción los ar de ing th er on the re né für över al ki no pa".split()
OPENERS = {
    "menu": ["nav", "nav class='menu'", "div class='nav'", "div id='menu'", "ul class='menu'", "div class='breadcrumb'", "div role='navigation'"],
    "header": ["header", "div id='header'", "div class='site-header'", "div class='top-bar'", "div class='masthead'"],
    "notice": ["div class='cookie-notice'", "div class='notice'", "div id='banner'", "div class='alert'", "section class='newsletter'"],
    "advert": ["div class='ad'", "div class='ads'", "div class='advert'", "div class='sponsored'", "aside class='promo'", "div id='ad-top'", "section class='advertisement'"],
    "sidebar": ["aside", "div class='sidebar'", "div id='sidebar'", "aside class='related'", "div class='widget'", "div class='share'"],
    "footer": ["footer", "div id='footer'", "div class='footer'", "div class='site-footer'", "div class='bottom'"],
    "form": ["form", "form class='search'", "form id='login'", "form class='contact'"],
    "comment": ["section class='comments'", "div id='comments'", "div class='comment-list'", "ol class='comments'", "div class='discussion comments'"],
    "main": ["article", "article", "article class='post'", "main", "div class='content'", "div id='content'", "div class='post-body'", "div class='entry-content'", "div id='main'", "section class='article'"],
}


def training_page(rng: np.random.Generator) -> tuple[str, list[tuple[str, bool]]]:
    """A page and, in order, the text of each of its blocks with its label."""
    out, said = [], []

    def pick(xs):
        return xs[int(rng.integers(len(xs)))]

    def sentence(most: int) -> str:
        words = ["".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(1, most)))]
        return (" ".join(words)).capitalize() + pick([".", ".", ".", "!", "", "?"])

    def put(open_: str, text: str, main: bool, inside: str = "{}") -> None:
        out.append(f"<{open_}>{inside.format(text)}" + ("" if open_ == "p" and rng.random() < 0.2 else f"</{open_.split()[0]}>"))
        said.append((" ".join(text.split()), main))

    def part(kind: str) -> None:
        open_ = pick(OPENERS[kind])
        out.append(f"<{open_}>")
        if open_.split()[0] in ("ul", "ol") or kind in ("menu", "header") and rng.random() < 0.8:
            if open_.split()[0] not in ("ul", "ol"):
                out.append("<ul>")
            for _ in range(int(rng.integers(1, 8))):
                put("li", pick(PHRASES.get(kind, PHRASES["menu"])) if rng.random() < 0.5 else sentence(3), False, "<a href='/x'>{}</a>" if kind != "comment" else "{}")
            if open_.split()[0] not in ("ul", "ol"):
                out.append("</ul>")
        else:
            bare = rng.random() < 0.5 and kind in ("advert", "footer", "notice", "header")
            if bare:
                text = (pick(PHRASES.get(kind, PHRASES["menu"])) + " " if rng.random() < 0.4 else "") + sentence(14)
                out.append(text)
                said.append((" ".join(text.split()), False))
            else:
                for _ in range(int(rng.integers(1, 5))):
                    text = pick(PHRASES.get(kind, PHRASES["menu"])) if rng.random() < 0.5 else sentence(20 if kind != "comment" else 60)
                    put(pick(["p", "div", "p", "h3", "div class='item'"]), text, False, pick(["{}", "<a href='/y'>{}</a>", "{}"]))
        out.append(f"</{open_.split()[0]}>")

    def main() -> None:
        open_ = pick(OPENERS["main"])
        out.append(f"<{open_}>")
        if rng.random() < 0.85:
            put(pick(["h1", "h1", "h2"]), sentence(12), True)
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            if r < 0.75:
                kind = rng.random()
                text = " ".join(sentence(30) for _ in range(int(rng.integers(1, 8))))
                if kind < 0.2:
                    text = sentence(3) + pick(["", "", " |", ",", " 12"])
                elif kind < 0.3:
                    text = " ".join([sentence(2)] * int(rng.integers(2, 40)))
                put("p", text, True, pick(["{}", "{}", "<b>{}", "<em>{}</em>", "{}<br>"]))
            elif r < 0.82:
                put(pick(["h2", "h3"]), sentence(8), True)
            elif r < 0.88:
                out.append("<ul>")
                for _ in range(int(rng.integers(1, 5))):
                    put("li", sentence(12), True)
                out.append("</ul>")
            elif r < 0.93:
                put(pick(["blockquote", "pre", "figcaption", "div"]), sentence(25), True)
            elif r < 0.96:
                out.append("<table><tr>")
                for _ in range(int(rng.integers(1, 5))):
                    put("td", sentence(5), True)
                out.append("</tr></table>")
            else:
                part(pick(["advert", "sidebar"]))
        out.append(f"</{open_.split()[0]}>")

    order = [k for k, p in (("header", .3), ("menu", .8), ("notice", .3), ("advert", .5), ("sidebar", .2), ("form", .2)) if rng.random() < p]
    rng.shuffle(order)
    tail = [k for k, p in (("advert", .2), ("comment", .35), ("sidebar", .35), ("form", .2), ("menu", .1), ("footer", .85)) if rng.random() < p]
    out.append("<html><head><title>" + sentence(5) + "</title><style>p{}</style><script>var t='</p>';</script></head><body>")
    wrap = rng.random() < 0.4
    out.append("<div class='wrapper'>" if wrap else "")
    for kind in order:
        part(kind)
    if rng.random() < 0.97:
        main()
    for kind in tail:
        part(kind)
    out.append(("</div>" if wrap else "") + pick(["</body></html>", ""]))
    return "".join(out), said


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller after ``epochs`` rounds of Adam over ``pages`` made pages; the same every time."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(pages):
        page, said = training_page(rng)
        found = blocks(page)
        if [b.text for b in found] == [t for t, _ in said] and found:
            rows.append((inputs(found), np.array([m for _, m in said])))
    net = Labeller(rng)
    mean, square, step = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(rows)).tolist(), key=lambda i: len(rows[i][0]))
        groups = [order[i:i + 24] for i in range(0, len(order), 24)]
        for i in rng.permutation(len(groups)):
            x, mask = stacked([rows[j][0] for j in groups[i]])
            y = np.zeros(mask.shape, bool)
            if rng.random() < 0.3:
                x[:, :, PATH:PATH + WORDS] = 0  # so that the path alone must do at times
            for k, j in enumerate(groups[i]):
                y[:len(rows[j][1]), k] = rows[j][1]
            _, g = net.gradients(x, mask, y)
            step += 1
            norm = np.sqrt(sum((v * v).sum() for v in g.values()))
            for k, v in g.items():
                v = v * min(1, 5 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.999 * square[k] + 0.001 * v * v
                net.w[k] = (net.w[k] - 0.01 * 0.7 ** epoch * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def main_text(pages: DataFrame, html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """Replaces ``html_col`` by text (empty if none) and n_chars (its code points), for all rows.

    The whole page is read. Null and empty pages and pages without main text: empty text, 0.
    Repeated rows stay; all other columns pass through, but for such named text or n_chars,
    which give way. Empty table: no rows.
    """
    net = model or trained()
    kept = pages.select(*[c for c in pages.columns if c == html_col or c not in ("text", "n_chars")])
    inner = kept.select(*[F.col(c).alias("__html" if c == html_col else f"c{i}") for i, c in enumerate(kept.columns)])
    passed = [(n, f) for n, f in zip(inner.columns, kept.schema) if n != "__html"]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 1000):
                part = b.iloc[s:s + 1000]
                found = [blocks(h if isinstance(h, str) else None) for h in part["__html"]]
                texts = ["\n".join(x.text for x, main in zip(p, said) if main) for p, said in zip(found, net.label(found))]
                yield part.drop(columns="__html").assign(text=texts, n_chars=[len(t) for t in texts])

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in passed] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_batches(inner, extract, schema).toDF(*[f.name for _, f in passed], "text", "n_chars")
