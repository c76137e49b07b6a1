import re
import struct
import zlib
from hashlib import sha256
from html import unescape

import numpy as np
import pytest

from wattlens.llm import common, html_text, prefix_hash as ph, repair, viterbi
from wattlens.llm.encoder import encoder
from wattlens.llm.html_blocks import blocks
from wattlens.llm.queries import QUERIES, piece_bpe, word_bpe

SF = "/root/testdata/sf0.01"


# --- pages

def test_blocks_of_broken_markup():
    page = "<html><head><title>t</title><style>p{}</style></head><body>a &amp; b<nav><ul><li>x<li>y</ul></nav><!-- <p>no</p> --><script>var t='</p>';</script>" \
           "<p>one  two\n<b>three<br>four<p>five < six &copy;</p><table><tr><td>c1<td>c2</table><img src='x>y'><p>end"
    got = blocks(page)
    assert [b.text for b in got] == ["a & b", "x", "y", "one two three four", "five < six ©", "c1", "c2", "end"]
    assert got[1].path == ("html", "body", "nav", "ul", "li") and got[4].path == ("html", "body", "p")
    assert blocks(None) == blocks("") == [] and [b.text for b in blocks("only text")] == ["only text"]
    assert blocks("<" * 2000 + "p") and blocks("<p title='" * 300) == []


@pytest.mark.parametrize("tag", "template noscript iframe object svg math canvas audio video select".split())
def test_hidden_elements_end_with_the_element_around_them(tag):
    def texts(page):
        return [b.text for b in blocks(page)]

    assert texts(f"<body><div>a<{tag} x=1><p>no</div><article><p>the article</p></article>") == ["a", "the article"]
    assert texts(f"<p>a <{tag}>no<{tag}><b>no</b></{tag}><div>no</div> no</{tag}> b<p>c") == ["a b", "c"]
    assert texts(f"<p>a <{tag} /> b<br>c</p>") == ["a b c"] and texts(f"a<{tag}>no") == ["a"]


def test_labels_of_pages_with_known_parts():
    net, rng, right, total = html_text.trained(), np.random.default_rng(77), 0, 0
    for _ in range(150):
        page, said = html_text.training_page(rng)
        found = blocks(page)
        assert [b.text for b in found] == [t for t, _ in said]
        if found:
            right += (net.label([found])[0] == np.array([m for _, m in said])).sum()
            total += len(said)
    assert right / total > 0.985


def test_main_text_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op3_html"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


def test_odd_pages(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "<nav><a href=x>Home</a></nav>", "c"), (3, "<nav><a href=x>Home</a></nav>", "c"), (None, "<article><p>Long text, and more of it.</p></article>", "d")]
    out = html_text.main_text(spark.createDataFrame(rows, "page_id long, html string, text string"))
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in out.collect()}
    assert out.count() == 5 and {(1, "", 0), (2, "", 0), (3, "", 0), (None, "Long text, and more of it.", 26)} == got
    assert html_text.main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


# --- SentencePiece

@pytest.fixture(scope="module")
def files():
    with open(piece_bpe(), "rb") as f:
        return f.read()


def test_merge_model_gives_the_library_s_ids(files):
    import sentencepiece

    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=piece_bpe()), viterbi.Codec(files), np.random.default_rng(6)
    letters = list("aB'sΣİé ñ\n\t .,!<|>theand ing한🙂▁ ")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(800)] + ["the " * 50, "ingth" * 400]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == lib.encode(t)
        assert own.decode(ids) == lib.decode(ids.tolist())


def test_stream_commits_within_a_bounded_window(files):
    m = viterbi.Model(files)
    s, text = viterbi.Stream(m), "▁" + "▁".join(["reformulation", "of", "the"] * 500)
    early = s.feed(text)
    assert len(early) > 1000 and s.widest < 8 * m.longest
    assert viterbi.Codec(files)._ids(early + s.finish()) == viterbi.Codec(files).encode(text[1:].replace("▁", " ")).tolist()


def test_common_beginnings_are_searched_once(files, monkeypatch):
    """Words that begin alike, and parts that no piece reaches across, take few steps of the search; ids stay the library's."""
    import sentencepiece

    lib, own, steps, best = sentencepiece.SentencePieceProcessor(model_file=piece_bpe()), viterbi.Codec(files), [], viterbi.Stream._best
    monkeypatch.setattr(viterbi.Stream, "_best", lambda self, at: steps.append(at) or best(self, at))
    words = [f"reformulation{end}.\nKonstantin{number}" for end in ("s", "al", "ed", "ing", "") for number in range(100)]
    text = " ".join(words)
    ids = own.encode(text)
    assert ids.tolist() == lib.encode(text) and own.decode(ids) == text
    assert len(steps) < len(text) / 20


def test_parts_are_searched_once_in_whatever_word(files, monkeypatch):
    """Different words out of the same parts: a part that no piece reaches across is searched once."""
    import sentencepiece

    lib, own, searched, resume = sentencepiece.SentencePieceProcessor(model_file=piece_bpe()), viterbi.Codec(files), [], viterbi.Stream.resume
    monkeypatch.setattr(viterbi.Stream, "resume", lambda self, text, known: searched.append(text) or resume(self, text, known))
    ends = ["ation", "ing", "ed", "er", "ly", "ness", "al", "ous", "ive", "ity"]
    text = " ".join(f"th{a}.\nTh{b}" for a in ends for b in ends)
    assert own.encode(text).tolist() == lib.encode(text)
    assert len(searched) == len(set(searched)) < 50


def test_memo_keeps_what_is_asked_for():
    made = []
    memo = viterbi.Memo(lambda t: made.append(t) or t.encode(), 20)
    for i in range(200):
        assert memo["often"] == b"often" and memo[f"once{i}"] == f"once{i}".encode()
    assert made.count("often") == 1 and len(memo) + len(memo.older) <= 20
    assert memo["x" * 100] == b"x" * 100 and "x" * 100 not in memo


def test_unigram_model_gives_the_best_sum(files):
    """The same pieces as a unigram model, against the search over all ways of short texts."""
    m = viterbi.Model(files)
    m.type = viterbi.UNIGRAM

    def best(t):
        if not t:
            return 0.0
        return max((m.scores[m.ids[t[:n]]] if t[:n] in m.ids else m.least - 10 if n == 1 else -1e18) + best(t[n:]) for n in range(1, min(len(t), m.longest) + 1))

    for t in ("▁the", "▁thing", "▁reand", "ééx", "▁a▁b한"):
        s = viterbi.Stream(m)
        pieces = s.feed(t) + s.finish()
        assert "".join(pieces) == t
        assert abs(sum(m.scores[m.ids[p]] if p in m.ids else m.least - 10 for p in pieces) - best(t)) < 1e-6


def test_sentencepiece_rows(spark, mixed):
    out = viterbi.encode(mixed, piece_bpe())
    got = [(r["doc_id"], r["decoded"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((r["doc_id"], r["text"] or "") for r in mixed.collect()), key=str)
    assert viterbi.encode(mixed.limit(0), piece_bpe()).count() == 0
    d = {r["doc_id"]: r for r in viterbi.digests(out).collect()}
    assert d[4]["n_ids"] == 0 and d[4]["decoded_crc32"] == 0 and d[1]["decoded_crc32"] == zlib.crc32(mixed.filter("doc_id = 1").first()["text"].encode())


# --- token files

def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(8)
    for ids in (rng.integers(0, 50, 20000), np.zeros(999, int), np.array([5]), np.tile([1, 2, 3], 700), rng.integers(0, 49000, 3000)):
        ids = ids.astype(np.uint32)
        ends = np.unique([*rng.integers(0, len(ids), 5), len(ids)])
        shard = repair.Shard(repair.to_file(ids, ends, 49408))
        assert (shard.ids() == ids).all()
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            assert (shard.document(i) == ids[a:b]).all()
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert (shard.span(a, b) == ids[a:b]).all()
    rules, seq = repair.compress(np.tile([1, 2, 3, 4], 500).astype(np.uint32), 10)
    assert len(rules) and len(seq) < 300
    with pytest.raises(ValueError):
        repair.Shard(b"RPR0" + struct.pack("<5I", 0, 0, 0, 0, 2))


def test_large_vocabularies_are_compressed_too():
    ids = np.tile([70001, 3, 70002, 4], 500).astype(np.uint32)
    for base in (1 << 16, 100_000):
        ids = np.minimum(ids, base - 1)
        data = repair.to_file(ids, np.array([len(ids)]), base)
        shard = repair.Shard(data)
        assert len(shard.rules) and len(data) < ids.nbytes / 4 and shard.ids().tolist() == ids.tolist()


def test_files_of_the_table(spark, mixed):
    tok = encoder(word_bpe()).tokenizer
    rows = sorted(((r["doc_id"], r["text"]) for r in mixed.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    shards = repair.write_shards(mixed, word_bpe(), shard_ids=300)
    assert shards.count() > 1
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in repair.read_shards(shards).collect()), key=lambda x: x[1])
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert got == [(k, s, len(x), zlib.crc32(x.tobytes())) for (k, _), s, x in zip(rows, starts, ids)]
    assert repair.read_shards(repair.write_shards(mixed.limit(0), word_bpe())).count() == 0


# --- fingerprints

def test_spans_and_common_extensions():
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("ab"), 400))
    p = ph.PrefixHash(ph.codes(text))
    for _ in range(300):
        i, j = (int(x) for x in rng.integers(0, 400, 2))
        n = int(rng.integers(0, 400 - max(i, j) + 1))
        assert p.equal(i, p, j, n) == (text[i:i + n] == text[j:j + n])
        k = 0
        while max(i, j) + k < 400 and text[i + k] == text[j + k]:
            k += 1
        assert p.common_extension(i, p, j) == k
    a = ph.PrefixHash(ph.codes("abc" * 50), p, 100)
    assert a.span(0, a.n) == ph.PrefixHash(ph.codes(text[:100] + "abc" * 50)).span(0, a.n)


def test_likeness():
    words = [f"word{i}" for i in range(400)]
    text = " ".join(words)
    other = " ".join(f"else{i * 7}" for i in range(400))
    moved = " ".join(words[200:] + words[:200])
    f = ph.fingerprint
    assert ph.likeness(f(text), f(text)) == 1 and ph.likeness(f(""), f(None)) == 1 and ph.likeness(f(""), f("a")) == 0
    assert ph.likeness(f(text), f(text + "!")) > 0.8 and ph.likeness(f(text), f(moved)) > 0.5 > 0.3 > ph.likeness(f(text), f(other))
    assert 0 <= ph.likeness(f("a"), f("b")) < 1 and ph.likeness(f("ab"), f("ac")) < 1


def test_sketch_holds_the_least_distinct_windows():
    text = "one line that stands here again and again\n" * 400 + " ".join(f"w{i * 7919 % 1009}" for i in range(300))
    for t in (text, text[::-1], "ab" * 5000, "short", ""):
        h = ph.PrefixHash(ph.codes(t))
        want = sorted(set(h.windows(ph.WINDOW).tolist()))[:ph.LEAST]
        raw = ph.base64.b64decode(h.fingerprint())
        assert np.frombuffer(raw[16 + 8 * int((ph.GRID <= len(t)).sum()):], "<u4").tolist() == want
    assert len(set(ph.PrefixHash(ph.codes(text)).windows(ph.WINDOW).tolist())) > 10 * ph.LEAST


@pytest.mark.parametrize("size", [10, 1 << 25])
def test_edited_texts(spark, mixed, monkeypatch, size):
    monkeypatch.setattr(common.in_ranges, "__defaults__", (size, 20_000))
    docs = mixed.filter("doc_id IS NOT NULL AND doc_id < 13")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in ph.edited_fingerprints(docs).collect()}
    for i, (k, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == ph.fingerprint(t) and r["edited_fingerprint"] == ph.fingerprint(edited)
        assert r["near_next"] == ph.likeness(ph.fingerprint(t), ph.fingerprint(following))
    assert ph.edited_fingerprints(mixed).count() == mixed.count() and ph.edited_fingerprints(mixed.limit(0)).count() == 0
    text = docs.filter("doc_id = 7").first()["text"]
    one = ph.edited_fingerprints(docs.filter("doc_id = 7")).first()  # its own next
    assert one["edited_sha256"] == sha256((text[:len(text) - len(text) // 2] + text[:len(text) // 2]).encode()).hexdigest()
