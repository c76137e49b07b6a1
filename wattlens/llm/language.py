"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a linear classifier on hashed character n-grams
tells the languages with +1 from those with -1. Decoding weighs each bit's exponential loss
by how well that bit's classifier knows that language and takes the codeword with the least
loss; a document whose two nearest codewords are about equally near is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import map_batches

UNKNOWN = "und"
FIT_COLUMNS = 1024  # of the training matrix that a product widens to doubles at a time
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None, size: int) -> np.ndarray | None:
    """Hashed counts of letter n-grams (1 to 3, words edged by a space), square-rooted and of
    unit length; None without letters. Non-letters only part words."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32).astype(np.uint64)
    code = np.concatenate([[32], code[letter | np.concatenate([[False], letter[:-1]])], [32]]).astype(np.uint64)
    a = code * np.uint64(0x9E3779B97F4A7C15)
    b = a[:-1] + code[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    c = b[:-1] + code[2:] * np.uint64(0x165667B19E3779F9)
    shift, total = np.uint64(64 - (size.bit_length() - 1)), np.zeros(size)
    for grams in (a, b, c):
        mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total += np.bincount((mixed >> shift).astype(np.int64), minlength=size)
    total = np.sqrt(total)
    return (total / np.linalg.norm(total)).astype(np.float32)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Exhaustive code up to 7 classes (every split once), else random splits, 10 log2(classes)
    columns, the draw with the widest least distance of 64."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 7:
        splits = range(1, 2 ** (classes - 1))
        return np.array([[1.0 if s >> c & 1 else -1.0 for s in splits] for c in range(classes)])
    rng, n, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes))), None, -1
    for _ in range(64):
        m = np.where(rng.random((classes, n)) < 0.5, -1.0, 1.0)
        if (np.abs(m.sum(axis=0)) == classes).any():
            continue
        near = (n - (m @ m.T)[np.triu_indices(classes, 1)]).min()
        if near > far:
            best, far = m, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    trust: np.ndarray  # languages x bits, rows add up to 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        return (np.exp(-self.code[None] * margin[:, None, :]) * self.trust[None]).sum(axis=2)


def fit(x: np.ndarray, y: list[str], ridge: float = 0.3) -> Model:
    """One least-squares classifier a bit, languages weighed alike; a bit's trust for a
    language is the share of its left-out rows on the right side. ``x``, the largest thing
    on the driver, is centred in place and widened in parts."""
    languages = sorted(set(y))
    at = np.array([languages.index(v) for v in y])
    code = codewords(len(languages))
    count = np.bincount(at, minlength=len(languages))
    mean = x.mean(axis=0)
    target = code[at]
    offset = code.mean(axis=0)
    x -= mean
    gram = x @ x.copy().T
    inverse = np.linalg.inv(gram + ridge * np.diag(count[at] / count.mean()))
    dual = inverse @ (target - offset)
    left_out = target - dual / np.diag(inverse)[:, None]
    right = (left_out * target > 0).astype(float)
    trust = np.vstack([right[at == k].mean(axis=0) for k in range(len(languages))]) + 1e-3
    weights = np.vstack([x[:, i:i + FIT_COLUMNS].T @ dual for i in range(0, x.shape[1], FIT_COLUMNS)]).astype(np.float32)
    return Model(languages, code, trust / trust.sum(axis=1, keepdims=True), weights, offset - mean @ weights)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400,
          size: int = 8192) -> Model | None:
    """Fit on about ``per_language`` labelled rows of each language, never more, chosen by a hash
    of id and text.

    That bound is the only sample in the operator. Rows without label or letters teach
    nothing; None if no row teaches.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    wide = 1 << 30
    place = F.pmod("key", F.lit(wide))
    counts = sorted(map(tuple, known.groupBy("lang").agg(F.count(F.lit(1)), F.min(place)).collect()))  # one row a language
    if not counts:
        return None
    bound = F.create_map(*[F.lit(v) for k, n, first in counts for v in (k, max(first + 1, min(wide, -(-wide * per_language // n))))])
    drawn = known.filter(place < F.element_at(bound, F.col("lang")))
    # equal rows share a hash and are drawn together; tasks keep this many of them before the shuffle
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(place, "key"))
    chosen = drawn.withColumn("nth", nth).filter(F.col("nth") <= per_language).drop("nth")

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, lang in zip(b["key"], b["text"], b["lang"]):
                if (f := features(t, size)) is not None:
                    i = np.flatnonzero(f)
                    rows.append((k, lang, i.astype("<i4").tobytes(), f[i].astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["key", "lang", "at", "value"])

    rows = map_batches(chosen, sparse, "key long, lang string, at binary, value binary").collect()  # at most per_language a language
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["key"]))
    labels = [r["lang"] for r in rows]
    x = np.zeros((len(rows), size), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["value"], "<f4")
    del rows, r
    return fit(x, labels)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", margin: float = 0.02, size: int = 8192, keep_text: bool = False) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous to every row; the whole text counts.

    Null texts and texts without a letter: ``und``, score 0, not ambiguous. Without a model
    every text is ``und``. A single known language is always taken, with score 1. Ties go to
    the first language of the alphabet. Columns with the new names give way. The text is
    returned only with ``keep_text``.
    """
    kept = docs.drop("lang_pred", "score", "ambiguous")
    inner = kept.select(*[F.col(c).alias("__text" if c == text_col else f"c{i}") for i, c in enumerate(kept.columns)])

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b if keep_text else b.drop(columns="__text")
            lang, score, unclear = [UNKNOWN] * len(b), np.zeros(len(b)), np.zeros(len(b), bool)
            texts = b["__text"].tolist()
            for s in range(0, len(b), 256) if model else ():
                got = [features(t, size) for t in texts[s:s + 256]]
                at = [i for i, f in enumerate(got) if f is not None]
                if not at:
                    continue
                loss = model.losses(np.vstack([got[i] for i in at]))
                share = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
                share /= share.sum(axis=1, keepdims=True)
                order = np.sort(loss, axis=1)
                for i, row, best, ranked in zip(at, share, loss.argmin(axis=1), order):
                    lang[s + i], score[s + i] = model.languages[best], row[best]
                    unclear[s + i] = len(ranked) > 1 and ranked[1] - ranked[0] < margin
            yield out.assign(lang_pred=lang, score=score, ambiguous=unclear)

    passed = [(n, f) for n, f in zip(inner.columns, kept.schema) if keep_text or n != "__text"]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in passed] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                                                                              T.StructField("ambiguous", T.BooleanType())])
    return map_batches(inner, predict, schema).toDF(*[f.name for _, f in passed], "lang_pred", "score", "ambiguous")
