import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlens.llm import packing, sharding
from wattlens.llm.common import gapless
from wattlens.llm.encoder import encoder
from wattlens.llm.queries import word_bpe


def test_place_takes_the_largest_dot_product():
    where = sharding.place(np.array([[5.0, 1], [1, 5], [4, 0.5], [0.5, 4]]), 2)
    assert where[0] == where[3] != where[1] == where[2]


def test_shards_are_whole_and_even(spark, mixed):
    out = sharding.shard(mixed, shards=3)
    rows = out.collect()
    assert len(rows) == mixed.count()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    by_text = {r["doc_id"]: r for r in rows}
    assert by_text[4]["size"] == by_text[5]["size"] == 16 and by_text[4]["text_crc32"] == 0
    assert by_text[10]["shard"] == by_text[11]["shard"] and by_text[1]["shard"] == by_text[2]["shard"]
    assert by_text[1]["text_crc32"] == zlib.crc32(mixed.filter("doc_id = 1").first()["text"].encode())
    assert sharding.shard(mixed.limit(0), 3).count() == 0


def test_a_group_larger_than_a_shard_is_cut(spark):
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "the same text").otherwise(F.concat(F.lit("text number "), "id")).alias("text"))
    n = {r["shard"]: r["n"] for r in sharding.shard(d, 10).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert len(n) == 10 and max(n.values()) < 1.1 * sum(n.values()) / 10


def test_gapless_numbers_over_several_parts(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") * 0).alias("tied"))
    for order in (["id"], ["tied"]):
        rows = gapless(d, ["k"], [F.col(c) for c in order], "n", per_part=20).collect()
        for k in range(3):
            assert sorted(r["n"] for r in rows if r["k"] == k) == list(range(sum(r["k"] == k for r in rows)))


def packed(spark, lengths, capacity, **limits):
    parts = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out: dict = {}
    for r in packing.pack(parts, capacity, **limits).collect():
        out.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in out.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= capacity
    assert sorted(n for rows in out.values() for _, n in rows) == sorted(lengths)
    return out


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_under_every_capacity(spark, rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 300).tolist()
    free = packed(spark, lengths, 100, rule=rule)
    left: list[int] = []  # best-fit decreasing piece by piece
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        i = min(fits, key=lambda i: left[i]) if fits else left.append(100) or len(left) - 1
        left[i] -= n
    assert len(free) <= len(left)
    few = packed(spark, lengths, 100, documents=3, rule=rule)
    assert max(map(len, few.values())) <= 3
    cheap = packed(spark, [n for n in lengths if n <= 60], 100, attention=4000, rule=rule)
    assert all(sum(n * n for _, n in rows) <= 4000 for rows in cheap.values())


def test_plan_refuses_what_fits_nowhere():
    with pytest.raises(ValueError):
        packing.plan({50: 1}, 100, attention=1000)


def test_documents_are_packed_whole(spark, mixed):
    out = packing.pack_documents(mixed, word_bpe(), capacity=64, end_id=0).toPandas()
    enc = encoder(word_bpe())
    for doc, text in [(r["doc_id"], r["text"]) for r in mixed.filter("doc_id < 13").collect()]:
        ids = np.array([*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = out[out.doc_id == doc].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length.iloc[:-1] == 64).all()
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s:s + 64].tobytes()) for s in range(0, len(ids), 64)]
        assert mine.start.tolist() == list(range(0, len(ids), 64))
    assert (out.doc_id == 13).sum() == 2 and out.doc_id.isna().sum() >= 1
    assert packing.pack_documents(mixed.limit(0), word_bpe()).count() == 0


def test_encoder_equals_the_library():
    enc = encoder(word_bpe())
    rng = np.random.default_rng(3)
    letters = list("aB'sΣΩİé ñß\n\t \x1c\x85 .,!<|>endoftextﬁ1²½&_한🙂́")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 40)))) for _ in range(2000)] + ["a <|endoftext|> b", "word" * 300, "don't they'll"]
    for t, ids in zip(texts, enc.encode_batch(texts)):
        assert ids.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
