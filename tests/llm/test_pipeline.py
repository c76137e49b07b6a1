import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from wattlens.llm import pseudonyms
from wattlens.llm.encoder import encoder
from wattlens.llm.queries import PSEUDONYM_KEY, QUERIES, word_bpe

from test_joins import brute

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(QUERIES) <= set(names)


def test_stages_one_by_one(spark, tmp_path):
    """The whole pipeline, stage by stage, against plain definitions over all rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, None, "s", 0), (9001, "", "en", "s", 0), (9002, "12 34 %% 2023-01-02", "en", "s", 3)], docs.schema)
    docs = docs.union(extra)
    columns = docs.columns
    kept = []
    for i, (name, stage) in enumerate(cp.STAGES):
        docs.write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        kept.append(docs.collect())
        docs = stage(spark, docs, SF)
        if i < len(cp.STAGES) - 1:
            assert docs.columns == columns
    packed = docs.toPandas()
    start, known, single, private = kept
    assert {r["doc_id"] for r in start} - {r["doc_id"] for r in known} >= {9000, 9001, 9002}
    assert len(known) >= 0.99 * (len(start) - 3)

    want = {c for k, _, c in brute([(r["doc_id"], r["text"]) for r in known])}
    assert sorted(r["doc_id"] for r in single) == sorted(want)

    before = {r["doc_id"]: r for r in single}
    assert len(private) == len(single)
    for r in private:
        assert r["text"] == pseudonyms.pseudonymise_text(before[r["doc_id"]]["text"], PSEUDONYM_KEY)[0] and r["n_chars"] == len(r["text"])

    enc = encoder(word_bpe())
    for r in private:
        ids = np.array([*enc.tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        mine = packed[packed.doc_id == r["doc_id"]].sort_values("piece")
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s:s + 2048].tobytes()) for s in range(0, len(ids), 2048)]
    sums = packed.groupby("sequence_id").length.sum()
    assert sums.max() <= 2048 and len(sums) <= packed.length.sum() / 2048 + 2


def test_language_stage_keeps_columns_named_like_its_own(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(
        {"score": F.concat(F.lit("s"), "doc_id"), "lang_pred": F.lit("mine"), "ambiguous": F.col("doc_id") * 2})
    out = cp.language_stage(spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all((r["score"], r["lang_pred"], r["ambiguous"]) == (f"s{r['doc_id']}", "mine", 2 * r["doc_id"]) for r in rows)


def test_near_duplicate_stage_with_odd_rows(spark, mixed):
    out = cp.near_duplicate_stage(spark, mixed, SF)
    ids = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert out.columns == mixed.columns
    assert {k for k, _ in ids} == {c for k, n, c in brute(rows)} | {None} and len(ids) == len(set(ids))


def test_near_duplicate_stage_with_repeated_and_null_ids(spark):
    one, two = (" ".join(f"{c}{j}" for j in range(40)) for c in "ab")
    rows = [(1, one), (2, two), (2, one), (2, one), (None, one), (None, two + " more"), (None, "only here"), (None, "only here"), (None, ""), (None, ""), (3, None), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L AS root", "2L AS text_key", "true AS worded")
    got = sorted(((r["doc_id"], r["text"] or "") for r in cp.near_duplicate_stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, one), (2, two), (None, "only here"), (None, ""), (None, ""), (3, "")], key=str)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.filter(F.col("length") > 0).count() == out.count() > 0


def test_near_duplicates_shuffle_the_texts_once_behind_the_join(spark, mixed):
    """Repeated rows go by the columns of the join: one exchange carries texts, and rows without id and words all stay."""
    rows = mixed.select("doc_id", "text", "lang").union(spark.createDataFrame([(None, " ", "a"), (None, " ", "b"), (None, None, "c"), (None, "no id here", "d"), (0, "no id here either", "e"), (3, None, "f"), (3, None, "f")], "doc_id long, text string, lang string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cp.near_duplicate_stage(spark, rows, SF)
        plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    carried = [part for part in plan.split("\n\n") if " Exchange\n" in part and ("text#" in part or "first#" in part)]
    assert len(carried) == 1
    # of every id and text one row, and of linked texts the smallest id; nothing tells rows without id and words apart
    assert got == sorted([(r["doc_id"], r["text"]) for r in rows.filter("doc_id in (1, 4, 5, 6, 7, 8, 9, 10, 12)").collect()]
                         + [(13, "123 456 !!"), (None, "no id here"), (0, "no id here either"), (3, None), (None, " "), (None, " "), (None, None)], key=str)
