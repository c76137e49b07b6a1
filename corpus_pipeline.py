"""Corpus pipeline: each stage applies one corpus operator to all that its predecessor kept.

Rows are told apart by doc_id and text. Null and empty texts, repeated rows and empty tables pass as
the stages say; extra columns stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattlens.llm import jaccard_join, language, packing, pseudonyms
from wattlens.llm.common import store
from wattlens.llm.queries import PSEUDONYM_KEY, held_out, word_bpe


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter, without text, or
    about equally near to two languages go."""
    model = language.train(docs.filter(~held_out()))
    passed = ["text" if c == "text" else f"__{i}" for i, c in enumerate(docs.columns)]  # no name is one of the model's
    said = language.identify(docs.toDF(*passed), model, keep_text=True)
    return said.filter((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).select(*passed).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by word 5-gram similarity of 0.8 or more one row: that with the
    smallest doc_id (rows without an id last), then the smallest hash of its text. Documents
    without words are no copies of each other and stay. Of rows that repeat id and text one
    stays; rows without an id and without words are told apart by nothing, so all stay."""
    found = jaccard_join.jaccard_components(docs, n=5, percent=80, keys=True)
    worded = F.col("n_shingles") > 0
    best = found.filter(worded).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("b"))
    kept = best.select("b.doc_id", "b.text_key").union(found.filter(~worded & F.col("doc_id").isNotNull()).select("doc_id", "text_key").distinct())
    no_id = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    kept = kept.select(F.col("text_key").alias("__kept"), no_id.alias("__kept_id"), F.col("doc_id").isNull().alias("__kept_none"))
    untold = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # repeats go first and by the columns of the join, so the texts are shuffled once for both
    rows = docs.filter(~untold).withColumns({"__key": jaccard_join.text_key("text"), "__id": no_id, "__none": F.col("doc_id").isNull()}).dropDuplicates(["__key", "__id", "__none"])
    named = rows.join(kept, (F.col("__key") == F.col("__kept")) & (F.col("__id") == F.col("__kept_id")) & (F.col("__none") == F.col("__kept_none")))
    return named.select(*docs.columns).union(docs.filter(untold))


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for private values; n_chars follows the text."""
    out = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    length = F.char_length("text").cast("long")
    return out.withColumn("n_chars", length).select(*docs.columns) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, word_bpe(), capacity=2048, end_id=0)


STAGES = [("language", language_stage), ("near_duplicates", near_duplicate_stage), ("private_data", private_stage), ("packing", packing_stage)]

#: No SQL: classifier, keyed permutation and tokenizer are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
