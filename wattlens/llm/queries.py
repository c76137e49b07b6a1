"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, html_text, jaccard_join, language, lexical, line_dedup, neighbours, packing, prefix_hash, pseudonyms, repair, sharding, viterbi
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe() -> str:
    """The word vocabulary; its place is a parameter of every operator that tokenises."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_sharding")
def op1_sharding(spark, d):
    out = sharding.shard(table(spark, d, "documents"), shards=40)
    return out.select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The key that the registered query and the pipeline use; a production run names its own.
PSEUDONYM_KEY = b"corpus pseudonyms"


@query("op2_pii")
def op2_pii(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY, counts=True)


@query("op3_html")
def op3_html(spark, d):
    return html_text.main_text(table(spark, d, "pages").select("page_id", "url", "html"))


@query("op4_jaccard_join", r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.node = d.doc_id GROUP BY 1""")
def op4_jaccard_join(spark, d):
    found = jaccard_join.jaccard_components(table(spark, d, "documents"), n=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op5_sentencepiece")
def op5_sentencepiece(spark, d):
    return viterbi.digests(viterbi.encode(table(spark, d, "documents"), piece_bpe()))


@query("op6_repair_files")
def op6_repair_files(spark, d):
    return repair.read_shards(repair.write_shards(table(spark, d, "documents"), word_bpe(), end_id=1))


@query("op7_fingerprints")
def op7_fingerprints(spark, d):
    return prefix_hash.edited_fingerprints(table(spark, d, "documents"))


@query("op8_packing")
def op8_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), word_bpe(), capacity=2048, end_id=0)


@query("op9_neighbours")
def op9_neighbours(spark, d):
    return neighbours.search(table(spark, d, "embeddings"), k=20, every=20)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


@query("op10_language")
def op10_language(spark, d):
    docs = table(spark, d, "documents").withColumn("held_out", held_out())
    model = language.train(docs.filter(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "held_out", "text"), model)


@query("op11_alignment")
def op11_alignment(spark, d):
    return alignment.align(table(spark, d, "documents"), byte_bpe(), piece_bpe())


@query("op12_line_dedup", r"""WITH l AS (
  SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
r AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE l.doc_id <> r.first) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE r.first IS NULL OR l.doc_id = r.first), '')) AS kept_sha256
FROM l LEFT JOIN r ON r.k = l.k GROUP BY 1""")
def op12_line_dedup(spark, d):
    kept = line_dedup.drop_repeated_lines(table(spark, d, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op13_lexical_search", r"""WITH w AS MATERIALIZED (
  SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents) GROUP BY ALL),
d AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM w GROUP BY 1),
c AS MATERIALIZED (SELECT count(*)::BIGINT AS N0, sum(n)::BIGINT AS L0 FROM d),
f AS (SELECT t, floor(1000 * ln((2 * N0 + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS wt FROM w, c GROUP BY t, N0),
m AS (SELECT doc_id, 100 - 25 + (25 * n * N0) // L0 AS m FROM d, c),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * wt * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""")
def op13_lexical_search(spark, d):
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"), k=20)
