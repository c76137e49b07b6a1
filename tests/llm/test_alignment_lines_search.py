"""Alignment, line dedup and lexical search against brute force."""

import math
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from wattlens.llm import alignment, lexical, line_dedup
from wattlens.llm.queries import QUERIES, byte_bpe, piece_bpe

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- alignment

def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(byte_bpe())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe())
    table_a, table_b = alignment.ByteLevel(byte_bpe()).bytes, alignment.Pieces(piece_bpe()).bytes
    found, counts = [], Counter()
    for i, t in rows:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if b"".join(table_a[x] for x in ids_a) != want or b"".join(table_b[x] for x in ids_b) != want:
            ids_a, ids_b = [], []
        ends_a, ends_b = np.cumsum([len(table_a[x]) for x in ids_a]).tolist(), np.cumsum([len(table_b[x]) for x in ids_b]).tolist()
        place_a, place_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        cuts = [(place_a[e], place_b[e]) for e in ends_a if e in place_b]
        links = [(ids_a[x], ids_b[y]) for x, y in cuts]
        starts = [(0, 0)] + [(x + 1, y + 1) for x, y in cuts]
        groups = ";".join(",".join(map(str, ids_a[s:x + 1])) + "|" + ",".join(map(str, ids_b[u:y + 1])) for (s, u), (x, y) in zip(starts, cuts))
        counts.update(links)
        found.append((i, len(ids_a), len(ids_b), len(cuts), links, groups))
    most = {}
    for (_, y), c in counts.items():
        most[y] = max(most.get(y, 0), c)
    return sorted(((i, na, nb, n, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                    sha256(g.encode()).hexdigest() if g else "", g) for i, na, nb, n, links, g in found), key=str)


@pytest.mark.parametrize("piece", [alignment.PAIRS_A_PIECE, 200])
def test_alignment_of_awkward_texts(spark, mixed, piece):
    odd = [(100, "<|endoftext|> <s> </s>"), (101, "a ▁ b"), (102, "a\x00b"), (103, " two  spaces \n\t tail  "), (104, "日本語テキスト" * 200), (105, "x" * 30_000), (106, "don't we'll 12345 ½ é é")]
    docs = mixed.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = alignment.align(docs, byte_bpe(), piece_bpe(), groups=True, piece=piece).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_alignment(rows)


def test_alignment_query_and_empty_table(spark):
    got = sorted((tuple(r) for r in QUERIES["op11_alignment"](spark, SF).collect()), key=str)
    assert got == sorted((x[:8] for x in brute_alignment(documents(spark))), key=str)
    none = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.align(none, byte_bpe(), piece_bpe()).count() == 0
    with pytest.raises(ValueError):
        alignment.align(spark.createDataFrame([], "n_a long, text string"), byte_bpe(), piece_bpe(), id_col="n_a")


def test_lanes_change_nothing_and_lockstep_ends():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 7, 5000, 40]
    a, b, total = [], [], 0
    for n in sizes:
        whole = total + np.arange(1, n + 1)
        keep = [np.unique(np.append(rng.choice(whole, max(1, n // 2)), whole[-1])) for _ in range(2)]
        a.append(keep[0])
        b.append(keep[1])
        total += n
    ends_a, ends_b = np.concatenate(a), np.concatenate(b)
    to_a, to_b = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
    from_a, from_b = to_a - [len(x) for x in a], to_b - [len(x) for x in b]
    want = np.intersect1d(ends_a, ends_b)
    for every in (1, 3, 64, 10 ** 6):
        x, y = alignment.lockstep(ends_a, ends_b, *alignment.lanes(ends_a, ends_b, from_a, to_a, from_b, every))
        assert (ends_a[x] == want).all() and (ends_b[y] == want).all()


def test_other_byte_level_files_go_through_the_library():
    lib = alignment.ByteLevel(byte_bpe())
    texts = [" a  b\n\n c'll", " " + "q" * 3000, "  <|endoftext|>", " ü" * 50]
    fast = [lib.encode(t).tolist() for t in texts]
    assert lib.fast is not None
    lib.fast = None
    assert [lib.encode(t).tolist() for t in texts] == fast


# --- lines

def key(line):
    return re.sub(r"[A-Z]", lambda x: x[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, least=10):
    order = lambda i: (i is None, i if i is not None else 0)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    first = {k: min(v, key=order) for k, v in holders.items() if len(v) > 1}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in first or first[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = np.random.default_rng(5)
    pool = [f"  Line NUMBER {i} of the pool{' ' * (i % 3)}" for i in range(60)] + ["short", "ten signs.", "nine sig.", "", "ÄÖÜ äöü groß", "\x0b\ttabbed line here\x0c\r", "\xa0no-break stays here\xa0"]
    rows = [(int(i), "\n".join(rng.choice(pool, rng.integers(0, 9)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, "line number 3 of the pool\nonly in rows without id"), (None, "only in rows without id"), (7, "a second text of document seven\n" + pool[1])]
    rows += [(300 + i, "the one very common line\nown line of " + str(i)) for i in range(80)] + [(500, "\n".join(["own repeats stay here"] * 50)), (501, "x" * 40_000)]
    return rows + rows[:5] + [(400, "\n".join(f"long text line {i}" for i in range(20_000))), (401, "\n".join(f"long text line {i}" for i in range(0, 20_000, 2)))]


@pytest.mark.parametrize("filter_bytes", [line_dedup.FILTER_BYTES, 1024])
def test_lines_against_brute_force(spark, filter_bytes):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS at", "9 AS n_lines", "'d' AS drop").repartition(5)
    got = line_dedup.drop_repeated_lines(docs, filter_bytes=filter_bytes)
    assert got.columns == ["doc_id", "text", "key", "at", "drop", "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_many_hash_ranges_and_the_filters_miss_nothing(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    twice = line_dedup.twice_seen(docs, docs["text"], 10, range_keys=500).collect()
    suspects = {int(h) for r in twice for h in np.frombuffer(r["hashes"], np.int64)}
    lines = docs.selectExpr("id", "explode(split(coalesce(text, ''), '\\n')) AS line").select("id", line_dedup.line_key("line").alias("k")).filter("char_length(k) >= 10")
    held = lines.selectExpr("k", "id", "xxhash64(k) AS h").collect()
    documents, rows_of = {}, Counter(r["h"] for r in held)
    for r in held:
        documents.setdefault(r["h"], set()).add(r["id"])
    assert len(twice) > 10 and all(len(ids) == 1 for h, ids in documents.items() if h not in suspects)
    false = sum(n == 1 and h in suspects for h, n in rows_of.items())
    assert false < 0.01 * len(rows_of)


# --- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, k=20):
    def terms(t):
        return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))

    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs]
    total, length = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 75 + 25 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, postings, first, block", [(20, lexical.PART_POSTINGS, lexical.FIRST_DOCS, lexical.ITEM_BYTES), (3, 40, 2, 300)])
def test_search_against_brute_force(spark, mixed, monkeypatch, k, postings, first, block):
    monkeypatch.setattr(lexical, "PART_POSTINGS", postings)
    monkeypatch.setattr(lexical.stratified, "__defaults__", (postings,))
    monkeypatch.setattr(lexical, "FIRST_DOCS", first)
    monkeypatch.setattr(lexical, "CELLS", 64 if first == 2 else lexical.CELLS)
    more = [(50 + i, f"common common term{i % 7} ÄÖ é{i % 3} Fox" + " pad" * (i % 11), None) for i in range(120)]
    docs = mixed.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True).repartition(3)
    items = spark.createDataFrame([(1, "The quick fox, the LAZY dog!"), (2, None), (3, ""), (4, "term3 é1 common; ÄÖ"), (5, "zzz nothing"), (5, "le chat dort 123"),
                                   (None, "short"), (6, "w1q1 w2q2 " * 20)], "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score")
    got = [tuple(r) for r in lexical.search(docs, items, k=k, block_bytes=block).select("item_id", "rank", "doc_id", "score").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_search(rows, [(r["item_id"], r["text"]) for r in items.collect()], k)
    assert sorted(got, key=str) == want
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_later_strata_are_pruned_but_nothing_is_lost(spark):
    rows = [(i, "alpha beta gamma" if i < 30 else "alpha " + "filler " * (i % 40)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("q", "alpha beta gamma")], "item_id string, text string")
    assert sorted((tuple(r) for r in lexical.search(docs, items, k=5).collect()), key=str) == brute_search(rows, [("q", "alpha beta gamma")], 5)
