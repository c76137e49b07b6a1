import re
from collections import defaultdict
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlens.llm import jaccard_join as jj, neighbours
from wattlens.llm.components import components

SF = "/root/testdata/sf0.01"


def brute(rows):
    """doc_id -> (set size, smallest id reachable), by an inverted index over all pairs that share an n-gram."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders = [], defaultdict(list)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        s = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(i)
        sets.append(s)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(docs):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(docs).collect()), key=str)


def test_join_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert joined(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark, mixed):
    assert joined(mixed) == brute([(r["doc_id"], r["text"]) for r in mixed.select("doc_id", "text").collect()])
    assert jj.jaccard_components(mixed.limit(0)).count() == 0


def test_large_groups_chains_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 10)
    monkeypatch.setattr(jj, "BLOCK_SETS", 7)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # near copies at random distances, on both sides of the bound
        w = list(base)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, 120))] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w[int(rng.integers(0, 12)):])))
    for i in range(30):  # a common passage in otherwise different documents, mostly short
        rows.append((100 + i, " ".join(base[:14] + [f"y{i}_{j}" for j in range(i % 9)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs) == brute(rows)


def test_only_links_leave_the_blocks(spark, monkeypatch):
    """Near copies that mostly miss the bound: links that come out stay below sets times blocks."""
    monkeypatch.setattr(jj, "BLOCK_SETS", 20)
    made = []
    monkeypatch.setattr(jj, "judge", lambda *a, f=jj.judge: made.append(jj.store(f(*a))) or made[-1])
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        w = [f"w{j}" for j in range(180)]
        for at in rng.choice(180, 2, replace=False):
            w[int(at)] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert len(made) == 1 and 0 < made[0].count() <= 90 * 5


def test_tree_passes_over_names_that_are_not_wanted():
    tree = jj.PrefixTree(np.empty(0, np.uint64))
    sets = [np.arange(k, k + 50, dtype=np.uint64) for k in (0, 0, 1, 2, 30)]
    for i, s in enumerate(sets):
        tree.add(s, i)
    assert sorted(tree.probe(sets[0], 80)) == [0, 1, 2, 3]
    assert sorted(tree.probe(sets[0], 80, lambda name: name not in (1, 2))) == [0, 3]


def test_copies_go_before_n_grams_are_made(spark, monkeypatch):
    seen = []
    for name in ("profile", "meetings", "_sets"):
        monkeypatch.setattr(jj, name, lambda slim, *a, f=getattr(jj, name): seen.append((slim.count(), slim.select("key").distinct().count())) or f(slim, *a))
    near = [" ".join(f"w{j}" for j in range(40 + i)) for i in range(3)]
    rows = [(i if i % 7 else None, near[i % 3]) for i in range(300)] + [(5, near[1]), (5, near[2]), (400, None), (401, "")]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert len(seen) >= 3 and set(seen) == {(4, 4)}


def test_number_of_spanning_links_is_named_so(spark):
    near = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(i, f"{near} v{i}") for i in range(12)] + [(20, "alone")], "doc_id long, text string")
    out = jj.jaccard_components(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_spanning_links"]
    assert {r["doc_id"] for r in out.filter("n_spanning_links = 0").collect()} == {20}


def test_tree_shares_beginnings_and_finds_all():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(60, int(rng.integers(3, 40)), replace=False)).astype(np.uint64) for _ in range(200)]
    tree = jj.PrefixTree(np.empty(0, np.uint64))
    for i, s in enumerate(sets):
        tree.add(s, i)
    for probe in sets[:50]:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 60 * len(np.union1d(s, probe))}
        assert set(tree.probe(probe, 60)) == want


def test_bitmaps_never_reject_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, len(a) // 10).astype(np.uint64)]))
        if not len(b):
            continue
        x, y = (np.frombuffer(jj.bitmap(s), "<u8")[None] for s in (a, b))
        while x.shape[1] > y.shape[1]:
            x = jj.fold(x)
        while y.shape[1] > x.shape[1]:
            y = jj.fold(y)
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert jj.may_link(len(a), len(b), int(np.bitwise_count(x ^ y).sum()), 80)


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}, 5001: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    """A round is three shuffles: the driver's memory grows with what it plans and schedules."""
    from wattlens.llm import components as module

    plans = []
    monkeypatch.setattr(module, "store", lambda df, f=module.store: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or f(df))
    links = spark.range(4, 400).selectExpr("id AS a", "id - 1 - id % 3 AS b")
    assert {r["root"] for r in components(links).collect()} == {2}
    assert plans and max(p.count("Scan parquet") for p in plans) <= 2


def exact(rows, k, every=20):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s, other = (v * v[i]).sum(axis=1), ids != ids[i]
        out[int(ids[i])] = [(int(x), float(y)) for x, y in sorted(zip(ids[other], s[other]), key=lambda z: (-z[1], z[0]))[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


def test_recall_and_scores(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = found(neighbours.search(spark.read.parquet(f"{SF}/embeddings.parquet"))), exact(rows, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    by = dict(rows)
    assert all(abs(np.dot(np.array(by[q], float), np.array(by[i], float)) - s) < 1e-12 for q in got for i, s in got[q])


def test_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(i, [1.0, 0.0, 0.0, -0.0]) for i in range(100, 260)]
    bad = [(1001, None), (1002, []), (1003, [0.0] * 4), (1004, [1.0, None, 0.0, 0.0]), (1005, [float("nan")] * 4), (1006, [float("inf"), 0.0, 0.0, 0.0]), (1020, [1.0, 2.0]), (None, [1.0] * 4)]
    d = spark.createDataFrame(rows + rows[:5] + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "'a' AS h", "2 AS score", "3 AS part", "4 AS rank")
    got, want = found(neighbours.search(d, k=20)), exact(rows, 20)
    assert got.keys() == want.keys()
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want if q >= 100)  # copies of the common vector, smallest ids first
    small = rows[:7]
    assert {q: [i for i, _ in x] for q, x in found(neighbours.search(spark.createDataFrame(small, "vec_id long, embedding array<double>"))).items()} == \
        {q: [i for i, _ in x] for q, x in exact(small, 20).items()}
    assert neighbours.search(d.limit(0)).count() == 0 and neighbours.search(d.filter(F.col("vec_id") > 1000)).count() in (0, 1)


@pytest.mark.parametrize("probes", [1, 10, 40])
def test_perturbations_come_in_order(probes):
    inside = np.array([0.1, 0.7, 0.4])
    cost = lambda s: sum((inside[j] if d < 0 else 1 - inside[j]) ** 2 for j, d in s)
    sets = neighbours.perturbations(inside, probes)
    costs = [cost(s) for s in sets]
    assert costs == sorted(costs) and len({tuple(sorted(s)) for s in sets}) == len(sets) == min(probes, 27)


# --- hashes of words

def test_words_are_hashed_without_a_step_a_word():
    """Words as ``bytes.lower().split()`` gives them: equal ones have equal hashes, others different ones."""
    rng, letters, known = np.random.default_rng(11), list("aB \t\n\x0b\x0c\r\x1c\x85\xa0é한Z"), {}
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 40)))) for _ in range(800)]
    texts += ["", " ", "q" * 64, "q" * 65 + " " + "Q" * 65, "q" * 400, " ".join(map(str, range(30_000)))]
    for t in texts:
        data = t.encode()
        words, hashes = data.lower().split(), jj.word_hashes(data).tolist()
        assert len(words) == len(hashes) and all(known.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(known.values())) == len(known)


def test_n_grams_keep_the_order_of_words():
    """Every order of the same few words is an n-gram of its own."""
    for words in (("a", "b", "c", "d", "e"), ("a", "a", "b", "b", "b"), ("1", "2", "3", "4", "4")):
        orders = set(permutations(words))
        assert len({int(jj.shingles(" ".join(o), 5)[0]) for o in orders}) == len(orders)
    rows = set(product("abcd", repeat=5))
    assert len(jj.shingles(" ".join(w for r in rows for w in r), 5)) == len({w for t in [[w for r in rows for w in r]] for w in zip(*(t[i:] for i in range(5)))})
