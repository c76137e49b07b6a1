"""N-gram Jaccard join with prefix trees.

A document's set is its distinct word n-grams, as 64-bit hashes, in one global order: rare
n-grams first, by counts in a table of fixed size that sums over the whole corpus, then by
hash. Two sets that link share an n-gram among the first ``n - ceil(t n) + 1`` of each, so
documents meet under those n-grams only; equal texts meet once. Under a key, neighbours by
size are compared first, in linear number; components so far drop most keys. Under keys that
still hold several components, sizes and bitmaps tell which texts may link; these form groups,
and within a group the sets meet block by block. Sets to compare with are stored in
a prefix tree, which one walk compares with a set: partial overlaps are shared along
common beginnings, and subtrees are cut where the remaining lengths cannot reach the bound.
Only links leave a task, never more than its sets: no pair that does not link becomes a row.

No link is lost and none is guessed: the order affects speed only, and every link is an exact
count of common n-gram hashes. Hashes of n-grams and texts have 64 bits; two different
texts of a corpus of 10^9 share one with a probability of about 3 percent.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, store
from .components import Forest, components

SKETCH_BITS = 20  # counters of the order's table: its size does not depend on the corpus
PAIRS_UP_TO = 4  # keys of so many documents compare all pairs at once, larger ones neighbours first
BLOCK = 20_000  # about as many documents of one key meet in a task
BLOCK_SETS, BLOCK_GRAMS = 512, 2_000_000  # sets and n-grams of a group that a task stores, and as many that walk them
BROADCAST_KEYS = 1_000_000  # as many keys (8 bytes each) are sent to all tasks; more are joined by a shuffle
LETTERS = 64  # bytes of a word that are hashed by table


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number to another one without a pattern (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letter_table() -> np.ndarray:
    """A 64-bit number for each byte at each of the first LETTERS places of a word; A-Z have those of a-z."""
    table = _mixed(np.arange(1, LETTERS * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(LETTERS, 256)
    table[:, 65:91] = table[:, 97:123]
    return table.ravel()


_letters = _letter_table()


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lowered, parted by ASCII white space: the sum of the
    table's numbers of its bytes at their places. Words beyond LETTERS bytes: BLAKE2b."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw - np.uint8(9) > 4) & (raw != 32))  # bytes below 9 wrap around
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1] + 1) + 1])
    size = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, size)
    out = np.add.reduceat(_letters[np.minimum(place, LETTERS - 1) * 256 + raw[at]], first)
    for i in np.flatnonzero(size > LETTERS).tolist():
        word = data[at[first[i]]:at[first[i]] + size[i]].lower()
        out[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    return _mixed(out)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams: A-Z lowered, words parted by ASCII white
    space. Fewer words than n: one n-gram of them all. None, empty or no words: empty."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    size = min(n, len(h))
    rows = len(h) - size + 1
    places = _mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    total, part = np.full(rows, size, np.uint64), np.empty(rows, np.uint64)
    for i in range(size):
        total += np.multiply(h[i:rows + i], places[i], out=part)
    total = _mixed(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def slots_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def required(n: int | np.ndarray, percent: int):
    """Least overlap of any set that links with one of n n-grams."""
    return -(-percent * n // 100)


def overlap_needed(a, b, percent: int):
    """Least overlap at which sets of a and b n-grams link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """Ordered sets by common beginnings. A node holds a run of n-grams, its subtrees by their
    first n-gram, the names that end there and the least and greatest size below."""

    __slots__ = ("run", "below", "names", "least", "most")

    def __init__(self, run: np.ndarray):
        self.run, self.below, self.names, self.least, self.most = run, {}, [], 1 << 60, 0

    def add(self, items: np.ndarray, name) -> None:
        node, rest = self, items
        while True:
            node.least, node.most = min(node.least, len(items)), max(node.most, len(items))
            if not len(rest):
                node.names.append((name, len(items)))
                return
            child = node.below.get(int(rest[0]))
            if child is None:
                leaf = PrefixTree(rest)
                leaf.least = leaf.most = len(items)
                leaf.names.append((name, len(items)))
                node.below[int(rest[0])] = leaf
                return
            n = min(len(rest), len(child.run))
            differ = np.flatnonzero(rest[:n] != child.run[:n])
            n = int(differ[0]) if len(differ) else n
            if n < len(child.run):
                upper = PrefixTree(child.run[:n])
                upper.least, upper.most = child.least, child.most
                child.run = child.run[n:]
                upper.below[int(child.run[0])] = child
                node.below[int(rest[0])] = child = upper
            node, rest = child, rest[n:]

    def probe(self, items: np.ndarray, percent: int, wanted=None) -> list:
        """Names of the stored sets that link with ``items`` (sorted by value); with ``wanted`` only
        names it holds for, and a set with no such name is not compared."""
        found, size = [], len(items)
        stack = [(self, 0, 0)]
        while stack:
            node, depth, hits = stack.pop()
            if wanted and not node.below and not any(wanted(name) for name, _ in node.names):
                continue
            if len(node.run):
                at = np.minimum(np.searchsorted(items, node.run), size - 1)
                hits += int((items[at] == node.run).sum())
                depth += len(node.run)
            if hits + min(size - hits, node.most - depth) < overlap_needed(size, node.least, percent):
                continue
            found += [name for name, other in node.names if 100 * hits >= percent * (size + other - hits) and (not wanted or wanted(name))]
            stack += [(child, depth, hits) for child in node.below.values()]
        return found


def text_key(text_col: str) -> Column:
    """The hash that tells texts apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), text_key(text_col).alias("key"))


def bitmap(grams: np.ndarray) -> bytes:
    """A bit for each n-gram by the last bits of its hash, in 8 to 16 times as many bits as n-grams
    (64 at least; a power of two): few n-grams share a bit, so few pairs below the bound pass."""
    size = 1 << max(6, int(8 * len(grams) - 1).bit_length()) if len(grams) else 64
    bits = np.zeros(size, np.uint8)
    bits[(grams & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(rows: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at half their size."""
    half = rows.shape[1] // 2
    return rows[:, :half] | rows[:, half:]


def may_link(n_a, n_b, differ, percent: int):
    """Whether sets of these sizes can link: each bit that differs is an n-gram of one set alone."""
    return n_a + n_b - differ >= 2 * overlap_needed(n_a, n_b, percent)


def profile(slim: DataFrame, id_type: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """In one pass over the texts: (__id, key, size, bits) of each, and counts of the n-grams of
    all texts by the first bits of their hash. Those are 2^SKETCH_BITS numbers whatever
    the corpus, summed in tasks, then by slices of the table."""
    slices = 64
    wide = (1 << SKETCH_BITS) // slices

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            size, bits = [], []
            for t in b["__text"]:
                g = shingles(t, n)
                if len(g) < 4096:
                    np.add.at(total, slots_of(g), 1)
                else:
                    total += np.bincount(slots_of(g), minlength=len(total))
                size.append(len(g))
                bits.append(bitmap(g))
            yield pd.DataFrame({"part": -1, "__id": b["__id"], "key": b["key"], "size": size, "bits": bits})
        yield pd.DataFrame({"part": range(slices), "__id": None, "key": 0, "size": 0, "bits": [total[i * wide:(i + 1) * wide].tobytes() for i in range(slices)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["bits"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "bits": [np.asarray(total).tobytes()]})

    both = store(map_batches(slim, scan, f"part int, __id {id_type}, key long, size int, bits binary"))
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in both.filter("part >= 0").select("part", "bits").groupBy("part").applyInPandas(add, "part int, bits binary").collect():  # 64 slices of fixed size
        out[r["part"] * wide:(r["part"] + 1) * wide] = np.frombuffer(r["bits"], np.int64)
    return both.filter("part < 0").drop("part"), out


def in_order(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return grams[np.lexsort((grams, counts[slots_of(grams)]))]


def _runs(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Rows with equal values, out of batches sorted by ``column``."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        v = b[column].to_numpy()
        edges = np.flatnonzero(v[1:] != v[:-1]) + 1
        parts = [b.iloc[i:j] for i, j in zip([0, *edges], [*edges, len(b)])]
        for p in parts:
            if held and held[-1][column].iloc[0] != p[column].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(p)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _key_edges(b: pd.DataFrame, last: list) -> tuple[pd.DataFrame, np.ndarray]:
    """The batch joined to the open rest of the last one, and where its complete keys begin."""
    b = pd.concat([*last, b]) if last else b
    v = b["gram"].to_numpy()
    s = b["block"].to_numpy()
    return b, np.concatenate([[0], np.flatnonzero((v[1:] != v[:-1]) | (s[1:] != s[:-1])) + 1])


def meetings(slim: DataFrame, counts, n: int, percent: int) -> DataFrame:
    """(gram, block, blocks, key, size, at): under which n-grams each text is compared. A frequent
    n-gram deals its texts over several blocks."""
    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counts.value
        for b in batches:
            grams, sizes, keys, at = [], [], [], []
            for k, t in zip(b["key"].tolist(), b["__text"]):
                g = in_order(shingles(t, n), table)
                p = len(g) - int(required(len(g), percent)) + 1 if len(g) else 0
                if p:
                    grams.append(g[:p])
                    sizes.append(np.full(p, len(g), np.int32))
                    keys.append(np.full(p, k, np.int64))
                    at.append(np.arange(p, dtype=np.int32))
            if grams:
                g, k = np.concatenate(grams), np.concatenate(keys)
                blocks = 1 + table[slots_of(g)] // BLOCK
                yield pd.DataFrame({"gram": g.view(np.int64), "block": ((k.view(np.uint64) >> np.uint64(16)) % blocks.astype(np.uint64)).astype(np.int32),
                                    "blocks": blocks.astype(np.int32), "key": k,
                                    "size": np.concatenate(sizes), "at": np.concatenate(at)})

    return map_batches(slim.select("key", "__text"), prefixes, "gram long, block int, blocks int, key long, size int, at int")


def neighbours(met: DataFrame, percent: int) -> DataFrame:
    """Sorted rows of ``meetings`` to pairs (kind 0: a, b) and to the members of keys that are large
    or have several blocks (kind 1: gram, block, blocks, a, size, at)."""
    columns = ["kind", "gram", "block", "blocks", "a", "b", "size", "at"]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list = []
        for b in batches:
            if not len(b):
                continue
            b, edges = _key_edges(b, last)
            last = [b.iloc[edges[-1]:]]
            yield from whole(b.iloc[:edges[-1]])
        if last:
            yield from whole(last[0])

    def whole(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(b):
            return
        g, s, k, n, at, many = (b[c].to_numpy() for c in ("gram", "block", "key", "size", "at", "blocks"))
        o = np.lexsort((k, n, s, g))
        g, s, k, n, at, many = g[o], s[o], k[o], n[o], at[o], many[o]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (k[1:] != k[:-1])])  # copies meet once
        g, s, k, n, at, many = g[new], s[new], k[new], n[new], at[new], many[new]
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
        group = np.cumsum(first) - 1
        m = np.bincount(group)[group]
        rows = []
        for step in range(1, PAIRS_UP_TO):
            i = np.flatnonzero((group[step:] == group[:-step]) & ((m[step:] <= PAIRS_UP_TO) | (step == 1)))
            j = i + step
            need = overlap_needed(n[i].astype(np.int64), n[j].astype(np.int64), percent)
            fits = (100 * n[i].astype(np.int64) >= percent * n[j].astype(np.int64)) & (1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1 >= need)
            i, j = i[fits], j[fits]
            rows.append(pd.DataFrame({"kind": 0, "gram": 0, "block": 0, "blocks": 0, "a": np.minimum(k[i], k[j]), "b": np.maximum(k[i], k[j]), "size": 0, "at": 0}))
        rows[0] = pd.concat(rows).drop_duplicates()
        big = (m > PAIRS_UP_TO) | (many > 1)
        rows[1:] = [pd.DataFrame({"kind": 1, "gram": g[big], "block": s[big], "blocks": many[big], "a": k[big], "b": 0, "size": n[big], "at": at[big]})]
        yield pd.concat(rows).astype({"kind": "int32", "block": "int32", "blocks": "int32", "size": "int32", "at": "int32"})[columns]

    return map_batches(met, near, "kind int, gram long, block int, blocks int, a long, b long, size int, at int")


def may_meet(members: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b): the texts under each key, out of different components, that sizes, places and
    bitmaps let link, as a forest: whatever may link is connected, and a key gives fewer rows than
    it has texts. Takes sorted rows (gram, x, y, block, a, size, at, root, bits)."""
    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs((b.assign(meet=list(zip(b["gram"], b["x"], b["y"]))) for b in batches), "meet"):
            run = run.drop_duplicates("a").sort_values(["size", "a"])
            k, n, at, root, block = (run[c].to_numpy() for c in ("a", "size", "at", "root", "block"))
            n = n.astype(np.int64)
            across = run["x"].iloc[0] != run["y"].iloc[0]
            width = np.array([len(x) for x in run["bits"]])  # grows with the size, so each width is one stretch of rows
            stretch = {int(w): (int(np.argmax(width == w)), np.frombuffer(b"".join(run["bits"][width == w]), "<u8").reshape(-1, w // 8)) for w in np.unique(width)}
            folded = {w: fold(m) for w, (_, m) in stretch.items() if w > 8}
            group = np.arange(len(k))  # name of what is connected so far under this key
            for i in range(len(k)):
                end = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
                if end <= i + 1:
                    continue
                own, w = stretch[int(width[i])][1][i - stretch[int(width[i])][0]], int(width[i])
                for other, rows in ((w, stretch[w][1]), (2 * w, folded.get(2 * w))):
                    if other not in stretch:
                        continue
                    first = stretch[other][0]
                    low, high = max(i + 1, first), min(end, first + len(rows))
                    if low >= high:
                        continue
                    j = np.arange(low, high)
                    ok = (root[j] != root[i]) & (group[j] != group[i]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= overlap_needed(n[i], n[j], percent))
                    if across:
                        ok &= block[j] != block[i]
                    j = j[ok]
                    if len(j):
                        differ = np.bitwise_count(rows[j - first] ^ own).sum(axis=1).astype(np.int64)
                        j = j[may_link(n[i], n[j], differ, percent)]
                    if len(j):
                        group[np.isin(group, group[j])] = group[i]
            least = {}
            for g, key in zip(group.tolist(), k.tolist()):
                least[g] = min(key, least.get(g, key))
            b = np.array([least[g] for g in group.tolist()], np.int64)
            if (b != k).any():
                yield pd.DataFrame({"a": k[b != k], "b": b[b != k]})

    return map_batches(members, far, "a long, b long")


def judge(groups: DataFrame, sets: DataFrame, by_key: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all texts of a group as far as links do. ``groups``: (key, group,
    root), the texts that may link and their component so far.

    A group is dealt over blocks of at most about BLOCK_SETS sets and BLOCK_GRAMS n-grams. For two
    blocks a task stores one in a prefix tree, walks it with each set of the other and keeps
    what is connected; a pair that is connected already is not compared. So no pair leaves the task
    but links, fewer than its sets."""
    sized = groups.join(by_key.select("key", "size"), "key")
    many = sized.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    dealt = sized.join(many, "group").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("key", "group", "root", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).join(sets, "key")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs((b.assign(meet=list(zip(b["group"], b["x"], b["y"]))) for b in batches), "meet"):
            whole = run["x"].iloc[0] == run["y"].iloc[0]
            forest, tree, links = Forest(), PrefixTree(np.empty(0, np.uint64)), []
            stored = (run["block"] == run["x"]).to_numpy()
            for key, root, first, g in zip(run["key"].tolist(), run["root"].tolist(), stored.tolist(), run["grams"]):
                forest.union(key, root)
                if first and not whole:
                    tree.add(np.frombuffer(g, "<u8"), key)
            for key, first, g in zip(run["key"].tolist(), stored.tolist(), run["grams"]):
                if first and not whole:
                    continue
                items = np.frombuffer(g, "<u8")
                links += [(key, name) for name in tree.probe(np.sort(items), percent, lambda name: forest.root(name) != forest.root(key)) if forest.union(key, name)]
                if whole:  # each set is compared with those before it
                    tree.add(items, key)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return map_batches(rows.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y"), compare, "a long, b long")


def promising(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps let link."""
    one = bits.select(F.col("key").alias("a"), F.col("size").alias("na"), F.col("bits").alias("ba"))
    two = bits.select(F.col("key").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("bb"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for na, nb, x, y in zip(b["na"].tolist(), b["nb"].tolist(), b["ba"], b["bb"]):
                x, y = np.frombuffer(x, "<u8")[None], np.frombuffer(y, "<u8")[None]
                while x.shape[1] > y.shape[1]:
                    x = fold(x)
                while y.shape[1] > x.shape[1]:
                    y = fold(y)
                keep.append(bool(may_link(na, nb, int(np.bitwise_count(x ^ y).sum()), percent)))
            yield b.loc[keep, ["a", "b"]]

    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ba", "bb"), compare, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by walking a prefix tree of a's partners."""
    partners = pairs.join(sets.select(F.col("key").alias("b"), "grams"), "b").select("a", F.lit(1).alias("partner"), "b", "grams")
    own = sets.join(pairs.select(F.col("a").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("a"), F.lit(0).alias("partner"), F.lit(0).cast("long").alias("b"), "grams")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"a": None, "items": None, "tree": None, "n": 0}
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if state["n"]:
                out.extend((state["a"], name) for name in state["tree"].probe(state["items"], percent))
            state["tree"], state["n"] = PrefixTree(np.empty(0, np.uint64)), 0

        for batch in batches:
            for a, partner, b, g in zip(batch["a"], batch["partner"], batch["b"], batch["grams"]):
                if not partner:
                    flush()
                    state["a"], state["items"] = int(a), np.sort(np.frombuffer(g, "<u8"))
                    continue
                state["tree"].add(np.frombuffer(g, "<u8"), int(b))
                state["n"] += 1
                if state["n"] >= 256:  # a tree is walked and dropped, so memory stays bounded
                    flush()
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
            out.clear()
        flush()
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = partners.union(own).repartition("a").sortWithinPartitions("a", "partner", "b")
    return map_batches(rows, walk, "a long, b long")


def _sets(slim: DataFrame, keys: DataFrame, counts, n: int) -> DataFrame:
    """(key, grams): the ordered sets of the texts named by ``keys``, once for each."""
    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "grams": [in_order(shingles(t, n), counts.value)[::-1].tobytes() for t in b["__text"]]})

    # the tree shares beginnings, so sets are stored with the n-grams that many texts have first
    count = keys.count()
    wanted = slim.select("key", "__text").join(F.broadcast(keys) if count <= BROADCAST_KEYS else keys, "key", "left_semi")
    return map_batches(wanted, grams, "key long, grams binary")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """Every row's id, n_shingles (set size), component_id (smallest id reachable by links, its
    own included) and n_spanning_links: distinct other texts found linked with its text while the
    components were made. Pairs inside a component found so far are not compared, so this is
    no count of its links; it is at least 1 for a text that links with another text.
    With ``keys`` also text_key and root, a key of the component's texts that is its name.

    Documents link when their sets have a Jaccard similarity of at least ``percent`` in a
    hundred. Null, empty and wordless texts have no n-grams and link with nothing, not even
    each other. Repeated rows and equal texts link. Null ids: the rows count as documents,
    the smallest non-null id names the component. Empty table: no rows. Other columns are
    neither read nor returned.
    """
    spark = docs.sparkSession
    slim = _slim(docs, id_col, text_col)
    texts = store(slim.groupBy("key").agg(F.min("__id").alias("__id"), F.first("__text").alias("__text")))  # copies go before any n-gram is made
    profiled, table = profile(texts, docs.schema[id_col].dataType.simpleString(), n)
    counts = spark.sparkContext.broadcast(table)  # 8 * 2^SKETCH_BITS bytes
    by_key = profiled.withColumnRenamed("__id", "least")

    def linked(pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        return store(verify(pairs, store(_sets(texts, store(keys), counts, n)), percent))

    found = store(neighbours(meetings(texts, counts, n, percent).repartition("gram", "block").sortWithinPartitions("gram", "block"), percent))
    pairs = store(promising(found.filter("kind = 0").select("a", "b").distinct(), by_key, percent))
    members = found.filter("kind = 1").select("gram", "block", "blocks", "a", "size", "at")
    links = linked(pairs)
    roots = components(links)

    # keys that still hold several components: all pairs across them
    rooted = members.join(roots, F.col("a") == F.col("node"), "left").select("gram", "block", "blocks", "a", "size", "at", F.coalesce("root", "a").alias("root"))
    spread = rooted.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1")
    open_ = rooted.join(spread.select("gram"), "gram").join(by_key.select(F.col("key").alias("a"), "bits"), "a")
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.select("gram", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "a", "size", "at", "root", "bits")
    near = store(may_meet(open_.repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y"), percent).distinct())
    all_links = links
    if near.head(1):
        named = components(near)  # texts that may link, whether near or far along a chain, form a group
        groups = named.select(F.col("node").alias("key"), F.col("root").alias("group")).union(named.select("root", "root").distinct())
        groups = store(groups.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "group", F.coalesce("root", "key").alias("root")))
        more = store(judge(groups, store(_sets(texts, groups.select("key"), counts, n)), by_key, percent))
        all_links = links.union(more)
        roots = components(all_links)
    counts.unpersist()  # all that needed it is written

    degree = all_links.select(F.col("a").alias("key")).union(all_links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n_spanning_links"))
    named = by_key.join(roots, F.col("key") == F.col("node"), "left").join(degree, "key", "left").select(
        "key", "least", "size", F.coalesce("root", "key").alias("root"), F.coalesce("n_spanning_links", F.lit(0)).alias("n_spanning_links"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    said = named.join(least, "root").select("key", "size", "root", "component_id", "n_spanning_links")
    empty = F.col("n_shingles") == 0
    return slim.select("__id", "key").join(said.withColumn("n_shingles", F.col("size").cast("long")), "key").select(F.col("__id").alias(id_col), "n_shingles", F.when(empty, F.col("__id")).otherwise(F.col("component_id")).alias("component_id"),
                                           F.when(empty, F.lit(0)).otherwise(F.col("n_spanning_links")).cast("long").alias("n_spanning_links"),
                                           *([F.col("key").alias("text_key"), "root"] if keys else []))
