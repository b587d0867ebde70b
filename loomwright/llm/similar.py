"""Near duplicates by word shingles, at a similarity of their sets.

Candidates come from the SimHash trie of op9 (simhash.links): each text's 64-bit fingerprint of all its
shingles, self-joined within the Hamming budget. Texts of similarity 0.8 differ in some ten of these
bits, which no trie can prune, so the trie also has help for what lies beyond its budget: SAMPLES
hash functions each pick about one shingle in `m`, m by the text's length so that a handful is picked,
and the SimHash of a pick is the text's key there. Texts of similarity 0.8 share all of a pick of five
with probability 0.8 ** 5, so some of 32 keys agree all but surely (1 - 0.67 ** 32). A text too short
for picks has its whole set as a key, and the set less each one shingle. Keys meet in an equi-join,
where long SimHashes of all shingles, at a bar some four standard errors too wide, only tell which
texts may belong together. Texts chained by links of the trie and of the keys then meet with their
whole shingle sets, and a link is what their Jaccard index says.

Each group gives the links of a spanning forest, found breadth first, never all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.components import connected
from loomwright.llm.dealing import dealt, join_counted
from loomwright.llm.simhash import BUDGET, fold, links, majority
from loomwright.llm.text import MIX, Words, mixed, powers, slices, window_hashes
from loomwright.session import bounded_broadcast, ship, written

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES = 32
#: Picks hold from so many shingles to twice as many.
PICK = 4
LONG_BITS = 1024
#: Distinct texts of one key in one task are at most about twice as many.
GROUP = 20_000
#: The same for texts that meet with their shingle sets.
SETS_GROUP = 4_000
#: The loose links' bar on long SimHashes is that of a similarity so much lower.
SLACK = 0.14
MOST_BROADCAST = 300_000


def distance(similarity: float, bits: int = LONG_BITS) -> int:
    """Bits in which SimHashes of sets of that Jaccard similarity differ on average."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of each text; one of all words where it has fewer than n."""
    words = Words([fold(t) for t in texts])
    own = words.hashes()
    tail = np.concatenate([own, np.zeros(n, dtype=np.uint64)])
    grams = window_hashes(tail, n)[: len(own)] if len(own) else own
    begin, count = words.bounds[:-1], words.count
    some = np.where(count >= n, count - n + 1, 0)
    at = np.repeat(begin, some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
    doc = np.repeat(np.arange(len(texts)), some)
    hashes = grams[at]
    short = [(i, mixed(np.add.reduce(own[a : a + c] * powers(0x2545F4914F6CDD1D, n + 1)[1 : c + 1], keepdims=True) + np.uint64(c))[0]) for i, (a, c) in enumerate(zip(begin.tolist(), count.tolist(), strict=True)) if 0 < c < n]
    if short:
        doc = np.concatenate([doc, [i for i, _ in short]])
        hashes = np.concatenate([hashes, np.array([h for _, h in short], dtype=np.uint64)])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


_project: dict[int, np.ndarray] = {}


def long_prints(hashes: np.ndarray, bounds: np.ndarray, bits: int = LONG_BITS) -> np.ndarray:
    """SimHashes of many bits, a row of bytes each: signs of random projections of the counts of the hashes' byte values."""
    if bits not in _project:
        _project[bits] = np.random.default_rng(bits).choice(np.array([-1, 1], dtype=np.float32), (8 * 256, bits))
    texts, total = len(bounds) - 1, np.diff(bounds)
    owner = np.repeat(np.arange(texts), total)
    seen = np.empty((texts, 8 * 256), dtype=np.float32)
    for k in range(8):
        byte = (hashes >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)
        seen[:, 256 * k : 256 * (k + 1)] = np.bincount(owner * 256 + byte, minlength=texts * 256).reshape(texts, 256)
    seen -= (total / 256).astype(np.float32)[:, None]
    return np.packbits(seen @ _project[bits] > 0, axis=1)


def levels(n: int, ratio: float) -> list[int]:
    """log2 of m for a text of n shingles: texts whose sizes are within the ratio have one in common."""
    level = lambda x: max(0, math.floor(math.log2(max(1.0, x / PICK))))
    return sorted({level(n), level(n * ratio)})


def keys(hashes: np.ndarray, bounds: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Each text's keys."""
    texts, total = len(bounds) - 1, np.diff(bounds)
    owner = np.repeat(np.arange(texts), total)
    wanted = [levels(n, similarity) if n else [] for n in total.tolist()]
    out: list[list[np.ndarray]] = [[] for _ in range(texts)]
    high = np.array([w[-1] if w else 0 for w in wanted])
    low = np.array([w[0] if w else 0 for w in wanted])
    for level_of in (high, low) if (high != low).any() else (high,):
        use = np.ones(texts, dtype=bool) if level_of is high else high != low
        use &= total > 0
        for f in range(SAMPLES):
            mine = mixed(hashes * np.uint64(2 * f + 0x9E3779B97F4A7C15))
            shift = (64 - level_of[owner]).astype(np.uint64)
            picked = np.where(level_of[owner] == 0, f == 0, mine >> np.minimum(shift, np.uint64(63)) == 0) & use[owner]
            at = np.flatnonzero(picked)
            some = np.bincount(owner[at], minlength=texts)
            print_ = majority(mine[at], np.concatenate([[0], np.cumsum(some)]))
            key = mixed(print_ ^ mixed((level_of * 64 + f + 1).astype(np.uint64)) + some.astype(np.uint64))
            for i in np.flatnonzero(some).tolist():
                out[i].append(key[i])
    # Without picks, near sets of so few shingles differ in one that the larger set has.
    salted = mixed(hashes ^ MIX)
    for i in np.flatnonzero((total > 0) & (low == 0)).tolist():
        own = salted[bounds[i] : bounds[i + 1]]
        whole = np.add.reduce(own, keepdims=True)
        out[i] += mixed(whole).tolist()
        if len(own) - 1 >= similarity * len(own):
            out[i] += mixed(whole - own).tolist()
    return [np.array(k, dtype=np.uint64).view(np.int64) for k in out]


def keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return rows.withColumn("tkey", F.xxhash64("text"))


def outlines(docs: DataFrame, n: int, similarity: float) -> DataFrame:
    """(doc_id, tkey, size, fp, print, keys) of every row with a doc_id and words; tkey is the text's hash, fp the 64-bit SimHash."""
    ship(docs.sparkSession)
    rows = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text"), 1 << 20):
                hashes, bounds = shingles(texts, n)
                prints, size, fp = long_prints(hashes, bounds), np.diff(bounds), majority(hashes, bounds).view(np.int64)
                own = keys(hashes, bounds, similarity)
                some = np.flatnonzero(size)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first + some)) for c in ("doc_id", "tkey")), pa.array(size[some]), pa.array(fp[some]), pa.array([prints[i].tobytes() for i in some], pa.binary()), pa.array([own[i] for i in some], pa.list_(pa.int64()))], names=["doc_id", "tkey", "size", "fp", "print", "keys"])

    return rows.mapInArrow(run, "doc_id long, tkey long, size long, fp long, print binary, keys array<bigint>")


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """(id, print, shingles) of rows (id, print, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text"), 1 << 20):
                hashes, bounds = shingles(texts, n)
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(texts)) for c in ("id", "print")), sets], names=["id", "print", "shingles"])

    return rows.select("id", "print", "text").mapInArrow(run, "id long, print binary, shingles array<bigint>")


class Sets:
    """Some texts' shingle sets: sorted 64-bit hashes, one after another."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.bounds = np.concatenate([[0], np.cumsum(size)])

    def jaccard(self, one: int, others: np.ndarray, step: int = 512) -> np.ndarray:
        """The index of one set with each of the others."""
        own = self.flat[self.bounds[one] : self.bounds[one + 1]]
        same = np.zeros(len(others), dtype=np.int64)
        for k in range(0, len(others), step):
            part = others[k : k + step]
            theirs = np.concatenate([self.flat[self.bounds[i] : self.bounds[i + 1]] for i in part.tolist()])
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            same[k : k + step] = np.add.reduceat(hit.astype(np.int64), np.cumsum(self.size[part]) - self.size[part])
        return same / (self.size[others] + len(own) - same)


def close_forest(prints: np.ndarray, most: int, sets: Sets | None = None, similarity: float = 0.0) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of rows that differ in at most `most` bits and whose sets, if given, are that similar, breadth first."""
    a, b = [], []
    open_ = np.arange(len(prints))
    while len(open_):
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            at = queue.pop()
            near = np.bitwise_count(prints[open_] ^ prints[at]).sum(axis=1, dtype=np.int64) <= most
            if sets is not None and near.any():
                near[near] = sets.jaccard(at, open_[near]) >= similarity - 1e-12
            found = open_[near].tolist()
            a += [at] * len(found)
            b += found
            queue += found
            open_ = open_[~near]
    return a, b


def links_of_groups(rows: DataFrame, key: str, most: int, similarity: float | None = None) -> DataFrame:
    """(a, b) ids of linked rows (key, one, two, id, print, and shingles if a similarity is given) of a group (key, one, two)."""
    columns = [key, "one", "two", "id", "print", *(["shingles"] if similarity is not None else [])]
    rows = rows.select(*columns).repartition(key, "one", "two").sortWithinPartitions(key, "one", "two", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            ids = np.concatenate([h.column("id").to_numpy() for h in held])
            prints = np.frombuffer(b"".join(x for h in held for x in h.column("print").to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
            sets = None
            if similarity is not None:
                lists = [h.column("shingles") for h in held]
                sets = Sets(np.concatenate([x.flatten().to_numpy() for x in lists]).view(np.uint64), np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]).astype(np.int64))
            a, b = close_forest(prints, most, sets, similarity or 0.0)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"]) if a else None

        at, held = None, []
        for batch in batches:
            own, one, two = (batch.column(c).to_numpy() for c in (key, "one", "two"))
            turn = np.flatnonzero((own[1:] != own[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            for i, j in zip([0, *turn.tolist()], [*turn.tolist(), len(own)], strict=True):
                if i == j:
                    continue
                now = (own[i], one[i], two[i])
                if held and now != at:
                    if (out := solve(held)) is not None:
                        yield out
                    held = []
                at = now
                held.append(batch.slice(i, j - i))
        if held and (out := solve(held)) is not None:
            yield out

    return rows.mapInArrow(run, "a long, b long").distinct()


def loose_links(nodes: DataFrame, most: int) -> DataFrame:
    """(a, b) ids of nodes (id, print, keys) that share a key and differ in at most `most` bits."""
    each = nodes.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    return links_of_groups(dealt(each, ["key"], GROUP).join(nodes.select("id", "print"), "id"), "key", most)


def trie_links(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b) ids of nodes (id, fp) that the trie links: each node to the smallest of its fingerprint, these to each other within the budget."""
    own = nodes.select("id", "fp")
    firsts = written(own.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "similar-fingerprints")
    same = join_counted(own, firsts.where("n > 1"), ["fp"]).where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return same.union(links(firsts.select(F.col("first").alias("id"), "fp"), budget).select("a", "b"))


def similar_links(docs: DataFrame, nodes: DataFrame, n: int, similarity: float) -> DataFrame:
    """(a, b) ids of nodes (id, tkey, fp, print, keys) whose shingle sets are that similar: chains of them reach all that such pairs join."""
    most = distance(similarity - SLACK)
    chained = written(connected(trie_links(nodes).union(loose_links(nodes, most))).select(F.col("node").alias("id"), "component"), "similar-loose")
    asked = nodes.join(chained, "id").select(F.col("id").alias("doc_id"), "tkey", "id", "print")
    sets = written(shingle_sets(keyed(docs).join(asked, ["doc_id", "tkey"]).dropDuplicates(["id"]), n), "similar-sets")
    return links_of_groups(dealt(chained, ["component"], SETS_GROUP).join(sets, "id"), "component", most, similarity)


def similar_documents(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every doc_id: texts chained by links share a component, named by its smallest doc_id.

    Shingles are of n folded words; a shorter text is one shingle. Rows without words, or without a
    doc_id, take no part. A link is a Jaccard index of the whole shingle sets of `similarity` or more."""
    found = written(outlines(docs, n, similarity), "similar")
    groups = written(found.groupBy("size", "print").agg(F.min("doc_id").alias("id")), "similar-distinct")
    nodes = found.join(groups, (F.col("doc_id") == F.col("id")) & (found["size"] == groups["size"]) & (found["print"] == groups["print"]), "left_semi").dropDuplicates(["doc_id"])
    nodes = nodes.select(F.col("doc_id").alias("id"), "tkey", "fp", "print", "keys")
    labels = connected(similar_links(docs, nodes, n, similarity))
    owner = groups.join(labels, F.col("id") == F.col("node"), "left").select("size", "print", F.coalesce("component", "id").alias("component_id"))
    return found.join(owner, ["size", "print"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def drop_similar(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that a smaller doc_id of their component stands for."""
    gone = similar_documents(docs, n, similarity).where("component_id < doc_id").select(F.col("doc_id").alias("__gone"))
    gone = bounded_broadcast(written(gone, "similar-gone"), MOST_BROADCAST)
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
