"""SimHash fingerprints and near duplicates by a self-join of binary tries.

Fingerprints within a Hamming budget of each other agree on one of budget + 1 blocks of their bits.
Each block in turn is moved to the front; fingerprints with the same leading block are the leaves of
one subtree. Node pairs of all subtrees of a task are traversed together: a pair of nodes keeps the
number of bits in which their paths differ, and is dropped once that exceeds the budget. Subtrees give
the links of a spanning forest, never all pairs, so a group of n costs at most n - 1 rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.components import connected
from loomwright.llm.dealing import dealt
from loomwright.llm.text import Words, slices
from loomwright.session import ship, spread_small, written

SEED = 42
SHINGLE = 3
BUDGET = 2
BITS = 64
#: Fingerprints of one subtree that are walked in one task are at most about twice as many.
GROUP = 50_000
#: Subtrees are walked together until they have so many fingerprints.
WALK = 100_000


def fold(text: bytes) -> bytes:
    """A-Z in lower case, words joined by one space."""
    return b" ".join(text.lower().split())


def shingle_hashes(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle, first shingle of each text and the number of all). texts are folded."""
    words = Words(texts)
    count = words.count
    some = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(some)])
    owner = np.repeat(np.arange(len(texts)), some)
    first = words.bounds[:-1][owner] + np.arange(bounds[-1]) - bounds[:-1][owner]
    last = np.minimum(first + n, words.bounds[1:][owner]) - 1
    digest, buffer = xxhash.xxh64_intdigest, words.buffer
    spans = zip(words.starts[first].tolist(), words.ends[last].tolist(), strict=True) if len(first) else ()
    return np.fromiter((digest(buffer[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(first)), bounds


#: bits of a byte, most significant first
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int32)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each text's fingerprint: the bits that over half of its hashes have. No hash: zero."""
    texts = len(bounds) - 1
    total = np.diff(bounds)
    out = np.zeros(texts, dtype=np.uint64)
    owner = np.repeat(np.arange(texts), total)
    for k in range(8):
        byte = ((hashes >> np.uint64(56 - 8 * k)) & np.uint64(255)).astype(np.int64)
        seen = np.bincount(owner * 256 + byte, minlength=texts * 256).reshape(texts, 256)
        bits = (2 * (seen @ BYTE_BITS) > total[:, None]).astype(np.uint8)
        out |= np.packbits(bits, axis=1)[:, 0].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row; a null text has no words and fingerprint 0."""
    ship(docs.sparkSession)
    rows = spread_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text"), 1 << 20):
                found = majority(*shingle_hashes([fold(t) for t in texts], n))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


# -- the trie ---------------------------------------------------------------------------------


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a-b between 0 .. n - 1, those that join two trees yet."""
    root = list(range(n))
    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def trie_pairs(keys: np.ndarray, roots: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of 64-bit keys of one subtree that differ in 1 .. budget bits.

    keys[roots[i] : roots[i + 1]], sorted and distinct, are the leaves of subtree i, whose keys agree in
    their first `depth` bits. A node is a range of keys that agree so far. All node pairs of all
    subtrees are expanded together, level by level, into pairs of children; a pair is dropped once its
    paths differ in more bits than the budget, and settled at once when both nodes are single leaves. A
    level with too many pairs is walked in parts."""
    ones: dict[int, np.ndarray] = {}
    low, high = roots[:-1][np.diff(roots) > 1], roots[1:][np.diff(roots) > 1]
    stack = [(depth, low, high, low, high, np.zeros(len(low), dtype=np.int64))]
    while stack:
        depth, a, a_end, b, b_end, differ = stack.pop()
        if len(a) > 1 << 18:
            half = len(a) // 2
            stack += [(depth, *(x[:half] for x in (a, a_end, b, b_end, differ))), (depth, *(x[half:] for x in (a, a_end, b, b_end, differ)))]
            continue
        single = (a_end - a == 1) & (b_end - b == 1)
        if single.any():
            x, y = a[single], b[single]
            near = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= budget)
            if near.any():
                yield x[near], y[near]
            a, a_end, b, b_end, differ = (v[~single] for v in (a, a_end, b, b_end, differ))
        if not len(a):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum(keys >> np.uint64(63 - depth) & np.uint64(1), dtype=np.int32)])
        upto = ones[depth]
        a_cut, b_cut = a_end - (upto[a_end] - upto[a]), b_end - (upto[b_end] - upto[b])
        same = a == b
        parts = []
        for left, left_end, right, right_end, more in ((a, a_cut, b, b_cut, 0), (a_cut, a_end, b_cut, b_end, 0), (a, a_cut, b_cut, b_end, 1), (a_cut, a_end, b, b_cut, 1)):
            ok = (left < left_end) & (right < right_end) & (differ + more <= budget)
            if left is a_cut and right is b:
                ok &= ~same  # of a node with itself, one order of its children is enough
            parts.append((left[ok], left_end[ok], right[ok], right_end[ok], differ[ok] + more))
        stack.append((depth + 1, *(np.concatenate(p) for p in zip(*parts, strict=True))))


def trie_forest(keys: np.ndarray, roots: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the subtrees."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x, y in trie_pairs(keys, roots, depth, budget):
        a, b = forest(len(keys), np.concatenate([a, x]), np.concatenate([b, y]))
    return a, b


def blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of budget + 1 blocks of a fingerprint."""
    cut = [round(k * bits / (budget + 1)) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b) ids of linked fingerprints; prints has one row (id, fp) for each distinct fp.

    Groups with one fingerprint are dropped before Python sees them; one of over GROUP is dealt into
    parts, each pair of which is walked on its own. Some WALK fingerprints are in memory at a time. A
    fingerprint has at most some bits ** budget / 2 others within the budget, whatever the group's size."""
    ship(prints.sparkSession)
    moved = []
    for k, (low, width) in enumerate(blocks(BITS, budget)):
        # The block first: its bits lead, the others follow in their circle.
        turned = F.col("fp") if low + width == BITS else F.shiftleft("fp", BITS - low - width).bitwiseOR(F.shiftrightunsigned("fp", low + width))
        moved.append(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(turned, BITS - width).alias("lead"), turned.alias("turned")))
    each = prints.select("id", F.explode(F.array(*moved)).alias("g")).select("id", "g.k", "g.lead", "g.turned")
    group = ["k", "lead", "one", "two"]
    rows = dealt(each, ["k", "lead"], GROUP).repartition(*group).sortWithinPartitions(*group, F.col("turned").bitwiseXOR(F.lit(-(1 << 63))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = blocks(BITS, budget)

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, ids, k = table["turned"].to_numpy().view(np.uint64), table["id"].to_numpy(), table["k"].to_numpy()
            turn = starts(table)
            for block in np.unique(k).tolist():
                at = np.flatnonzero(k == block)
                roots = np.append(turn[(turn >= at[0]) & (turn <= at[-1])], at[-1] + 1) - at[0]
                a, b = trie_forest(keys[at], roots, cuts[block][1], budget)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at][a]), pa.array(ids[at][b])], names=["a", "b"])

        def starts(table: pa.Table) -> np.ndarray:
            new = np.zeros(len(table), dtype=bool)
            new[:1] = True
            for name in group:
                value = table[name].to_numpy()
                new[1:] |= value[1:] != value[:-1]
            return np.flatnonzero(new)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= WALK:
                # All but the last group, which may go on.
                table = pa.Table.from_batches(held).combine_chunks()
                last = int(starts(table)[-1])
                if last:
                    yield from solve(table.slice(0, last).combine_chunks())
                held, size = table.slice(last).combine_chunks().to_batches(), len(table) - last
        if size:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return rows.select("k", "lead", "one", "two", "turned", "id").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id): rows whose fingerprints are chained by links share a component.

    component_id is the smallest doc_id that is reachable. Rows without words link like any other.
    A null doc_id is kept, and takes the component of its fingerprint's other rows."""
    prints = written(fingerprints(docs, n), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL"), "simhash-distinct")
    edges = links(nodes, budget)
    labels = connected(edges).select(F.col("node").alias("id"), F.col("component").alias("low"))
    owner = nodes.join(labels, "id", "left").select("fp", F.coalesce("low", "id").alias("component_id"))
    return prints.join(owner, "fp", "left").select("doc_id", "fp", "component_id")
