"""Substring dedup: windows of `length` words that stand in an earlier document are cut.

1. Each text gives its digest and its anchors: of every window the leftmost least hash of `GRAM`
   consecutive words (a minimizer), so equal windows always have equal anchors, and a run of windows
   shares one. A copy of a whole text is settled by the digest; one text of each group goes on.
2. Anchors that two documents have are counted out; only runs round these can hold a repeat.
3. A run's words are sent to its anchor's shard. A shard builds a compressed FM-index of its runs,
   streams them through by backward search over the wavelet matrix, and at each position where the
   match is long enough asks for the smallest document among the suffixes found.
4. An anchor with over HOT runs is dealt to several shards; of each window only the shards' smallest
   documents then meet, by the windows' 128-bit hashes.
5. Flagged windows meet their documents again and their words are cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.dealing import join_counted
from loomwright.llm.fm_index import FMIndex
from loomwright.llm.text import Words, slices, window_hashes, window_ok
from loomwright.session import ship, written

LENGTH = 50
GRAM = 8
#: Runs of one anchor in one shard at most.
HOT = 2048
#: Words of an index at most, but for one anchor's runs.
INDEX_WORDS = 150_000


def minimizers(hashes: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost least value of each span consecutive ones."""
    n = len(hashes) - span + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)

    def lesser(value, at, shift):
        other, place = value[shift:], at[shift:]
        left = value[: len(other)] <= other
        return np.where(left, value[: len(other)], other), np.where(left, at[: len(other)], place)

    value, at, have = hashes, np.arange(len(hashes)), 1
    while 2 * have <= span:
        value, at = lesser(value, at, have)
        have *= 2
    if have < span:
        value, at = lesser(value, at, span - have)
    return at[:n]


def runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first window, last window) of each run of windows with one anchor."""
    grams = window_hashes(words.hashes(), GRAM)
    owner = minimizers(grams, length - GRAM + 1)
    ok = window_ok(words, length)
    at = np.flatnonzero(ok)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    turn = np.concatenate([[True], (owner[at][1:] != owner[at][:-1]) | (at[1:] != at[:-1] + 1) | (words.doc[at][1:] != words.doc[at][:-1])])
    first = at[turn]
    last = at[np.append(np.flatnonzero(turn)[1:] - 1, len(at) - 1)]
    doc = words.doc[first]
    base = words.bounds[:-1][doc]
    return doc, grams[owner[first]], first - base, last - base


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tkey", F.xxhash64("text"))


def outline(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, tkey, digest, n_words, anchors, firsts, lasts) of every row with a doc_id and length words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                words = Words(texts)
                doc, anchor, a, b = runs(words, length)
                keep = np.flatnonzero(words.count >= length)
                if not len(keep):
                    continue
                bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
                digests = [xxhash.xxh3_128_digest(b" ".join(texts[i].split())) for i in keep.tolist()]
                lists = lambda x: [x[bounds[i] : bounds[i + 1]] for i in keep.tolist()]  # noqa: B023, E731
                rows = pa.array(first + keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("tkey").take(rows), pa.array(digests, pa.binary()), pa.array(words.count[keep]), pa.array(lists(anchor.view(np.int64)), pa.list_(pa.int64())), pa.array(lists(a.astype(np.int32)), pa.list_(pa.int32())), pa.array(lists(b.astype(np.int32)), pa.list_(pa.int32()))],
                    names=["doc_id", "tkey", "digest", "n_words", "anchors", "firsts", "lasts"],
                )

    schema = "doc_id long, tkey long, digest binary, n_words long, anchors array<bigint>, firsts array<int>, lasts array<int>"
    return keyed(docs).where("doc_id IS NOT NULL").mapInArrow(run, schema)


def cut_runs(texts: DataFrame, length: int) -> DataFrame:
    """texts (doc_id, tkey, text, asked: array of (anchor, salts, first, last)): one row for each different run of words, with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, tkeys = batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist()
            out: list[tuple] = []
            size = 0
            for i, asked in enumerate(batch.column("asked").to_pylist()):
                words = batch.column("text")[i].as_py().encode().split()
                found: dict[tuple, list[int]] = {}
                for r in asked:
                    found.setdefault((r["anchor"], r["salts"], b" ".join(words[r["first"] : r["last"] + length])), []).append(r["first"])
                for (anchor, salts, piece), places in found.items():
                    out.append((anchor, salts, doc_ids[i], tkeys[i], piece, places))
                    size += len(piece)
                if size > 8 << 20:
                    yield _table(out)
                    out, size = [], 0
            if out:
                yield _table(out)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "salts", "doc_id", "tkey", "words", "places"])

    return texts.mapInArrow(run, "anchor long, salts long, doc_id long, tkey long, words binary, places array<int>")


FOUND = "doc_id long, tkey long, place int, windows int, hot boolean, at array<int>, h1 array<bigint>, h2 array<bigint>"


def search_shard(pieces: list[bytes], doc: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece: at each of its windows the smallest document that has it.

    A shard's pieces are both its index and its queries, since a window may repeat in any of them. So
    every window is found, by itself at least; what the search is for is its range, the suffixes of
    all pieces that begin with the same words, and through it the smallest document among them."""
    words = Words(pieces)
    symbols = np.unique(words.hashes(), return_inverse=True)[1].astype(np.int64) + 1
    starts = words.bounds[:-1] + np.arange(len(pieces))
    text = np.zeros(len(words) + len(pieces) + 1, dtype=np.int64)
    text[np.arange(len(words)) + words.doc] = symbols
    index = FMIndex(text, length)
    own = np.full(len(text), np.iinfo(np.int64).max)
    own[np.arange(len(words)) + words.doc] = doc[words.doc]
    smallest = np.minimum.reduceat(own[index.order], index.group_starts)
    out = [np.zeros(n - length + 1, dtype=np.int64) for n in words.count.tolist()]
    offset = np.concatenate([[0], np.cumsum(words.count - length + 1)])
    flat = np.zeros(offset[-1], dtype=np.int64)
    for live, at, size, low, _ in index.matches(starts, words.count):
        full = size >= length
        flat[offset[live[full]] + at[full]] = smallest[index.group[low[full]]]
    return [flat[offset[i] : offset[i + 1]] for i in range(len(out))]


def wide_hashes(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window, from independent hashes of its words: 128 bits together."""
    return tuple(window_hashes(words.hashes(lane), length, 11 + lane) for lane in (0, 1))


def search(pieces: DataFrame, length: int) -> DataFrame:
    """Flagged stretches (doc_id, tkey, place, windows); windows of hot anchors that are not flagged yet: their places from `place` and hashes."""
    salt = F.pmod(F.xxhash64("doc_id", "tkey"), F.col("salts"))
    rows = pieces.withColumn("salt", salt).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[tuple]) -> pa.RecordBatch:
            least = search_shard([r[5] for r in held], np.array([r[3] for r in held]), length)
            out: list[tuple] = []
            for (_, salts, _, doc_id, tkey, piece, places), low in zip(held, least, strict=True):
                flags = low < doc_id
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                    out += [(doc_id, tkey, p + a, b - a, False, None, None, None) for p in places]
                # Where this is the shard's smallest document, another shard may have a smaller one.
                if salts > 1 and not flags.all():
                    own, at = Words([piece]), np.flatnonzero(~flags)
                    h1, h2 = (h.view(np.int64)[at] for h in wide_hashes(own, length))
                    out += [(doc_id, tkey, p, 0, True, at, h1, h2) for p in places]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = zip(*out, strict=True) if out else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "tkey", "place", "windows", "hot", "at", "h1", "h2"])

        key, held, size = None, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "salts", "salt", "doc_id", "tkey", "words", "places")]
            for row in zip(*columns, strict=True):
                now = (row[0], row[2])
                if now != key and size > INDEX_WORDS:
                    yield solve(held)
                    held, size = [], 0
                key = now
                held.append(row)
                size += row[5].count(b" ") + 1
        if held:
            yield solve(held)

    return rows.select("anchor", "salts", "salt", "doc_id", "tkey", "words", "places").mapInArrow(run, FOUND)


def marks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tkey, copy, spans): what to cut from rows with that doc_id and text hash. spans: array of (place, n) words."""
    lines = written(outline(docs, length), "outline")
    low = lines.groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    known = written(join_counted(lines, low, ["digest"]), "outline-groups")
    copies = known.where("doc_id > low").select("doc_id", "tkey").distinct()
    chosen = known.where("doc_id = low").dropDuplicates(["digest"])
    each = chosen.select("doc_id", "tkey", F.explode(F.arrays_zip("anchors", "firsts", "lasts")).alias("r")).select("doc_id", "tkey", F.col("r.anchors").alias("anchor"), F.col("r.firsts").alias("first"), F.col("r.lasts").alias("last"))
    each = written(each, "anchors")
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("anchor", "n", F.ceil(F.col("n") / HOT).alias("salts"))
    asked = join_counted(each, shared, ["anchor"]).groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("anchor", "salts", "first", "last")).alias("asked"))
    pieces = cut_runs(keyed(docs).join(asked, ["doc_id", "tkey"]).dropDuplicates(["doc_id", "tkey"]), length)
    found = written(search(pieces, length), "repeats")
    flagged = found.where("NOT hot").select("doc_id", "tkey", "place", "windows")
    hot = found.where("hot").select("doc_id", "tkey", "place", F.explode(F.arrays_zip("at", "h1", "h2")).alias("h")).select("doc_id", "tkey", (F.col("place") + F.col("h.at")).alias("place"), "h.h1", "h.h2")
    hot = written(hot, "repeats-hot")  # read for the counts, the hot keys and the others
    smallest = hot.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    late = join_counted(hot, smallest, ["h1", "h2"]).where("least < doc_id").select("doc_id", "tkey", "place", F.lit(1).alias("windows"))
    spans = flagged.union(late).groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("place", (F.col("windows") + length - 1).alias("n"))).alias("spans"))
    return spans.select("doc_id", "tkey", F.lit(False).alias("copy"), "spans").unionByName(copies.select("doc_id", "tkey", F.lit(True).alias("copy"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))


def cut(text: bytes, copy: bool, spans: list | None) -> tuple[bytes, int, int]:
    """(what is left of the text, its words before, words cut). The white space after a cut word goes with it."""
    words = Words([text])
    n = len(words)
    if copy:
        return b"", n, n
    gone = np.zeros(n + 1, dtype=np.int64)
    for place, size in spans or ():
        gone[place] += 1
        gone[min(place + size, n)] -= 1
    gone = np.cumsum(gone[:n]) > 0
    if not gone.any():
        return text, n, 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~gone, [False]]).view(np.int8)))
    begins = np.append(words.starts, len(text))
    parts = [text[begins[a] if a else 0 : begins[b]] for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True)]
    return b"".join(parts), n, int(gone.sum())


def dedup(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of every row, text without repeated words, n_words and n_removed.

    A word goes if a window of `length` words that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input. A null text has no words and stays null. Rows
    with a null doc_id are neither earlier nor later than others and stay whole. Repeated rows are
    treated alike: the same doc_id is not smaller."""
    ship(docs.sparkSession)
    todo = marks(docs, length).withColumnsRenamed({"doc_id": "__id", "tkey": "__tkey", "copy": "__copy", "spans": "__spans"})
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("doc_id").cast("long").alias("__own"), F.col("text").cast("string").alias("__text"))
    rows = rows.withColumn("__hash", F.xxhash64("__text"))
    joined = rows.join(todo, (F.col("__own") == F.col("__id")) & (F.col("__hash") == F.col("__tkey")), "left").select(*keep, "__text", "__copy", "__spans")
    kinds = [joined.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(keep, kinds, strict=True)), "text string, n_words bigint, n_removed bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, copies = batch.column("__spans"), batch.column("__copy")
            for first, texts in slices(batch.column("__text")):
                done = []
                for i, text in enumerate(texts):
                    own = spans[first + i].as_py()
                    done.append(cut(text, bool(copies[first + i].as_py()), own and [(s["place"], s["n"]) for s in own]))
                null = batch.column("__text").slice(first, len(texts)).is_null().to_pylist()
                parts = [batch.column(c).slice(first, len(texts)) for c in keep]
                left = [None if none else d[0].decode() for none, d in zip(null, done, strict=True)]
                yield pa.RecordBatch.from_arrays([*parts, pa.array(left, pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=[*keep, "text", "n_words", "n_removed"])

    return joined.mapInArrow(run, schema)
