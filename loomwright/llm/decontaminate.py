"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over up to SPAN consecutive words of which only some are hashed, so a match
survives substituted words at the ignored places. The masks are chosen by enumeration: wherever the
bar lets words be substituted, one mask at least has only equal words somewhere in the stretch. (A
stretch of 24 words or more holds a shorter one that meets the bar, so 12 .. 23 words are all there is
to enumerate.) Hashes of every benchmark position meet those of every training position. A Bloom filter of bounded size, made of
the benchmark's hashes, is all that is broadcast: positions it turns away never leave their task, the
rest meet the benchmark in an equi-join. Each hit is verified where it lies: on its diagonal the two
texts are compared word by word, and the best-scoring stretch round the seed, with substitutions,
must hold LEAST_WORDS words of which LEAST_SHARE are equal; where it doesn't, the longest stretch of
the diagonal that does counts.

Words are runs without white space, with ASCII punctuation removed and A-Z in lower case."""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.dealing import join_counted
from loomwright.llm.text import Words, mixed, powers, slices
from loomwright.session import ship, written

SPAN = 12
#: 1: the word is hashed; 0: it is ignored.
MASKS = ("1110111", "11100001011", "110110011")
#: Masks of items of 10 and 11 words, of which two may be substituted.
SHORT_MASKS = {10: ("1111011", "11001111", "110110011", "11110101", "10101111"), 11: ("1110111", "111001011", "1011111", "111111")}
LEAST_WORDS = 12
LEAST_SHARE = 0.8
#: Words kept on either side of a hit for its verification.
CONTEXT = 96
#: Score of an equal and of a substituted word in a stretch.
EQUAL, SUBSTITUTED = 1, -3

#: Bits of the filter are a power of two, FILTER_SHARE or more for each seed, within these bounds.
FILTER_BITS = (20, 28)
FILTER_SHARE = 16
FILTER_HASHES = 3
#: Seeds that are broadcast to their hits (some 30 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000

_table = bytes(range(256)).lower()
_punctuation = string.punctuation.encode()


def plain(text: bytes) -> bytes:
    return text.translate(_table, _punctuation)


def masks_for(length: int) -> tuple[str, ...]:
    """Masks of an item of so many words. Of 5 to 9 words one may be substituted: all but each one; of fewer, none."""
    if length >= SPAN:
        return MASKS
    if length in SHORT_MASKS:
        return SHORT_MASKS[length]
    if length >= 5:
        return tuple("1" * k + "0" + "1" * (length - 1 - k) for k in range(length))
    return ("1" * length,) * bool(length)


def mask_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every position where it fits."""
    n = len(words) - len(mask) + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    weight = powers(0x9FB21C651E98DF25, len(mask) + 2)
    out = np.full(n, zlib.crc32(mask.encode()) | 1 << 40, dtype=np.uint64)
    for j, used in enumerate(mask):
        if used == "1":
            out += words[j : j + n] * weight[j + 1]
    return mixed(out)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits of each hash, one column each."""
    return np.stack([((hashes >> np.uint64(32 * k)) if k < 2 else mixed(hashes)) & np.uint64((1 << bits) - 1) for k in range(FILTER_HASHES)], axis=1).astype(np.int64)


ITEMS = "item_id long, words array<bigint>, hashes array<bigint>, places array<int>, spans array<int>"
REGIONS = "doc_id long, start int, words array<bigint>, hashes array<bigint>, places array<int>, spans array<int>"


def benchmark_items(items: DataFrame) -> DataFrame:
    """(item_id, words, hashes, places, spans): every item's words and seeds."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                words = Words([plain(t) for t in texts])
                hashes = words.hashes()
                own = [hashes[a:b] for a, b in zip(words.bounds, words.bounds[1:], strict=False)]
                seeds = [[mask_hashes(w, m) for m in masks_for(len(w))] for w in own]
                found = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in seeds]
                places = [np.concatenate([np.arange(len(y)) for y in x]) if x else [] for x in seeds]
                spans = [[len(m) for m, y in zip(masks_for(len(w)), x, strict=True) for _ in y] for w, x in zip(own, seeds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(first, len(texts)), pa.array([w.view(np.int64) for w in own], pa.list_(pa.int64())), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.int32()))], names=["item_id", "words", "hashes", "places", "spans"])

    return rows.mapInArrow(run, ITEMS)


def build_filter(seeds: DataFrame) -> bytes:
    """The Bloom filter of the seeds' hashes: 128 KB to 32 MB by their number. At its largest, of 17 million seeds, it lets one position in 200 pass; with more seeds more pass, which costs work but no result."""
    spark = seeds.sparkSession
    wanted = min(FILTER_BITS[1], max(FILTER_BITS[0], (FILTER_SHARE * seeds.count()).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << wanted, dtype=bool)
        for batch in batches:
            bits[slots(batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64), wanted).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])

    few = seeds.select("hash").coalesce(min(64, max(1, spark.sparkContext.defaultParallelism)))
    whole = np.zeros((1 << wanted) // 8, dtype=np.uint8)
    for row in few.mapInArrow(part, "bits binary").toLocalIterator():
        whole |= np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    return whole.tobytes()


def training_regions(docs: DataFrame, bits: bytes, masks: list[str]) -> DataFrame:
    """Stretches of docs round positions whose hash the filter lets pass: their words once, and all their seeds' places."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).view(bool)
        size_bits = len(have).bit_length() - 1
        for batch in batches:
            keys = batch.column("doc_id")
            for first, texts in slices(batch.column("text")):
                words = Words([plain(t) for t in texts])
                hashes = words.hashes()
                found = []
                for mask in masks:
                    n = len(hashes) - len(mask) + 1
                    if n < 1:
                        continue
                    seeds = mask_hashes(hashes, mask)
                    bit = (seeds & np.uint64(len(have) - 1)).astype(np.int64)
                    at = np.flatnonzero(have[bit] & (words.doc[:n] == words.doc[len(mask) - 1 :]))
                    at = at[have[slots(seeds[at], size_bits)].all(axis=1)] if len(at) else at
                    found.append((at, seeds[at], np.full(len(at), len(mask))))
                if not sum(len(f[0]) for f in found):
                    continue
                at, seeds, size = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(at, kind="stable")
                at, seeds, size = at[order], seeds[order], size[order]
                doc = words.doc[at]
                turn = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * CONTEXT)) + 1, [len(at)]])
                i, j = turn[:-1], turn[1:]
                low = np.maximum(at[i] - CONTEXT, words.bounds[:-1][doc[i]])
                high = np.minimum(at[j - 1] + SPAN + CONTEXT, words.bounds[1:][doc[i]])
                spread = list(zip(i.tolist(), j.tolist(), low.tolist(), high.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(first + doc[i])), pa.array(low - words.bounds[:-1][doc[i]], pa.int32()), pa.array([hashes[a:b].view(np.int64) for _, _, a, b in spread], pa.list_(pa.int64())), pa.array([seeds[x:y].view(np.int64) for x, y, _, _ in spread], pa.list_(pa.int64())), pa.array([at[x:y] - a for x, y, a, _ in spread], pa.list_(pa.int32())), pa.array([size[x:y] for x, y, _, _ in spread], pa.list_(pa.int32()))],
                    names=["doc_id", "start", "words", "hashes", "places", "spans"],
                )

    return rows.mapInArrow(run, REGIONS)


def best_stretch(equal: np.ndarray, first: int, last: int) -> tuple[int, int]:
    """(begin, end) of the best-scoring stretch of the diagonal that holds first .. last."""
    score = np.where(equal, EQUAL, SUBSTITUTED)
    before = np.concatenate([[0], np.cumsum(score[:first][::-1])])
    after = np.concatenate([[0], np.cumsum(score[last:])])
    return first - int(before.argmax()), last + int(after.argmax())


def longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """(begin, end) of the first longest stretch of which LEAST_SHARE are equal; (0, 0) if there is none."""
    # In whole numbers: an equal word counts 1, a substituted one -4.
    upto = np.concatenate([[0], np.cumsum(np.where(equal, 1, -round(LEAST_SHARE / (1 - LEAST_SHARE))))])
    # The least begin whose sum is at most that of an end: begins that are new lows are all that matter.
    lows = np.minimum.accumulate(upto)
    begin = np.searchsorted(-lows, -upto)
    size = np.arange(len(upto)) - begin
    end = int(size.argmax())
    return (int(begin[end]), end) if size[end] > 0 else (0, 0)


FOUND = "doc_id long, item_id long, doc_start int, item_start int, n_words int, n_equal int, item_words int"


def meet(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """hits joined with seeds by hash. Beyond MOST_BROADCAST seeds, the hashes of a passage that very many documents hold are still no hot key: join_counted."""
    if seeds.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return hits.join(F.broadcast(seeds), "hash")
    counts = hits.groupBy("hash").agg(F.count("*").alias("n"))
    same = seeds.groupBy("hash").agg(F.collect_list(F.struct("item_id", "item_place", "item_span")).alias("__seeds"))
    return join_counted(hits, counts.join(same, "hash"), ["hash"]).withColumn("s", F.explode("__seeds")).select("*", "s.*").drop("__seeds", "s")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified overlaps (doc_id, item_id, doc_start, item_start, n_words, n_equal, item_words).

    One row for each stretch; positions count words. Null or empty texts have none; rows with a null
    doc_id or item_id can't be named and are left out. An item of fewer than LEAST_WORDS words counts
    where it stands whole, LEAST_SHARE of its words equal. Items without words match nothing."""
    ship(docs.sparkSession)
    known = written(benchmark_items(items), "benchmark-items")
    seeds = known.select("item_id", F.explode(F.arrays_zip("hashes", "places", "spans")).alias("s")).select("item_id", F.col("s.hashes").alias("hash"), F.col("s.places").alias("item_place"), F.col("s.spans").alias("item_span"))
    lengths = known.select(F.least(F.size("words"), F.lit(SPAN)).alias("n")).distinct().collect()  # SPAN and one at most
    masks = sorted({m for r in lengths for m in masks_for(r["n"])})
    regions = written(training_regions(docs.where("doc_id IS NOT NULL"), build_filter(seeds), masks), "regions").withColumn("region", F.xxhash64("doc_id", "start", "words"))
    hits = regions.select("doc_id", "region", F.explode(F.arrays_zip("hashes", "places", "spans")).alias("s")).select("doc_id", "region", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place"), F.col("s.spans").alias("span"))
    met = meet(hits, seeds).where("span = item_span").withColumn("diagonal", F.col("place") - F.col("item_place"))
    # One row for each diagonal of a region and an item; its seeds' places go along.
    pairs = met.groupBy("doc_id", "region", "item_id", "diagonal", "span").agg(F.collect_set("place").alias("places"))
    texts = regions.select("doc_id", "region", "start", "words").dropDuplicates(["doc_id", "region"])
    pairs = pairs.join(texts, ["doc_id", "region"]).join(known.select("item_id", F.col("words").alias("item")), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words, item, d = np.array(r["words"]), np.array(r["item"]), r["diagonal"]
                low, high = max(0, d), min(len(words), len(item) + d)
                equal = words[low:high] == item[low - d : high - d]
                done, least, kept = -1, min(LEAST_WORDS, len(item)), len(out)
                for place in sorted(r["places"]):
                    if place < done:
                        continue  # inside the stretch before
                    i, j = best_stretch(equal, place - low, place - low + r["span"])
                    done = low + j
                    same = int(equal[i:j].sum())
                    if same >= LEAST_SHARE * (j - i) and j - i >= least:
                        out.append((r["doc_id"], r["item_id"], r["start"] + low + i, low + i - d, j - i, same, len(item)))
                if len(out) == kept:
                    i, j = longest_stretch(equal)
                    if j - i >= least:
                        out.append((r["doc_id"], r["item_id"], r["start"] + low + i, low + i - d, j - i, int(equal[i:j].sum()), len(item)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(zip(*out, strict=True))], names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal", "item_words"])

    return pairs.select("doc_id", "item_id", "start", "words", "item", "diagonal", "span", "places").mapInArrow(verify, FOUND).distinct()


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_overlaps, n_words, n_equal) for every overlapping document and item: the longest overlap's words."""
    best = F.max(F.struct("n_equal", "n_words")).alias("best")
    return overlaps(docs, items).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_overlaps"), best).select("doc_id", "item_id", "n_overlaps", F.col("best.n_words").cast("long").alias("n_words"), F.col("best.n_equal").cast("long").alias("n_equal"))
