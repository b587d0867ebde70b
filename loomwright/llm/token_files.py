"""Token ids in binary files: Simple-8b words, with escapes and per-block offsets.

A file (one row of the written table, so that Spark's committer and any store it reads serve) holds
consecutive documents in ascending doc_id order:

    magic "LS8B", version u32, documents u32, blocks u32, ids u64
    document lengths            u32 each
    block offsets               u32 each: the first 64-bit word of a block of BLOCK ids
    words                       u64 each: a 4-bit selector above 60 bits of payload

A selector gives how many ids share a word, each in 60 // count bits. Selector 15 is an escape: the
whole next word is one id of up to 64 bits, for values that 60 bits can't hold."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.encoder import encoder
from loomwright.llm.text import slices
from loomwright.session import ship, written

#: Ids of one word for selectors 0 to 13, and their widths.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = 15
BLOCK = 4096
#: A file is closed once it has so many ids.
FILE_IDS = 1 << 20

HEAD = struct.Struct("<4sIIIQ")
FILES = "part int, start long, docs array<bigint>, ids long, body binary"


def _widest(width: np.ndarray, shift: int, n: int) -> np.ndarray:
    """At each position the larger of width here and shift further on (past the end: here)."""
    out = width.copy()
    np.maximum(width[: n - shift], width[shift:], out=out[: n - shift])
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids; all blocks advance together."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    need = np.ones(n, dtype=np.uint8)
    for bit in range(1, int(ids.max()).bit_length()):
        need += ids >= np.uint64(1 << bit)
    # The selector at each position: the most ids that all fit from here to the block's end.
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n))
    chosen = np.full(n, ESCAPE, dtype=np.uint8)
    doubled = {1: need}
    while 2 * (span := max(doubled)) <= min(COUNTS[0], n):
        doubled[2 * span] = _widest(doubled[span], span, n)
    for selector in range(len(COUNTS) - 1, -1, -1):
        count = int(COUNTS[selector])
        if count > n:
            break
        span = 1 << count.bit_length() - 1
        widest = _widest(doubled[span], count - span, n) if count > span else doubled[span]
        chosen[(widest <= WIDTHS[selector]) & (left >= count)] = selector
    steps = np.append(COUNTS, [1, 1])[chosen]
    at = np.arange(blocks) * BLOCK
    ends = np.minimum(at + BLOCK, n)
    heads, owner = [], []
    live = np.arange(blocks)
    while len(live):
        heads.append(at[live])
        owner.append(live)
        at[live] += steps[at[live]]
        live = live[at[live] < ends[live]]
    first = np.sort(np.concatenate(heads))
    selector = chosen[first].astype(np.int64)
    wide = selector == ESCAPE
    slot = np.cumsum(1 + wide) - (1 + wide)
    words = np.zeros(len(first) + int(wide.sum()), dtype=np.uint64)
    words[slot] = selector.astype(np.uint64) << np.uint64(60)
    words[slot[wide] + 1] = ids[first[wide]]
    for s, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), strict=True)):
        mine = np.flatnonzero(selector == s)
        for k in range(count):
            words[slot[mine]] |= ids[first[mine] + k] << np.uint64(k * width)
    starts = slot[np.searchsorted(first, np.arange(blocks) * BLOCK)]
    return words, starts.astype(np.uint32)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of words, by selector for all words at once. Any block's words decode alone."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():
        # The word after an escape is data: walk runs of escapes, which never overlap.
        data = np.zeros(len(words), dtype=bool)
        for i in np.flatnonzero(selector == ESCAPE).tolist():
            if not data[i]:
                data[i + 1] = True
        heads = np.flatnonzero(~data)
    else:
        heads = np.arange(len(words))
    selector = selector[heads]
    count = np.where(selector == ESCAPE, 1, COUNTS[np.minimum(selector, len(COUNTS) - 1)])
    first = np.cumsum(count) - count
    out = np.zeros(n, dtype=np.uint64)
    for s, (many, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), strict=True)):
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << width) - 1)
        for k in range(many):
            out[first[mine] + k] = (words[heads[mine]] >> np.uint64(k * width)) & mask
    wide = np.flatnonzero(selector == ESCAPE)
    out[first[wide]] = words[heads[wide] + 1]
    return out


def write_file(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts = pack(ids)
    return b"".join([HEAD.pack(b"LS8B", 1, len(lengths), len(starts), len(ids)), lengths.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def read_file(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of documents, their ids one after another)."""
    magic, version, docs, blocks, n = HEAD.unpack_from(body)
    if magic != b"LS8B" or version != 1:
        raise ValueError("not a token file")
    lengths = np.frombuffer(body, "<u4", docs, HEAD.size)
    words = np.frombuffer(body, "<u8", offset=HEAD.size + 4 * (docs + blocks))
    return lengths, unpack(words, n)


def read_block(body: bytes, block: int) -> np.ndarray:
    """The ids of one block only."""
    _, _, docs, blocks, n = HEAD.unpack_from(body)
    starts = np.frombuffer(body, "<u4", blocks, HEAD.size + 4 * docs)
    words = np.frombuffer(body, "<u8", offset=HEAD.size + 4 * (docs + blocks))
    last = starts[block + 1] if block + 1 < blocks else len(words)
    return unpack(words[starts[block] : last], min(BLOCK, n - block * BLOCK))


def encode_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Files of the documents, in ascending doc_id order within and across parts.

    docs needs doc_id and text; other columns are ignored. A null text is empty (one end id); null
    ids come first; repeated rows are kept, in the order of their texts' hash."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        own, streams, lengths, held = [], [], [], 0

        def file() -> pa.RecordBatch:
            body = write_file(np.concatenate(lengths), np.concatenate(streams))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([own], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([body], pa.binary())], names=["part", "start", "docs", "ids", "body"])

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, texts in slices(batch.column("text")):
                flat, bounds = encoder(tokenizer).encode(texts, end_id)
                begin = 0
                while begin < len(texts):
                    # Whole documents, until a file is full.
                    stop = min(len(texts), int(np.searchsorted(bounds, bounds[begin] + FILE_IDS - held)))
                    own += keys[first + begin : first + stop]
                    streams.append(flat[bounds[begin] : bounds[stop]])
                    lengths.append(np.diff(bounds[begin : stop + 1]))
                    held += int(bounds[stop] - bounds[begin])
                    begin = stop
                    if held >= FILE_IDS:
                        yield file()
                        start += held
                        own, streams, lengths, held = [], [], [], 0
        if own:
            yield file()

    return rows.mapInArrow(encode, FILES)


def read_documents(files: DataFrame) -> DataFrame:
    """Rows (doc_id, start, ids) of encoded files; ids as little-endian unsigned 32-bit integers.

    Only the files' sizes meet on the driver: one number for each part."""
    ship(files.sparkSession)
    totals = files.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()
    before, total = [], 0
    for row in totals:
        before.append((row["part"], total))
        total += row["ids"]
    offsets = files.sparkSession.createDataFrame(before or [(0, 0)], "part int, part_start long")
    placed = files.join(F.broadcast(offsets), "part").select("docs", "body", (F.col("part_start") + F.col("start")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, ids = read_file(batch.column("body")[i].as_py())
                lengths = lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("docs")[i].as_py(), pa.int64()), pa.array(batch.column("start")[i].as_py() + ends - lengths, pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "ids"])

    return placed.mapInArrow(decode, "doc_id long, start long, ids binary")


def token_files(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write the documents' files to the shared folder and read them back."""
    return read_documents(written(encode_files(docs, tokenizer, end_id), "token-files"))
