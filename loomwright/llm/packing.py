"""Order-preserving packing of documents into training sequences.

Token streams are cut into windows of at most `most` tokens. A dynamic program over the allowed cuts
minimises padding plus a penalty for where each window ends: nothing at a document's end, little at a
sentence's end, more inside a sentence. f(j) = min over i of f(i) + pad(p_j - p_i) + penalty(j); as
padding is most - (p_j - p_i), and a sequence costs a constant more, the best i of a sliding window is kept in a monotone queue, so the
program is linear. A window whose length is a power of two needs no padding; those lengths are a
fixed dozen of further transitions. No shuffle is needed: each input partition is one stream (an input
so small that a few row groups hold it is dealt out by doc_id first)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.encoder import encoder
from loomwright.llm.text import slices
from loomwright.session import ship, spread_small

MOST = 4096
SENTENCE_PENALTY = 8.0
INSIDE_PENALTY = 48.0
#: Every sequence costs so much, so that many short windows are no way round padding.
SEQUENCE_COST = 256.0
#: Inside a longer stretch without a sentence's end, a cut is allowed every so many tokens.
INSIDE_STEP = 64
#: A stream is packed in runs of whole documents of about so many tokens.
RUN = 1 << 18

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(ends: np.ndarray, sentence: np.ndarray, total: int, step: int = INSIDE_STEP) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) at which a window may end, 0 and total among them."""
    penalty = np.full(total + 1, np.inf)
    penalty[::step] = INSIDE_PENALTY
    penalty[sentence] = SENTENCE_PENALTY
    penalty[ends] = 0.0
    penalty[0] = penalty[total] = 0.0
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def best_windows(at: np.ndarray, penalty: np.ndarray, most: int = MOST) -> list[int]:
    """Cut positions of the cheapest windows; the last may be open (its padding counts as any)."""
    # Windows of a power of two: (last cut, first cut) where both are cuts, in order of the last.
    lasts, firsts = [], []
    for p in (1 << k for k in range(most.bit_length()) if 1 << k <= most):
        k = np.searchsorted(at, at - p)
        met = np.flatnonzero(at[k] == at - p)
        lasts.append(met)
        firsts.append(k[met])
    lasts, firsts = np.concatenate(lasts), np.concatenate(firsts)
    order = np.argsort(lasts, kind="stable")
    exact = firsts[order].tolist()
    begin = np.searchsorted(lasts[order], np.arange(len(at) + 1)).tolist()
    at, penalty = at.tolist(), penalty.tolist()
    cost, back = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - most:
            queue.popleft()
        i = queue[0]
        least, whence = cost[i] + at[i] + most - here, i  # what each window costs anyway is added below
        for k in exact[begin[j] : begin[j + 1]]:
            if cost[k] < least:
                least, whence = cost[k], k
        cost[j], back[j] = least + penalty[j] + SEQUENCE_COST, whence
        key = cost[j] + here
        while queue and cost[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [at[-1]], len(at) - 1
    while j:
        j = back[j]
        out.append(at[j])
    return out[::-1]


def sentence_ends(tokenizer: str) -> np.ndarray:
    """Which ids end a sentence, by the text of the token."""
    library = encoder(tokenizer).library
    out = np.zeros(library.get_vocab_size() + 1, dtype=bool)
    for token, i in library.get_vocab().items():
        body = token.removesuffix("</w>").rstrip("\"')]")
        out[i] = body.endswith((".", "!", "?"))
    return out


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, most: int = MOST) -> DataFrame:
    """One row for each piece: which tokens of which document, and their place in a sequence.

    docs needs doc_id and text. A null or empty text is its end id alone. Repeated rows are packed
    each; rows of one input partition stay in their order; a text of any length is cut across
    sequences. An empty table gives no rows."""
    ship(docs.sparkSession)
    rows = spread_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")

    def run(keys: list, stream: np.ndarray, length: np.ndarray, marks: np.ndarray, first_sequence: int) -> tuple[pa.RecordBatch, int]:
        raw = stream.astype("<u4").tobytes()
        ends = np.cumsum(length)
        at, penalty = cuts(ends, np.flatnonzero(marks[np.minimum(stream, len(marks) - 1)]) + 1, len(stream))
        windows = np.array(best_windows(at, penalty, most))
        edges = np.union1d(windows, ends)
        edges = edges[edges > 0]
        begins = np.concatenate([[0], edges[:-1]])
        doc = np.searchsorted(ends, begins, side="right")
        sequence = np.searchsorted(windows, begins, side="right") - 1
        starts = ends - length
        columns = [
            pa.array([keys[d] for d in doc.tolist()], pa.int64()),
            pa.array(begins - starts[doc]),
            pa.array(edges - begins),
            pa.array([raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), edges.tolist(), strict=True)], pa.binary()),
            pa.array(length[doc]),
            pa.array(sequence + first_sequence),
            pa.array(begins - windows[sequence]),
        ]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays(columns, names=names), len(windows) - 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        marks = sentence_ends(tokenizer)
        keys, streams, lengths, held = [], [], [], 0
        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for first, texts in slices(batch.column("text")):
                flat, bounds = encoder(tokenizer).encode(texts, end_id)
                begin = 0
                while begin < len(texts):
                    # Whole documents, until a run is full.
                    stop = min(len(texts), int(np.searchsorted(bounds, bounds[begin] + RUN - held)))
                    keys += own[first + begin : first + stop]
                    streams.append(flat[bounds[begin] : bounds[stop]])
                    lengths.append(np.diff(bounds[begin : stop + 1]))
                    held += int(bounds[stop] - bounds[begin])
                    begin = stop
                    if held >= RUN:
                        out, made = run(keys, np.concatenate(streams), np.concatenate(lengths), marks, sequence)
                        yield out
                        sequence += made
                        keys, streams, lengths, held = [], [], [], 0
        if keys:
            yield run(keys, np.concatenate(streams), np.concatenate(lengths), marks, sequence)[0]

    return rows.mapInArrow(packed, PIECES)
