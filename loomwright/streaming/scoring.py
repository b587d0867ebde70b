"""Scoring streams: transforms whose apply looks at no other row run unchanged on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.errors import EngineError
from loomwright.operators import get


def score_stream(stream: DataFrame, steps: list[dict], states: list[dict]) -> DataFrame:
    """The stream after the steps (op, params) with states fitted on a batch frame."""
    for s, state in zip(steps, states, strict=True):
        op = get(s["op"])
        if not op.streamable:
            raise EngineError(f"{s['op']} looks at other rows and can't run on a stream")
        stream = op.apply(stream, s.get("params"), state)
    return stream


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and value, with a watermark that bounds the state."""
    out = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return out.groupBy(F.window(time, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
