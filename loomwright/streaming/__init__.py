"""Fitted steps applied to streams (an extension)."""

from loomwright.streaming.scoring import score_stream, windowed_counts  # noqa: F401
