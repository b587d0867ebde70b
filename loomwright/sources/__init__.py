"""Sources and sinks."""

from loomwright.sources.readers import READERS, load, source_columns, spec_of  # noqa: F401
from loomwright.sources.sinks import export, write_csv, write_parquet  # noqa: F401
