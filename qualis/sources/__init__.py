"""Sources and sinks."""

from .readers import TABLES, detect_format, fold_nan, read_any, read_csv, read_entities, read_table, sample_rows  # noqa: F401
from .fixtures import dirty_view, view_sql  # noqa: F401
