"""qualis: a PySpark engine for data profiling, policy issues, row fixes and wide tables.

Every per-row computation is a native Spark Column expression; only bounded
per-column metadata (one row per column) is ever brought to the driver.
"""

__version__ = "0.1.0"
