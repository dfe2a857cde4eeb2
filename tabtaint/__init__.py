"""tabtaint — data-error injection, profiling, synthetic tables and their evaluation on Spark.

Every operator takes and returns Spark DataFrames; driver state stays small (column
statistics, histograms, thresholds).  Randomness is a pure function of
``(seed, tag, row_key)`` so results do not depend on partitioning.
"""

from tabtaint.session import get_spark, checkpoint_dir
from tabtaint.spec import TableSpec, with_row_key

__all__ = ["get_spark", "checkpoint_dir", "TableSpec", "with_row_key"]
