"""tillroll: retail sales reports and customer-value segmentation on Spark.

Every public function takes and returns DataFrames, so steps chain with
``DataFrame.transform`` and the whole pipeline stays one lazy Catalyst plan
until an action (or an explicit checkpoint) runs it.

Sub-packages
------------
sources    transaction readers (CSV, Parquet, the driver's star schema), sinks
functions  column-level helpers (whole-day differences, exact rounding, ...)
operators  the reports and the customer-value steps
plans      the end-to-end pipeline and the independent SQL oracles
streaming  incremental ingestion of new invoice-line files
"""

from tillroll.session import build_session, checkpoint_dir, release_tables, tune

__all__ = ["build_session", "checkpoint_dir", "release_tables", "tune"]
