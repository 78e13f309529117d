"""Result sinks: each table is written by its own distributed write job.

A CSV or Parquet "file" here is a directory of part files, one per task;
nothing is funnelled through the driver or a single task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _csv_ready(df: DataFrame) -> DataFrame:
    """CSV has no array type: join string arrays with ' | '."""
    from pyspark.sql import functions as F

    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(field.name), " | ").alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    writer = (_csv_ready(df) if fmt == "csv" else df).write.mode(mode)
    if fmt == "csv":
        # doubled quotes, as spreadsheet programs and pandas write and read
        # them; blanks and line ends at the edges of a text are kept
        writer = (writer.option("header", True).option("escape", '"')
                  .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    writer.format(fmt).save(path)
    return path


def write_tables(
    tables: Mapping[str, DataFrame],
    out_dir: str | None,
    prefix: str = "",
    fmt: str = "parquet",
) -> dict[str, str]:
    """Write every table to ``{out_dir}/{prefix}{name}``. ``out_dir=None``
    skips the export (the reference's ``export_results=False``)."""
    if out_dir is None:
        return {}
    return {
        name: write_table(df, f"{out_dir.rstrip('/')}/{prefix}{name}", fmt)
        for name, df in tables.items()
    }
