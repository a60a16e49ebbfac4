"""Tables between the steps of an operator, in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import new_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as Parquet in the folder of ``spark.checkpoint.dir`` and read them from there.

    Cuts the lineage, survives lost executors, and later readers see the same rows in compressed columns.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, with as many underscores as it takes to differ from all ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
