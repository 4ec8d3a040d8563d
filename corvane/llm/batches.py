"""How much text goes to a Python worker at once, and stages that leave a table's columns as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch. Spark's default of 10,000 long texts takes hundreds of MB of each task, in Python and in the JVM's buffers.
ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Lowers the session's batch size to ``rows``; a smaller one stays."""
    now = int(spark.conf.get(_KEY))
    if now <= 0 or now > rows:
        spark.conf.set(_KEY, str(rows))


def beside(df: DataFrame, added: Iterable[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What stage makes of df, with df's columns alone. Columns named like those that it adds are put aside meanwhile, so they come out with their own values."""
    clash = {c for c in df.columns if c.lower() in {a.lower() for a in added}}
    out = stage(df.withColumnsRenamed({c: f"__own_{c}" for c in clash}))
    return out.select(*[F.col(f"`__own_{c}`").alias(c) if c in clash else F.col(f"`{c}`") for c in df.columns])
