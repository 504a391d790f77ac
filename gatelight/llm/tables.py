"""What the operators share at their edges: reading tables, keys that may be null, private names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of an Arrow batch, where the session doesn't say.
BATCH_BYTES = 8 << 20


def modest(spark: SparkSession) -> None:
    """Bound the Arrow batches by ``BATCH_BYTES``, unless the session states a bound of its own.

    Texts are of any length, so a number of rows bounds nothing, and Spark's own 64 MB are held about four times
    over in each task. Results don't depend on it. The setting stays, as plans are made after an operator returns.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def field(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_text(df: DataFrame, text: Column, column: str = "text", size: str = "n_chars") -> DataFrame:
    """df with another text, and n_chars, where there is such a column, brought up to date."""
    new = {column: text}
    if size in df.columns:
        new[size] = F.length(text).cast(df.schema[size].dataType)
    return df.select(*[(new[c] if c in new else field(c)).alias(c) for c in df.columns])
