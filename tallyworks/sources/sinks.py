"""Writers: snapshots of facts and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A complete snapshot in fixed columns with a header, nulls as empty cells."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json_by(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in a folder per key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a Parquet table, NUL characters out of its strings."""
    clean = {c: F.replace(c, F.lit("\u0000"), F.lit("")) for c, t in df.dtypes if t == "string"}
    df.withColumns(clean).write.mode("overwrite").parquet(path)


def append_new_documents(stored: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """Append the documents whose key is not stored yet, each once."""
    new.dropDuplicates([key]).join(stored.select(key), key, "left_anti").write.mode("append").parquet(path)
