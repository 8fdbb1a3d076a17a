"""Helpers that all training-data operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_dir, stored, table

__all__ = ["WS", "WS_CLASS", "column", "fresh", "held_out", "new_dir", "raw", "rows_of", "sampled", "stored"]

#: The white space of every contract: blank, tab, line feed, vertical tab, form feed, return.
#: It is what bytes.split() and bytes.strip() treat as white space.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 3 is 1; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def sampled(rows: DataFrame, n: int, key: str = "key") -> DataFrame:
    """n distinct rows, or all if fewer, by the hash of their columns: the same for any layout of
    the table. The hash is added as `key`. Only hashes are ordered, so no task gathers texts, and
    however often a row repeats, the bound holds."""
    keyed = rows.withColumn(key, F.xxhash64(*rows.columns))
    cut = keyed.select(key).distinct().orderBy(key).limit(n).agg(F.max(key).alias("top")).first()["top"]
    return keyed.where(F.col(key) <= F.lit(cut).cast("long")).dropDuplicates([key])
