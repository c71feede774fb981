"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantpulse.session import work_path

# Fixed value: the ASCII white space that separates words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and tells the
    planner the true size, so that it broadcasts only what is small."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of rows that Spark hands to a Python worker at once; its own default is 64 MB, on either side of the pipe.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """What runs inside gets Arrow batches of BATCH_BYTES and at most one row more, unless the session sets a size itself.

    It decides memory, never results; a DataFrame that runs after it has the session's batches.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    free = spark.conf.get(key, None) is None
    if free:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if free:
            spark.conf.unset(key)


def empty_if_null(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text (runs of anything but ASCII white space), none for an empty one."""
    body = F.btrim(text, F.lit(SPACE))
    none = F.array().cast("array<string>")
    return F.when(F.length(body) == 0, none).otherwise(F.split(body, SPACE_PATTERN))


# Bits of the filter of `maybe_in`: at most 4 MB when broadcast, whatever the number of keys. A full filter only saves nothing.
KEY_BITS = 25


def maybe_in(df: DataFrame, hashed: str, keys: DataFrame, name: str = "__maybe") -> DataFrame:
    """Adds `name`: false only where the 64-bit hash in a column is none of the hashes in the same column of `keys`.

    A bitmap of fixed size meets the rows by a broadcast join on its block, so rows that have no partner are found without moving.
    """
    bit = F.pmod(F.col(hashed), F.lit(1 << KEY_BITS))
    bits = keys.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("__block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("__bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    out = df.withColumns({"__block": F.bitmap_bucket_number(bit), "__place": place}).join(F.broadcast(bits), "__block", "left")
    hit = F.coalesce(F.expr("shiftright(__byte, cast(__place % 8 as int))").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return out.withColumn("__byte", byte).withColumn(name, hit).drop("__block", "__bits", "__place", "__byte")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
