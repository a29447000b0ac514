"""What the training-data operators share: the shared folder, tables written to it, Arrow helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import scratch, shared_dir, ship, table  # noqa: F401

#: The ASCII white space that parts words, as a regex class and as its characters.
WS_CLASS = "[\\x20\\x09-\\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later steps need no more of its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(spark: SparkSession, sf_dir: str, null: str = "") -> DataFrame:
    """doc_id and text of documents; a null text counts as `null`."""
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit(null)).alias("text"))


def passing(rows: DataFrame, column: str, keys: DataFrame, bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """rows whose `column` may be among the values of keys' one column, and the rows where it surely isn't.

    A bitmap of 2**bits hashed values is broadcast: 8 MB by default, however many keys there are. More keys than bits let
    more rows pass, so an exact join has to follow; it then shuffles only the rows that passed. Null passes.
    """
    h = lambda c: F.xxhash64(c).bitwiseAND((1 << bits) - 1)
    size = 15  # bitmap_construct_agg makes bitmaps of 2**15 bits
    at = lambda c: (F.shiftright(h(c), size), h(c).bitwiseAND((1 << size) - 1))
    (name,) = keys.columns
    b, p = at(name)
    maps = keys.select(b.alias("_b"), p.alias("_p")).distinct().groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_m"))
    b, p = at(column)
    byte = F.substring(F.col("_m"), F.shiftright(p, 3).cast("int") + 1, F.lit(1))
    mask = F.call_function("shiftleft", F.lit(1), p.bitwiseAND(7).cast("int"))
    hit = F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(mask) != 0, F.lit(False)) | F.col(column).isNull()
    marked = rows.withColumn("_b", b).join(F.broadcast(maps), "_b", "left").withColumn("_hit", hit).drop("_b", "_m")
    return marked.where("_hit").drop("_hit"), marked.where("not _hit").drop("_hit")


def lean() -> None:
    """In a Python worker: Arrow's batches go back to the system when they are done, not to a pool that keeps them."""
    pa.set_memory_pool(pa.system_memory_pool())


def raw(column: pa.Array) -> list[bytes]:
    """A string column as bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file, in `folder` or where the installed files are."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent(dict):
    """A bounded memo of two generations: `missing(key)` makes what neither of them holds."""

    __slots__ = ("cap", "missing", "old")

    def __init__(self, missing, cap: int):
        super().__init__()
        self.cap, self.missing, self.old = cap, missing, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.missing(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
