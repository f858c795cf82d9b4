"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leasegrain.session import shared_folder, staged

#: A key with more than this share of all rows is hot; there are at most as many hot keys as its inverse.
HOT_SHARE = 0.001


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="leasegrain-")) / "leasegrain.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand freed memory back to the system, as a Python worker lives on for tasks of other stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def seeded(seed: int | str, *columns: Column) -> Column:
    """A 52-bit number from MD5: the same in Spark, DuckDB and Python, and exact as a double."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def with_prefix(df: DataFrame, part: list[str], bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one within ``part``.

    ``bucket`` must rise with ``order``. Sums per bucket are running totals over
    a table with a row per part and bucket; rows are ordered only inside one
    bucket, so no task holds a whole part, however hot. Parts must not be null.
    """
    df = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("long"))
    keys = [*part, "_bucket"]
    sums = df.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(bases, keys)
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_bucket", "_value", "_base", "_inside")
    )


def join_counted(large: DataFrame, small: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``large`` with ``small`` (unique ``key``), whose ``count`` says how many rows of ``large`` each key has.

    Keys with more than ``HOT_SHARE`` of the ``total`` rows, at most 1 / HOT_SHARE
    of them, are broadcast; the rest meet in a shuffled join in which no key is hot.
    """
    limit = max(1.0, total * HOT_SHARE)
    columns = [c for c in small.columns if c != key]
    hot = small.where(F.col(count) > limit).select(F.col(key).alias("_hot"), F.struct(*columns).alias("_found"))
    cold = small.where(F.col(count) <= limit)
    marked = large.join(F.broadcast(hot), large[key] == hot["_hot"], "left")
    is_hot = F.col("_hot").isNotNull()
    first = marked.where(is_hot).select(*large.columns, *[F.col(f"_found.{c}").alias(c) for c in columns])
    rest = marked.where(~is_hot).select(*large.columns).join(cold, key, "left")
    return first.unionByName(rest.select(*large.columns, *columns))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of ``nodes(id)`` under ``edges(a, b)``.

    Large-star and small-star rounds: every edge is replaced by one to the
    smallest neighbour, so the edge table never grows and the rounds grow with
    the logarithm of the diameter. Each round is a table in the shared folder; the
    rounds end with the first table that is stars, so none only confirms the last.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return pairs.join(least, "a")

    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.isEmpty():
        return nodes.select("id", F.col("id").alias("component"))
    while not are_stars(now):
        large = star(both(now)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = star(large.where("a <> b"))
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = staged(small.where("a <> b").distinct(), "links")
    return nodes.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def are_stars(links: DataFrame) -> bool:
    """Whether in ``links(a, b)``, distinct and with ``a > b``, every ``a`` hangs on one ``b`` that hangs on none: the smallest of its component."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("hangs")).unionByName(links.select(F.col("b").alias("id"), F.lit(0).alias("hangs")))
    tied = ends.groupBy("id").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("least"))
    return tied.where("n > 1 or n = 1 and least = 0").count() == 0


class Scratch:
    """Tables staged in the shared folder that go when their reader is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(f"{shared_folder(self.spark)}/leasegrain-tables/{label}-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        """Delete the tables; only of this object, and only once no frame that is still to run reads them."""
        for path in self.paths:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []


#: Bits of a key filter, and of one of its blocks (as Spark's bitmap functions have it).
FILTER_BITS, FILTER_BLOCK = 24, 1 << 15


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """``block, bits``: a bitmap of at most ``1 << FILTER_BITS`` bits (2 MB) of the hashes of a long column.

    A key whose bit is not set is not among ``keys``; one whose bit is set may be.
    More keys than bits only let more through.
    """
    place = F.xxhash64(F.col(column)).bitwiseAND((1 << FILTER_BITS) - 1)
    return (
        keys.where(F.col(column).isNotNull())
        .select(F.floor(place / FILTER_BLOCK).alias("block"), (place % FILTER_BLOCK).alias("_place"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("_place").alias("bits"))
    )


def may_be_in(df: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """Adds ``_hit``: whether the long ``column`` may be among the keys of a ``key_filter``; null is no key."""
    place = F.xxhash64(F.col(column)).bitwiseAND((1 << FILTER_BITS) - 1)
    inside = place % FILTER_BLOCK
    byte = F.conv(F.hex(F.call_function("substring", F.col("_bits"), F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (inside % 8).cast("int")).bitwiseAND(1) == 1
    blocks = F.broadcast(bitmap.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    joined = df.join(blocks, F.floor(place / FILTER_BLOCK) == F.col("_block"), "left")
    return joined.withColumn("_hit", F.col(column).isNotNull() & F.coalesce(bit, F.lit(False))).drop("_block", "_bits")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def slices(batches: Iterator, column: str, limit: int = 4 << 20) -> Iterator:
    """Record batches cut so that ``column`` holds about ``limit`` bytes in each; one row may be longer."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)
