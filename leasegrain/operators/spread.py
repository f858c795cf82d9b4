"""Joins on a key that a large part of all rows may share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shares(counts: DataFrame, keys: Sequence[str]) -> Column:
    """Into how many parts the rows of a key are dealt; 1 for ordinary keys.

    ``counts`` has ``keys`` and ``rows``. A key is dealt out when it has more
    rows than an even split over ``spark.sql.shuffle.partitions`` tasks gives
    one task, into as many parts as it has such portions. There are fewer such
    keys than tasks, so the map that carries them is small at any size, and
    all parts together are at most twice as many as tasks.
    """
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    portions = F.ceil(F.col("rows") * tasks / counts.agg(F.sum("rows")).scalar()).cast("int")
    hot = (
        counts.select(F.xxhash64(*keys).alias("_key"), portions.alias("_parts"))
        .where(F.col("_parts") > 1)
        .groupBy("_key")
        .agg(F.max("_parts").alias("_parts"))
        .agg(F.map_from_entries(F.collect_list(F.struct("_key", "_parts"))))
    )
    return F.coalesce(F.element_at(hot.scalar(), F.xxhash64(*keys)), F.lit(1))


def spread_join(
    large: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``large`` with ``small`` without gathering a frequent key.

    The rows of a frequent key are dealt out by the columns ``by``, in
    proportion to how many there are, and only that key's rows of ``small`` are
    copied to each part; see ``shares``. A join on the bare key would gather the
    key's rows in one task, and a later step grouped by it would keep them
    there. Spark may still broadcast ``small``. ``counts`` (``keys`` and
    ``rows``) tells roughly how the rows of ``large`` spread, for callers that
    know it without computing ``large``; else ``large`` is counted.
    """
    keys = list(keys)
    if counts is None:
        counts = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    parts = shares(counts, keys)
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*by), parts).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
