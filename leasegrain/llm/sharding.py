"""Shards that all have the mixture of the whole, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasegrain.llm.common import seeded, with_prefix

#: Rows ordered together in one bucket, about; the number of buckets follows the rows.
ROWS_PER_BUCKET = 50_000
SPAN = 1 << 52


def interleave(docs: DataFrame, shards: int, seed: int = 7, bucket_rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0) to ``docs(doc_id, source, ...)``.

    Rows are shuffled by seed within their source and get the fractional rank
    ``(rank + u) / rows of the source``, where ``u`` in [0, 1) is drawn per source
    so that small sources spread over all shards. Sorted by it, every stretch has
    each source's share to within a row or two; cuts at equal numbers of rows make
    shard sizes differ by one row at most.

    A null source is a source of its own, null ids and repeated rows are rows like
    others (equal rows may swap slots), an empty table gives no rows. Other columns
    are carried along, but for ``shard`` and ``slot``, which are replaced; names that
    start with an underscore are reserved.
    """
    docs = docs.drop("shard", "slot")
    rows = docs.count()
    buckets = max(1, -(-rows // bucket_rows))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    others = [F.col(c).asc_nulls_first() for c, kind in docs.dtypes if c != "doc_id" and not kind.startswith(("map", "variant"))]
    ties = [F.col("doc_id").asc_nulls_first(), *others]
    keyed = docs.withColumn("_source", source).withColumn("_hash", seeded(seed, F.col("doc_id"), F.col("_source")))
    ranked = with_prefix(
        keyed, ["_source"], F.floor(F.col("_hash") * F.lit(float(buckets)) / F.lit(float(SPAN))), [F.col("_hash"), *ties], F.lit(1), "_rank"
    )
    sizes = docs.groupBy("source").agg(F.count("*").alias("_rows"))
    sizes = sizes.select(
        source.alias("_source"), "_rows", (seeded(f"{seed}-start", source) / F.lit(float(SPAN))).alias("_start")
    )
    # sources are joined per bucket, so that a hot one is spread
    spread = sizes.withColumn("_spot", F.explode(F.sequence(F.lit(0), F.lit(min(buckets, 64) - 1))))
    ranked = ranked.withColumn("_spot", (F.col("_hash") % min(buckets, 64)).cast("int")).join(spread, ["_source", "_spot"])
    placed = ranked.withColumn("_at", (F.col("_rank") + F.col("_start")) / F.col("_rows")).withColumn("_all", F.lit(0))
    lined = with_prefix(
        placed, ["_all"], F.floor(F.col("_at") * buckets), [F.col("_at"), F.col("_source"), F.col("_hash"), *ties], F.lit(1), "_position"
    )
    shard = F.expr(f"int(_position * {shards} div {max(rows, 1)})")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return lined.withColumn("shard", shard).withColumn("slot", F.col("_position") - first).select(*docs.columns, "shard", "slot")
