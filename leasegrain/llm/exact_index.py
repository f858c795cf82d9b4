"""Exact deduplication through an index of live digests behind cuckoo filters.

A version of the index is one table in two partitions: ``content`` (bucket, digest,
text, keep_id, group_size), one row per live text, and ``filters`` (bucket, filter),
a cuckoo filter of the live digests of each bucket. An update reads the filters first; a
miss is a new text, a hit is verified against the stored text of its bucket.
Filters that overflow are rebuilt larger from the stored digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrain.llm.common import join_counted, map_arrow, slices
from leasegrain.session import shared_folder

SLOTS, KICKS = 4, 500
#: Bytes of text in a bucket, about, and texts that a map task holds before it passes them on.
BUCKET_BYTES, HELD_BYTES = 32 << 20, 48 << 20

CONTENT = "bucket int, digest binary, text string, keep_id long, group_size long"
FILTERS = "bucket int, filter binary"
#: kind 0: filter, 1: stored digest (with its text where the batch asks for it), 2: batch row to insert, 3: to delete
ROWS = f"kind int, {CONTENT}"
OUT = f"{ROWS}, filter binary"


class CuckooFilter:
    """16-bit marks in buckets of four; a mark has two homes, each computable from the other."""

    def __init__(self, capacity: int = 64):
        self.n = 1 << max(1, (max(capacity, 1) * 20 // (19 * SLOTS)).bit_length())
        self.marks, self.count = [0] * (self.n * SLOTS), 0

    def homes(self, digest: bytes) -> tuple[int, int, int]:
        mark, home = struct.unpack_from("<HQ", digest)
        mark = mark or 1
        home &= self.n - 1
        return mark, home, self.other(home, mark)

    def other(self, home: int, mark: int) -> int:
        return home ^ ((mark * 0x5BD1E995 >> 3) & (self.n - 1))

    def place(self, home: int, was: int, now: int) -> bool:
        for k in range(home * SLOTS, home * SLOTS + SLOTS):
            if self.marks[k] == was:
                self.marks[k] = now
                return True
        return False

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.homes(digest)
        return mark in self.marks[a * SLOTS : a * SLOTS + SLOTS] or mark in self.marks[b * SLOTS : b * SLOTS + SLOTS]

    def insert(self, digest: bytes) -> bool:
        """False if there is no room; the filter must then be rebuilt, as one mark may be homeless."""
        mark, a, b = self.homes(digest)
        if self.place(a, 0, mark) or self.place(b, 0, mark):
            self.count += 1
            return True
        home = a
        for k in range(KICKS):
            at = home * SLOTS + (mark + k) % SLOTS
            mark, self.marks[at] = self.marks[at], mark
            home = self.other(home, mark)
            if self.place(home, 0, mark):
                self.count += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only for digests that were inserted."""
        mark, a, b = self.homes(digest)
        found = self.place(a, mark, 0) or self.place(b, mark, 0)
        self.count -= found
        return found

    def pack(self) -> bytes:
        return struct.pack(f"<QQ{len(self.marks)}H", self.n, self.count, *self.marks)

    @classmethod
    def unpack(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.n, out.count = struct.unpack_from("<QQ", data)
        out.marks = list(struct.unpack_from(f"<{out.n * SLOTS}H", data, 16))
        return out


class Bucket:
    """Live digests of one bucket, with the filter in front."""

    def __init__(self, filter: CuckooFilter | None = None):
        self.filter, self.live, self.dirty = filter or CuckooFilter(), {}, filter is None

    def add_mark(self, digest: bytes) -> None:
        """``digest`` is already stored; a filter without room is rebuilt larger from the stored digests."""
        self.dirty = True
        if self.filter.insert(digest):
            return
        room = 2 * max(len(self.live), self.filter.count)
        while True:
            self.filter = CuckooFilter(room)
            if all([self.filter.insert(stored) for stored in self.live]):
                return
            room *= 2

    def store(self, digest: bytes, text: str | None, keep_id: int | None, size: int) -> None:
        self.live[digest] = [text, keep_id, size]

    def insert(self, digest: bytes, text: str, doc_id: int | None, size: int) -> None:
        held = self.live.get(digest) if digest in self.filter else None
        if held is None:
            self.store(digest, text, doc_id, size)
            self.add_mark(digest)
            return
        if held[0] != text:
            raise ValueError(f"two texts with digest {digest.hex()}")
        held[1] = held[1] if doc_id is None else doc_id if held[1] is None else max(held[1], doc_id)
        held[2] += size

    def delete(self, digest: bytes, text: str) -> None:
        held = self.live.get(digest) if digest in self.filter else None
        if held is not None and held[0] == text:
            del self.live[digest]
            self.filter.delete(digest)
            self.dirty = True


def _batch(rows: list[tuple], schema_names: list[str]):
    import pyarrow as pa

    kinds = {"kind": pa.int32(), "bucket": pa.int32(), "digest": pa.binary(), "text": pa.string(), "keep_id": pa.int64(), "group_size": pa.int64(), "filter": pa.binary()}
    columns = list(zip(*rows)) or [[] for _ in schema_names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(columns, schema_names)], schema_names)


def _chunks(rows: Iterator[tuple], names: list[str], text_at: int) -> Iterator:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "") + 100
        if size > 8 << 20:
            yield _batch(held, names)
            held, size = [], 0
    if held:
        yield _batch(held, names)


def _collapse(buckets: int):
    """Equal texts of a map task become one row; what it holds is bounded, later ones meet in their bucket."""

    def run(batches: Iterator) -> Iterator:
        names = ["bucket", "digest", "text", "keep_id", "group_size"]
        home = Bucket()

        def rows():
            for digest, (text, keep_id, size) in home.live.items():
                yield (int.from_bytes(digest[-4:], "big") * buckets >> 32, digest, text, keep_id, size)

        held = 0
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                data = text.encode("utf-8")
                digest = hashlib.sha256(data).digest()
                before = len(home.live)
                home.insert(digest, text, doc_id, 1)
                held += (len(home.live) - before) * (len(data) + 300)
            if held > HELD_BYTES:
                yield from _chunks(rows(), names, 2)
                home, held = Bucket(), 0
        yield from _chunks(rows(), names, 2)

    return run


def _update(batches: Iterator) -> Iterator:
    """Rows in order of bucket and kind in; live rows (kind 1) and changed filters (kind 0) of each bucket out."""
    names = ["kind", "bucket", "digest", "text", "keep_id", "group_size", "filter"]

    def finish(number, bucket, touched):
        for digest in touched:
            if digest in bucket.live:
                yield (1, number, digest, *bucket.live[digest], None)
        if bucket.dirty:
            yield (0, number, None, None, None, None, bucket.filter.pack())

    def rows():
        number, bucket, touched = None, None, {}
        for batch in slices(batches, "text"):
            for kind, home, digest, text, keep_id, size, marks in zip(*[batch.column(n).to_pylist() for n in names]):
                if home != number:
                    if bucket:
                        yield from finish(number, bucket, touched)
                    number, bucket, touched = home, Bucket(CuckooFilter.unpack(marks) if kind == 0 else None), {}
                if kind == 1:
                    bucket.store(digest, text, keep_id, size)
                elif kind == 2:
                    bucket.insert(digest, text, keep_id, size)
                    touched[digest] = None
                elif kind == 3:
                    bucket.delete(digest, text)
        if bucket:
            yield from finish(number, bucket, touched)

    yield from _chunks(rows(), names, 3)


class LiveIndex:
    """An index under ``path``; every update writes a new version, and readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, version: str | None = None):
        self.spark, self.path, self.buckets, self.version = spark, path, buckets, version

    @classmethod
    def create(cls, docs: DataFrame, path: str | None = None) -> LiveIndex:
        """An empty index with buckets for about as much text as ``docs`` hold."""
        spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        return cls(spark, path or f"{shared_folder(spark)}/leasegrain-tables/index-{uuid.uuid4().hex}", max(1, -(-size // BUCKET_BYTES)))

    def _read(self, kind: int, schema: str) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        if self.version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(OUT).parquet(f"{self.path}/{self.version}").where(f"kind = {kind}").select(*columns)

    def content(self) -> DataFrame:
        return self._read(1, CONTENT)

    def filters(self) -> DataFrame:
        return self._read(0, FILTERS)

    def update(self, docs: DataFrame, kind: int) -> LiveIndex:
        batch = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _collapse(self.buckets), CONTENT)
        batch = batch.select(F.lit(kind).alias("kind"), "*")
        parts = batch
        if self.version is not None:
            # of the stored texts only those that the batch may equal are read into the update
            asked = batch.select("digest", F.lit(True).alias("asked")).distinct()
            stored = self.content().join(asked, "digest", "left").select(
                F.lit(1).alias("kind"), "bucket", "digest", F.expr("if(asked, text, null)").alias("text"), "keep_id", "group_size"
            )
            parts = parts.unionByName(stored)
        columns = [F.col(c) for c in ("kind", "bucket", "digest", "text", "keep_id", "group_size")]
        parts = parts.select(*columns, F.lit(None).cast("binary").alias("filter"))
        if self.version is not None:
            marks = self.filters().selectExpr(
                "0 kind", "bucket", "cast(null as binary) digest", "cast(null as string) text", "cast(null as long) keep_id", "cast(null as long) group_size", "filter"
            )
            parts = parts.unionByName(marks)
        tasks = max(1, min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        ordered = parts.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind")
        now = LiveIndex(self.spark, self.path, self.buckets, uuid.uuid4().hex)
        map_arrow(ordered, _update, OUT).write.partitionBy("kind").parquet(f"{self.path}/{now.version}")
        if self.version is not None:
            untouched = self.content().join(batch.select("digest").distinct(), "digest", "left_anti")
            untouched.select("bucket", "digest", "text", "keep_id", "group_size").write.mode("append").parquet(f"{self.path}/{now.version}/kind=1")
            unchanged = self.filters().join(now.filters().select("bucket"), "bucket", "left_anti")
            unchanged.select("bucket", "filter").write.mode("append").parquet(f"{self.path}/{now.version}/kind=0")
        return now

    def insert(self, docs: DataFrame) -> LiveIndex:
        """The index with the texts of ``docs(doc_id, text)``; a text's id is the largest of its rows."""
        return self.update(docs, 2)

    def delete(self, docs: DataFrame) -> LiveIndex:
        """The index without the texts of ``docs``; texts that are not live change nothing."""
        return self.update(docs, 3)


def exact_groups(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs(doc_id, text)``.

    All rows go through a new index. Of equal texts the row with the largest id
    stays (all rows that carry that id). Null counts as empty; a group with only
    null ids has a null ``keep_id`` and keeps its rows; an empty table gives no
    rows. Other columns are ignored.
    """
    index = LiveIndex.create(docs, path).insert(docs)
    groups = index.content().select(F.hex("digest").alias("digest"), "keep_id", "group_size")
    rows = docs.select("doc_id", F.upper(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
    joined = join_counted(rows, groups, "digest", "group_size", docs.count())
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower("digest").alias("text_sha256")
    )
