"""Registered corpus queries on a given table, against plain restatements or their SQL."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from leasegrain.llm import personal, queries
from tests.llm.test_personal import plainly

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    frame = pd.read_parquet(f"{FOLDER}/documents.parquet")
    return {r.doc_id: r.text for r in frame.itertuples()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = base.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    got = [tuple(r) for r in queries.QUERIES[name](spark, FOLDER).select(*columns).collect()]
    assert rows and Counter(got) == Counter(rows)


def test_op11_equals_the_plain_patterns(spark, texts):
    got = queries.op11_anchored_personal_data(spark, FOLDER).collect()
    assert len(got) == len(texts) and sum(r.n_email for r in got)
    for r in got:
        found = plainly(texts[r.doc_id])
        line = ",".join(f"{personal.BASE[k]}:{a}:{b}" for a, k, b in found)
        counts = Counter(personal.BASE[k] for _, k, _ in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in personal.BASE)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_op1_laws_hold_on_the_whole_table(spark, texts):
    got = queries.op1_interleaved_shards(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    per = Counter(r.shard for r in got)
    assert len(per) == 16 and max(per.values()) - min(per.values()) <= 1
    for shard, n in per.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
