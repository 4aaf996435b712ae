import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cases import SF, documents, needs_tables
from laneflow.llm import queries, sharding


def brute(key, weights):
    own = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)

    def cost(shard):
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(struct.pack("<Q", own), 42))
        return -math.log(((h >> 12) + 0.5) / 2.0**52) / weights[shard], shard

    return min(map(cost, weights))[1]


def test_every_key_goes_to_its_cheapest_shard(spark):
    weights = {0: 1.0, 3: 2.0, 7: 0.5, 8: 1.0}
    df = spark.range(500).select(F.col("id").alias("k")).union(spark.sql("select cast(null as bigint)"))
    for row in sharding.assign_shards(df, "k", weights).collect():
        assert row["shard"] == brute(row["k"], weights)


def test_only_the_new_shard_gains(spark):
    df = spark.range(4000).select(F.col("id").alias("k"))
    both = sharding.assign_shards(sharding.assign_shards(df, "k", dict.fromkeys(range(10), 1.0)), "k", dict.fromkeys(range(11), 1.0), "then")
    moved = both.where("shard <> `then`").collect()
    assert {r["then"] for r in moved} == {10} and 200 < len(moved) < 560


def test_weights_set_the_shares(spark):
    counts = Counter(r["shard"] for r in sharding.assign_shards(spark.range(6000).withColumnRenamed("id", "k"), "k", {0: 1.0, 1: 2.0, 2: 3.0}).collect())
    assert abs(counts[2] / 6000 - 0.5) < 0.03 and abs(counts[0] / 6000 - 1 / 6) < 0.03


def test_bad_weights():
    for weights in ({}, {0: 0.0}, {0: 1.0, 1: -1.0}):
        with pytest.raises(ValueError):
            sharding.rendezvous(F.lit(1), weights)


@pytest.mark.parametrize("block_rows", [100_000, 3])
def test_slots_have_no_gaps(spark, block_rows):
    df = documents(spark, clashes=True).unionByName(documents(spark, [(1, "same")] * 25, clashes=True))
    placed = sharding.number_slots(sharding.assign_shards(df, "doc_id", {0: 1.0, 1: 1.0}), "shard", "doc_id", block_rows=block_rows).collect()
    assert len(placed) == df.count()
    for shard in (0, 1):
        slots = sorted(r["slot"] for r in placed if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_runs_longer_than_a_step(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 4)
    placed = sharding.number_slots(spark.createDataFrame([(0, 5)] * 11, "shard int, k int")).collect()
    assert sorted(r["slot"] for r in placed) == list(range(11))


def test_empty(spark):
    assert sharding.number_slots(sharding.assign_shards(documents(spark, []), "doc_id", {0: 1.0})).count() == 0


@needs_tables
def test_query(spark):
    rows = queries.QUERIES["op1_rendezvous_sharding"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib

    assert len(rows) == len(docs)
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]) and r["law"] == "key"
        assert r["shard"] == brute(r["doc_id"], dict.fromkeys(range(24), 1.0)) and r["grown_shard"] in (r["shard"], 24)
