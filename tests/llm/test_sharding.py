"""Sharding: sizes, places, near equal bytes, and what edits of a map move."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.errors import AnalysisException

from paraspark.llm import sharding


def sharded(docs, tmp_path, **options):
    return sharding.shard_documents(docs, f"{tmp_path}/map", **options).collect()


def check_places(rows, shards):
    places = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards
        places[r["shard"]].append(r["place"])
    for found in places.values():
        assert sorted(found) == list(range(len(found)))


def test_test_documents(spark, corpus, tmp_path):
    df, texts = corpus
    rows = sharded(df, tmp_path)
    assert sorted(r["doc"] for r in rows) == sorted(texts)
    check_places(rows, 40)
    for r in rows:
        data = (texts[r["doc"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    placed, weights = sharding.map_of(sharding.read_map(spark, f"{tmp_path}/map", 1))
    assert sorted(placed) == list(range(sharding.SLOTS))
    assert {r["slot"]: r["shard"] for r in rows}.items() <= placed.items()
    loads = defaultdict(int)
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert sum(loads.values()) == sum(weights.values())
    # Nothing but a document of more than a shard's share makes a shard heavier than the mean by more than it.
    mean, longest = sum(loads.values()) / 40, max(weights.values())
    assert max(loads.values()) <= mean + longest


def test_bytes_are_near_equal(spark, documents, tmp_path):
    chance = random.Random(5)
    rows = sharded(documents([(i, "x" * int(chance.paretovariate(1.2) * 50)) for i in range(3000)]), tmp_path, shards=7)
    loads = defaultdict(int)
    for r in rows:
        loads[r["shard"]] += r["size"]
    mean = sum(loads.values()) / 7
    assert max(abs(x - mean) for x in loads.values()) <= 0.01 * mean


def test_odd_rows(spark, documents, tmp_path):
    rows = [(1, None), (2, ""), (None, "same"), (None, "same"), (3, "long " * 50000), (4, "grüße 😀"), (4, "grüße 😀"), (4, "other")]
    docs = documents(rows)
    for c in ("doc", "slot", "shard", "place", "row", "part", "start", "nth", "text_crc32"):
        docs = docs.selectExpr("*", f"'x' AS `{c}`")
    got = sharded(docs, tmp_path, shards=3, slots=50)
    check_places(got, 3)
    expected = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]
    assert sorted(((r["doc"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(expected, key=repr)
    again = sharding.shard_documents(docs, f"{tmp_path}/again", shards=3, slots=50).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_empty_table(spark, documents, tmp_path):
    assert sharded(documents([]), tmp_path) == []
    placed, weights = sharding.map_of(sharding.read_map(spark, f"{tmp_path}/map", 1))
    assert len(placed) == sharding.SLOTS and not weights


def test_a_hash_of_many_rows_is_numbered_over_several_ranges(spark, documents, tmp_path):
    got = sharded(documents([(7, "same")] * 4000 + [(i, str(i)) for i in range(500)]), tmp_path, shards=3)
    check_places(got, 3)
    assert len(got) == 4500


def test_a_new_shard_takes_slots_only_into_itself():
    chance = random.Random(3)
    weights = {s: chance.randrange(1, 5000) for s in range(4000)}
    placed = sharding.first_map(weights, 40, 4096)
    grown = sharding.add_shard(placed, weights, 40)
    moved = {s for s in placed if placed[s] != grown[s]}
    assert moved and all(grown[s] == 40 for s in moved)
    loads = sharding.shard_loads(grown, weights, 41)
    mean = sum(loads) / 41
    assert max(abs(x - mean) for x in loads) <= 0.02 * mean


def test_rebalancing_moves_few_slots():
    chance = random.Random(4)
    weights = {s: chance.randrange(1, 5000) for s in range(4000)}
    placed = sharding.first_map(weights, 20, 4096)
    later = {s: w * (3 if placed[s] < 2 else 1) for s, w in weights.items()}  # two shards have grown
    edited = sharding.rebalance(placed, later, 20)
    loads = sharding.shard_loads(edited, later, 20)
    mean = sum(loads) / 20
    assert max(abs(x - mean) for x in loads) <= 0.011 * mean
    moved = [s for s in placed if placed[s] != edited[s]]
    assert moved and all(placed[s] < 2 for s in moved)
    assert sharding.rebalance(edited, later, 20) == edited


def test_versions_are_kept(spark, tmp_path):
    weights = {0: 5, 1: 7, 2: 3}
    first = sharding.first_map(weights, 2, 4)
    sharding.store_map(spark, str(tmp_path), 1, first, weights)
    grown = sharding.add_shard(first, weights, 2)
    sharding.store_map(spark, str(tmp_path), 2, grown, weights)
    assert sharding.map_of(sharding.read_map(spark, str(tmp_path), 1)) == (first, weights)
    assert sharding.map_of(sharding.read_map(spark, str(tmp_path), 2)) == (grown, weights)
    with pytest.raises(AnalysisException):
        sharding.store_map(spark, str(tmp_path), 2, first, weights)
