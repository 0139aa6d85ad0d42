"""The versioned slot-to-shard map."""

import random
from collections import Counter

import pytest

from sightline.llm import sharding


def loads(slot_map, slot_bytes, n):
    out = [0] * n
    for slot, shard in enumerate(slot_map):
        out[shard] += slot_bytes.get(slot, 0)
    return out


@pytest.fixture
def slot_bytes():
    r = random.Random(4)
    return {s: r.randint(1, 500) for s in range(1024)}


def test_growth_moves_slots_into_new_shards_alone(slot_bytes):
    now = sharding.rebalanced(sharding.first_map(4, 1024), slot_bytes, 4)
    grown = sharding.resized(now, slot_bytes, 6)
    moved = [(a, b) for a, b in zip(now, grown) if a != b]
    assert {b for _, b in moved} == {4, 5}
    assert max(loads(grown, slot_bytes, 6)) - min(loads(grown, slot_bytes, 6)) <= 2 * max(slot_bytes.values())


def test_shards_that_go_give_their_slots_away(slot_bytes):
    now = sharding.first_map(5, 1024)
    fewer = sharding.resized(now, slot_bytes, 4)
    assert all(a == b for a, b in zip(now, fewer) if a < 4)
    assert set(fewer) == {0, 1, 2, 3}


def test_versions_are_read_edited_and_appended(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    shards = {r.doc_id: r.shard for r in sharding.shard_by_slots(docs, 4, n_slots=256, map_path=path).collect()}
    first = sharding.read_map(spark, path, 1)[1]
    version, now = sharding.read_map(spark, path)
    assert {r.doc_id: r.shard for r in sharding.shard_by_slots(docs, 4, n_slots=256, map_path=path).collect()} == shards
    assert sharding.read_map(spark, path) == (version, now)  # nothing to edit
    grown = {r.doc_id: r.shard for r in sharding.shard_by_slots(docs, 5, n_slots=256, map_path=path).collect()}
    assert sharding.read_map(spark, path)[0] == version + 1
    assert sharding.read_map(spark, path, 1)[1] == first and sharding.read_map(spark, path, version)[1] == now
    assert {b for i, b in grown.items() if b != shards[i]} == {4}
    assert 0 < sum(grown[i] != shards[i] for i in grown) < 0.3 * len(grown)


def test_very_many_equal_rows_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    docs = spark.range(500).selectExpr("if(id < 400, 1, id) as doc_id", "'same' as text")
    got = sharding.shard_by_slots(docs, 4, n_slots=64).collect()
    assert Counter(r.doc_id for r in got) == Counter({1: 400} | {i: 1 for i in range(400, 500)})
    assert len({r.vslot for r in got if r.doc_id == 1}) > 50
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
