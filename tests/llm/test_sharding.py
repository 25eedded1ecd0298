import zlib
from collections import Counter

from clearlane.llm import sharding
from tests.llm.cases import ODD, documents, prose


def checked(rows, texts_by_id):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def test_groups_stay_together_and_shards_are_even(spark):
    texts = [" ".join(prose(i % 700, 5 + i % 90)) for i in range(1500)] + ODD
    rows = checked(sharding.assign_shards(documents(spark, texts)).collect(), texts)
    assert len(rows) == len(texts)
    shard_of = {}
    load = Counter()
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        shard_of.setdefault(data, set()).add(r.shard)
        load[r.shard] += r["size"]
    assert all(len(s) == 1 for s in shard_of.values())
    assert max(load.values()) - min(load.values()) <= max(len(t) * 3 for t in texts if t)


def test_large_groups_as_plain_longest_first(spark):
    texts = [f"t{i} " * (10 + 7 * i) for i in range(40)] + ["t3 " * 31] * 5
    rows = sharding.assign_shards(documents(spark, texts), items=100_000).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    groups = Counter()
    for t in texts:
        groups[t] += len(t) + 1
    plain = Counter()
    placed = sharding.longest_first(enumerate(groups.values()), 16)
    for i, size in enumerate(groups.values()):
        plain[placed[i]] += size
    assert sorted(load.values()) == sorted(plain.values())


def test_longest_first_takes_the_least_loaded():
    assert sharding.longest_first([(0, 5), (1, 4), (2, 3), (3, 3)], 2) == {0: 0, 1: 1, 2: 1, 3: 0}


def test_repeats_nulls_and_empty(spark):
    df = documents(spark, ["a", "a", None, "", "a"], [1, 1, None, None, 1])
    rows = checked(sharding.assign_shards(df).collect(), None)
    assert len(rows) == 5 and len({r.shard for r in rows if r["size"] == 1}) == 1
    assert sharding.assign_shards(df.limit(0)).collect() == []
    first = sorted(map(str, sharding.assign_shards(df).collect()))
    assert first == sorted(map(str, sharding.assign_shards(df.repartition(5)).collect()))
