import math
import random
import zlib

import pytest

from millrace.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard string, node int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "", "", 0) for i, t in texts], SCHEMA)


def check(rows, texts, shards):
    by_id = dict(texts)
    assert len(rows) == len(texts)
    slots, sizes = {}, [0] * shards
    for r in rows:
        data = (by_id[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


@pytest.mark.parametrize("shards", [16, 5, 1])
def test_near_equal_bytes_and_groups_together(spark, shards):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("ab c\u00e9\n", k=rng.choice([3, 50, 400])))) for i in range(3000)]
    texts += [(5000 + i, texts[i][1]) for i in range(200)] + [(9000, None), (9001, "")]
    rows = sharding.shard(frame(spark, texts), shards).collect()
    sizes = check(rows, texts, shards)
    assert max(sizes) <= 1.05 * sum(sizes) / shards and min(sizes) >= 0.95 * sum(sizes) / shards
    homes = {}
    for r in rows:
        homes.setdefault(dict(texts)[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_one_text_holds_most_rows(spark):
    texts = [(i, "the same text in a third of all rows " * 5) for i in range(1000)] + [(2000 + i, f"text {i} " * 20) for i in range(2000)]
    sizes = check(sharding.shard(frame(spark, texts), 16).collect(), texts, 16)
    assert max(sizes) <= 1.05 * sum(sizes) / 16


def test_few_rows_repeated_rows_and_none(spark):
    assert sharding.shard(frame(spark, []), 16).collect() == []
    rows = sharding.shard(frame(spark, [(1, "x"), (1, "x"), (None, None)]), 16).collect()
    assert len(rows) == 3 and all(0 <= r.shard < 16 for r in rows)
    assert sharding.shard(frame(spark, [(7, "only")]), 16).count() == 1


def test_rows_equal_in_everything_are_divided(spark):
    texts = [(7, "one row, many times " * 5)] * 1600
    sizes = check(sharding.shard(frame(spark, texts), 16).collect(), texts, 16)
    assert max(sizes) <= 1.05 * sum(sizes) / 16 and min(sizes) >= 0.95 * sum(sizes) / 16
    # Half of the rows have no id.
    texts = [(None, "no id at all " * 8)] * 800 + [(i, f"number {i:04d} " * 8) for i in range(800)]
    rows = sharding.shard(frame(spark, texts), 16).collect()
    sizes = [0] * 16
    for r in rows:
        sizes[r.shard] += r["size"]
    assert len(rows) == 1600 and max(sizes) <= 1.05 * sum(sizes) / 16 and min(sizes) >= 0.95 * sum(sizes) / 16


def measures(text):
    size, chars = len((text or "").encode()) + 1, len(text or "")
    return {"length": math.log2(size), "script": size / (chars + 1), "line": math.log2((chars + 1) / ((text or "").count("\n") + 1))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_split_by_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = {1: "ab c", 2: "ab\u00e9\u65e5", 3: "abc\n"}[seed]
    texts = [(i, "".join(rng.choices(letters, k=int(rng.lognormvariate(4, 1.2)) + 1))) for i in range(1500)]
    rows = sharding.shard(frame(spark, texts), 2).collect()
    own = {i: measures(t) for i, t in texts}
    # the shards are apart along one dimension, to the grain of its scale
    left, right = ([r for r in rows if r.shard == k] for k in (0, 1))
    apart = []
    for d in ("length", "script", "line"):
        grain = (max(m[d] for m in own.values()) - min(m[d] for m in own.values())) / ((1 << sharding.DIMENSION_BITS) - 1)
        apart.append(grain > 0 and max(own[r.doc_id][d] for r in left) - min(own[r.doc_id][d] for r in right) <= grain)
    assert any(apart)
    # no other place of the cut along that dimension is nearer to half, to the tolerance
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["size"] for r in left) - total / 2) <= max(0.002 * total / 2, max(r["size"] for r in rows))


def test_a_text_larger_than_a_shard(spark):
    texts = [(0, "long text " * 300_000)] + [(i, f"text {i} " * 30) for i in range(1, 400)]
    rows = sharding.shard(frame(spark, texts), 4).collect()
    check(rows, texts, 4)
    assert len({r.shard for r in rows}) >= 2
