import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from cavern.llm import sharding


def check(rows, got, n_shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, texts = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < n_shards and r.law == "bytes" and r.grown_shard is None
        texts[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in texts.values())


def test_differencing_beats_or_meets_greedy():
    r = random.Random(3)
    for _ in range(30):
        sizes = np.array([r.randint(1, 1000) for _ in range(r.randint(1, 60))])
        part = sharding.karmarkar_karp(sizes, 4)
        sums = np.bincount(part, weights=sizes, minlength=4)
        greedy = [0] * 4
        for s in sorted(sizes.tolist(), reverse=True):
            greedy[greedy.index(min(greedy))] += s
        assert sums.sum() == sizes.sum() and sums.max() <= max(greedy) * 1.02 + 1
    assert len(set(itertools.chain(sharding.karmarkar_karp(np.array([5] * 8), 4).tolist()))) == 4


def test_levels_slots_and_groups(spark):
    r = random.Random(5)
    rows = [(i, "x" * r.randint(0, 300) + str(r.randint(0, 400))) for i in range(1500)]
    rows += [(9000 + i, "hot copy") for i in range(700)] + [(None, None), (None, ""), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, 16, bucket_items=600).collect()
    check(rows, got, 16)
    size = Counter()
    for x in got:
        size[x.shard] += x.size
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 16


def test_group_heavier_than_a_shard_and_empty(spark):
    rows = [(i, "hot " * 50) for i in range(200)] + [(1000 + i, "d" * (20 + i % 7) + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, 4, bucket_items=64).collect()
    check(rows, got, 4)
    sizes = Counter()
    for x in got:
        sizes[x.shard] += x.size
    light = sorted(sizes.values())[:3]
    assert len({x.shard for x in got if x.size > 150}) == 1 and light[-1] - light[0] < 0.02 * light[0]
    assert sharding.shard(df.limit(0)).count() == 0
