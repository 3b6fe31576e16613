import random
import re

import numpy as np
import xxhash

from cavern.llm import simhash
from cavern.llm.graph import components


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_wide(text, n=5):
    """The words of a wide fingerprint as one number."""
    mask = (1 << 64) - 1
    words = (text or "").lower().split()
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    out = 0
    for k in range(simhash.WIDE):
        hs = []
        for s in shingles:
            x = xxhash.xxh64_intdigest(s.encode(), 42)
            if k:
                x = (x + k * 0x9E3779B97F4A7C15) & mask
                x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
                x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
                x ^= x >> 31
            hs.append(x)
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) << 64 * k
    return out


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def odd_bits(seed, n):
    r = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        x = r.getrandbits(64) if r.random() < 0.3 else r.choice(out)
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


def test_tree_finds_all_pairs():
    fps = np.array(odd_bits(1, 400), np.uint64)
    for leaf in (1, 8, 64):
        tree = simhash.BKTree(fps, leaf)
        got = {(int(a), int(b)) for q, m in tree.search(fps, 4) for a, b in zip(q, m)}
        assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}


def test_blocks_share_a_shard():
    r = random.Random(2)
    for blocks in (5, 6, 7):
        masks = simhash.block_masks(blocks, 4)
        for _ in range(200):
            x = y = r.getrandbits(64)
            for b in r.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_components_equal_brute_force(spark):
    fps = odd_bits(7, 600)
    want = plain_components(fps, 4)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    for shard_rows, blocks in ((16_384, None), (3, None), (16_384, 6)):
        edges = simhash.links(df.select("fp").distinct(), 4, shard_rows, blocks)
        found = dict(components(edges).collect())
        least = {}
        for i, f in rows:
            least.setdefault(found.get(f, f), i)
        assert [least[found.get(f, f)] for _, f in rows] == want


def test_query_over_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(3, base), (2, base.replace("w399", "v")), (5, "Hot Copy"), (None, "hot copy"), (9, None), (8, " \n\t"), (9, None), (11, "one two three"), (12, "é À b c d")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, FP string")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{plain_fingerprint(t):016x}") for i, t in rows)
    assert {r.doc_id: r.component_id for r in got} == {3: 2, 2: 2, 5: 5, None: 5, 9: 8, 8: 8, 11: 11, 12: 12}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 300)], "u long, v long")
    got = dict(components(edges).collect())
    assert all(got[i] == 0 for i in range(1, 61)) and got[200] == got[300] == 100


def test_similar_texts_are_tied(spark):
    r = random.Random(6)
    rows, of = [], {}
    for g in range(60):
        words = [f"v{r.randrange(5000)}" for _ in range(400)]
        for c in range(3):
            own = list(words)
            for k in range(3 * c):  # each change spoils five shingles
                own[40 + 60 * k % 300] = f"new{g}x{c}x{k}"
            rows.append((3 * g + c, " ".join(own)))
            of[3 * g + c] = 3 * g
    got = simhash.similar_component_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same = sum(x.component_id == of[x.doc_id] for x in got)
    assert same >= 0.97 * len(got) and all(of[x.component_id] == of[x.doc_id] for x in got)
    for hot in (16_384, 2):
        found = simhash.similar_component_ids(spark.createDataFrame([(i, "one two three four five six") for i in range(9)] + [(9, None)], "doc_id long, text string"), shard_rows=hot).collect()
        assert {x.component_id for x in found} == {0, 9}


def test_links_are_decided_by_exact_similarity(spark):
    """Pairs just above and just below the similarity, common shingles, groups in several blocks, texts without words."""
    r = random.Random(8)
    rows, shared = [], [f"common{k}" for k in range(12)]
    for g in range(150):
        words = [f"v{r.randrange(5000)}" for _ in range(300)] + shared
        for c, changes in enumerate((0, 6, 7, 12, 13)):  # of 308 shingles each change spoils five
            own = list(words)
            for k in range(changes):
                own[10 + 20 * k] = f"new{g}x{c}x{k}"
            rows.append((5 * g + c, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A  b"), (None, rows[0][1])]
    sets = [{tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    want = {i: rows[k][0] for (i, _), k in zip(rows, root)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shard_rows, block_rows in ((16_384, 1024), (200, 2)):
        got = simhash.similar_component_ids(df, 5, 0.8, shard_rows, block_rows).collect()
        assert {x.doc_id: x.component_id for x in got} == want


def test_production_trees_grow_and_prune(monkeypatch):
    """A shard of the intended size has nodes with children, and a search leaves some of their edges out."""
    r = random.Random(3)
    shared = r.getrandbits(13)
    fps = [r.getrandbits(51) << 13 | shared for _ in range(simhash.SHARD_MEAN)]
    fps = np.array(sorted({*fps, *(f ^ 1 << 20 + k % 40 for k, f in enumerate(fps[:40]))}), np.uint64)
    tree = simhash.BKTree(fps, simhash.LEAF)
    assert tree.root["children"] and all(len(x["members"]) <= simhash.LEAF for x in tree.root["children"].values() if x["pivot"] is None)
    compared, hamming = [], simhash.hamming
    monkeypatch.setattr(simhash, "hamming", lambda a, b: compared.append(np.broadcast(a, b).size) or hamming(a, b))
    found = {(int(q), int(m)) for own, near in tree.search(fps, 4) for q, m in zip(own, near)}
    assert sum(compared) < 0.9 * len(fps) ** 2
    assert found == {(i, j) for i, a in enumerate(fps.tolist()) for j, b in enumerate(fps.tolist()) if (a ^ b).bit_count() <= 4} and len(found) > len(fps)


def test_long_texts(spark):
    long = " ".join(f"w{k % 977}" for k in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "other words of a text")]
    got = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].component_id == 1 and got[3].component_id == 3
    assert sorted(x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3]


def test_one_of_each_is_the_same_without_broadcasts(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for i in range(60):
        words = [r.choice("abcdefgh") + str(r.randrange(90)) for _ in range(60)]
        rows += [(3 * i, " ".join(words), i), (3 * i + 1, " ".join([*words[:-1], "other"]), i), (3 * i, " ".join(words), i)]
    df = spark.createDataFrame([*rows, (None, None, 1), (None, None, 1)], "doc_id long, text string, __n int")
    both = []
    for bound in (10**6, -1):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
        both.append(sorted(map(tuple, simhash.one_of_each(df).collect()), key=str))
    assert both[0] == both[1] and [x[0] for x in both[0]].count(None) == 1
    assert sorted(x[0] for x in both[0] if x[0] is not None) == [3 * i for i in range(60)]
