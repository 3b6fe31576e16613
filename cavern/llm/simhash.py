"""Operator 8: SimHash near-duplicates found with BK-trees.

A BK-tree keeps a pivot and, for each integer Hamming distance to it, the subtree of what lies at that distance;
a search within radius r follows only edges of length d-r to d+r. Small subtrees are kept as arrays and compared
at once, and many queries go down a tree together.

A tree over all fingerprints can't be broadcast at scale, so there is one tree for each shard. With b blocks of
bits, two fingerprints that differ in at most r bits agree in some b-r blocks; each choice of b-r blocks and
their bits is a shard, so every link lies inside a shard. b follows the number of fingerprints. Shards above a
size are given to several tasks, each with the whole tree and a part of the queries. A shard yields a spanning
forest of its links, not all pairs; the components of these are found in DataFrames.

Defined cases: a null or empty text has no words and fingerprint zero, and zero links like any other; a null
doc_id gets its component's least doc_id that isn't null (null if there is none); repeated rows are documents
like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, ragged, slices, texts, written
from .graph import components

#: Fingerprints of a subtree that are compared at once instead of being split further; the wide ones' radius prunes less.
LEAF, WIDE_LEAF = 16, 64
#: Queries that go down a tree together.
QUERIES = 4096
#: Fingerprints of a shard whose queries one task takes.
SHARD_ROWS = 16_384
#: The mean number of fingerprints in a shard that decides on the number of blocks.
SHARD_MEAN = 256
#: Rows of at most 56 bytes that are broadcast.
BROADCAST_ROWS = 500_000
#: Texts of a block of a large group of similar fingerprints; a task compares two blocks.
BLOCK_ROWS = 1024
#: Shingles of texts that are looked up at once.
GATHERED = 4_000_000
#: One of so many documents is in the sample whose common shingles come last in the prefixes; in how many of the
#: sample's texts these are, and how many of them there are at most.
SAMPLE, COMMON_TEXTS, COMMON_SHINGLES = 64, 8, 100_000
#: Words of a wide fingerprint, for similarities whose radius is beyond an exact search in 64 bits.
WIDE = 3
WORDS = [f"w{k}" for k in range(WIDE)]


def words_of(text: str) -> bytes:
    """The words, of ASCII letters lower-cased, joined by single spaces."""
    return b" ".join(text.encode().lower().split())


def shingle_hashes(text: str, shingle_words: int) -> np.ndarray:
    """XXH64 of the shingles of words, repeats included; of all words where there are fewer, and none without words."""
    joined = words_of(text)
    if not joined:
        return np.empty(0, np.uint64)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.r_[0, blanks + 1].tolist(), np.r_[blanks, len(joined)].tolist()
    digest = xxhash.xxh64_intdigest
    if len(starts) < shingle_words:
        return np.array([digest(joined, 42)], np.uint64)
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle_words - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[at : at + 65_536])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent hashes made of one, by the finaliser of splitmix64; the 0th is the hash itself."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, shingle_words: int = 4) -> int:
    return majority(shingle_hashes(text, shingle_words))


def fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            found = np.array([fingerprint(t, shingle_words) for t in texts(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """doc_id and fp, the 64 bits of the fingerprint as a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: fingerprint_batches(it, shingle_words), f"doc_id {kind}, fp long")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints; a last axis of length over one holds the words of one."""
    bits = np.bitwise_count(a ^ b)
    return bits[..., 0] if bits.shape[-1] == 1 else bits.sum(axis=-1, dtype=np.int16)


class BKTree:
    """Nodes are (pivot, children by distance) or an array of members; members are indices into fps [fingerprint, word]."""

    def __init__(self, fps: np.ndarray, leaf: int = LEAF):
        self.fps = fps = fps[:, None] if fps.ndim == 1 else fps
        self.root = self._node(np.arange(len(fps)))
        todo = [self.root]
        while todo:
            node = todo.pop()
            if len(node["members"]) <= leaf:
                continue
            pivot, rest = node["members"][0], node["members"][1:]
            away = hamming(fps[rest], fps[pivot])
            order = np.argsort(away, kind="stable")
            distances, first = np.unique(away[order], return_index=True)
            node["pivot"], node["members"] = pivot, None
            node["children"] = {int(d): self._node(part) for d, part in zip(distances, np.split(rest[order], first[1:]))}
            todo += node["children"].values()

    @staticmethod
    def _node(members: np.ndarray) -> dict:
        return {"members": members, "pivot": None, "children": {}}

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (query, member) of all pairs within the radius; both are indices."""
        queries = queries[:, None] if queries.ndim == 1 else queries
        for at in range(0, len(queries), QUERIES):
            todo = [(self.root, np.arange(at, min(at + QUERIES, len(queries))))]
            while todo:
                node, own = todo.pop()
                if node["pivot"] is None:
                    q, m = np.nonzero(hamming(queries[own][:, None, :], self.fps[node["members"]][None, :, :]) <= radius)
                    yield own[q], node["members"][m]
                    continue
                away = hamming(queries[own], self.fps[node["pivot"]]).astype(np.int16)
                near = own[away <= radius]
                yield near, np.full(len(near), node["pivot"])
                for distance, child in node["children"].items():
                    down = own[np.abs(away - distance) <= radius]
                    if len(down):
                        todo.append((child, down))


def spanning(fps: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices u, v) of a forest that ties the fps as the links between asked ones and all do."""
    label = np.arange(len(fps))
    queries = np.flatnonzero(asked)
    for q, m in BKTree(fps, LEAF if fps.shape[-1] == 1 else WIDE_LEAF).search(fps[queries], radius):
        a, b = label[queries[q]], label[m]
        differ = a != b
        if not differ.any():
            continue
        pairs = np.unique(np.stack([np.minimum(a, b)[differ], np.maximum(a, b)[differ]], 1), axis=0)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        move = np.arange(len(fps))
        for x in up:
            move[x] = top(x)
        label = move[label]
    own = np.flatnonzero(label != np.arange(len(fps)))
    return own, label[own]


def forest_batches(batches: Iterator[pa.RecordBatch], radius: int, node: str, words: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, part, node, words of the fingerprint, asked), sorted by shard and part, to edges (u, v) of nodes."""
    held: list[list[np.ndarray]] = []

    def done(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        shard, part, asked, nodes = columns[:4]
        fps = np.stack(columns[4:], 1).view(np.uint64)
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
        bounds = np.r_[0, cuts, len(fps)]
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        two = two[(asked[two] | asked[two + 1]) & (hamming(fps[two], fps[two + 1]) <= radius)]
        edges = [(a, *spanning(fps[a:b], asked[a:b], radius)) for a, b in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2])]
        edges = [(nodes[a + u], nodes[a + v]) for a, u, v in edges if len(u)] + ([(nodes[two], nodes[two + 1])] if len(two) else [])
        if edges:
            u, v = (np.concatenate(x) for x in zip(*edges))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "part", "asked", node, *words)]
        if not len(columns[0]):
            continue
        last = len(columns[0]) - 1
        begins = int(np.flatnonzero((columns[0] == columns[0][last]) & (columns[1] == columns[1][last]))[0])
        same = held and held[-1][0][-1] == columns[0][0] and held[-1][1][-1] == columns[1][0]
        if begins == 0 and (same or not held):
            held.append(columns)
            continue
        ready = [*held, [c[:begins] for c in columns]]
        if found := done([np.concatenate(x) for x in zip(*ready)]):
            yield found
        held = [[c[begins:] for c in columns]]
    if held and (found := done([np.concatenate(x) for x in zip(*held)])):
        yield found


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask of 64 bits for each choice of blocks - radius blocks."""
    bounds = [round(k * 64 / blocks) for k in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    return [sum(x) for x in combinations(each, blocks - radius)]


def blocks_for(rows: int, radius: int) -> int:
    blocks = radius + 1
    while rows / 2 ** (64 * (blocks - radius) / blocks) > SHARD_MEAN and blocks < radius + 4:
        blocks += 1
    return blocks


def sharded_links(rows: DataFrame, keys: Column, node: str, words: list[str], radius: int, shard_rows: int) -> DataFrame:
    """Distinct fingerprints (node and words) and the array of their shards to edges (u, v) of nodes."""
    columns = list(dict.fromkeys([node, *words]))
    members = rows.select(node, F.explode(keys).alias("shard"))
    # Shards of one member link nothing; only the others' members take their fingerprints along.
    met = members.groupBy("shard").count().where("count > 1").select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    members = members.join(met, "shard")
    rows = members if columns == [node] else members.join(rows.select(*columns), node)
    rows = rows.select("shard", *columns, "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = rows.select("shard", "part", *columns, (F.pmod(F.xxhash64(node), F.col("parts")) == F.col("part")).alias("asked"))
    return rows.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(lambda it: forest_batches(it, radius, node, words), "u long, v long")


def links(fps: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS, blocks: int | None = None) -> DataFrame:
    """Distinct fingerprints (one column, fp) to edges (u, v) that tie them as all links within the radius do."""
    masks = block_masks(blocks or blocks_for(fps.count(), radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)))
    return sharded_links(fps, keys, "fp", ["fp"], radius, shard_rows)


def sized(rows: DataFrame) -> DataFrame:
    """Rows of some numbers each, broadcast up to a checked count, so that texts needn't move to them; joined by shuffles beyond."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def tied_components(docs_fp: DataFrame, firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """docs_fp (doc_id, fp, ...) with component_id; firsts (fp, first) has each fingerprint's least doc_id."""
    roots = components(edges)
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    tied = firsts.select("fp", "first").join(nodes.withColumnRenamed("node", "fp"), "fp")
    least = tied.groupBy("root").agg(F.min("first").alias("least"))
    tied = tied.join(least, "root").select("fp", "least")
    # Written, so that the last join has plain exchanges on both sides and a fingerprint of very many copies can be split.
    found = checkpointed(firsts.select("fp", "first").join(tied, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return docs_fp.join(found, "fp")


def component_ids(docs_fp: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp) to (doc_id, fp, component_id); docs_fp is read several times."""
    firsts = checkpointed(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return tied_components(docs_fp, firsts, links(firsts.select("fp"), radius))


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    found = component_ids(checkpointed(fingerprints(docs, shingle_words)), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, shingle_words: int) -> np.ndarray:
    """The distinct shingle hashes in order; a text without words has the one hash zero, so that such texts are equal."""
    hashes = np.unique(shingle_hashes(text, shingle_words))
    return hashes if len(hashes) else np.zeros(1, np.uint64)


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first of a set's hashes, common ones last: sets of the similarity or more share one of these."""
    size = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    late = np.isin(hashes, common)
    return np.r_[hashes[~late], hashes[late]][:size]


def wide_batches(batches: Iterator[pa.RecordBatch], shingle_words: int, similarity: float, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = [shingle_set(t, shingle_words) for t in texts(batch, "text")]
            words = [np.array([majority(remixed(h, k)) for h in sets], np.uint64).view(np.int64) for k in range(WIDE)]
            shards = [prefix(h, similarity, common).view(np.int64) for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), *map(pa.array, words), pa.array(shards, pa.list_(pa.int64()))], names=["doc_id", "fp", *WORDS, "shards"])


def count_shingles(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            shingles, counts = np.unique(np.concatenate([shingle_set(t, shingle_words) for t in texts(batch, "text")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(counts)], names=["shingle", "texts"])


def common_shingles(docs: DataFrame, shingle_words: int) -> np.ndarray:
    """Shingles that are common in a sample. They only order the prefixes, so no result depends on them."""
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = chosen.mapInArrow(lambda it: count_shingles(it, shingle_words), "shingle long, texts long").groupBy("shingle").agg(F.sum("texts").alias("texts"))
    found = counts.where(F.col("texts") >= COMMON_TEXTS).orderBy(F.desc("texts"), "shingle").limit(COMMON_SHINGLES).toArrow()
    return found.column("shingle").to_numpy().view(np.uint64)


def similar_radius(similarity: float) -> int:
    """Differing bits of a wide fingerprint at a Jaccard similarity of shingles: the angle between texts of one length."""
    return round(64 * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def search_radius(similarity: float) -> int:
    """The radius five standard deviations beyond the mean at the similarity."""
    share = similar_radius(similarity) / (64 * WIDE)
    return similar_radius(similarity) + math.ceil(5 * math.sqrt(64 * WIDE * share * (1 - share)))


def similar_forest(fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices u, v) of a forest that ties the sets as all links do: within the radius, and exactly of the similarity or more."""
    sizes = np.array([len(x) for x in sets])
    offsets = np.cumsum(sizes) - sizes
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(codes.max()) + 1, bool)
    left = np.arange(len(sets))
    us, vs = [], []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            can = hamming(fps[left], fps[x]) <= radius
            can &= np.minimum(sizes[left], sizes[x]) >= similarity * np.maximum(sizes[left], sizes[x]) - 1e-9
            near = left[can]
            if not len(near):
                continue
            own = codes[offsets[x] : offsets[x] + sizes[x]]
            mark[own] = True
            shared = np.empty(len(near), np.int64)
            for part in np.split(np.arange(len(near)), np.flatnonzero(np.diff(np.cumsum(sizes[near]) // GATHERED)) + 1):
                of = sizes[near[part]]
                shared[part] = np.add.reduceat(mark[ragged(codes, offsets[near[part]], of)], np.cumsum(of) - of, dtype=np.int64)
            mark[own] = False
            hit = near[shared >= similarity * (sizes[near] + sizes[x] - shared) - 1e-9]
            us.append(hit)
            vs.append(np.full(len(hit), x))
            todo += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
    return (np.concatenate(us), np.concatenate(vs)) if us else (left, left)


def similar_batches(batches: Iterator[pa.RecordBatch], shingle_words: int, radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (root, part, fp, words of the fingerprint, text), sorted by root and part, to edges (u, v) of fp."""

    def done(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(group)
        if rows.num_rows < 2:
            return None
        fps = np.stack([rows.column(w).to_numpy() for w in WORDS], 1).view(np.uint64)
        u, v = similar_forest(fps, [shingle_set(t or "", shingle_words) for t in rows.column("text").to_pylist()], radius, similarity)
        nodes = rows.column("fp").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"]) if len(u) else None

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        root, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("root", "part"))
        bounds = [0, *(np.flatnonzero((np.diff(root) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(root)]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            if held and last != (root[a], part[a]):
                if found := done(held):
                    yield found
                held = []
            held.append(batch.slice(a, b - a))
            last = root[a], part[a]
    if held and (found := done(held)):
        yield found


def similar_links(docs: DataFrame, firsts: DataFrame, near: DataFrame, shingle_words: int, similarity: float, block_rows: int) -> DataFrame:
    """Edges (u, v) of fp that tie texts as all links of exactly the similarity or more do.

    near (u, v) ties all that can be linked. Each group it ties is read whole, and by pairs of blocks beyond `block_rows`.
    """
    roots = components(near)
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    large = nodes.groupBy("root").count().where(F.col("count") > block_rows).select("root", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    nodes = nodes.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    nodes = checkpointed(nodes.join(firsts.select("fp", "first", *WORDS), "fp"))
    same = (F.col("t.fp") == F.col("n.fp")) & F.col("doc_id").eqNullSafe(F.col("first"))
    rows = docs.alias("t").join(sized(nodes).alias("n"), same).select("n.*", "text")
    rows = rows.groupBy("root", "fp", "blocks", *WORDS).agg(F.any_value("text").alias("text"))  # rows may repeat id and text
    block = F.pmod(F.xxhash64(F.lit(1), F.col("fp")), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != block) | (F.col("blocks") == 1))
    pairs = F.transform(others, lambda x: F.least(x, block).cast("long") * F.col("blocks") + F.greatest(x, block))
    rows = rows.select("root", F.explode(pairs).alias("part"), "fp", *WORDS, "text")
    radius = search_radius(similarity)
    return rows.repartition("root", "part").sortWithinPartitions("root", "part").mapInArrow(lambda it: similar_batches(it, shingle_words, radius, similarity), "u long, v long")


def similar_component_ids(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fp, component_id), linked where the sets of shingles have the Jaccard similarity or more; fp is the text's hash.

    A shard is a shingle, and a text is in the shards of its prefix, so that two texts of the similarity always meet.
    BK-trees of wide fingerprints with a radius of five standard deviations more tie the groups whose sets are compared.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"))
    common = common_shingles(docs, shingle_words)
    found = docs.mapInArrow(lambda it: wide_batches(it, shingle_words, similarity, common), f"doc_id {kind}, fp long, " + ", ".join(f"{w} long" for w in WORDS) + ", shards array<long>")
    docs_fp = written(found, "fingerprints")
    firsts = written(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first"), *(F.any_value(c).alias(c) for c in (*WORDS, "shards"))), "firsts")
    near = sharded_links(firsts, F.col("shards"), "fp", WORDS, search_radius(similarity), shard_rows)
    return tied_components(docs_fp.select("doc_id", "fp"), firsts, similar_links(docs, firsts, near, shingle_words, similarity, block_rows))


def one_of_each(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs' rows and columns, but of each component only the document of the least doc_id (nulls last), and of rows
    that repeat its id and text only one."""
    key = F.xxhash64("doc_id", "text")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), key.alias("key")).alias("doc_id")
    found = similar_component_ids(docs.select(order, "text"), shingle_words, similarity)
    kept = checkpointed(found.where("doc_id = component_id").select(F.col("component_id.key").alias("__key")).distinct())
    rows = docs.withColumn("__key", key).join(sized(kept), "__key", "left_semi")
    repeated = checkpointed(docs.groupBy(key.alias("__key")).count().where("count > 1").select("__key"))
    once = rows.join(sized(repeated), "__key", "left_anti")
    again = rows.join(sized(repeated), "__key", "left_semi").withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy("__key"))).where("__nth = 1")
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))
