"""Operator 4: harmonic packing of token pieces into sequences of a fixed capacity.

A piece of length in (C/(k+1), C/k] has class k, and k pieces of the class fill a sequence. What a document
leaves after whole sequences is cut where its own class would waste more than a small share of its slot: the
largest C/k below it goes, and the rest is looked at again. Cuts depend on the length alone, so every worker
cuts on its own. Pieces are numbered within their class from counts of hashed buckets, and the k pieces of
numbers b*k to b*k+k-1 share sequence b of the class. Pieces beyond the last whole sequence of a class (fewer
than k, so their number is bounded by the classes, not the input) are placed together, largest first, where they
fit.

Defined cases: a null text is empty and has the end id alone; repeated rows and null doc_ids are documents like
any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ByteBPE
from .common import WHITE, checkpointed, n_parts, ragged, slices

CAPACITY = 4096
#: The share of its slot that an uncut piece may waste.
SLACK = 1 / 64
#: Pieces of a class that one task numbers.
CLASS_ROWS = 100_000
#: Chunks that a worker remembers before it starts afresh, and their bytes with those of the texts at hand.
CACHE_CHUNKS, CACHE_BYTES = 600_000, 64 << 20
#: New chunks that are Python strings at once.
LEARNT_AT_ONCE = 20_000
#: Chunks whose ids are gathered at once.
GATHERED_AT_ONCE = 1 << 16
#: Chunks of letters whose case and normal form don't depend on context, without the mark of special tokens.
PLAIN = re.compile("(?!.*<\\|)[\0-\xff]*", re.DOTALL)
#: What the vocabulary's pre-tokenizer keeps of a chunk (fixed values), and the line end between chunks.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+|\n")
#: What Arrow's split takes for white space, as str.split does, but the vocabulary's normalizer doesn't.
SEPARATORS = "".join(map(chr, range(28, 32)))


class ChunkTokenizer:
    """Encodes texts as the tokenizers library does, each distinct run between white space once.

    Right for vocabularies whose normalizer and pre-tokenizer treat such runs apart and drop the white space,
    as word-end BPE does. Runs are split, told apart and remembered in Arrow arrays; only new ones become Python strings.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merger = ByteBPE(path)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([""])  # stands where white space begins or ends a text
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.offsets, self.lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, new: pa.Array) -> None:
        """Plain chunks are merged in numpy rounds, many at once; the library encodes the others."""
        for at in range(0, len(new), LEARNT_AT_ONCE):
            part = new.slice(at, LEARNT_AT_ONCE).to_pylist()
            all_plain = PLAIN.fullmatch("".join(part)) is not None
            is_plain = np.array([all_plain or PLAIN.fullmatch(c) is not None for c in part])
            plain, others = [c for c, p in zip(part, is_plain) if p], [c for c, p in zip(part, is_plain) if not p]
            lengths, flat = np.empty(len(part), np.int64), []
            if plain:
                ids, lengths[is_plain] = self.merger.merge_runs(PIECE.findall("\n".join([*plain, ""]).lower()), "\n")
                flat.append(ids)
            if others:
                found = [x.ids for x in self.library.encode_batch_fast(others, add_special_tokens=False)]
                lengths[~is_plain] = [len(x) for x in found]
                flat.append(np.fromiter((i for x in found for i in x), np.int64, int(lengths[~is_plain].sum())))
            self.add(np.concatenate(flat), lengths, np.argsort(~is_plain, kind="stable"))

    def add(self, flat: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> None:
        """Stores the ids of chunks, which lie in flat in this order of them."""
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(self.ids) // 2, len(flat)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        offsets = np.empty(len(lengths), np.int64)
        offsets[order] = self.used + np.cumsum(lengths[order]) - lengths[order]
        self.offsets, self.lengths = np.concatenate([self.offsets, offsets]), np.concatenate([self.lengths, lengths])
        self.used += len(flat)

    def encode(self, batch: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and each text's number of them."""
        column = pc.fill_null(pa.array(batch, pa.string()) if isinstance(batch, list) else batch.cast(pa.string()), "")
        if len(self.known) > CACHE_CHUNKS or self.known.nbytes + column.nbytes > CACHE_BYTES:
            self.forget()
        odd = pc.any(pc.match_substring_regex(column, f"[{SEPARATORS}]")).as_py()
        own = pc.split_pattern_regex(column, f"[{WHITE}]+") if odd else pc.utf8_split_whitespace(column)
        # What is known comes first, so that its codes stay, and new chunks get the codes that follow.
        n, coded = len(self.known), pa.concat_arrays([self.known, own.flatten()]).dictionary_encode()
        self.known = coded.dictionary
        self.learn(self.known.slice(n))
        picks = coded.indices.to_numpy()[n:]
        ends = np.cumsum(pc.list_value_length(own).to_numpy(), dtype=np.int64)
        bounds = np.cumsum(np.r_[0, self.lengths[picks]])[np.r_[0, ends]]
        ids = np.empty(bounds[-1], np.uint32)
        at = 0
        for k in range(0, len(picks), GATHERED_AT_ONCE):
            part = picks[k : k + GATHERED_AT_ONCE]
            found = ragged(self.ids, self.offsets[part], self.lengths[part])
            ids[at : at + len(found)] = found
            at += len(found)
        return ids, np.diff(bounds)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


@lru_cache(maxsize=2)
def remainder_cuts(capacity: int = CAPACITY, slack: float = SLACK) -> list[list[int]]:
    """How a rest of each length below the capacity is cut."""
    cuts: list[list[int]] = [[]]
    for r in range(1, capacity):
        k = capacity // r
        slot = capacity // k
        cut = capacity // (k + 1)
        cuts.append([r] if slot - r <= slack * slot else [cut, *cuts[r - cut]])
    return cuts


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    return [capacity] * (n // capacity) + remainder_cuts(capacity)[n % capacity]


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, digest: Callable[[np.ndarray], int]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (doc_id, text) to pieces; digest makes a piece's `ids_crc32` from its ids."""
    own = tokenizer(path)
    for whole in batches:
        for batch in slices(whole, "text"):
            ids, counts = own.encode(batch.column("text"))
            rows: list[tuple[int, int, int, int, int]] = []
            at = 0
            for k, n in enumerate(counts.tolist()):
                doc, start = np.append(ids[at : at + n], np.uint32(end_id)), 0
                for length in cut(n + 1, capacity):
                    rows.append((k, start, length, digest(doc[start : start + length]), n + 1))
                    start += length
                at += n
            columns = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )
    own.forget()  # other operators' tasks may run in this worker next
    pa.default_memory_pool().release_unused()


def pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, digest: Callable[[np.ndarray], int] = crc32_of) -> DataFrame:
    """Every document's ids, and end_id, cut into pieces: doc_id, start, length, ids_crc32, doc_tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: piece_batches(it, path, end_id, capacity, digest), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def place_rest(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Largest first, each piece into the fullest sequence that takes it."""
    pdf = pdf.sort_values(["length", "class", "number"], ascending=[False, True, True], ignore_index=True)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    occupied = np.zeros(capacity + 1, bool)
    placed, room = np.empty(len(pdf), np.int64), []
    for k, n in enumerate(pdf["length"].tolist()):
        at = n + int(np.argmax(occupied[n:]))
        if occupied[at]:
            b = by_room[at].pop()
            occupied[at] = bool(by_room[at])
        else:
            b = len(room)
            room.append(capacity)
        placed[k] = b
        room[b] -= n
        by_room[room[b]].append(b)
        occupied[room[b]] = room[b] > 0
    return pdf.assign(bin=placed)


def pack(pieces: DataFrame, capacity: int = CAPACITY, class_rows: int = CLASS_ROWS) -> DataFrame:
    """pieces (any columns, among them a positive `length` of at most the capacity) with `sequence_id` and `offset`.

    The pieces are read several times; pass a checkpointed or stored DataFrame.
    """
    columns = pieces.columns
    rows = pieces.withColumn("class", F.floor(F.lit(capacity) / F.col("length")))
    order = [F.xxhash64(*columns), *columns]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(n_parts(rows.count(), class_rows))))
    counts = rows.groupBy("class", "bucket").count()
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("class", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    # One row a class, and there are at most `capacity` classes.
    sizes = counts.groupBy("class").agg(F.floor(F.sum("count") / F.col("class")).alias("full")).orderBy("class")
    classes = sizes.withColumn("base", F.coalesce(F.sum("full").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = rows.withColumn("at", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(*order))).join(starts, ["class", "bucket"])
    own = own.join(F.broadcast(classes), "class").withColumn("number", F.col("first") + F.col("at") - 1)
    own = own.withColumn("bin", F.floor(F.col("number") / F.col("class"))).drop("first", "at", "bucket")
    own = checkpointed(own)
    kept = [*columns, "number", "class"]
    full = own.where("bin < full").select(*kept, (F.col("base") + F.col("bin")).alias("sequence_id"))
    names = {f.name: f.dataType for f in own.schema.fields}
    rest_schema = ", ".join(f"`{c}` {names[c].simpleString()}" for c in [*kept, "bin"])
    rest = own.where("bin >= full").select(*kept, "bin").groupBy().applyInPandas(lambda pdf: place_rest(pdf, capacity)[[*kept, "bin"]], rest_schema)
    total = F.broadcast(classes.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("total")))
    rest = rest.crossJoin(total).select(*kept, (F.col("total") + F.col("bin")).alias("sequence_id"))
    within = Window.partitionBy("sequence_id").orderBy("class", "number").rowsBetween(Window.unboundedPreceding, -1)
    return full.unionByName(rest).withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("number", "class")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Every document cut and packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(checkpointed(pieces(docs, path, end_id, capacity)), capacity)
