"""Operator 1: byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In a round, every pair of neighbours is looked up in a hash
table of the pair keys, each word's lowest-rank pair is merged wherever it occurs (from the left,
without overlap), and words with nothing left to merge leave the array. Only words not met before by the worker
are merged; a text is then a ragged gather over the stored ids.

Defined cases: a null or empty text has no ids and decodes to the empty text; every other column is passed
through (null ids, repeated rows and empty tables too); input columns named as an output (`ids`, `decoded`) are
replaced. Texts of any length are encoded whole. Strings of added tokens in a text become their ids, as in the
tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WHITE, ragged, slices, texts

#: What a run between white space splits into (fixed values: the published pattern of byte-level BPE).
INNER = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+")
#: Runs that hold whole matches of the pattern: a blank goes with what follows it.
OUTER = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Words that a worker remembers before it starts afresh.
CACHE_WORDS = 400_000
NONE = np.iinfo(np.int64).max
#: Mixes pair keys for their slots (2**64 over the golden ratio, odd).
MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(shifted.get(b, b)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        of_symbol = {c: b for b, c in enumerate(symbols)}
        self.size = max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.byte_ids = np.array([vocab[c] for c in symbols], np.int64)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.last_ids = np.array([vocab[c + suffix] for c in symbols], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.index(left * self.size + right, merged)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pieces = [b""] * self.size
        for token, k in vocab.items():
            pieces[k] = bytes(of_symbol[c] for c in token) if all(c in of_symbol for c in token) else token.encode()
        for token, k in self.added.items():
            pieces[k] = token.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_lengths = np.array([len(x) for x in pieces], np.int64)
        self.piece_offsets = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.offsets, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def index(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Lays the merges, given in order of rank, out by the hash slots of their pair keys, some four slots for each."""
        self.shift = np.uint64(64 - max(8, (3 * len(keys)).bit_length()))
        slots = self.slots(keys)
        order = np.argsort(slots, kind="stable")
        counts = np.bincount(slots, minlength=1 << (64 - int(self.shift)))
        self.first, self.shared = (np.cumsum(counts) - counts).astype(np.int32), counts > 1
        self.longest = int(counts.max())
        end = np.zeros(self.longest + 1, np.int64)  # walked into from the last slots; no key is -1
        self.keys, self.ranks, self.merged = np.r_[keys[order], end - 1], np.r_[order, end], np.r_[merged[order], end]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """A place in self.keys for each of the keys: its own, or one that holds another key if it has none."""
        slots = self.slots(keys)
        at = self.first[slots]
        left = np.flatnonzero(self.shared[slots] & (self.keys[at] != keys))
        for _ in range(self.longest - 1):
            at[left] += 1
            left = left[self.keys[at[left]] != keys[left]]
        return at

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and each word's number of them. Words are not empty."""
        raw, lengths = np.frombuffer(b"".join(words), np.uint8), [len(w) for w in words]
        sym, last = self.byte_ids[raw], np.cumsum(lengths) - 1
        sym[last] = self.last_ids[raw[last]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = self.look_up(key)
            rank = np.full(len(sym), NONE)
            rank[:-1] = np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.ranks[at], NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            over = least == NONE
            done_sym.append(sym[over])
            done_word.append(word[over])
            here = np.flatnonzero((rank == least) & ~over)
            run = np.flatnonzero(np.r_[True, np.diff(here) != 1]) if len(here) else here
            in_run = np.arange(len(here)) - np.repeat(run, np.diff(np.r_[run, len(here)])) if len(here) else here
            here = here[in_run % 2 == 0]
            sym[here] = self.merged[at[here]]
            over[here + 1] = True
            sym, word = sym[~over], word[~over]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def merge_runs(self, words: list[str], break_word: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of words, one after the other, and each run's number of them.

        break_word stands between two runs and after the last; a distinct word is merged once.
        """
        distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
        ends = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
        stop = distinct.pop(break_word)
        ids, counts = self.merge([w.encode() for w in distinct])
        counts = np.insert(counts, stop, 0)
        offsets = np.cumsum(counts) - counts
        bounds = np.cumsum(counts[ends])[ends == stop]
        return ragged(ids, offsets[ends], counts[ends]), np.diff(np.r_[0, bounds])

    def learn(self, runs: set[str]) -> None:
        """Adds runs not met before to the store."""
        new = [r for r in runs if r not in self.known]
        if not new:
            return
        words = []
        for run in new:
            words += INNER.findall(run)
            words.append("")
        flat, lengths = self.merge_runs(words, "")
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(self.ids), len(flat)), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.offsets = np.concatenate([self.offsets, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(flat)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and each text's number of them."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        runs, n_runs = [], []
        for text in batch:
            if self.split_added and any(x in text for x in self.added):
                own = [r for part in self.split_added.split(text) for r in ([part] if part in self.added else OUTER.findall(part))]
                for special in self.added.keys() - self.known.keys():
                    self.known[special] = len(self.known)
                    self.ids = np.concatenate([self.ids[: self.used], [self.added[special]], np.empty(1 << 16, np.int32)]).astype(np.int32)
                    self.offsets, self.lengths = np.append(self.offsets, self.used), np.append(self.lengths, 1)
                    self.used += 1
            else:
                own = OUTER.findall(text)
            runs += own
            n_runs.append(len(own))
        self.learn(set(runs))
        picks = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
        lengths = self.lengths[picks]
        ends = np.cumsum(np.r_[0, lengths])
        bounds = ends[np.cumsum(np.r_[0, n_runs]).astype(np.int64)]
        return ragged(self.ids, self.offsets[picks], lengths), np.diff(bounds)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of `counts` ids; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.piece_lengths[ids]
        data = ragged(self.piece_bytes, self.piece_offsets[ids], lengths).tobytes()
        bounds = np.cumsum(np.r_[0, lengths])[np.cumsum(np.r_[0, counts]).astype(np.int64)].tolist()
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    """One for each worker, kept for its later tasks."""
    return ByteBPE(path)


def replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """batch with the columns set, in place of others of their names in any case."""
    low = {x.lower() for x in columns}
    kept = [x for x in batch.schema.names if x.lower() not in low]
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *columns.values()], names=[*kept, *columns])


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Adds `ids`, an int32 list, to Arrow batches."""
    bpe = vocabulary(path)
    for whole in batches:
        for batch in slices(whole, column):
            ids, counts = bpe.encode(texts(batch, column))
            lists = pa.LargeListArray.from_arrays(pa.array(np.cumsum(np.r_[0, counts]), pa.int64()), pa.array(ids, pa.int32()))
            yield replaced(batch, ids=lists.cast(pa.list_(pa.int32())))


def decode_batches(batches: Iterator[pa.RecordBatch], path: str, ids: str = "ids") -> Iterator[pa.RecordBatch]:
    """Adds `decoded`, the text of the ids; a null list decodes to the empty text."""
    bpe = vocabulary(path)
    for batch in batches:
        lists = batch.column(ids)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield replaced(batch, decoded=pa.array(bpe.decode(pc.list_flatten(lists).to_numpy().astype(np.int64), counts), pa.binary()).cast(pa.string()))


def schema_with(df: DataFrame, **types: T.DataType) -> T.StructType:
    low = {x.lower() for x in types}
    return T.StructType([*(f for f in df.schema.fields if f.name.lower() not in low), *(T.StructField(k, v) for k, v in types.items())])


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """df with `ids`, the token ids of the whole text."""
    return df.mapInArrow(lambda it: encode_batches(it, path, column), schema_with(df, ids=T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with `decoded`, the text of its ids, special tokens included."""
    return df.mapInArrow(lambda it: decode_batches(it, path, ids), schema_with(df, decoded=T.StringType()))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, bounds = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        shas = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]
        decoded = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column("decoded").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(shas), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each document's text in one pass over Arrow batches, and digests ids and text."""
    chain = lambda it: digests(decode_batches(encode_batches(it, path), path))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(chain, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
