"""Operator 7: text probability by prediction by partial matching over bytes.

A text is coded as its words (ASCII letters lower-cased), each followed by a blank, and an end symbol. A symbol
is predicted from the bytes before it: the trie of byte contexts, pretrained on the corpus, is asked for the
longest context first. A context gives a symbol seen there 2c-1 shares of 2n and leaves its number of distinct
symbols as the escape (method D); after an escape the next shorter context is asked without the symbols already
refused. Below the longest order, a context counts the distinct longer contexts in which a symbol was new, as
update exclusion does. What no context knows is uniform over the symbols not seen at all.

The trie is a table of the longest-order grams with their counts; shorter orders are sums of its rows. Rows whose
contexts end in the same three bytes lie in one task, at most 2**24 of them; the orders from two down come from a table
of grams of three bytes, at most as many again, that every task gets. Documents are dealt over splits of bounded size,
a task each. Each split lists its distinct grams and words once, they are counted over all splits, and each split gets
the values of its own by a join. The grams' values are broadcast while their number is below a bound, and go to the
splits like the words' beyond it. Words are told apart by 64-bit hashes, so n_known may be off where two collide.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as the empty text in the fold;
repeated rows are documents like any other; without a training row all counts are zero and the base score is
that of an empty table (c, N and V zero); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_fold, n_parts, slices, texts, written

#: Bytes of context; with the symbol, a gram fits eight bytes.
ORDER = 5
#: Bytes that no word holds: the end of a text, and what stands before its start.
END, BEFORE = 0x0B, 0x0A
#: Symbols a text can be coded with: every byte but the six of white space, the blank and the end.
SYMBOLS = 252
#: Text bytes of a split at most, on the mean.
SPLIT_BYTES = 24 << 20
#: Slices of a split whose grams are held before they are summed.
HELD = 12
#: Gram values that are broadcast (16 bytes each); beyond it they are joined.
BROADCAST_GRAMS = 3_000_000
GRAM, WORD, TEXT = 0, 1, 2
END_WORD = b"\x0b"


def coded(text: str) -> tuple[list[bytes], bytes]:
    """The tokens of a text and the bytes it is coded as."""
    words = text.encode().lower().split()
    return [*words, END_WORD], b"".join((b" ".join([*words, b""]), bytes([END])))


def grams_of(data: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each coded byte of the texts, one after the other, and each text's number of them."""
    start = bytes([BEFORE]) * order
    flat = np.frombuffer(b"".join(x for d in data for x in (start, d)), np.uint8)
    keys = np.zeros(len(flat) - order, np.uint64)
    for k in range(order + 1):
        keys |= flat[k : len(flat) - order + k].astype(np.uint64) << np.uint64(8 * (order - k))
    lengths = np.array([len(d) for d in data])
    ends = np.cumsum(lengths + order) - order
    own = np.ones(len(keys), bool)
    for k in range(order):
        own[ends[:-1] + k] = False
    return keys[own], lengths


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


class SplitCounts:
    """The distinct grams and words of a split's documents, counted in the training rows."""

    def __init__(self, split: int, order: int):
        self.split, self.order = split, order
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: dict[bytes, int] = {}

    def add(self, rows: pa.RecordBatch, train: bool) -> None:
        words, data = self.words, []
        for tokens, x in map(coded, texts(rows, "text")):
            data.append(x)
            if train:
                for w in tokens:
                    words[w] = words.get(w, 0) + 1
            else:
                for w in tokens:
                    words.setdefault(w, 0)
        if data:
            keys, n = np.unique(grams_of(data, self.order)[0], return_counts=True)
            self.grams.append((keys, n * train))
        if len(self.grams) > HELD:
            self.grams = [summed(*(np.concatenate(x) for x in zip(*self.grams)))]

    def result(self) -> pa.RecordBatch:
        keys, n = summed(*(np.concatenate(x) for x in zip(*self.grams)))
        words = np.fromiter(map(word_key, self.words), np.uint64, len(self.words))
        columns = [
            pa.array(np.full(len(keys) + len(words), self.split), pa.int32()),
            pa.array(np.repeat([GRAM, WORD], [len(keys), len(words)]), pa.int32()),
            pa.array(np.concatenate([keys, words]).view(np.int64)),
            pa.array(np.concatenate([n, np.fromiter(self.words.values(), np.int64, len(words))]), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["split", "kind", "key", "n"])


def split_counts(batches: Iterator[pa.RecordBatch], order: int = ORDER) -> Iterator[pa.RecordBatch]:
    """Rows (split, text, train) to counts (split, kind, key, n); a split whose rows aren't together is counted in parts."""
    own: SplitCounts | None = None
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            split = batch.column("split").to_numpy()
            for part in np.split(np.arange(len(split)), np.flatnonzero(np.diff(split)) + 1):
                if own is None or own.split != split[part[0]]:
                    if own:
                        yield own.result()
                    own = SplitCounts(int(split[part[0]]), order)
                rows = batch.slice(part[0], len(part))
                for train in (True, False):
                    own.add(rows.filter(rows.column("train") if train else pa.compute.invert(rows.column("train"))), train)
    if own:
        yield own.result()


class ShortOrders:
    """Orders 2 to 0, from how many contexts of three bytes that end alike know a symbol: (grams of three bytes, these numbers)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order].astype(np.int64), counts[order].astype(np.int64)
        pairs = self.grams & 0xFFFF
        self.one = np.bincount(pairs, minlength=1 << 16).reshape(256, 256)
        self.zero = (self.one > 0).sum(axis=0)
        context = self.grams >> 8
        lower = self.one[pairs >> 8, pairs & 255]
        self.two = [np.bincount(context, weights=w, minlength=1 << 16).astype(np.int64) for w in (self.counts, np.ones(len(context)), lower)]

    def count(self, grams: np.ndarray) -> np.ndarray:
        """Of grams of three bytes."""
        if not len(self.grams):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.counts[at], 0)


def log_probabilities(keys: np.ndarray, n: np.ndarray, short: ShortOrders, order: int = ORDER) -> np.ndarray:
    """log10 probability of each gram (uint64) given its context; all grams of the contexts' last three bytes are there."""
    one, zero = short.one, short.zero
    # For each order from the longest to 0, for each gram: its symbol's count, and its context's total,
    # distinct symbols, and the total that those symbols have in the next shorter context.
    grams, counts = keys, n.astype(np.int64)
    place = np.arange(len(keys))
    levels = []
    for k in range(order, 2, -1):
        shorter = grams & np.uint64((1 << 8 * k) - 1)
        distinct, into = np.unique(shorter, return_inverse=True)
        below = np.bincount(into, weights=counts > 0, minlength=len(distinct)).astype(np.int64)
        below_of = short.count(shorter.astype(np.int64)) if k == 3 else below[into]
        _, context = np.unique(grams >> np.uint64(8), return_inverse=True)
        total, symbols, lower = (np.bincount(context, weights=w)[context] for w in (counts, counts > 0, below_of * (counts > 0)))
        levels.append(tuple(x[place] for x in (counts, total, symbols, lower)))
        grams, counts, place = distinct, below, into[place]
    three = (keys & np.uint64(0xFFFFFF)).astype(np.int64)
    b, s = three >> 8 & 255, three & 255
    levels.append((short.count(three), *(x[three >> 8] for x in short.two)))
    levels.append((one[b, s], one.sum(axis=1)[b], (one > 0).sum(axis=1)[b], ((one > 0) * zero[None, :]).sum(axis=1)[b]))
    levels.append((zero[s], np.full(len(keys), zero.sum()), np.full(len(keys), (zero > 0).sum()), None))
    out, over = np.zeros(len(keys)), np.zeros(len(keys), bool)
    refused_total, refused = np.zeros(len(keys)), np.zeros(len(keys))
    for count, total, symbols, lower in levels:
        left, new = total - refused_total, symbols - refused
        asked = ~over & (left > 0)
        hit = asked & (count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(hit, np.log10((2 * count - 1) / (2 * left)), 0) + np.where(asked & ~hit, np.log10(new / (2 * left)), 0)
        over |= hit
        refused_total, refused = lower, symbols
    unseen = SYMBOLS - (zero > 0).sum()
    return np.where(over, out, out - np.log10(max(unseen, 1)))


class Lookup:
    """Values by 64-bit key, found by a table over the keys' leading hash bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length() + 1))
        hashed = self._hash(keys)
        order = np.argsort(hashed, kind="stable")
        self.keys, self.values = np.r_[keys[order], np.uint64(0)], np.r_[values[order], 0.0]
        self.first = np.searchsorted(hashed[order] >> self.shift, np.arange((1 << (64 - int(self.shift))), dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """All keys must be known."""
        at = self.first[self._hash(keys) >> self.shift]
        off = np.flatnonzero(self.keys[at] != keys)
        while len(off):
            at[off] += 1
            off = off[self.keys[at[off]] != keys[off]]
        return self.values[at]


def score_batches(batches: Iterator[pa.RecordBatch], lookup: Lookup | None, n_train: int, v_train: int, order: int = ORDER) -> Iterator[pa.RecordBatch]:
    """A split's values and then its documents (kind, key, value, doc_id, text, train) to the figures of each document."""
    values: list[tuple[np.ndarray, ...]] = []
    known: tuple[np.ndarray, np.ndarray] | None = None
    with np.errstate(divide="ignore"):
        base = np.log10(0.5) - np.log10(n_train + 0.5 * (v_train + 1))
    for whole in batches:
        kind = whole.column("kind").to_numpy()
        if (kind != TEXT).any():
            own = whole.filter(pa.array(kind != TEXT))
            values.append((own.column("kind").to_numpy(), own.column("key").to_numpy().view(np.uint64), own.column("value").to_numpy()))
        docs = whole.filter(pa.array(kind == TEXT))
        if not docs.num_rows:
            continue
        if known is None:
            kinds, keys, value = (np.concatenate(x) for x in zip(*values))
            values.clear()
            known = summed(keys[kinds == WORD], value[kinds == WORD])
            lookup = lookup or Lookup(keys[kinds == GRAM], value[kinds == GRAM])
        for batch in slices(docs, "text", 1 << 20):
            both = [coded(t) for t in texts(batch, "text")]
            n_tokens = np.array([len(tokens) for tokens, _ in both])
            words = list(set().union(*(tokens for tokens, _ in both)))
            at = np.searchsorted(known[0], np.fromiter(map(word_key, words), np.uint64, len(words)))
            counts = dict(zip(words, known[1][at].tolist()))
            c = np.fromiter((counts[w] for tokens, _ in both for w in tokens), np.float64, int(n_tokens.sum()))
            first = np.cumsum(n_tokens) - n_tokens
            token_keys, lengths = grams_of([x for _, x in both], order)
            score = np.add.reduceat(lookup(token_keys), np.cumsum(lengths) - lengths)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "held_out": pa.compute.invert(batch.column("train")),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first), pa.int64()),
                "train_tokens": pa.array(np.full(len(both), n_train), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10(2 * c + 1), first) + n_tokens * base),
                "score": pa.array(score),
            })


def short_orders(grams: DataFrame) -> ShortOrders:
    """From all grams and counts; at most 2**24 rows reach the driver."""
    pairs = grams.where("n > 0").select(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("g")).distinct()
    rows = pairs.groupBy(F.col("g").bitwiseAND(F.lit(0xFFFFFF)).alias("g")).count().toArrow()
    return ShortOrders(rows.column("g").to_numpy(), rows.column("count").to_numpy())


def score(docs: DataFrame, holdout_fold: int = 1, order: int = ORDER, split_bytes: int = SPLIT_BYTES, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    splits = n_parts(total, split_bytes)
    split = F.pmod(F.xxhash64("doc_id", "text"), F.lit(splits)).cast("int").alias("split")
    rows = docs.select(split, "doc_id", "text", (id_fold(F.col("doc_id")) != holdout_fold).alias("train"))
    # A partition for each split, so that no task gets two.
    dealt = rows.select("split", "text", "train").repartitionById(splits, F.col("split"))
    counted = written(dealt.mapInArrow(lambda it: split_counts(it, order), "split int, kind int, key long, n long"), "counts")
    model = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "model")
    words, grams = model.where(F.col("kind") == WORD), model.where(F.col("kind") == GRAM)
    n_train, v_train = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    n_grams = grams.count()
    short = spark.sparkContext.broadcast(short_orders(grams))

    def gram_values(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy().view(np.uint64)
        return pd.DataFrame({"kind": GRAM, "key": pdf["key"], "value": log_probabilities(keys, pdf["n"].to_numpy(), short.value, order)})

    ends = F.shiftrightunsigned(F.col("key"), 8).bitwiseAND(F.lit(0xFFFFFF))
    bucket = F.pmod(F.xxhash64(ends), F.lit(max(n_parts(n_grams, 100_000), 12)))
    valued = grams.select("key", "n", bucket.alias("bucket")).groupBy("bucket").applyInPandas(gram_values, "kind int, key long, value double")
    known, shared = words.select("kind", "key", F.col("n").cast("double").alias("value")), None
    if n_grams <= broadcast_grams:
        found = valued.toArrow()
        shared = spark.sparkContext.broadcast(Lookup(found.column("key").to_numpy().view(np.uint64), found.column("value").to_numpy()))
        own = counted.where(F.col("kind") == WORD)
    else:
        known, own = written(known.unionByName(valued), "values"), counted
    # A key of very many splits is split by Spark's adaptive handling of skewed joins; a partition for each split after it.
    values = own.select("split", "kind", "key").join(known, ["kind", "key"])
    both = values.unionByName(rows.withColumn("kind", F.lit(TEXT)), allowMissingColumns=True).repartitionById(splits, F.col("split")).sortWithinPartitions("kind")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.mapInArrow(lambda it: score_batches(it, shared.value if shared else None, n_train, v_train, order), schema)
