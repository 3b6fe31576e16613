"""Operator 6: removal of passages that an earlier document has, by patience alignment of pairs of documents.

A document is its lines that hold words. The runs of neighbouring lines from each line on and back from each line,
just long enough for `min_words` words, are hashed with 128 bits; such runs are rare where single lines need not be. A later document with a
run is paired with the earliest document that has it, so that a passage finds a partner whatever other documents
hold its lines alone, and a run of very many documents makes one pair for each, never all pairs. The whole lines of
both are aligned as patience diff does: lines that either has once are anchors, the chain of most words in the order
of both is kept, and its matches are extended over equal neighbours; what lies between is aligned likewise, from the
longest common run where no line is left that either has once. Blocks of `min_words` words or more are deleted from the
later document. Runs that the pair shares but the alignment can't hold, because they stand in another order, are
extended and deleted in their place. So a line goes if, and only if, it stands in a run of `min_words` words or more
that some earlier document has too.

Documents are ordered by doc_id, nulls first, then by a hash of id and text. Words are what Unicode white space parts.
Defined cases: a null text stays null and an empty one empty; lines without words are never compared, stay, and don't
interrupt a passage; rows that repeat both doc_id and text are one document and all get its result; a document all of
whose lines go is kept with an empty text; what repeats only within one document is left; an empty table gives an
empty result. Columns of the input named like an output are replaced, all others kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, texts, written

#: Words from which a block is a passage.
MIN_WORDS = 20
#: Later documents of one source that are dealt out together.
SOURCE_ROWS = 2_048
#: A digest's bytes.
DIGEST = 16
#: What is written of a document's lines and runs.
COLUMNS, HASHES = ("positions", "words", "lines", "first", "second", "begins", "sizes"), {"lines", "first", "second"}


def longest_chain(numbers: list[int], weights: list[int]) -> list[int]:
    """Indices of the strictly increasing subsequence of the largest weight, by piles that a heavier card covers."""
    tops: list[int] = []  # the last numbers of chains, increasing, and so are the chains' weights
    cards: list[int] = []
    total: list[int] = []
    back: list[int] = []
    for k, x in enumerate(numbers):
        at = bisect_left(tops, x)
        back.append(cards[at - 1] if at else -1)
        total.append(weights[k] + (total[back[k]] if at else 0))
        if at < len(tops) and tops[at] == x and total[cards[at]] >= total[k]:
            continue
        end = at
        while end < len(tops) and total[cards[end]] <= total[k]:
            end += 1
        tops[at:end], cards[at:end] = [x], [k]
    chain, k = [], cards[-1] if cards else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    return chain[::-1]


def longest_run(d: list, e: list, words: list[int], d0: int, d1: int, e0: int, e1: int) -> tuple[int, int] | None:
    """Where a common run of the most words begins in both ranges; the first of equal ones."""
    places: dict = {}
    for j in range(e0, e1):
        places.setdefault(e[j], []).append(j)
    best, most, before = None, 0, {}
    for i in range(d0, d1):
        now = {}
        for j in places.get(d[i], ()):
            start, own = before.get(j - 1, (i, 0))
            now[j] = start, own + words[i]
            if now[j][1] > most:
                most, best = now[j][1], (start, j - (i - start))
        before = now
    return best


def patience(d: list, e: list, words: list[int]) -> list[tuple[int, int, int]]:
    """The aligned blocks (place in d, place in e, lines), in the order of both; words are those of d's lines."""
    out = []
    todo = [(0, len(d), 0, len(e))]
    while todo:
        d0, d1, e0, e1 = todo.pop()
        here, there = Counter(d[d0:d1]), Counter(e[e0:e1])
        place = {x: j for j, x in enumerate(e[e0:e1], e0) if there[x] == 1}
        anchors = [(i, place[x]) for i, x in enumerate(d[d0:d1], d0) if here[x] == 1 and x in place]
        if anchors:
            anchors = [anchors[k] for k in longest_chain([j for _, j in anchors], [words[i] for i, _ in anchors])]
        elif here.keys() & there.keys():
            anchors = [longest_run(d, e, words, d0, d1, e0, e1)]
        i1, j1 = d0, e0  # the end of the last block
        for i, j in anchors:
            if i < i1:
                continue  # within a block already
            n = 0
            while i > i1 and j > j1 and d[i - 1] == e[j - 1]:
                i, j, n = i - 1, j - 1, n + 1
            while i + n < d1 and j + n < e1 and d[i + n] == e[j + n]:
                n += 1
            out.append((i, j, n))
            if i > i1 and j > j1:
                todo.append((i1, i, j1, j))
            i1, j1 = i + n, j + n
        if anchors and d1 > i1 and e1 > j1:
            todo.append((i1, d1, j1, e1))
    # Blocks found in different ranges may meet.
    whole: list[tuple[int, int, int]] = []
    for i, j, n in sorted(out):
        if whole and whole[-1][0] + whole[-1][2] == i and whole[-1][1] + whole[-1][2] == j:
            i, j, n = whole[-1][0], whole[-1][1], whole.pop()[2] + n
        whole.append((i, j, n))
    return whole


def removed_lines(d: list, words: list[int], d_runs: list, d_begins: list[int], d_sizes: list[int], e: list, e_runs: list, e_begins: list[int], min_words: int) -> list[int]:
    """Places of the later document's lines that go; runs are the hashes of runs just long enough, with their first places and lines."""
    begins = dict(zip(e_runs, e_begins))
    shared = [(i, begins[x], n) for x, i, n in zip(d_runs, d_begins, d_sizes) if x in begins]
    if not shared:
        return []
    ends = np.r_[0, np.cumsum(words)].tolist()
    gone = np.zeros(len(d), bool)
    for i, _, n in patience(d, e, words):
        if ends[i + n] - ends[i] >= min_words:
            gone[i : i + n] = True
    # Passages in another order than the alignment's.
    for i, j, n in shared:
        if not gone[i : i + n].all() and d[i : i + n] == e[j : j + n]:
            gone[i : i + n] = True
    return np.flatnonzero(gone).tolist()


def runs_of(words: list[int], min_words: int) -> np.ndarray:
    """[run, (first place, end)] of the shortest runs of min_words words from each place on, and back from each place."""
    ends = np.r_[0, np.cumsum(words, dtype=np.int64)]
    until = np.searchsorted(ends, ends[:-1] + min_words)
    since = np.searchsorted(ends, ends[1:] - min_words, "right") - 1
    places = np.arange(len(words))
    on, back = until <= len(words), since >= 0
    found = np.r_[np.stack([places, until], 1)[on], np.stack([since, places + 1], 1)[back]]
    return np.unique(found, axis=0) if len(found) else found


def line_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc, text) to the lines with words (positions, words, hashes) and the runs (two halves of a hash, first place, lines)."""
    for whole in batches:
        for batch in slices(whole, "text"):
            rows: list[tuple] = []
            for text in texts(batch, "text"):
                lines = text.split("\n")
                words = [len(x.split()) for x in lines]
                at = [k for k, n in enumerate(words) if n]
                words = [words[k] for k in at]
                digests = b"".join([xxhash.xxh3_128_digest(lines[k].encode()) for k in at])
                runs = runs_of(words, min_words)
                halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(digests[DIGEST * a : DIGEST * b]) for a, b in runs.tolist()]), np.int64).reshape(-1, 2)
                rows.append((at, words, np.frombuffer(digests, np.int64)[::2], halves[:, 0], halves[:, 1], runs[:, 0], runs[:, 1] - runs[:, 0]))
            columns = [pa.array(c, pa.list_(pa.int64() if name in HASHES else pa.int32())) for name, c in zip(COLUMNS, zip(*rows))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), *columns], names=["doc_id", "doc", *COLUMNS])


def align_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[p[k] for k in removed_lines(*own, min_words)] for p, *own in zip(*(batch.column(c).to_pylist() for c in ("positions", "lines", "words", "first", "begins", "sizes", "e_lines", "e_first", "e_begins")))]
        out = pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.list_(pa.int32()))], names=["doc", "removed"])
        yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))


def union_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a document loses by each of its pairs, to all it loses: the positions, and a flag for each position up to the last."""
    for batch in batches:
        found = [np.unique(np.concatenate(x)) for x in batch.column("removed").to_pylist()]
        flags = [np.isin(np.arange(x[-1] + 1), x, assume_unique=True) for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.list_(pa.int32())), pa.array(flags, pa.list_(pa.bool_()))], names=["doc", "removed_lines", "flags"])


def removals(docs: DataFrame, min_words: int = MIN_WORDS, source_rows: int = SOURCE_ROWS) -> DataFrame:
    """doc, the hash of doc_id and text, the positions of its lines that go and a flag for each; only documents that lose some."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, doc long, " + ", ".join(f"{c} array<{'long' if c in HASHES else 'int'}>" for c in COLUMNS)
    lined = written(keyed.mapInArrow(lambda it: line_batches(it, min_words), schema), "lines")
    runs = lined.select("doc_id", "doc", F.explode(F.arrays_zip("first", "second")).alias("run")).select("doc_id", "doc", "run.*")
    earliest = F.min(F.struct("doc_id", "doc")).alias("earliest")
    shared = runs.groupBy("first", "second").agg(earliest, F.max(F.struct("doc_id", "doc")).alias("latest"))
    # Written, so that the joins below have plain exchanges on both sides, and a run or source of very many documents can be split.
    shared = checkpointed(shared.where("earliest.doc <> latest.doc").select("first", "second", F.col("earliest.doc").alias("source")))
    pairs = checkpointed(runs.join(shared, ["first", "second"]).where("doc <> source").select("doc", "source").distinct())
    # A source of very many documents is dealt out in parts, its lines to each.
    hot = pairs.groupBy("source").count().where(F.col("count") > source_rows).select("source", F.ceil(F.col("count") / source_rows).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    pairs = pairs.join(hot, "source", "left").select("doc", "source", F.pmod(F.xxhash64("doc"), parts).cast("int").alias("part"))
    own = lined.drop("doc_id", "second").dropDuplicates(["doc"])
    sources = own.select(F.col("doc").alias("source"), F.col("lines").alias("e_lines"), F.col("first").alias("e_first"), F.col("begins").alias("e_begins"))
    sources = sources.join(hot, "source", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    aligned = pairs.join(own, "doc").join(sources, ["source", "part"]).mapInArrow(lambda it: align_batches(it, min_words), "doc long, removed array<int>")
    later = aligned.groupBy("doc").agg(F.collect_list("removed").alias("removed"))
    return later.mapInArrow(union_batches, "doc long, removed_lines array<int>, flags array<boolean>")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the passages removed from `text`; `removed_lines` has their positions (none: an empty list)."""
    kept = [c for c in docs.columns if c.lower() != "removed_lines"]
    gone = removals(docs, min_words).select(F.col("doc").alias("__doc"), F.col("removed_lines").alias("__removed"), F.col("flags").alias("__flags"))
    joined = docs.select(*kept, F.xxhash64("doc_id", "text").alias("__doc")).join(gone, "__doc", "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda _, k: ~F.coalesce(F.get("__flags", k), F.lit(False))), "\n")
    text = F.when(F.col("__flags").isNull(), F.col("text")).otherwise(rest).alias("text")
    removed = F.coalesce("__removed", F.array().cast("array<int>")).alias("removed_lines")
    return joined.select(*(text if c == "text" else F.col(f"`{c}`") for c in kept), removed)


#: What is no word, for SQL (fixed values): Unicode white space and the four separators of ASCII.
NO_WORD = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The rows of op6_line_dedup by brute force: equal lines of all pairs of documents, in runs at one distance.
SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^{NO_WORD}]+')) AS words FROM l
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM w WHERE words > 0
), m AS (
  SELECT d.doc_id, e.doc_id AS source, d.pos, d.words, d.place, d.place - e.place AS away
  FROM n AS d JOIN n AS e ON d.line = e.line AND d.doc_id > e.doc_id
), b AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id, source, away ORDER BY place) AS block FROM m
), g AS (
  SELECT DISTINCT doc_id, pos FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, source, away, block) AS total FROM b) WHERE total >= {MIN_WORDS}
), k AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS n_removed
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_removed, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)
"""
