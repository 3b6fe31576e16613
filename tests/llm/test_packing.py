import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from cavern.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunks_encode_like_whole_texts():
    lib, own = Tokenizer.from_file(PATH), packing.ChunkTokenizer(PATH)
    batch = ["", "It's  A test\x1cwith\x85odd space", "É é ́x ΣΑΣ ΣΑΣ. İx", "<|endoftext|> a<|startoftext|>b", "1234 5.6 中文🙂", "  lead and trail \n"]
    r = random.Random(1)
    batch += ["".join(r.choice("aAbBßÀéµªº½²'sStT’<|>.,;1 \n" + "\x1c\x7f\xa0\xad") for _ in range(r.randint(1, 120))) for _ in range(300)]
    ids, counts = own.encode(batch)
    at = 0
    for text, n in zip(batch, counts):
        assert ids[at : at + n].tolist() == lib.encode(text, add_special_tokens=False).ids, text
        at += n


def test_chunks_met_before_and_new_ones_in_arrow_columns(monkeypatch):
    monkeypatch.setattr(packing, "LEARNT_AT_ONCE", 7)
    monkeypatch.setattr(packing, "GATHERED_AT_ONCE", 5)
    lib, own = Tokenizer.from_file(PATH), packing.ChunkTokenizer(PATH)
    r = random.Random(3)
    words = ["plain", "It's", "Œuvre", "中文", "ÀÉ", "<|endoftext|>", "x9.", "🙂", "ﬁn"]
    for kind, limit in [(pa.string(), 600_000), (pa.large_string(), 600_000), (pa.string(), 3)]:
        monkeypatch.setattr(packing, "CACHE_CHUNKS", limit)
        for blank in [" ", "\u2003", "\x1d", " \n"]:
            batch = [None, "", *(blank.join(f"{r.choice(words)}{r.choice(['', r.randint(0, 99)])}" for _ in range(20)) for _ in range(5))]
            ids, counts = own.encode(pa.array(["gone", *batch], kind).slice(1))
            want = [lib.encode(t or "", add_special_tokens=False).ids for t in batch]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_chunks_take_few_bytes_in_a_worker():
    own, n = packing.ChunkTokenizer(PATH), 100_000
    once, often = [" ".join(f"w{i:x}" for i in range(n))], ["it " * (10 * n)]
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        own.encode(once)
        assert (tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before) / n < 80
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        own.encode(often)
        assert (tracemalloc.get_traced_memory()[1] - held) / (10 * n) < 48
    finally:
        tracemalloc.stop()


def test_cuts():
    for n in [1, 2, 63, 64, 2049, 4095, 4096, 4097, 100_003, *range(3000, 3100)]:
        parts = packing.cut(n)
        assert sum(parts) == n and all(0 < p <= 4096 for p in parts)
        assert all(4096 / (4096 // p) - p <= 4096 / (4096 // p) / 64 + 1 for p in parts)


def test_every_id_once_and_little_padding(spark):
    r = np.random.default_rng(2)
    vocab = ["alpha", "Beta", "gamma-ray", "it's", "42", "Ünïcode"]
    rows = [(i, " ".join(r.choice(vocab, r.integers(0, 900)))) for i in range(150)] + [(None, None), (5, ""), (77, "word " * 9000), (77, "word " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(df, PATH).collect()
    lib = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2]))
    seqs = defaultdict(list)
    for x in got:
        assert any(len(d) == x.doc_tokens and zlib.crc32(d[x.start : x.start + x.length].astype("<u4").tobytes()) == x.ids_crc32 for d in want[x.doc_id])
        seqs[x.sequence_id].append((x.offset, x.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(d) for ds in want.values() for d in ds)
    assert sum(x.length for x in got) == total
    assert len(seqs) * 4096 < 1.05 * total + 4096
    assert sorted(seqs) == list(range(len(seqs)))
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
