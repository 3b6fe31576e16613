import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cavern.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def samples():
    r = random.Random(1)
    alphabet = "aabcde  \n\t'sSÀéßñ中文 1234567890.,!?\x1c\x85 　🙂<|>aaaa’"
    out = ["", " ", "\n\n", "a" * 3000, "it's we'll  they've \n x", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "  lead", "trail  ", "ab" * 500]
    return out + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 200))) for _ in range(300)]


def test_ids_and_text_equal_the_library():
    lib, own = Tokenizer.from_file(PATH), bpe.ByteBPE(PATH)
    batch = samples()
    ids, counts = own.encode(batch)
    at = 0
    for text, n in zip(batch, counts):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == want, text
        assert own.decode(ids[at : at + n].astype(int), [n])[0].decode() == lib.decode(want, skip_special_tokens=False)
        at += n


def test_invalid_utf8_decodes_like_the_library():
    lib, own = Tokenizer.from_file(PATH), bpe.ByteBPE(PATH)
    ids, n = own.encode(["中🙂"])
    for k in range(int(n[0])):
        assert own.decode(ids[k:].astype(int), [n[0] - k])[0].decode() == lib.decode(ids[k:].tolist(), skip_special_tokens=False)


def test_query_over_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y"), (4, "long " * 50000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = bpe.round_trip_digests(df, PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got][:4] == [0, 2, 2, 0]
    assert got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[-1].decoded_sha256 == hashlib.sha256(b"long " * 50000).hexdigest()
    assert bpe.encode(df, PATH).columns == ["doc_id", "text", "ids"]
    assert [r.decoded or "" for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()] == [r[1] or "" for r in rows]
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0


def test_pairs_are_found_in_a_few_steps():
    own, r = bpe.ByteBPE(PATH), np.random.default_rng(4)
    assert own.longest <= 8
    for keys in [own.keys[own.keys >= 0], np.arange(5), np.arange(0)]:
        own.index(keys, keys + 1)
        asked = np.r_[keys, r.integers(0, own.size**2, 20_000)]
        at = own.look_up(asked)
        assert ((own.keys[at] == asked) == np.isin(asked, keys)).all()
        assert (own.merged[at[: len(keys)]] == keys + 1).all() and (own.ranks[at[: len(keys)]] == np.arange(len(keys))).all()
