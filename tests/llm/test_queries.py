"""Each query over the whole smallest tables, against SQL or brute force."""

import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cavern.llm.queries import QUERIES, SQL

from .test_ppm import expected, plain_scores
from .test_sharding import check
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, duck, name):
    df, own = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(own.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(own.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())


def test_bpe(spark, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op1_bpe"](spark, SF).collect())) == sorted(want)


def test_sharding(spark, docs):
    got = QUERIES["op2_sharding"](spark, SF).collect()
    check(docs, got, 16)


def test_packing(spark, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs}
    at = {i: 0 for i in want}
    got = QUERIES["op4_packing"](spark, SF).collect()
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
    assert at == {i: len(w) for i, w in want.items()}
    total = sum(at.values())
    assert len({r.sequence_id for r in got}) * 4096 < total * 1.05 + 4096


def test_lm_scoring(spark, docs):
    got = QUERIES["op7_lm_scoring"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected(docs)
    assert np.allclose([r.score for r in sorted(got, key=lambda r: r.doc_id)], [x for _, x in plain_scores(docs)])


def test_simhash(spark, docs):
    docs = sorted(docs)
    fps = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(fps, 4)
    want = [(i, f"{f:016x}", docs[r][0]) for (i, _), f, r in zip(docs, fps, roots)]
    assert sorted(map(tuple, QUERIES["op8_simhash"](spark, SF).collect())) == want
