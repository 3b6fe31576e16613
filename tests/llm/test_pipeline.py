import corpus_pipeline as cp
from cavern.llm import packing, simhash

from .test_linededup import plain
from .test_simhash import plain_components, plain_wide


def tables(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"own line {i} alpha beta\n" + " ".join(f"w{i}x{k}" for k in range(30 + i)), "en", "s", 5) for i in range(60)]
    rows += [(100, rows[3][1], "en", "s", 5), (101, f"{passage}\nfirst", "en", "s", 1), (102, f"second\n{passage}", "en", None, 1), (103, "", None, "s", 0), (104, None, None, None, None), (None, "no id here at all", "en", "s", 2)]
    rows += [(200 + i, f"oaf nitwit oaf w{i} " * 3, "en", "s", 9) for i in range(20)] + [(103, "", None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 1) for i in range(20)]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, str(tmp_path)


def test_stages_equal_brute_force(spark, tmp_path):
    rows, d = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, d)
    assert clean.columns == docs.columns
    kept = [tuple(r) for r in clean.collect()]
    assert sorted(kept, key=str) == sorted((r for r in rows if r[0] is None or r[0] < 200), key=str)
    lined = [tuple(r) for r in cp.drop_repeated_passages(spark, clean, d).collect()]
    want = plain([(-1 if i is None else i, t) for i, t, *_ in kept], 20)
    assert sorted(((-1 if i is None else i, t) for i, t, *_ in lined), key=str) == sorted(((-1 if i is None else i, None if t is None else want[-1 if i is None else i, t]) for i, t, *_ in kept), key=str)
    assert all(n == len(t) for i, t, _, _, n in lined if i in (100, 102))
    df = spark.createDataFrame(lined, docs.schema)
    near = cp.drop_near_duplicates(spark, df, d)
    assert near.columns == docs.columns
    own = sorted(lined, key=lambda r: (r[0] is None, r[0] or 0))
    roots = plain_components([plain_wide(r[1], cp.SHINGLE_WORDS) for r in own], simhash.similar_radius(cp.SIMILARITY))
    assert sorted((r.doc_id for r in near.collect()), key=str) == sorted((own[k][0] for k in set(roots)), key=str)


def test_run_packs_what_is_left(spark, tmp_path):
    rows, d = tables(spark, tmp_path)
    got = cp.run(spark, d).collect()
    ids = {r.doc_id for r in got}
    assert 3 in ids and 100 in ids and not ids & set(range(200, 220)) and None in ids
    assert max(r.offset + r.length for r in got) <= packing.CAPACITY


def test_empty_tables(spark, tmp_path):
    rows, d = tables(spark, tmp_path)
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, d).count() == 0
