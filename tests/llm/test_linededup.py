import random

import pytest

from cavern.llm import linededup


def plain(rows, min_words):
    """Of each document, all runs of equal lines at one distance with each earlier document, by brute force."""
    rows = sorted({(i, t) for i, t in rows if t is not None})
    own = [[(p, x) for p, x in enumerate(t.split("\n")) if x.split()] for _, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        gone = set()
        for e in own[:k]:
            for a in range(len(own[k])):
                for b in range(len(e)):
                    n = 0
                    while a + n < len(own[k]) and b + n < len(e) and own[k][a + n][1] == e[b + n][1]:
                        n += 1
                    if sum(len(x.split()) for _, x in own[k][a : a + n]) >= min_words:
                        gone |= {p for p, _ in own[k][a : a + n]}
        out[i, t] = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    return out


def dedup(spark, rows, min_words=linededup.MIN_WORDS):
    return {x.doc_id: x.text for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words).collect()}


def line(name, words):
    return " ".join(f"{name}{k}" for k in range(words))


def test_longest_chain_by_words():
    assert linededup.longest_chain([3, 1, 4, 2, 5], [1] * 5) in ([0, 2, 4], [1, 2, 4], [1, 3, 4])
    assert linededup.longest_chain([5, 1, 2, 3], [9, 1, 1, 1]) == [0] and linededup.longest_chain([], []) == []
    r = random.Random(2)
    for _ in range(300):
        n = [r.randrange(8) for _ in range(8)]
        w = [r.randint(1, 5) for _ in n]
        best = max(sum(w[k] for k in range(8) if s >> k & 1) for s in range(256) if all(n[a] < n[b] for a in range(8) for b in range(a + 1, 8) if s >> a & 1 and s >> b & 1))
        chain = linededup.longest_chain(n, w)
        assert sum(w[k] for k in chain) == best and all(n[a] < n[b] for a, b in zip(chain, chain[1:]))


def test_alignment_keeps_the_chain_of_most_words():
    d, e = list("xpqrs"), list("pqrsx")
    assert linededup.patience(d, e, [1] * 5) == [(1, 0, 4)]
    assert linededup.patience(d, e, [9, 1, 1, 1, 1]) == [(0, 4, 1)]
    # Repeated lines go with their neighbours: the second a of the source belongs to b.
    assert linededup.patience(list("ab"), list("axab"), [1, 1]) == [(0, 2, 2)]
    assert linededup.patience(list("aabb"), list("xaabbaa"), [1] * 4) == [(0, 1, 4)]
    assert linededup.patience(list("ab"), list("cd"), [1, 1]) == [] == linededup.patience([], list("a"), [])


def test_a_chain_of_one_would_lose_the_alignment(monkeypatch):
    d, e = list("xpqrs"), list("pqrsx")
    monkeypatch.setattr(linededup, "longest_chain", lambda numbers, weights: [0])
    assert linededup.patience(d, e, [1] * 5) != [(1, 0, 4)]


def test_passages_whose_lines_others_hold(spark):
    a, b, own = line("a", 10), line("b", 14), line("own", 30)
    got = dedup(spark, [(1, a), (2, f"{a}\n{b}"), (3, f"{own}\n{a}\n{b}")])
    assert got == {1: a, 2: f"{a}\n{b}", 3: own}
    got = dedup(spark, [(1, f"{a}\nx\n{a}\n{b}"), (2, f"{a}\n{b}\nend")])
    assert got[2] == "end"
    seven = [line(f"s{k}x", 10) for k in range(7)]
    rows = [(k + 1, f"first {k}\n{seven[2 * k]}\nlast {k}") for k in range(3)] + [(4, "\n".join(["own"] + seven)), (5, "\n".join(seven + ["mine"]))]
    assert dedup(spark, rows)[5] == "mine"
    # Two passages in another order, with blank lines and tabs.
    p, q = line("p", 60).replace(" ", "\t"), line("q", 30).replace(" ", " ")
    assert dedup(spark, [(1, f"{p}\n\n{q}"), (2, f"{q}\n \t\nbetween\n{p}")])[2] == " \t\nbetween"


def test_equals_brute_force(spark):
    r = random.Random(4)
    pool = [" ".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) + str(k % 40) for k in range(40)] + ["", " ", "\t"]
    passages = [[r.choice(pool) for _ in range(r.randint(2, 5))] for _ in range(12)]
    rows = [(i, "\n".join(x for _ in range(r.randint(0, 5)) for x in (r.choice(passages) if r.random() < 0.6 else [r.choice(pool)]))) for i in range(250)]
    long = max((t for _, t in rows), key=len)
    rows += [(9, rows[9][1]), (900, None), (901, ""), (903, long), (902, "\n".join(long.split("\n")[::-1]))]
    df = spark.createDataFrame([(*x, [1], "a", 2) for x in rows], "doc_id long, text string, Removed_Lines array<int>, doc string, flags int")
    want = plain(rows, 12)
    got = linededup.dedup_lines(df, 12).collect()
    assert len(got) == len(rows) and got[0].doc == "a" and got[0].flags == 2
    by_id = {x.doc_id: x.text for x in got}
    assert all(by_id[i] == (None if t is None else want[i, t]) for i, t in rows)
    assert sum(t is not None and want[i, t] != t for i, t in rows) > 50
    assert not by_id[903].strip() and linededup.dedup_lines(df.limit(0)).count() == 0


def test_null_ids_and_long_texts(spark):
    passage = line("word", 60)
    df = spark.createDataFrame([(None, f"x\n{passage}"), (2, f"{passage}\nown line"), (2, f"{passage}\nown line"), (1, "own line")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.text) for x in linededup.dedup_lines(df).collect())
    assert got == [(0, f"x\n{passage}"), (1, "own line"), (2, "own line"), (2, "own line")]
    long = "\n".join(line(f"l{k}x", 5) for k in range(40_000))
    same = "\n".join(["over and over"] * 3_000)
    got = dedup(spark, [(1, long), (2, f"start\n{long}"), (3, f"{same}\nend"), (4, f"{same}\nlast")])
    assert got == {1: long, 2: "start", 3: f"{same}\nend", 4: "last"}


@pytest.mark.parametrize("text", ["", None])
def test_empty_texts(spark, text):
    assert dedup(spark, [(1, text), (2, text)]) == {1: text, 2: text}


def test_a_source_of_many_documents_is_dealt_in_parts(spark):
    rows = [(k, f"{line('p', 30)}\nown {k}") for k in range(40)]
    gone = linededup.removals(spark.createDataFrame(rows, "doc_id long, text string"), source_rows=3).collect()
    assert len(gone) == 39 and all(x.removed_lines == [0] for x in gone)
