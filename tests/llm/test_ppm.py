import zlib
from collections import Counter

import numpy as np

from cavern.llm import ppm


def grams_table(texts):
    keys, n = np.unique(ppm.grams_of([ppm.coded(t)[1] for t in texts])[0], return_counts=True)
    return dict(zip(keys.tolist(), n.tolist()))


def plain_log10(train, context, symbol, order=ppm.ORDER):
    """The probability by walking the contexts one at a time; train: counts by (context bytes, symbol), longest order."""
    counts = [Counter(train)]
    for k in range(order, 0, -1):
        counts.append(Counter((c[1:], s) for (c, s), n in counts[-1].items() if n))
    refused, out = set(), 0.0
    for k, table in zip(range(order, -1, -1), counts):
        here = {s: n for (c, s), n in table.items() if c == context[order - k :] and s not in refused}
        total = sum(here.values())
        if not total:
            continue
        if symbol in here:
            return out + np.log10((2 * here[symbol] - 1) / (2 * total))
        out += np.log10(len(here) / (2 * total))
        refused |= here.keys()
    return out - np.log10(ppm.SYMBOLS - len(refused))


def test_model_equals_plain_walk():
    train = ["the cat sat on the mat", "The dog sat", "", "on the dot the cat"]
    held = ["the cow sat", "zebra on the mat é"]
    table = grams_table(train)
    keys = np.array(sorted({*table, *grams_table(held)}), np.uint64)
    n = np.array([table.get(int(k), 0) for k in keys])
    seen, counts = np.unique(np.unique(keys[n > 0] & np.uint64(0xFFFFFFFF)) & np.uint64(0xFFFFFF), return_counts=True)
    got = ppm.log_probabilities(keys, n, ppm.ShortOrders(seen.astype(np.int64), counts))
    plain = {(int(k).to_bytes(6, "big")[:5], int(k) & 255): table[int(k)] for k in keys if table.get(int(k))}
    for k, p in zip(keys.tolist(), got):
        raw = k.to_bytes(6, "big")
        assert abs(p - plain_log10(plain, raw[:5], raw[5])) < 1e-9
    assert np.array_equal(ppm.Lookup(keys, got)(keys[::-1]), got[::-1])


def plain_scores(rows):
    """Each document's log10 probability: the trie as dictionaries, walked gram by gram from the longest context."""
    train = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            data = bytes([ppm.BEFORE]) * ppm.ORDER + ppm.coded(t or "")[1]
            train.update((data[k - ppm.ORDER : k], data[k]) for k in range(ppm.ORDER, len(data)))
    orders = [train]
    for _ in range(ppm.ORDER):
        orders.append(Counter((c[1:], s) for c, s in orders[-1]))
    tries = []
    for table in orders:
        trie = {}
        for (c, s), n in table.items():
            trie.setdefault(c, {})[s] = n
        tries.append(trie)
    cache = {}

    def one(context, symbol):
        refused, out = set(), 0.0
        for k, trie in enumerate(tries):
            here = {s: n for s, n in trie.get(context[k:], {}).items() if s not in refused}
            if not here:
                continue
            total = 2 * sum(here.values())
            if symbol in here:
                return out + np.log10((2 * here[symbol] - 1) / total)
            out += np.log10(len(here) / total)
            refused |= here.keys()
        return out - np.log10(ppm.SYMBOLS - len(refused))

    out = []
    for i, t in rows:
        data, score = bytes([ppm.BEFORE]) * ppm.ORDER + ppm.coded(t or "")[1], 0.0
        for k in range(ppm.ORDER, len(data)):
            gram = data[k - ppm.ORDER : k + 1]
            if gram not in cache:
                cache[gram] = one(gram[:-1], gram[-1])
            score += cache[gram]
        out.append((-1 if i is None else i, score))
    return sorted(out)


def expected(rows):
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for t in train for w in ppm.coded(t or "")[0])
    total, distinct = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        tokens = ppm.coded(t or "")[0]
        base = sum(np.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        out.append((-1 if i is None else i, len(tokens), sum(c[w] > 0 for w in tokens), total, round(base, 6)))
    return sorted(out)


def test_query_on_both_paths(spark):
    r = np.random.default_rng(4)
    vocab = ["the", "cat", "Sat", "on", "mat,", "é", "x" * 30, "dog"]
    rows = [(int(i), " ".join(r.choice(vocab, r.integers(0, 40)))) for i in range(60)] + [(None, None), (3, ""), (4, "a\n\tb  C"), (4, "a\n\tb  C")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = [ppm.score(df, split_bytes=b, broadcast_grams=g).collect() for b, g in ((1 << 20, 10**6), (100, 0))]
    for got in both:
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == expected(rows)
        assert all(x.score < 0 for x in got)
    key = lambda x: (-1 if x.doc_id is None else x.doc_id, round(x.score, 9))
    assert sorted(map(key, both[0])) == sorted(map(key, both[1]))
    assert np.allclose([s for _, s in sorted((-1 if x.doc_id is None else x.doc_id, x.score) for x in both[0])], [s for _, s in plain_scores(rows)])
    assert ppm.score(df.limit(0)).count() == 0
    assert {x.train_tokens for x in ppm.score(df.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")).collect()} == {0}


def test_long_texts_and_clashing_columns(spark):
    long = "some words of a long text " * 60_000
    rows = [(1, long, 5, "k", 0.5), (2, "a b", 6, "l", None), (4, None, 7, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, split int, kind string, value double")
    got = {x.doc_id: x for x in ppm.score(df).collect()}
    assert got[1].n_tokens == 360_001 and got[4].n_tokens == 1
    assert np.allclose([got[i].score for i in (1, 2, 4)], [s for _, s in plain_scores([r[:2] for r in rows])])
