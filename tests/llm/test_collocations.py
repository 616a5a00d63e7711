"""Filters against plain counting; phrases against a plain version, over both ways of giving ids."""

import random
from collections import Counter

import numpy as np
import pytest

import plain
from runsignal.llm.collocations import Phrases, collocations
from runsignal.llm.quotient import Packing, Sum, summed


@pytest.mark.parametrize("n,bits,parts", [(2, 1, 0), (2, 17, 5), (3, 21, 8), (3, 22, 3), (4, 16, 6), (4, 17, 6), (4, 31, 11), (2, 31, 40)])
def test_filters_lose_nothing(n, bits, parts):
    rng = np.random.default_rng(n * bits)
    ids = rng.integers(0, 1 << bits, (n, 5000), dtype=np.uint64)
    ids[:, :2000] = ids[:, 2000:4000]
    ids[:, :700] = ids[:, :1]
    packing = Packing(n, bits, parts)
    assert (packing.ids(packing.keys(ids)) == ids).all()
    want, total = Counter(map(tuple, ids.T.tolist())), {}
    for half in (ids[:, :3000], ids[:, 3000:]):
        key, a = summed([packing.keys(half)], [np.ones(half.shape[1], np.uint64)])
        part = packing.part(key)
        for p in np.unique(part):
            data = packing.filter(key[:, part == p], a[part == p])
            total.setdefault(int(p), Sum(least=10)).add(*packing.entries(int(p), data))
    got = Counter()
    for p, s in total.items():
        key, a = s.merge()
        got.update(dict(zip(map(tuple, packing.ids(key).T.tolist()), a.tolist())))
    assert got == want


def test_filters_are_smaller_than_their_keys():
    ids = np.random.default_rng(1).integers(0, 1 << 17, (2, 200_000), dtype=np.uint64)
    packing = Packing(2, 17, 0)
    key, a = summed([packing.keys(ids)], [np.ones(200_000, np.uint64)])
    assert len(packing.filter(key, a)) < 3 * len(a)


def texts(seed, n):
    rnd = random.Random(seed)
    w = ["The", "the", "of", "é", " x", "new", "york", "city", "a-b", "日本"]
    common = ["new york city hall", "New York", "of the", "a\tb  c", "x " * 9]
    out = []
    for _ in range(n):
        x = [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(w) + rnd.choice(("", "", str(rnd.randrange(9)))) for _ in range(rnd.randrange(40))]
        out.append("".join(y + rnd.choice((" ", " ", " ", "\t ", ". ", "\n", ",", "!?")) for y in x))
    return out


@pytest.mark.parametrize("cfg", [Phrases(least=5, top=40), Phrases(least=5, top=40, send=0), Phrases(least=3, top=1000, buffer=50), Phrases(least=2, longest=2)])
def test_phrases(spark, cfg):
    rows = [(t, (None, "en", "fr", "en")[i % 4], "x", i) for i, t in enumerate(texts(3, 120) + [None, "", " .\n", "one"] + ["go on and on " * 2000])]
    df = spark.createDataFrame(rows, "text string, lang string, word string, id long").repartition(5)
    want = plain.collocations([(r[0], r[1]) for r in rows], cfg.least, cfg.longest, cfg.top)
    got = sorted(tuple(r) for r in collocations(df, cfg).collect())
    assert got == sorted(want) and len(got) > 20


def test_no_rows(spark):
    empty = collocations(spark.createDataFrame([], "text string, lang string"))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0
