"""Variants against comparing all words with each other; what the filters let through."""

import random

import plain
import pytest

from runsignal.llm.spelling import Spelling, filters, letters, near_pairs, spelling_variants

SCHEMA = "doc_id long, text string"


def corpus(seed=1, n=80):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abéÿÀ") for _ in range(rnd.randint(6, 11))) for _ in range(12)]
    out = []
    for d in range(n):
        x = []
        for _ in range(rnd.randint(0, 40)):
            w = list(stems[int(rnd.random() ** 3 * 12)])
            if rnd.random() < 0.3:
                i = rnd.randrange(len(w))
                w[i : i + rnd.randint(0, 1)] = [rnd.choice("abzÿß×")][: rnd.randint(0, 1)]
            x.append("".join(w) if rnd.random() < 0.9 else "".join(w).upper())
        out.append((d, rnd.choice((" ", "1", "_\n")).join(x)))
    return out + [(n, None), (n + 1, ""), (n + 2, "q" * 300 + " " + "q" * 299 + " " + "q" * 300 + " " + "q" * 299), (None, "nullnull nullnull nullnulll")]


@pytest.mark.parametrize("cfg", [Spelling(), Spelling(bits=1, most=64 * 70), Spelling(drop=3, shards=8, probes=64), Spelling(least=4, drop=0, ratio=2)])
def test_variants(spark, cfg):
    docs = corpus()
    df = spark.createDataFrame([(*r, "w", 1) for r in docs], SCHEMA + ", word string, n long").repartition(4)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df, cfg).collect()}
    want = plain.spellings(docs, cfg.least, cfg.times, cfg.ratio, cfg.drop)
    assert got == want and sum(x[0] is not None for x in got.values()) > 3


def test_filters_hold_all_and_little_else(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(7, 12))) for _ in range(20_000)})
    lines = filters(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), Spelling())
    import numpy as np
    import pyarrow as pa

    from runsignal.llm.spelling import _CODE
    from runsignal.llm.words import Powers

    up = Powers().upto(64)[0]
    others = ["z" + w[1:] for w in words]
    for group, least, most in ((words, 1, 1), (others, 0, 0.01)):
        hits = total = 0
        for _, x in letters(pa.array(group)):
            n = x.shape[1]
            hits += len(lines.may_hold((_CODE[x] * up[:n]).sum(1, dtype=np.uint64), n))
            total += len(x)
        assert least <= hits / total <= most


def test_a_chain_of_forms(spark):
    words = [("abcdefgh", 1000), ("abcdefgi", 100), ("abcdefji", 10), ("abcdekji", 1), ("abcdefg", 9)]
    text = " ".join(" ".join([w] * n) for w, n in words)
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling_variants(spark.createDataFrame([(1, text)], SCHEMA), Spelling(times=1, drop=0)).collect()}
    assert got == {"abcdefgh": (None, "abcdefgh", 2), "abcdefgi": ("abcdefgh", "abcdefgh", 3), "abcdefji": ("abcdefgi", "abcdefgh", 2), "abcdekji": ("abcdefji", "abcdefgh", 1), "abcdefg": ("abcdefgh", "abcdefgh", 2)}


def test_no_rows(spark):
    empty = spelling_variants(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
    assert near_pairs(spark.createDataFrame([], "word string, n long"), Spelling()).count() == 0
