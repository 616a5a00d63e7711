"""Near-duplicate groups against all pairs, on texts around the threshold and on odd rows."""

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from runsignal.llm import components as cc
from runsignal.llm.components import components
from runsignal.llm.neardup import NearDup, least_matches, near_groups, prefix_pairs
from runsignal.llm.scratch import written

SCHEMA = "doc_id long, text string"


def family(rnd, words, n, copies, most):
    """A text and copies of it with some words dropped, replaced or added."""
    base = [rnd.choice(words) for _ in range(n)]
    out = [base]
    for _ in range(copies):
        x = list(rnd.choice((base, out[-1])))
        for _ in range(rnd.randint(0, most)):
            i = rnd.randrange(len(x))
            kind = rnd.randrange(3)
            if kind == 0:
                x[i] = rnd.choice(words)
            elif kind == 1:
                x.insert(i, rnd.choice(words))
            elif len(x) > 1:
                x.pop(i)
        out.append(x)
    return [" ".join(x) for x in out]


def test_equals_all_pairs(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for n, copies, most in ((120, 60, 8), (60, 40, 4), (15, 20, 1), (300, 10, 30)) for t in family(rnd, words, n, copies, most)]
    texts += [" ".join(rnd.choice(words) for _ in range(50)) for _ in range(30)]
    texts += [texts[0].upper(), "", " \t\n ", None, "one", "One", "one two", "a b c d", "a b c d"]
    rnd.shuffle(texts)
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(spark.createDataFrame(docs, SCHEMA), NearDup(shingle=4)).collect()}
    assert got == plain.components(docs, 4, 80)


def test_odd_rows(spark):
    rows = [(1, "same text here now please", 5), (2, "same text here now please", 6), (2, "same text here now please", 6), (None, "same text here now please", 7), (4, None, None), (5, "", 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", label long").selectExpr("*", "1 AS hub", "2 AS component_id")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_groups(df).collect())
    assert got == [(0, 1, None, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True)]
    empty = near_groups(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_long_chain_is_one_component(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in random.Random(1).sample(range(n), n)], "a long, b long")
    assert {(r.id, r.label) for r in components(links).collect()} == {(i, 0) for i in range(n + 1)}


@pytest.mark.parametrize("links,rounds", [([(i, 0) for i in range(1, 9)], 0), ([(9, i) for i in range(1, 9)] + [(20, 21)], 1)])
@pytest.mark.parametrize("send", [500_000, 0])
def test_stars_need_no_further_round(spark, monkeypatch, links, rounds, send):
    names = []
    monkeypatch.setattr(cc, "written", lambda df, name: names.append(name) or written(df, name))
    got = {(r.id, r.label) for r in components(spark.createDataFrame(links, "a long, b long"), send).collect()}
    assert got == ({(i, 0) for i in range(9)} if not rounds else {(i, 1) for i in range(1, 10)} | {(20, 20), (21, 20)})
    assert names == ["edges", *["large", "small"] * rounds]


def test_sequential_test_keeps_what_is_similar():
    cfg, rng = NearDup(), np.random.default_rng(2)
    same = rng.random((20_000, cfg.hashes)) < 0.8
    kept = np.ones(len(same), bool)
    for n, least in least_matches(cfg):
        kept &= same[:, :n].sum(1) >= least
    assert kept.mean() > 0.999
    assert (rng.random((1000, cfg.hashes)) < 0.5)[:, : cfg.hashes].sum(1).max() < least_matches(cfg)[-1][1]


def test_loosely_similar_texts_cost_no_pairs(spark):
    """A group around one text, each with five changes of its own: too far from it and from each other."""
    rnd, words = random.Random(9), [f"w{i}" for i in range(20_000)]
    base, made = [rnd.choice(words) for _ in range(100)], {}
    for n in (300, 600):
        texts = []
        for _ in range(n):
            x = list(base)
            for i in rnd.sample(range(100), 5):
                x[i] = rnd.choice(words)
            for i in rnd.sample(range(90), rnd.randrange(3)):
                x.pop(i)
            texts.append(" ".join(x))
        docs = spark.createDataFrame(list(enumerate([" ".join(base), *texts])), SCHEMA)
        rows = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("label"))
        made[n] = prefix_pairs(docs, rows, NearDup(shingle=4)).count()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(docs, NearDup(shingle=4)).collect()}
        assert got == plain.components(list(enumerate([" ".join(base), *texts])), 4, 80)
    assert made[600] < 600 and made[600] < 3 * made[300] + 60


def test_sent_ids_and_joined_ids_give_the_same(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    docs = list(enumerate(t for n in (20, 90) for t in family(rnd, words, n, 30, 9)))
    df = spark.createDataFrame(docs, SCHEMA)
    got = [sorted(tuple(r) for r in near_groups(df, NearDup(shingle=4, send=send)).collect()) for send in (0, 10**6)]
    assert got[0] == got[1]
