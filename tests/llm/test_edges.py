"""Texts of over a megabyte, repeated rows, clashing columns, empty tables and joins instead of sent tables, for all operators."""

import math
import os
import random
from collections import Counter

import plain
import pytest
import sentencepiece
from pyspark.sql import functions as F

from runsignal.llm import decontam, kneserney, langid, neardup, pieces, quality, queries, sharding, substring, urls

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def long_text(seed, n=200_000):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(50_000)}" for _ in range(n))


LONG = long_text(1)
ROWS = [(1, LONG), (2, "before " + LONG[:400_000] + "after it"), (3, None), (4, ""), (5, "one two three"), (5, "one two three"), (6, "x" * 1_200_000)]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 1 << 20
    clash = {c: F.lit("mine") for c in ("row", "ids", "n_tokens", "score", "hits", "component_id", "n_words", "kept", "m", "lang_pred", "shard")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(clash).repartition(3)


def test_pieces(spark, docs):
    model = pieces.read_model(queries.piece_file())
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = pieces.encoded(docs, model)
    got = sorted(((r.row.doc_id, r.ids) for r in out.collect()), key=lambda x: x[0])
    want = [(d, None if t is None else library.encode(t)) for d, t in ROWS]
    assert got == want and got[0][1]
    back = pieces.decoded(out, model).select(F.col("row.row.doc_id").alias("d"), F.col("text").eqNullSafe(F.col("row.row.text")).alias("same"))
    assert all(r.same for r in back.collect()) and back.count() == len(ROWS)
    empty = spark.createDataFrame([], "doc_id long, ids array<int>")
    assert pieces.decoded(empty, model).count() == 0 and pieces.encoded(docs.limit(0), model).count() == 0


def test_repeats_joined_by_document(spark, docs):
    want = plain.without_repeats([(d, t) for d, t in dict(ROWS).items()], 20)
    for cfg in (substring.Repeats(), substring.Repeats(send=0), substring.Repeats(send=0, shard=1)):
        got = [(r.row.doc_id, (r.n_words, plain.words(r.row.text))) for r in substring.without_repeats(docs, cfg).collect()]
        assert len(got) == len(ROWS) and all(w == want[d] for d, w in got)


def test_near_groups(spark, docs):
    cfg = neardup.NearDup(send=0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(docs, cfg).collect()}
    assert got == plain.components(list(dict(ROWS).items()), cfg.shingle, 80)


def test_quality_joined_by_host(spark):
    rows = [(i, "too short", f"h{i % 3}") for i in range(60)] + [(100 + i, " ".join(f"v{i}{j}" for j in range(40)), "good") for i in range(60)] + [(200, LONG, None), (201, None, "good")]
    df = spark.createDataFrame(rows, SCHEMA + ", source string")
    sent, joined = (sorted((r.row.doc_id, r.kept, r.host_rejected, r.m.n_words) for r in quality.judged(df, cfg=quality.Rules(send=n)).collect()) for n in (500_000, 0))
    assert sent == joined and dict((d, k) for d, k, _, _ in sent)[200] and sent[-2][3] == 200_000


def test_scores_of_repeated_and_long_rows(spark, docs):
    model = kneserney.train(docs.where("doc_id < 6"), parts=3)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in kneserney.score(docs, model).collect()), key=lambda r: r[0])
    uni = Counter(t for d, t in ROWS if d < 6 for t in [*plain.words(t, lower=True), None])
    n, kinds = sum(uni.values()), len(uni)
    for (d, tokens, known, base, score), (e, t) in zip(got, ROWS):
        x = [*plain.words(t, lower=True), None]
        assert (d, tokens, known) == (e, len(x), sum(uni[w] > 0 for w in x))
        assert base == pytest.approx(sum(math.log10((uni[w] + 1) / (n + kinds + 1)) for w in x)) and math.isfinite(score)
    assert got[4] == got[5] and model.n_tokens == n
    assert kneserney.score(docs.limit(0), model).count() == 0


def test_leaks_in_long_texts(spark, docs):
    item = " ".join(plain.words(LONG)[150_000:150_030])
    out = decontam.leaked(docs, spark.createDataFrame([(7, item), (7, item)], "item_id long, text string"))
    assert {r.row.doc_id: {h.item_id for h in r.hits} for r in out.collect()} == {1: {7}, 2: set(), 3: set(), 4: set(), 5: set(), 6: set()}
    assert decontam.leaked(docs.limit(0), spark.createDataFrame([(7, item)], "item_id long, text string")).count() == 0


def test_languages_of_odd_rows(spark, docs):
    train = spark.createDataFrame([(i, t, n) for i in range(100) for t, n in (("der und die mit", "de"), ("the of and with", "en"))], SCHEMA + ", lang string")
    models = langid.learn(train.withColumn("doc_id", F.monotonically_increasing_id()))
    out = langid.languages(docs.select("doc_id", "text", "lang_pred", "score"), models).collect()
    got = {r.row.doc_id: r.lang_pred for r in out}
    assert len(out) == len(ROWS) and got[3] == got[4] == "und" and got[1] in ("de", "en")
    assert langid.languages(docs.select("doc_id", "text").limit(0), models).count() == 0


def test_every_row_has_the_shard_of_the_plain_ring(spark):
    from test_native import plain_plan

    ring = sharding.Ring(shards=5, vnodes=8, cells=128)
    df = spark.createDataFrame([(i * 37, f"t{i}") for i in range(900)], SCHEMA)
    place = {r.doc_id: r.h & (2**64 - 1) for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    cells: dict[int, list] = {}
    for d, h in place.items():
        cells.setdefault((h >> 40) % ring.cells, []).append(d)
    shards = plain_plan({c: len(ds) for c, ds in cells.items()}, ring)
    signed = lambda d: place[d] - (1 << 64 if place[d] >> 63 else 0)  # noqa: E731  Spark orders hashes as signed numbers
    want = {d: shards[c, i] for c, ds in cells.items() for i, d in enumerate(sorted(ds, key=signed))}
    assert {r.doc_id: r.shard for r in sharding.sharded(df, ring).collect()} == want


def test_features_of_urls(spark):
    rnd = random.Random(3)
    made = ["".join(rnd.choice("ab1.9/?&=#-é:") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    made = [*made, *("https://" + u for u in made), "http://A.example.org/x/y?a=1&b=2#f", ""]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, u_url string")
    df = df.withColumns({"host": urls.host_of(F.col("u_url")), "path": urls.path_of(F.col("u_url"))})
    for r in urls.lexical(df).collect():
        u = r.u_url
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        share = [n / len(u) for n in Counter(u).values()]
        assert (r.host, r.path) == (host, path)
        assert (r.length, r.depth, r.n_params) == (len(u), path.count("/"), len(query.split("&")) if query else 0)
        assert r.digit_ratio == pytest.approx(sum(c in "0123456789" for c in u) / len(u) if u else 0)
        assert r.entropy == pytest.approx(-sum(p * math.log2(p) for p in share), abs=1e-9)
        assert (r.u_suffix, r.u_domain) == (host.split(".")[-1], ".".join(host.split(".")[-2:]))


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_held_out_languages(spark):
    got = queries.op8_language_families(spark, SF).where("held_out AND lang_pred <> 'und'")
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = got.join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    print(f"held-out accuracy {right:.4f}")
    assert right > 0.97
