"""Substring dedup, quality rules, ids, decontamination, language and perplexity against plain versions."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from runsignal.llm import decontam, kneserney, langid, pieces, quality, substring, words
from runsignal.llm.oracles import HOST_RULES

SCHEMA = "doc_id long, text string"
ODD = [(901, None), (902, ""), (903, " \t\n"), (904, "one"), (905, "x " * 3000), (906, "a\u0085b c")]


def corpus(seed=1, n=60, words=400):
    rnd = random.Random(seed)
    w = [f"w{i}" for i in range(words)]
    passages = [[rnd.choice(w) for _ in range(rnd.randint(15, 60))] for _ in range(5)]
    out = []
    for d in range(n):
        x = [rnd.choice(w) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randint(0, len(x))
            p = rnd.choice(passages)
            x[i:i] = p[rnd.randint(0, 5) :]
        out.append((d, rnd.choice((" ", "\n", " \t")).join(x)))
    return out + [(n, out[3][1]), (n + 1, " ".join(["go", "on"] * 40))] + ODD


@pytest.mark.parametrize("shard", [4096, 1])
def test_repeats_go(spark, shard):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"n_words": F.lit("mine"), "span_start": F.lit(1)})
    got = {r.row.doc_id: (r.n_words, plain.words(r.row.text)) for r in substring.without_repeats(df, substring.Repeats(shard=shard)).collect()}
    assert got == plain.without_repeats(docs, 20)


def test_repeats_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, "before " + text + " after"), (None, text)]
    got = sorted((r.row.doc_id or 0, r.n_removed) for r in substring.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 30)]
    assert substring.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_automaton_matching_statistics():
    rnd = random.Random(4)
    past = [[rnd.randrange(3) for _ in range(rnd.randint(1, 12))] for _ in range(20)]
    automaton = substring.Automaton()
    for p in past:
        automaton.add(p)
    inside = {tuple(p[i:j]) for p in past for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    seq = [rnd.randrange(3) for _ in range(200)]
    want = [max((n for n in range(1, i + 2) if tuple(seq[i + 1 - n : i + 1]) in inside), default=0) for i in range(len(seq))]
    assert automaton.match(seq) == want


def test_quality_rules(spark):
    rows = [(d, t, None if d % 11 == 0 else f"host{d % 3}", 1) for d, t in corpus(2)]
    rows += [(2000 + i, "too short", "junk", 1) for i in range(40)] + [(3000, " ".join(f"v{i}" for i in range(50)), "junk", 1)]
    docs = spark.createDataFrame(rows, SCHEMA + ", source string, m long")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    want = {r[0]: r[1:] for r in con.execute(HOST_RULES).fetchall()}
    got = {
        r.row.doc_id: (r.m.n_words, r.m.word_chars, r.m.n_symbols, r.m.n_dup_lines, r.m.n_repeat_words, r.base_failed, r.kept, r.host_rejected)
        for r in quality.judged(docs).collect()
    }
    assert got == want
    assert got[3000][-2:] == (False, True)  # a good text of a host that fails
    assert quality.judged(docs.limit(0)).count() == 0


MODEL = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_equal_the_library():
    vocabulary, library, rnd = pieces.Pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL), random.Random(1)
    texts = ["", " ", "  a  b ", "a\nb\t c", "日本語\u0000x", "<s> hi </s>", "=-" * 300, " " * 100, "🙂🙂 x🙂"]
    texts += ["".join(rnd.choice("abcdeinth er-=.%é日\n1 0") for _ in range(rnd.randint(1, 150))) for _ in range(800)]
    decoder = vocabulary.decoder()
    for t in texts:
        ids = np.frombuffer(vocabulary.encode(t), np.int32)
        assert ids.tolist() == library.encode(t), t
        assert decoder.decode(ids, np.array([0, len(ids)])) == [t]
    assert decoder.decode(np.array([-1, 99999, 3 + 0xFF, 3 + 65]), np.array([0, 2, 4])) == ["", "\ufffdA"]


def test_stream_commits_in_a_short_window():
    vocabulary, library = pieces.Pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    text = "internationalization" * 400
    stream, ids = pieces.Stream(vocabulary), []
    for i in range(0, len(text) + 1, 13):
        ids += stream.feed((" " + text)[i : i + 13])
    assert ids + stream.finish() == library.encode(text)
    assert stream.widest <= 4 * vocabulary.longest


def test_ids_in_spark(spark):
    df = spark.createDataFrame(corpus(3, 10), SCHEMA).withColumn("ids", F.lit("mine"))
    out = pieces.decoded(pieces.encoded(df, MODEL), MODEL).collect()
    assert all(r.text == r.row.row.text for r in out) and len(out) == df.count()
    assert all((r.row.ids is None) == (r.row.row.text is None) for r in out)


def edited(rnd, x, k, words):
    x = list(x)
    for _ in range(k):
        i = rnd.randrange(len(x))
        kind = rnd.randrange(3)
        if kind == 0:
            x[i] = rnd.choice(words)
        elif kind == 1:
            x.insert(i, rnd.choice(words))
        else:
            x.pop(i)
    return x


def test_leaks_recall_and_distance(spark):
    rnd, w = random.Random(3), [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rnd.choice(w) for _ in range(rnd.randint(8, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, "w1 w2")]
    docs, want = [], {}
    for d in range(400):
        i, text = items[rnd.randrange(40)]
        x = text.split()
        x = [rnd.choice(w) for _ in range(rnd.randint(0, 60))] + edited(rnd, x, rnd.randint(0, len(x) // 5), w) + [rnd.choice(w) for _ in range(rnd.randint(0, 60))]
        docs.append((d, " ".join(x).upper()))
        want[d] = i, plain.edits(text.split(), x), len(text.split()) // 5
    clean = [(1000 + d, " ".join(rnd.choice(w) for _ in range(200))) for d in range(50)]
    df = spark.createDataFrame(docs + clean + ODD, SCHEMA).withColumn("hits", F.lit(1))
    for block in (500_000, 300):  # one block of items, several blocks
        hits = {r.row.doc_id: {h.item_id: h.distance for h in r.hits} for r in decontam.leaked(df, spark.createDataFrame(items, "item_id long, text string"), decontam.Leaks(block=block)).collect()}
        inside = {d: v for d, v in want.items() if v[1] <= v[2]}
        found = [d for d, (i, e, _) in inside.items() if hits[d].get(i) == e]
        assert len(found) >= 0.99 * len(inside)
        assert not any(hits[d] for d, _ in clean + ODD)


def test_leaks_with_clustered_edits():
    rnd, w = random.Random(6), [f"w{i}" for i in range(5000)]
    some = lambda n: [rnd.choice(w) for _ in range(n)]
    for n in (20, 40, 100, 200, 500):
        k, items, docs = n // 5, [some(n) for _ in range(5)], []
        for i, x in enumerate(items):
            for at in (0, (n - k) // 2, n - k):
                for new in ([], some(k)):
                    for around in (0, 40):
                        docs.append((i, some(around) + x[:at] + new + x[at + k :] + some(around)))
        index = decontam.Index(pa.table({"item_id": range(5), "text": [" ".join(x) for x in items]}), decontam.Leaks())
        got = index.search(words.words_of(pa.array([" ".join(x) for _, x in docs]), words.Powers(), lower=True))
        assert all(got.get(d) == [(i, plain.edits(items[i], x))] for d, (i, x) in enumerate(docs)), n


def test_leaks_of_short_items():
    rnd, w = random.Random(7), [f"w{i}" for i in range(12)]
    items = [(i, [rnd.choice(w) for _ in range(1 + i % 7)]) for i in range(70)] + [(70, ["only"]), (71, [])]
    docs = [[rnd.choice(w) for _ in range(rnd.randint(0, 12))] for _ in range(200)] + [["only"], []]
    index = decontam.Index(pa.table({"item_id": [i for i, _ in items], "text": [" ".join(x) for _, x in items]}), decontam.Leaks())
    got = index.search(words.words_of(pa.array([" ".join(x) for x in docs]), words.Powers(), lower=True))
    for d, text in enumerate(docs):
        want = {i: e for i, x in items if x and (e := plain.edits(x, text)) <= len(x) // 5}
        assert dict(got.get(d, [])) == want and len(got.get(d, [])) == len(want)


def test_leaks_without_items(spark):
    df = spark.createDataFrame([(1, "a b c")], SCHEMA)
    assert decontam.leaked(df, spark.createDataFrame([], "item_id long, text string")).first().hits == []


def test_languages(spark):
    rnd = random.Random(2)
    parts = {"en": "the of and ing tion ly wh", "de": "der und sch ung keit ß ü", "fr": "le é eau que ment è oi", "es": "el ción ñ que os ll rr", "xx": "ж щ ы ю я ш"}
    text = lambda name, n: " ".join("".join(rnd.choice(parts[name].split()) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, text(name, 30), name) for i, name in enumerate(rnd.choice(list(parts)) for _ in range(400))]
    models = langid.learn(spark.createDataFrame(rows + [(500, "abc", None), (501, None, "en")], SCHEMA + ", lang string"))
    assert models.families == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    test = [(i, text(name, 40), name) for i, name in enumerate(rnd.choice(list(parts)) for _ in range(200))]
    got = {r.row.doc_id: r for r in langid.languages(spark.createDataFrame(test, SCHEMA + ", lang_pred string"), models).collect()}
    assert sum(got[i].lang_pred == name for i, _, name in test) >= 0.98 * len(test)
    odd = {r.row.doc_id: (r.lang_pred, r.score) for r in langid.languages(spark.createDataFrame([(1, None), (2, ""), (3, "12 %$"), (4, "the")], SCHEMA), models).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[4][0] in parts and 0 <= odd[4][1] <= 1
    nothing = langid.learn(spark.createDataFrame([], SCHEMA + ", lang string"))
    assert langid.languages(spark.createDataFrame([(4, "the")], SCHEMA), nothing).first().lang_pred == "und"


def test_language_sample_thins_copies(spark, monkeypatch):
    plans, written = [], langid.written
    monkeypatch.setattr(langid, "written", lambda df, name: plans.append((df._jdf.queryExecution().optimizedPlan().toString(), written(df, name))) or plans[-1][1])
    rows = [(i, "the same text" if i < 1000 else f"ein text {i}", "en" if i < 1000 else "de") for i in range(2000)]
    langid.learn(spark.createDataFrame(rows, SCHEMA + ", lang string").repartition(8), cfg=langid.Learning(per_lang=100))
    plan, sample = plans[0]
    assert all(60 <= r["count"] <= 140 for r in sample.groupBy("lang").count().collect()) and sample.select("lang").distinct().count() == 2
    assert "Repartition 4, false" not in plan  # a narrow one would read all texts in four tasks


def test_kneser_ney(spark):
    docs = corpus(5, 80, 60)
    train = [(d, t) for d, t in docs if d % 3]
    model = kneserney.train(spark.createDataFrame(train, SCHEMA), parts=3, buffer=500)
    got = {r.doc_id: r for r in kneserney.score(spark.createDataFrame(docs, SCHEMA), model).collect()}
    tokens = {d: [*plain.words(t, lower=True), None] for d, t in docs}
    uni, bi = Counter(), Counter()
    for d, _ in train:
        uni.update(tokens[d])
        bi.update(zip([0, *tokens[d]], tokens[d]))
    n, types, left = sum(uni.values()), len(uni), Counter(b for _, b in bi)
    db, du = plain.discounts(bi), plain.discounts(left)
    total, kinds = Counter(), defaultdict(Counter)
    for (a, _), c in bi.items():
        total[a] += c
        kinds[a][min(c, 3)] += 1
    freed = sum(du[min(c, 3)] for c in left.values()) / len(bi)

    def p(a, b):
        low = (left[b] - du[min(left[b], 3)]) / len(bi) + freed / (types + 1)
        if not total[a]:
            return low
        return (bi[a, b] - db[min(bi[a, b], 3)] + sum(db[i] * kinds[a][i] for i in (1, 2, 3)) * low) / total[a]

    assert abs(sum(p("w1", b) for b in uni) + p("w1", "unseen") - 1) < 1e-9
    for d, x in tokens.items():
        r = got[d]
        assert (r.n_tokens, r.n_known) == (len(x), sum(uni[t] > 0 for t in x))
        assert r.base_score == pytest.approx(sum(math.log10((uni[t] + 1) / (n + types + 1)) for t in x))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([0, *x], x)))


def test_kneser_ney_untrained(spark):
    model = kneserney.train(spark.createDataFrame([], SCHEMA), parts=2)
    r = kneserney.score(spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA), model).collect()
    assert [(x.n_tokens, x.n_known, x.score) for x in r] == [(3, 0, 0.0), (1, 0, 0.0)]
