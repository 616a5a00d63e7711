"""The pipeline on planted cases, odd rows and an empty table; the registered queries at the smallest scale."""

import os
import random

import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import differences, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, SCHEMA).withColumns({"kept": F.lit("mine"), "label": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    rnd = random.Random(8)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    item, passage, base = text(30), text(60), text(100)
    texts = [text(80) for _ in range(20)] + [base, base, base.replace(" ", " x ", 1), "too short", None, "", text(40) + " " + item + " " + text(40)]
    texts += [text(40) + " " + passage, text(40) + " " + passage + " " + text(10)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    sf = folder(spark, tmp_path, rows, [(1, item)])
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert name == "piece_ids" or sorted(docs.columns) == sorted(before)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["quality_rules"]) == set(range(29)) - {23, 24, 25}
    assert set(seen["near_duplicates"]) == set(seen["quality_rules"]) - {21, 22}
    cut = seen["repeated_passages"]
    assert cut[27].text == texts[27] and cut[28].text == texts[28].replace(passage + " ", "") and cut[28].n_chars == len(cut[28].text)
    assert set(seen["decontaminated"]) == set(cut) - {26}
    assert all(r.n_ids == len(r.ids) > 0 for r in seen["piece_ids"].values())
    assert corpus_pipeline.run(spark, sf).count() == len(seen["piece_ids"])
    assert plain.words(cut[0].text) == plain.words(texts[0])


def test_all_hits_of_a_document(spark, tmp_path):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in (1, 2, 3)]
    texts = ["before " + items[1][1].replace("i2w7", "x") + " between " + items[0][1] + " after", "clean", None]
    sf = folder(spark, tmp_path, [(d, t, "en", "s", 0) for d, t in enumerate(texts)], items)
    got = {r.doc_id: r for r in queries()["op3_cgk_decontamination"](spark, sf).collect()}
    assert [(h.item_id, h.distance) for h in got[0].hits] == [(1, 0), (2, 1)] and (got[0].n_items, got[0].item_id, got[0].distance) == (2, 1, 0)
    assert got[1].hits == got[2].hits == [] and got[1].kept and got[2].kept


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [])).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
@pytest.mark.parametrize("name", [n for n in queries() if n.startswith("op")])
def test_registered(spark, name):
    con = duck(SF)
    if name in oracle_sql():
        assert differences(spark, con, name, SF).startswith("equal")
    else:
        table = "pages" if name.startswith("op7") else "documents"
        assert queries()[name](spark, SF).count() == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
