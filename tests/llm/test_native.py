"""Ring shards, url verdicts and dialogue views: plain versions, odd rows, and plans without Python."""

import random
import zlib
from collections import Counter

import pytest
from runsignal.llm.chat import Template, perspectives
from runsignal.llm.quality import judged
from runsignal.llm.queries import URL_RULES
from runsignal.llm.sharding import Ring, plan, sharded
from runsignal.llm.urls import Rule, Trees, judged_urls

DOCS = "doc_id long, text string"


def plain_plan(counts, ring):
    """Row by row: in every round each waiting row asks its next node."""
    nodes = ring.owners()
    room, out = ring.capacities(sum(counts.values())), {}
    waiting = [(next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0), cell, r) for cell, n in counts.items() for r in range(n)]
    while waiting:
        rest = []
        for node, cell, r in sorted(waiting):
            shard = nodes[node][1]
            if room[shard]:
                room[shard] -= 1
                out[cell, r] = shard
            else:
                rest.append(((node + 1) % len(nodes), cell, r))
        waiting = rest
    return out


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring_plan(slack):
    rnd, ring = random.Random(1), Ring(shards=5, vnodes=4, cells=64, slack=slack)
    counts = {c: rnd.choice((0, 1, 3, 40)) for c in range(64)}
    got = {(c, r): s for c, a, b, s, _ in plan(counts, ring) for r in range(a, b)}
    assert got == plain_plan(counts, ring)
    assert max(Counter(got.values()).values()) <= max(ring.capacities(sum(counts.values())))


def test_shards(spark):
    rows = [(i, f"text {i % 7}") for i in range(1000)] + [(1000, None), (1001, ""), (None, "é"), (5, "text 5"), (5, "other")]
    out = sharded(spark.createDataFrame(rows, DOCS + "").selectExpr("*", "9 AS shard", "1 AS r_cell")).collect()
    count = Counter(r.shard for r in out)
    assert len(out) == len(rows) and set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(count[s]))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert sharded(spark.createDataFrame([], DOCS)).count() == 0


def test_one_more_shard_moves_little(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    old, new = ({r.doc_id: r.shard for r in sharded(df, Ring(shards=n, slack=0.25)).collect()} for n in (8, 9))
    assert sum(old[d] != new[d] for d in old) < 0.3 * len(old)  # a plain modulus moves 8 of 9


URLS = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"),
    ("https://M.Example.ORG/es/5?q=1", "m.example.org", "/es/5", "example.org/es/", "block"),
    ("https://example.org/en/17#top", "example.org", "/en/17", "example.org/en/1", "block"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/1://y", "x.com", "/de/1://y", "com/de/", "block"),
    ("http://x.com/DE/", "x.com", "/DE/", None, None),
    ("http://notorg/x", "notorg", "/x", None, None),
    ("http://a.org", "a.org", "", None, None),
    ("a.org/x", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def test_url_rules_and_trees(spark):
    extra = [(100 + i, f"http://h{i % 9}.example.{'org' if i % 2 else 'com'}/{('es', 'de')[i % 2 == 0] if i % 3 else 'fr'}/{i}") for i in range(300)]
    rows = [(i, u[0]) for i, u in enumerate(URLS)] + extra
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS label", "3 AS depth")
    got = {r.page_id: r for r in judged_urls(df, URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert 0 <= r.score <= 1
    alone = judged_urls(spark.createDataFrame([(1, "http://x.net/"), (1, "http://x.net/")], "page_id long, url string"), URL_RULES)
    assert [r.verdict for r in alone.collect()] == ["allow", "allow"]
    assert judged_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_url_rates_count_all_labels(spark):
    rules = [Rule("block", "net", "/b/"), Rule("allow", "net", "/a/")]
    urls = [f"http://d{i}.net/{'ab'[i % 2]}/{j}" for i in range(100, 400) for j in range(10)] + [f"http://d{i}.net/c/1" for i in range(100, 400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for send in (100_000, 0):
        out = judged_urls(df, rules, Trees(train_rows=100, send=send)).where("rule IS NULL").collect()
        assert len(out) == 300 and all(r.verdict == ("allow", "block")[int(r.host[1:4]) % 2] for r in out)


def test_views(spark):
    rows = [(1, 0, "system", "Rules"), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "ann", "late"), (2, 5, None, "alone"), (3, 0, "system", "no one"), (None, 1, "eve", "x")]
    rows += [(4, t, "pq"[t % 2], "y" * (t % 5)) for t in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS name", "2 AS pos")
    out = perspectives(df, Template(block=8)).collect()
    views = {}
    for r in sorted(out, key=lambda r: r.pos):
        views.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "eve"), (4, "p"), (4, "q")}
    for (conv, me), turns in views.items():
        whole = "".join(r.segment for r in turns)
        assert [r.pos for r in turns] == list(range(sum(x[0] == conv for x in rows)))
        for r in turns:
            assert whole[r.start : r.end] == r.segment
            assert (r.loss_start is not None) == (r.role == "assistant")
            if r.loss_start is not None:
                assert whole[r.loss_start : r.loss_end].endswith("<|im_end|>\n") and whole[r.start : r.loss_start] == "<|im_start|>assistant\n"
    assert [(r.role, r.name) for r in views[1, "bob"]] == [("system", None), ("user", "ann"), ("assistant", None), ("assistant", None), ("user", "ann")]
    assert perspectives(df.limit(0)).count() == 0


def test_no_python_in_the_plans(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], DOCS + ", source string")
    turns = spark.createDataFrame([(1, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    for df in (judged(docs), sharded(docs), perspectives(turns), judged_urls(pages, URL_RULES)):
        plan_text = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan_text for x in ("Python", "Pandas", "MapInArrow"))
