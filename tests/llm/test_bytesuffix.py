"""Suffix arrays, interval trees and what goes, against plain versions."""

import random
from collections import defaultdict

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runsignal.llm.bytesuffix import _END, ByteRepeats, _whole_shards, repeat_groups, scan, suffixes, without_repeated_bytes

SCHEMA = "doc_id long, text string"


def corpus(seed=1, n=70):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abé日 \n") for _ in range(rnd.randint(30, 160))) for _ in range(6)]
    out = []
    for d in range(n):
        x = "".join(rnd.choice("xyz€ ") for _ in range(rnd.randint(0, 60)))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            x += p[rnd.randint(0, 20) : len(p) - rnd.randint(0, 20)] + rnd.choice(("", "q", "Qw"))
        out.append((d, x))
    return out + [(n, out[5][1]), (n + 1, "ab" * 400), (n + 2, "a" * 500), (n + 3, None), (n + 4, ""), (n + 5, "\u0000" * 120)]


def test_suffixes():
    rnd = np.random.default_rng(1)
    for longest in (12, 40):
        pieces = [rnd.integers(97, 99, rnd.integers(1, longest), dtype=np.uint8) for _ in range(60)]
        data = np.concatenate([np.append(p, np.uint8(_END)) for p in pieces])
        order, same = suffixes(data, longest + 1)
        text = [(bytes(data[i:]).replace(bytes([_END]), b"\0"), i) for i in range(len(data))]
        ranks = [text[i][0][:longest] for i in order]
        assert ranks == sorted(ranks)
        for t in range(1, len(order)):
            a, b = bytes(data[order[t - 1] :]), bytes(data[order[t] :])
            want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert min(same[t], longest) == min(want, longest)


def test_scan_finds_maximal_repeats():
    rnd = random.Random(3)
    for _ in range(30):
        text = "".join(rnd.choice("ab") for _ in range(rnd.randint(2, 60)))
        least, n = 3, len(text)
        order = sorted(range(n), key=lambda i: text[i:])
        common = lambda x, y: next((k for k in range(min(n - x, n - y)) if text[x + k] != text[y + k]), n - max(x, y))
        same = [0] + [common(x, y) for x, y in zip(order, order[1:])]
        same = [s if s >= least else 0 for s in same]
        members = []
        scan(same, order, [256 if i == 0 else ord(text[i - 1]) for i in order], 0, members)
        groups, below = defaultdict(set), defaultdict(set)
        for s, group, length, via, _ in members:
            groups[group, length].add(order[s])
            if via:
                below[group, length].add(via)
        lengths = {g: (g, k) for g, k in groups}

        def occurrences(key):
            return set(groups[key]).union(*(occurrences(lengths[v]) for v in below[key]))

        got = {(text[min(groups[k]) :][: k[1]], frozenset(occurrences(k))) for k in groups}
        want = set()
        for i in range(n):
            for k in range(least, n - i + 1):
                at = frozenset(j for j in range(n) if text.startswith(text[i : i + k], j))
                left = {text[j - 1] if j else None for j in at}
                right = {text[j + k] if j + k < n else None for j in at}
                if len(at) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                    want.add((text[i : i + k], at))
        assert got == want
        lost = {order[s] + j for s, _, k, _, gone in members if gone for j in range(k)}
        assert lost == {i + j for i in range(n) for j in range(least) if i + least <= n and text.find(text[i : i + least]) < i}


@pytest.mark.parametrize("cfg", [ByteRepeats(), ByteRepeats(shard=1), ByteRepeats(send=0), ByteRepeats(length=30, gram=8), ByteRepeats(length=20, gram=20)])
def test_bytes_go(spark, cfg):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"kept": F.lit("mine"), "span_start": F.lit(1)}).repartition(4)
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in without_repeated_bytes(df, cfg).collect()}
    assert got == plain.without_repeated_bytes(docs, cfg.length)


def test_groups_hold_all_occurrences(spark):
    docs = corpus(4, 40)
    raw = {d: (t or "").encode() for d, t in docs}
    cfg = ByteRepeats(length=30, gram=8)
    rows = repeat_groups(spark.createDataFrame(docs, SCHEMA), cfg).collect()
    own, via, length = defaultdict(set), defaultdict(set), {}
    for r in rows:
        own[r.group].add((r.doc_id, r.start))
        length[r.group] = r.length
        if r.via:
            via[r.group].add((r.via, r.doc_id, r.start))
    assert all(len({raw[d][s : s + length[g]] for d, s in at}) == 1 for g, at in own.items())
    # Every string that occurs twice lies in one group at all its places, after members that stand for groups are followed.
    covered = set()
    for g, at in own.items():
        covered |= {(d, s + j) for d, s in at for j in range(length[g] - cfg.length + 1)}
    places = defaultdict(set)
    for d, t in raw.items():
        for i in range(len(t) - cfg.length + 1):
            places[t[i : i + cfg.length]].add((d, i))
    assert covered == set().union(*(p for p in places.values() if len(p) > 1))


def test_odd_rows(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(1, text), (1, text), (2, "<" + text + ">"), (None, text)]
    got = sorted((r.row.doc_id or 0, r.n_removed, r.n_spans) for r in without_repeated_bytes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, len(text), 1)]
    assert without_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    rnd = random.Random(2)
    head = "".join(rnd.choice("abcdefgh ") for _ in range(5 << 20))
    docs = [(1, head), (2, head[(4 << 20) - 50 : (4 << 20) + 90])]
    got = {r.row.doc_id: r.n_removed for r in without_repeated_bytes(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {1: 0, 2: 140}


def test_blocks_of_shards_stay_small():
    anchor = np.repeat(np.arange(6000), 3)
    pieces = [bytes(200) for _ in anchor]
    batches = [pa.RecordBatch.from_arrays([pa.array(anchor[a : a + 5000]), pa.array(pieces[a : a + 5000], pa.binary())], names=["anchor", "bytes"]) for a in range(0, len(anchor), 5000)]
    blocks = [np.array(b.column("anchor")) for b in _whole_shards(iter(batches))]
    assert np.concatenate(blocks).tolist() == anchor.tolist()
    # Sorting the suffixes of a byte takes about 150; two tasks of an executor sort at a time.
    assert max(len(b) * 200 for b in blocks) <= 1 << 20
    assert all((np.bincount(b)[b[0] :] == 3).all() for b in blocks)
