"""Collocations, top-k search and resampling against plain Python on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import plan_of
from llm_support import DOCS, library, odd_docs, prose  # noqa: F401

from starloom.llm import collocations, importance_resampling, threshold_search

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_of(docs: list[tuple], least: int, longest: int, top: int) -> list[tuple]:
    f: dict = {}
    for lang, text in docs:
        of = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(CAPITALS)):
            w = re.findall(r"[^\x20\x09]+", piece)
            of.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, of in f.items():
        n = sum(c for g, c in of.items() if len(g) == 1)
        known = {g: c for g, c in of.items() if len(g) > 1 and c >= least}
        rows, held = [], {}
        for h, a in known.items():
            for g in {h[i : i + m] for m in range(2, len(h)) for i in range(len(h) - m + 1)}:
                held[g] = max(held.get(g, 0), a)
        for g, a in known.items():
            if 100 * held.get(g, 0) < 100 * a:
                score, k = min((1000 * a * n // (of[g[:k]] * of[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), of[g[:k]], of[g[k:]]))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(rows[:top])]
    return sorted(out)


@pytest.mark.parametrize("group_rows", [5, 40, 10_000])
def test_phrases_are_those_of_all_ngrams(spark, prose, group_rows):
    common = "Read the terms of use and the terms of sale, then go on: the end of the day"
    docs = [("ab"[i % 2], t) for i, t in enumerate(prose)] + [("a", common)] * 30 + [(None, f"{common}\n{common}")] * 7
    docs += [("a", None), ("b", ""), (None, ". ,;"), ("c", "one"), ("b", "x " * 3000), ("a", "é\x00  ü é\x00  ü " * 9)]
    frame = spark.createDataFrame([(la, t, 1, "x") for la, t in docs], "lang string, text string, id int, words string")
    longest, top = (3, 10_000) if group_rows == 40 else (5, 50)
    got = collocations.collocations(frame, 6, longest, top, group_rows=group_rows)
    want = phrases_of(docs, 6, longest, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40


def test_a_position_of_common_words_gives_one_pointer(spark, monkeypatch):
    draw, seen = np.random.default_rng(5), []
    text = " ".join("abcdefghijkl"[i] for i in draw.integers(0, 12, 3000))
    point = collocations.pointers

    def kept(*args):
        seen.append(point(*args))
        return seen[-1]

    monkeypatch.setattr(collocations, "pointers", kept)
    frame = spark.createDataFrame([("a", text)], "lang string, text string").coalesce(1)
    got = collocations.collocations(frame, 4, 5, 10_000, group_rows=60)  # every word is above 60, no pair is
    want = phrases_of([("a", text)], 4, 5, 10_000)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert seen[0].count() < 3000


def test_phrases_of_odd_and_empty_tables(spark, odd_docs, prose):
    want = phrases_of([(r["lang"], r["text"]) for r in odd_docs.collect()], 3, 5, 100)
    assert sorted(map(tuple, collocations.collocations(odd_docs, 3, top=100).collect())) == want and want
    assert not collocations.collocations(odd_docs.where("false")).collect()
    assert not collocations.collocations(odd_docs.where("text is null")).collect()


def test_equal_parts_are_counts_of_leading_keys():
    draw = np.random.default_rng(3)
    keys = [draw.integers(0 if j else 1, 4, 500).astype(np.uint64) for j in range(4)]
    for j in range(2, 4):
        keys[j][keys[j - 1] == 0] = 0
    weight = draw.integers(1, 5, 500)
    want: Counter = Counter()
    for i in range(500):
        for n in range(1, 5):
            if n == 1 or keys[n - 1][i]:
                want[tuple(int(k[i]) for k in keys[:n])] += int(weight[i])
    got = {tuple(int(k[i]) for k in keys[:n]): w for i, n, w in collocations.equal_parts(keys, weight, 20)}
    assert got == {g: w for g, w in want.items() if w >= 20} and len(got) < len(want)


def best_of(rows: list[tuple], k: int, every: int) -> list[tuple]:
    whole = [
        (i, tuple(max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v)) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, q) in enumerate(whole):
        if i % every == 0:
            dots = [(sum(a * b for a, b in zip(q, v, strict=True)), j) for n, (j, v) in enumerate(whole) if n != at and len(v) == len(q)]
            hits = sorted((-max(-(2**63), min(2**63 - 1, s)), j) for s, j in dots)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def test_search_is_that_of_all_products(spark):
    draw = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in np.round(draw.normal(size=6), 2)]) for i in range(300)]
    rows += [(300 + i, rows[10][1]) for i in range(60)]  # copies, among them queries
    rows += [(400 + i, [0.0] * 6) for i in range(12)] + [(420 + i, [float(i % 2)] * 6) for i in range(12)]
    rows += [(500, None), (505, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (510, [float("nan")] * 6), (515, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(520, [1.0, 2.0]), (521, [0.5, -2.0]), (525, []), (530, []), (535, [3e30, -1.0, 2.0]), (540, [1e9, 1e8, -3.0]), (545, [7.0])]
    rows += [(600, rows[20][1]), (600, rows[20][1]), (600, rows[21][1])]  # rows of one id
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, key int")
    queries = frame.where("vec_id % 5 = 0")
    for k, block, batch in ((5, 16, 8), (1, 1000, 1000), (400, 64, 7)):
        got = sorted(map(tuple, threshold_search.top_k(queries, frame, k, block=block, batch=batch).collect()))
        assert got == best_of(rows, k, 5)
    assert not threshold_search.top_k(queries, frame.where("false")).collect()
    assert not threshold_search.top_k(queries.where("false"), frame).collect()


def test_batches_of_queries_do_not_pass_the_driver(spark, monkeypatch):
    draw, seen = np.random.default_rng(2), []
    search = threshold_search.search

    def kept(*args):
        seen.append(search(*args))
        return seen[-1]

    monkeypatch.setattr(threshold_search, "search", kept)
    rows = [(i, [float(x) for x in np.round(draw.normal(size=4), 2)]) for i in range(400)]
    rows += [(i, [float(i % 7), float(i % 5) - 2]) for i in range(400, 460)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for held, block, batch in ((2, 16, 8), (1, 4, 64), (512, 400, 8)):  # many groups of batches, many blocks, few blocks
        monkeypatch.setattr(threshold_search, "HELD", held, raising=False)
        got = sorted(map(tuple, threshold_search.top_k(frame.where("vec_id % 3 = 0"), frame, 5, block=block, batch=batch).collect()))
        assert got == best_of(rows, 5, 3)
        assert "Broadcast" not in plan_of(seen[-1])


def test_a_batch_finds_the_best_of_all_products_in_every_number_type():
    draw, kinds = np.random.default_rng(6), set()
    for scale in (3, 2_000, 1 << 23, 1 << 28, 1 << 62):
        v, q = draw.integers(-scale, scale, (150, 5)), draw.integers(-scale, scale, (12, 5))
        v[::4], q[0], q[1] = v[0], 0, -v[0]
        kinds.add(kind := threshold_search._working(v, q))
        lists = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T.astype(np.uint16))
        values = np.take_along_axis(v.astype(kind).T, lists.astype(int), axis=1)
        dots = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for b in v] for a in q]
        floors = np.array([threshold_search.NONE if i % 2 else sorted(d)[-3] for i, d in enumerate(dots)], np.int64)
        of, rows, scores, _ = threshold_search.batch_search(v.astype(kind), values, lists, q.astype(kind), 7, floors)
        want = {(i, r, s) for i, d in enumerate(dots) for s, r in sorted((-s, r) for r, s in enumerate(d) if s >= floors[i])[:7]}
        assert {(int(i), int(r), -int(s)) for i, r, s in zip(of, rows, scores, strict=True)} == want
    assert kinds == {np.float32, np.float64, np.int64, object}


def test_no_more_than_the_best_leave_a_task(spark, monkeypatch):
    draw = np.random.default_rng(9)
    rows = [(i, [int(x) for x in draw.integers(-90, 90, 3)], 1 + i) for i in range(300)]
    vectors = spark.createDataFrame(rows, "id long, v array<long>, key long")
    monkeypatch.setattr(threshold_search, "TASKS_A_CORE", 1, raising=False)
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    for n in (before, "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            blocks, batches = threshold_search.candidate_blocks(vectors, 60), threshold_search.query_batches(vectors, 3)
            found = threshold_search.search(batches, blocks, 60, 3, 4).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert max(Counter(r["key"] for r in found).values()) <= 4 * min(int(n), cores)


def test_search_stops_before_the_end_of_the_lists():
    draw = np.random.default_rng(1)
    v = np.concatenate([draw.normal(0, 1, (2000, 3)), draw.normal(9, 1, (48, 3))])
    lists = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T)
    values = np.take_along_axis(v.T, lists, axis=1)
    for q in (np.array([1.0, 2.0, 1.0]), np.array([1.0, 0.0, 3.0])):
        rows, scores, scored = threshold_search.threshold_search(v, values, lists, q, 5, threshold_search.NONE)
        assert set(rows) == set(np.argsort(-(v @ q))[:5]) and np.allclose(scores, v[rows] @ q)
        assert scored < 300
        floor = int(np.sort(v @ q)[-2]) + 1
        assert threshold_search.threshold_search(v, values, lists, q, 5, floor)[2] <= scored


def resampled(docs: list[tuple], target: list, percent: int, least: int, buckets: int) -> list[tuple]:
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        n, f = features(text)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): n + 1 for n, r in enumerate(may[: percent * len(may) // 100])}
    return sorted(((*r, ranks.get(id(r))) for r in rows), key=repr)


def test_resampling_is_that_of_plain_counts(spark, odd_docs, prose):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(100 + i, t) for i, t in enumerate(prose)]
    frame = spark.createDataFrame([(i, t, 1.0, 2, "x") for i, t in docs], "doc_id long, text string, score double, row int, n string")
    target = [prose[3], prose[4], None, "", "Ünlike 42 words"]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for percent, least, buckets in ((25, 20, 10_000), (90, 1, 50), (100, 0, 1)):
        got = importance_resampling.resample(frame, aim, percent, least, buckets).collect()
        assert sorted(map(tuple, got), key=repr) == resampled(docs, target, percent, least, buckets)
    got = importance_resampling.resample(frame, aim.where("false")).collect()
    assert sorted(map(tuple, got), key=repr) == resampled(docs, [], 25, 20, 10_000)
    assert not importance_resampling.resample(frame.where("false"), aim).collect()
    assert {r["rank"] for r in importance_resampling.resample(frame, aim, 0).collect()} == {None}


def test_ties_and_repeated_rows_are_drawn_exactly(spark):
    rows = [(i // 3, 30, 59, 5, 7 if i < 280 else 8, i) for i in range(300)] + [(None, 30, 59, 5, 7, 900 + i) for i in range(20)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long, row long")
    for percent in (10, 40, 99, 100):
        got = importance_resampling.draw(scored, percent).collect()
        n = percent * 320 // 100
        ranked = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"])
        want = sorted(rows, key=lambda r: (-r[4], r[0] is None, r[0] or 0))[:n]
        assert len(got) == 320 and ranked == [(i + 1, r[4], r[0]) for i, r in enumerate(want)]


def test_kth_smallest_counts_every_row(spark):
    values = [-(2**62), -5, -5, -5, 0, 3, 3, 2**63 - 1]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for k, v in [(0, values[0]), (3, -5), (4, 0), (7, values[7])]:
        assert importance_resampling.kth_smallest(frame, frame["v"], k + 1) == (v, values.index(v))


def test_checksums_of_spans_and_of_joined_spans():
    draw = np.random.default_rng(2)
    words = [bytes(draw.integers(97, 123, int(n)).astype(np.uint8)) for n in [1, 2, 7, 63, 64, 65, 300, 5000, 3, 3, *draw.integers(1, 90, 200)]]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    crc = importance_resampling.span_crcs(data, starts, ends)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    both = importance_resampling.joined_crcs(crc[:-1], crc[1:], (ends - starts)[1:])
    assert both.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]
    assert not len(importance_resampling.text_features(pa.array([], pa.string()))[0])
