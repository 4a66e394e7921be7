"""Near duplicates and contained items against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from llm_support import library, odd_docs, prose  # noqa: F401
from starloom.llm import batches, dart_minhash, decontaminate
from starloom.llm.components import components


def bag(text: str | None) -> Counter:
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def classes(texts: list) -> list[int]:
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            if (texts[i] or "") == (texts[j] or "") or union and sum((bags[i] & bags[j]).values()) >= 0.8 * union - 1e-9:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def copies(prose) -> list:
    """Chains of copies that drift from their origin, exact copies, short and empty texts."""
    draw = random.Random(2)
    texts: list = list(prose[:12])
    for origin in prose[:4]:
        words = origin.split()
        for _ in range(25):
            own = list(words)
            for _ in range(draw.randint(0, 8)):
                own[draw.randrange(len(own))] = "x" + str(draw.randrange(10**6))
            texts.append(" ".join(own))
    return texts + [prose[5]] * 20 + ["", None, "", "one two", "one two", "one two three four five", "one two three four five"]


def test_classes_are_those_of_all_pairs(spark, copies, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(copies)], "doc_id long, text string")
    want = classes(copies)
    for nodes in (1024, 4):  # blocks of a few texts give the same classes
        monkeypatch.setattr(dart_minhash, "BLOCK_NODES", nodes)
        got = {r["doc_id"]: r for r in dart_minhash.near_duplicate_classes(docs).collect()}
        assert [got[i]["class_id"] for i in range(len(copies))] == want
    sizes = Counter(want)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got.values())


def test_kept_documents(spark, odd_docs, copies):
    kept = dart_minhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    # null, empty and blank texts: null and empty are one class; equal rows and equal texts leave one row
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [
        (False, 1), (False, 3), (False, 4), (False, 7), (False, 8), (False, 9), (False, 11), (False, 12), (True, 0)
    ]
    assert dart_minhash.deduplicated(odd_docs.limit(0)).count() == 0


def test_signatures_estimate_the_similarity():
    draw = np.random.default_rng(4)
    common, a, b = (draw.integers(0, 2**63, n).astype(np.uint64) for n in (300, 100, 100))
    element = np.concatenate([common, a, common, b])
    row = np.repeat([0, 1], 400)
    s = dart_minhash.dart_signatures(element, row, 3, 2048)
    assert np.isinf(s[2]).all() and np.isfinite(s[:2]).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05


def test_signatures_take_fractions_of_weight():
    h = batches.mix(np.arange(1, 401, dtype=np.uint64))
    element, row = np.concatenate([h, h]), np.repeat([0, 1], 400)
    share = np.concatenate([np.ones(400), np.full(400, 0.5)])
    s = dart_minhash.dart_signatures(element, row, 2, 2048, share)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05


def test_components_of_random_edges(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    label = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert label == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contained_items(spark, prose):
    draw = random.Random(6)
    items = [" ".join(draw.choices(prose[i].split(), k=k)) for i, k in enumerate([6, 12, 30, 60])]
    items += ["too short here", "", None, items[1]]
    texts: list = []
    for i, item in enumerate(items[:4]):
        words = prose[10 + i].split()
        own = item.split()
        texts.append(" ".join(words + own + words))
        own[len(own) // 2] = "other"  # about five shingles less
        texts.append(" ".join(words + own))
    texts += [None, "", items[0], "too short here", " ".join(prose * 40) + " " + items[2], prose[3]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, items[3], 2)], "doc_id long, text string, h int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, size string")
    want = set()
    for i, text in [*enumerate(texts), (None, items[3])]:
        for j, item in enumerate(items):
            q = set(bag(item))
            if q and len(q & set(bag(text))) >= 0.8 * len(q):
                want.add((i, j, len(q & set(bag(text))), len(q)))
    got = decontaminate.contained_items(docs, bench)
    assert {tuple(r)[:4] for r in got.collect()} == want and got.count() == len(want) and len(want) >= 8
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns
    hit = {w[0] for w in want} - {None}
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == [i for i in range(len(texts)) if i not in hit]
    assert decontaminate.contained_items(docs.limit(0), bench).count() == 0
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0


def test_items_split_over_rows_of_one_id_and_rows_without_id(spark, prose):
    long, item = " ".join(prose[i] for i in range(6)).split(), prose[7].split()[:24]
    whole = " ".join(item)
    parts = [" ".join(item[:14]), " ".join(item[10:])]  # 10 of the item's 20 shingles each
    pieces = [" ".join(long[: len(long) * 3 // 4 + 2]), " ".join(long[len(long) * 3 // 4 - 2 :])]
    rows = [(1, parts[0]), (1, parts[1]), (2, parts[0]), (3, pieces[0]), (3, pieces[1]), (4, prose[20]), (4, prose[21]),
            (None, f"x y {whole} z"), (None, prose[22]), (None, None), (5, f"{whole} end"), (6, None), (None, pieces[1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, several string")
    bench = spark.createDataFrame([(10, whole), (11, " ".join(long)), (12, prose[30]), (12, prose[31])], "item_id long, text string")
    union: dict = {}
    for i, t in rows:
        union.setdefault(i, set()).update(bag(t) if t else [])
    items = {10: set(bag(whole)), 11: set(bag(" ".join(long))), 12: set(bag(prose[30])) | set(bag(prose[31]))}
    want = {(i, j, len(q & s)) for i, s in union.items() for j, q in items.items() if len(q & s) >= 0.8 * len(q)}
    assert {(r[0], r[1], r[2]) for r in decontaminate.contained_items(docs, bench).collect()} == want
    assert {w[:2] for w in want} == {(1, 10), (3, 11), (5, 10), (None, 10)}
    left = decontaminate.decontaminated(docs, bench)
    kept = [(2, parts[0]), (4, prose[20]), (4, prose[21]), (None, prose[22]), (None, None), (6, None), (None, pieces[1])]
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(kept, key=repr)


def test_a_filter_with_few_bits_changes_nothing(spark, prose):
    docs = spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(p.split()[5:40])) for i, p in enumerate(prose[:8])], "item_id long, text string")
    wide, narrow = (sorted(map(tuple, decontaminate.contained_items(docs, bench, bits=b).collect())) for b in (26, 8))
    assert wide == narrow and len(wide) >= 8


def test_shingles_are_those_of_python(prose):
    import pyarrow as pa

    texts = [*prose[:5], None, "", "a b c d", "a b c d e", " a\tb\x0bc\nd  e f "]
    h, row = batches.text_shingles(pa.array(texts))
    of: dict = {}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        mine = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        assert (row == i).sum() == len(mine)
        for key, value in zip(mine, h[row == i].tolist(), strict=True):
            assert of.setdefault(key, value) == value
    assert len(set(of.values())) == len(of)
