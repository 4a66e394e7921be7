"""Trained models: held-out quality on the given tables, exactness of what they compute, odd input."""

from __future__ import annotations

import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from llm_support import LARGE, library, odd_docs, prose  # noqa: F401
from starloom.llm import compression_quality, ppm_language, toxicity_neighbours
from starloom.llm.batches import mix, span_hashes, utf8
from starloom.llm.queries import QUERIES

needs_tables = pytest.mark.skipif(not os.path.isdir(LARGE), reason="test tables are not there")


def held_out_rows(spark, name: str, label: str) -> list:
    scored = QUERIES[name](spark, LARGE).where("held_out")
    return scored.join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").select("score", "predicted", label).collect()


@needs_tables
def test_quality_of_held_out_documents(spark):
    rows = held_out_rows(spark, "op2_compression_quality", "quality")
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert np.mean([(r["score"] - r["quality"]) ** 2 for r in rows]) < 0.02


@needs_tables
def test_toxicity_of_held_out_documents(spark):
    rows = held_out_rows(spark, "op9_toxicity_neighbours", "toxic")
    toxic, clean = [[r["predicted"] for r in rows if r["toxic"] == y] for y in (1, 0)]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


@needs_tables
def test_language_of_held_out_documents(spark):
    rows = QUERIES["op6_ppm_language"](spark, LARGE).where("held_out").join(
        spark.read.parquet(f"{LARGE}/documents.parquet"), "doc_id"
    ).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def code_length(text: bytes, counts: dict, known: set) -> float:
    """Bits of a text under the tree of one language, symbol by symbol; unseen bytes stand as zero."""
    total, seen_bytes = 0.0, {s for c in counts.values() for s in c}
    text = bytes(b if b in seen_bytes else 0 for b in text)
    for i, symbol in enumerate(text):
        for order in range(3, -1, -1):
            context = bytes([0] * max(0, order - i)) + text[max(0, i - order) : i]
            if order >= 2 and (order, context) not in known:
                continue
            seen = counts.get((order, context))
            if not seen:
                continue
            n, q = sum(seen.values()), len(seen)
            if symbol in seen:
                total -= math.log2(seen[symbol] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8.0
    return total


def test_code_lengths_are_those_of_the_trees(spark, prose):
    texts = {"aa": prose[:6], "bb": [p.upper() for p in prose[6:10]]}
    docs = spark.createDataFrame([(x, t) for x in texts for t in texts[x]] + [(None, "x"), ("aa", None)], "lang string, text string")
    model = ppm_language.train(docs, contexts=300)
    counts: dict = {x: defaultdict(Counter) for x in texts}
    totals: Counter = Counter()
    for lang, mine in texts.items():
        for t in mine:
            raw = t.encode()
            for i, symbol in enumerate(raw):
                for order in range(4):
                    context = bytes([0] * max(0, order - i)) + raw[max(0, i - order) : i]
                    counts[lang][(order, context)][symbol] += 1
                    if order >= 2:
                        totals[(order, context)] += 1
    known = {k for k, _ in sorted(totals.items(), key=lambda x: -x[1])[:300]}
    least = min(totals[k] for k in known)
    clear = {k for k in known if totals[k] > least}  # contexts tied at the cut are taken by number
    tried = [prose[20], prose[20].title(), "zzz \U0001f600", "a", ""]
    everything = {lang: counts[lang] for lang in counts}
    for lang in everything:  # both trees know the bytes of either language
        for other in everything:
            everything[lang].setdefault((9, b""), Counter()).update(everything[other][(0, b"")])
    got = model.bits(*utf8(pa.array(tried)))
    for lang_at, lang in enumerate(model.langs):
        for i, t in enumerate(tried):
            low, high = (code_length(t.encode(), counts[lang], k) for k in (clear, {k for k in totals if totals[k] >= least}))
            assert min(low, high) * 0.97 - 1 <= got[i, lang_at] <= max(low, high) * 1.03 + 1


def test_language_of_odd_documents(spark, odd_docs, prose):
    model = ppm_language.train(odd_docs.select("lang", "text"))
    rows = ppm_language.predict(odd_docs, model).collect()
    for r in rows:
        undetermined = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == undetermined and (r["score"] == 0) == undetermined
    assert ppm_language.predict(odd_docs, model).columns == [*(c for c in odd_docs.columns if c != "score"), "lang_pred", "score"]
    assert ppm_language.train(odd_docs.limit(0).select("lang", "text")) is None
    assert {r["lang_pred"] for r in ppm_language.predict(odd_docs, None).collect()} == {"und"}
    assert ppm_language.predict(odd_docs.limit(0), model).count() == 0


def labelled(spark, prose):
    """Prose with label 1, shouted symbols with label 0, and rows that must not matter."""
    texts = [*prose, *(" ".join(w + "***&&&" for w in p.split()) for p in prose)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "x")], "doc_id long, text string")
    labels = [(i, int(i < len(prose)), int(i % 4 == 0)) for i in range(len(texts))]
    return docs, spark.createDataFrame([*labels, labels[0], (900, 1, 1), (901, None, None), (902, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_compressed_sizes_are_those_of_the_library(spark, odd_docs, prose):
    docs, labels = labelled(spark, prose)
    model = compression_quality.train(docs, labels)
    texts = ["", None, prose[0], prose[0] * 50]
    sizes = compression_quality.compressed_sizes(pa.array(texts), model.dictionaries)
    for row, text in zip(sizes, texts, strict=True):
        raw = (text or "").encode()
        assert row[0] == len(raw)
        for size, data in zip(row[2:], model.dictionaries, strict=True):
            held = zstandard.ZstdCompressionDict(data)
            c = zstandard.ZstdCompressor(level=3, dict_data=held, write_dict_id=False, write_content_size=False)
            assert abs(len(c.compress(raw)) - size) <= 16
    rows = compression_quality.score(docs, model).where("doc_id < 900").collect()
    assert np.mean([r["predicted"] == (r["doc_id"] < len(prose)) for r in rows]) > 0.95
    odd = compression_quality.score(odd_docs, model)
    assert odd.count() == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd.collect())
    assert compression_quality.score(odd_docs.limit(0), model).count() == 0


def test_no_labels_give_no_model(spark, odd_docs, prose):
    docs, labels = labelled(spark, prose)
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert compression_quality.train(docs, some) is None
    assert {r["score"] for r in compression_quality.score(odd_docs, None).collect()} == {0.5}
    assert toxicity_neighbours.train(docs, labels.where("toxic = 1")) is None
    assert {r["score"] for r in toxicity_neighbours.score(odd_docs, None).collect()} == {0.0}


def test_neighbours_are_those_of_all_examples():
    draw = np.random.default_rng(8)
    n_terms, n = 60, 700
    words = [(f"w{i}", int(h), float(draw.uniform(0.5, 4))) for i, h in enumerate(draw.integers(-(2**62), 2**62, n_terms))]
    vectors = [[(int(t), int(draw.integers(1, 5))) for t in np.sort(draw.choice(n_terms, draw.integers(0, 6), replace=False))] for _ in range(n)]
    index = toxicity_neighbours.Index(words, list(range(n)), draw.integers(0, 2, n), vectors)
    dense = np.zeros((n, n_terms))
    for i, example in enumerate(index.ids):
        if vectors[example]:
            t, w = index.weights(vectors[example])
            dense[i, t] = w
    for _ in range(200):
        vector = [(int(t), int(draw.integers(1, 5))) for t in np.sort(draw.choice(n_terms, draw.integers(1, 8), replace=False))]
        t, w = index.weights(vector)
        cosine = dense[:, t] @ w
        [(found, score)] = index.nearest([vector])
        assert len(found) == min(16, (cosine > 0).sum()) == len(set(found.tolist()))
        assert np.allclose(np.sort(cosine)[::-1][: len(score)], score, atol=1e-5)
        assert np.allclose(cosine[found], score, atol=1e-5)


def test_toxic_words_are_learned(spark, prose):
    docs = [(i, p + (" you vile scumbag" if i % 3 == 0 else "")) for i, p in enumerate(prose * 4)]
    docs = spark.createDataFrame([(i, f"{t} {i}") for i, (_, t) in enumerate(docs)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(text like '%scumbag%' as int) as toxic")
    index = toxicity_neighbours.train(docs, labels)
    assert {"vile", "scumbag"} <= set(index.terms)
    tried = spark.createDataFrame([(1, "a VILE, scumbag!"), (2, prose[1]), (3, None), (4, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in toxicity_neighbours.score(tried, index).collect()}
    assert [rows[i]["predicted"] for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    toxic_ids = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert set(rows[1]["neighbours"]) <= toxic_ids and len(rows[1]["neighbours"]) == 16 and not rows[3]["neighbours"]


@needs_tables
def test_scores_and_neighbours_over_all_terms_are_those_of_plain_python(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").where("doc_id < 1200").select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", "toxic")
    index = toxicity_neighbours.train(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode().lower() for r in docs.collect()}
    known = {r["doc_id"] for r in labels.where("toxic is not null").collect()}
    examples = index.ids
    assert set(examples) <= known and len(examples) == len(set(examples))
    words = {i: re.findall(rb"[a-z0-9\x80-\xff]+", t) for i, t in texts.items()}
    counts = {}
    for i, found in words.items():
        counts[i] = Counter((w, False) for w in found)
        counts[i].update((w[:n], True) for w in found for n in (4, 5, 6) if len(w) > n)
    df = Counter(t for c in counts.values() for t in c)
    chosen = spark.createDataFrame([(texts[i].decode(), int(y)) for i, y in zip(index.ids, index.labels, strict=True)], "text string, y int")
    told = {h for _, h, _ in toxicity_neighbours.vocabulary(chosen)}

    def hashed(term: tuple[bytes, bool]) -> int:
        data = np.frombuffer(term[0], np.uint8)
        h = span_hashes(data, np.array([0]), np.array([len(data)]))
        return int((mix(h) if term[1] else h).view(np.int64)[0])

    every = {t for i in examples for t in counts[i]}
    of_label = {t for t in every if hashed(t) in told}
    assert of_label and len(of_label) < len(every) / 10
    idf = {t: (np.log(len(texts) / df[t]) + 0.1) * (1 if t in of_label else toxicity_neighbours.PLAIN) for t in every if t in of_label or not t[1]}

    def unit(c: Counter) -> dict:
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / size for t, x in w.items()}

    units = {i: unit(counts[i]) for i in texts}
    label = dict(zip(index.ids, index.labels, strict=True))
    with_word = 0
    for r in toxicity_neighbours.score(docs.where("doc_id % 3 = 0"), index).collect():
        mine = units[r["doc_id"]]
        cosine = {e: sum(x * units[e].get(t, 0.0) for t, x in mine.items()) for e in examples}
        best = sorted((x for x in cosine.values() if x > 1e-6), reverse=True)[:16]
        assert len(r["neighbours"]) == len(best) == len(set(r["neighbours"]))
        assert np.allclose(r["cosines"], best, atol=3e-5)
        assert np.allclose([cosine[e] for e in r["neighbours"]], r["cosines"], atol=3e-5)
        assert not mine or best
        if best:
            with_word += 1
            near = [1 / (1.05 - min(x, 1.0)) for x in r["cosines"]]
            share = (sum(n * label[e] for n, e in zip(near, r["neighbours"], strict=True)) + 0.5) / (sum(near) + 1)
            z = index.calibration[0] * math.log(share / (1 - share)) + index.calibration[1]
            assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-3 and r["predicted"] == int(r["score"] >= 0.5)
    assert with_word > 300


def test_rare_terms_and_terms_of_either_label_are_kept(spark):
    rows = [(f"common{i % 7} " + ("vilword" if 0 < i <= 18 else "") + ("kindword" if i > 3_900 else ""), int(i < 2_000)) for i in range(4_000)]
    words = toxicity_neighbours.vocabulary(spark.createDataFrame(rows, "text string, y int"))
    assert {"vilword", "kindword"} <= {w for w, _, _ in words}


def test_training_with_clashing_columns_text_ids_and_repeated_rows(spark, prose):
    docs, labels = labelled(spark, prose)
    docs = docs.unionAll(docs.where("doc_id < 4")).selectExpr("concat('d', doc_id) as doc_id", "text", "1 as y", "2 as id", "3 as __id", "4 as half")
    labels = labels.selectExpr("concat('d', doc_id) as doc_id", "quality", "toxic", "5 as y", "6 as n")
    model = compression_quality.train(docs, labels)
    rows = compression_quality.score(docs.where("length(text) > 1"), model).collect()
    assert np.mean([r["predicted"] == (int(r["doc_id"][1:]) < len(prose)) for r in rows]) > 0.95
    words = docs.selectExpr("*", "text as old").selectExpr("doc_id", "concat(old, if(doc_id rlike '[02468]$', ' vile', ' kind')) as text", "y")
    toxic = labels.selectExpr("doc_id", "cast(doc_id rlike '[02468]$' as int) as toxic", "y")
    index = toxicity_neighbours.train(words, toxic)
    out = toxicity_neighbours.score(words, index)
    assert out.schema["neighbours"].dataType.simpleString() == "array<string>"
    found = out.where("text is not null and text like '% vile'").collect()
    assert found and all(r["predicted"] == 1 and r["neighbours"][0].startswith("d") for r in found)
    assert toxicity_neighbours.score(words.limit(0), index).count() == 0


def test_newton_steps_are_damped():
    draw = np.random.default_rng(2)
    for scale in (1e-3, 1.0, 30.0):
        x = draw.normal(size=(400, 4)) ** 3 * scale
        y = (x[:, 0] > np.quantile(x[:, 0], 0.98)).astype(float)
        centre, spread, w = compression_quality.fit_logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip((x - centre) / spread @ w[:-1] + w[-1], -30, 30)))
        assert np.isfinite(w).all() and ((p > 0.5) == (y > 0)).mean() > 0.97
        z = np.column_stack([(x - centre) / spread, np.ones(len(x))])
        assert np.abs(z.T @ (p - y) + 1e-2 * np.append(w[:-1], 0)).max() < 1e-3
