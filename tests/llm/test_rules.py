"""Line rules, personal data and rollups against row-by-row versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_support import library, odd_docs, prose  # noqa: F401
from starloom.llm import line_rules, skip_chain_pii, token_rollup

WORD = r"[^\x20\x09-\x0D]+"


def base_counts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        copies += bool(re.search(WORD, line)) and line in seen
        seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(repeated), failed


def test_base_counts(spark, odd_docs, prose):
    docs = odd_docs.select("doc_id", "text").union(
        spark.createDataFrame([(100 + i, p + "\n" + p[:200] + "\n" + p) for i, p in enumerate(prose[:10])], "doc_id long, text string")
    ).union(spark.createDataFrame([(200, "a b c " * 40), (201, "x\n\nx\n x\n"), (202, "\x1c a\x85b \xa0")], "doc_id long, text string"))
    for r in line_rules.clean_lines(docs).collect():
        assert tuple(r[c] for c in (*line_rules.COUNTS, "base_failed")) == base_counts(r["text"]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


LINES = {
    "The first line is a plain sentence with words.": True,
    "home | news | about us | contact | search": False,
    "» home » news » about » contact": False,
    "THIS LINE IS SHOUTED AT THE READER ALL THE TIME.": False,
    "wow!! buy!! now!! cheap!! here!!": False,
    "a*** b&&& c%%% d$$$ e### f***": False,
    "Read more": False,
    "All rights reserved.": False,
    "same same same same same same same same same same same": False,
    "Yes.": True,
    "": True,
    "LÈVE ÉCOUTE ÀÇÉ ÊTRE ÖÄÜ ÉCOLE.": False,
}


@pytest.mark.parametrize("line", LINES)
def test_line_rules(spark, prose, line):
    body = prose[0] + "\n" + prose[1]
    text = body + "\n" + line + "\n" + prose[2]
    row = line_rules.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["clean_text"] == (text if LINES[line] else body + "\n" + prose[2])
    assert row["kept"]


def long_prose(n: int) -> str:
    """One clean line of n words whose distinct share falls with its length, as that of natural text does."""
    import random

    draw = random.Random(11)
    names = [f"w{i:x}" for i in range(12_000)]
    return " ".join(draw.choices(names, [1 / (i + 3) for i in range(len(names))], k=n)) + "."


def test_clean_text_without_line_breaks_stays(spark):
    text = long_prose(20_000)
    assert len(set(text.split())) < 0.3 * 20_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = line_rules.clean_lines(docs).first()
    assert row["kept"] and row["lost_words"] == 0 and row["clean_text"] == text


def test_degenerate_lines_of_any_length_fail(spark, prose):
    passage = " ".join(f"p{i}" for i in range(60))
    bad = ["buy cheap now " * 4, "buy cheap now " * 2_000, f"{passage} " * 5, f"{passage} " * 60]
    rows = [(i, long_prose(20_000) + "\n" + b) for i, b in enumerate(bad)]
    for r in line_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["kept"] and r["clean_text"] == long_prose(20_000), r["doc_id"]


def test_phrases_do_not_run_over_the_border_of_documents(prose):
    import pyarrow as pa

    texts = [prose[0] + "\nThen she heard the door click ", "here " + prose[1], prose[2] + "\nPlease click here now."]
    together = line_rules.judge(pa.array(texts), line_rules.LineLimits())
    assert together["lost_words"].tolist() == [0, 0, 4]
    assert [int(line_rules.judge(pa.array([t]), line_rules.LineLimits())["lost_words"][0]) for t in texts] == [0, 0, 4]


def test_documents_that_lose_too_much_go(spark, odd_docs, prose):
    menu = "\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(60))
    docs = spark.createDataFrame([(1, prose[0] + "\n" + menu, "en", "s", 1), (2, prose[0] + "\n" + menu[:60], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = line_rules.cleaned_documents(docs).collect()
    assert [r["doc_id"] for r in kept] == [2] and kept[0]["n_chars"] == len(kept[0]["text"])
    odd = line_rules.cleaned_documents(odd_docs)
    assert odd.columns == odd_docs.columns and {r["doc_id"] for r in odd.collect()} == {4, 5, None, 9}
    assert {r["kept"] for r in odd.collect()} == {"x"}
    assert line_rules.clean_lines(odd_docs.limit(0)).count() == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_spans(text: str) -> list[tuple]:
    def fits(kind: str, found: str) -> bool:
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if fits(kind, m[0]))


PII = [
    "write to jo.doe+x@mail.example.org or to a@b.c_d@e.f.g. not@here x@y @z.w a@@b.c",
    "hosts 10.0.0.1, 256.1.1.1 and 1.2.3.4.5.6.7.8 and 001.02.3.4 and 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4532015112830366.", "call +1 (499) 555-6503 or +49 30 1234567, +1 2",
    "4532015112830366 4532015112830366 twice, é\U0001f600 +44 20 7946 0958", "", "9" * 20_000 + " " + "a" * 20_000 + "@", None,
]


def test_base_spans_are_those_of_the_patterns(spark):
    texts = PII + [" ".join(x or "" for x in PII[:5]) * 30]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, pii int")
    found = skip_chain_pii.find_pii(docs)
    for r in skip_chain_pii.digests(found).collect():
        want = base_spans(texts[r["doc_id"]] or "") if r["doc_id"] != 6 else []
        text = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [sum(s[1] == k for s in want) for k in range(4)]
        assert set(text.split(",")) <= {*r["spans"].split(","), ""}


def test_repeats_of_found_data_become_spans(spark, prose):
    one = "Call +1 (499) 555-6503 for help.\n" + prose[0] + "\nAgain: 555-6503 is the number."
    other = prose[1] + "\nThe part number 555-6504 is on the box."
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    rows = {r["doc_id"]: r["pii"] for r in skip_chain_pii.find_pii(docs).collect()}
    added = [s for s in rows[1] if not s["base"]]
    assert [(s["kind"], one[s["start"] : s["end"]]) for s in added] == [("phone", "555-6503")]
    assert rows[2] == []
    text = skip_chain_pii.find_pii(docs, redact=True).where("doc_id = 1").first()["text"]
    assert "555-6503" not in text and text.count("<PHONE>") == 2


@pytest.mark.parametrize("repeats", [20, 300])
def test_all_repeats_in_a_long_document_become_spans(spark, prose, repeats):
    words = prose[0].replace("\n", " ")
    text = "Call +1 (499) 555-6503 for help.\n" + f"{words} 555-6503 {words}\n" * repeats
    docs = spark.createDataFrame([(1, text), (2, prose[1])], "doc_id long, text string")
    out = skip_chain_pii.find_pii(docs, redact=True).where("doc_id = 1").first()["text"]
    assert "555-6503" not in out and out.count("<PHONE>") == repeats + 1


def test_messages_reach_the_end_of_a_chain():
    import numpy as np

    n, share, agreement = 40, np.array([0.95, 0.05]), 0.99
    step = agreement * np.eye(2) + (1 - agreement) * share  # stationary at the share
    unary = np.tile(np.log(share), (n, 1))
    unary[0] = [-40.0, 0.0]
    edges = np.stack([np.arange(n - 1), np.arange(1, n)], 1)
    got = skip_chain_pii.marginals(unary, [(edges, np.log(step / share))])[:, 1]
    want = [np.linalg.matrix_power(step, i)[1, 1] for i in range(n)]
    assert np.abs(got - want).max() < 1e-6


def test_message_passing_is_exact_on_a_tree():
    import numpy as np

    draw = np.random.default_rng(3)
    unary = draw.normal(size=(4, 3))
    pair = draw.normal(size=(3, 3))
    pair = pair + pair.T
    edges = np.array([(0, 1), (1, 2), (1, 3)])
    got = skip_chain_pii.marginals(unary, [(edges[:2], pair), (edges[2:], pair)], rounds=60)
    joint = np.zeros((3,) * 4)
    for y in np.ndindex(*joint.shape):
        joint[y] = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(pair[y[a], y[b]] for a, b in edges))
    joint /= joint.sum()
    want = np.stack([joint.sum(tuple(j for j in range(4) if j != i)) for i in range(4)])
    assert np.abs(got - want).max() < 1e-6


def test_odd_documents_have_their_data_found(odd_docs):
    out = skip_chain_pii.redacted_documents(odd_docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[11]["text"] == "mail <EMAIL>" and rows[1]["text"] is None and rows[1]["n_chars"] == 0
    assert out.count() == odd_docs.count() and out.columns == odd_docs.columns and rows[11]["pii"] == [1]
    assert skip_chain_pii.find_pii(odd_docs.limit(0)).count() == 0


def change(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, token_rollup.CHANGE_SCHEMA).withColumn("batch", F.lit("x"))


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r u"))
    assert rollup.totals().count() == 0
    first = change(spark, [("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None)])
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    second = change(spark, [("revise", "a", "en", "v1", 7, 5), ("delete", None, None, "v1", 0, None), ("delete", "a", "en", "v1", 10, None), ("insert", "a", "en", "v2", 9, None)])
    rollup.commit("two", second)
    want = [("a", "en", "v1", 1, 7), ("a", "en", "v2", 1, 9)]
    assert sorted(map(tuple, rollup.totals().collect())) == want
    rollup.compact()
    assert not rollup.commit("two", second)
    rollup.commit("empty", first.limit(0))
    assert sorted(map(tuple, rollup.totals().collect())) == want
    rollup.commit("three", change(spark, [("delete", "a", "en", "v2", 9, None)]))
    rollup.compact()
    assert sorted(map(tuple, rollup.totals().collect())) == want[:1]
    assert rollup.batches() == ["empty", "one", "three", "two"]


def test_a_failed_batch_is_written_again(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    rows = change(spark, [("insert", "a", "en", "v1", 10, None)])
    rollup.commit("one", rows)
    (tmp_path / "r" / "batches" / "one" / "_SUCCESS").unlink()  # as if the writer had been lost
    assert rollup.totals().count() == 0 and rollup.commit("one", rows)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 10)]


def test_wrong_changes_are_errors(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "w"))
    for op in ("move", None):
        with pytest.raises(Exception, match="no such change"):
            rollup.commit("one", change(spark, [(op, "a", "en", "v1", 1, None)]))
    with pytest.raises(ValueError):
        rollup.commit("a/b", change(spark, []))
    assert rollup.batches() == []


def test_token_counts(spark, odd_docs):
    rows = odd_docs.select("text", *(token_rollup.count_tokens("text", t).alias(t) for t in token_rollup.PATTERNS)).collect()
    for r in rows:
        assert [r[t] for t in token_rollup.PATTERNS] == [len(re.findall(p, r["text"] or "")) for p in token_rollup.PATTERNS.values()]
