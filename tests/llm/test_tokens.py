"""Packing and token files against whole-text encoding by the tokenizers library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_support import library, odd_docs, prose  # noqa: F401
from starloom.llm import packing, token_file
from starloom.llm.bpe import CachedBpe

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", "a  b", " a", "a ", "\n", "a\n\nb", "a \nb", "a\n b", "a\tb", "a \tb", "a\t b", "a b", "!\x1c x", "It's ÉTÉ.",
    "<|endoftext|> a  b", "x<|endoftext|>", "don't I'LL 12 345", "a\r\nb", None, "é éx", " ", "中文 文", "A!!, b",
]


def reference(path: str, texts: list) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_cached_ids_are_those_of_whole_texts(name, prose):
    path = public_tokenizers.path(name)
    bpe = CachedBpe(path, cached=500)  # so small that the cache is emptied in between
    for texts in (ODD, prose, [p.upper() for p in prose[:9]], ODD):
        ids, sizes = bpe.encode(texts)
        at = np.cumsum([0, *sizes])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == reference(path, texts)


@pytest.mark.parametrize("name", FILES)
def test_cached_ids_of_random_texts(name):
    draw = random.Random(3)
    letters = "aBéß \n\t.,!'19中"
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(400)]
    path = public_tokenizers.path(name)
    ids, sizes = CachedBpe(path).encode(texts)
    assert ids.tolist() == [x for ids in reference(path, texts) for x in ids]
    assert sizes.sum() == len(ids)


def test_patterns_use_each_length_as_often_as_it_occurs():
    draw = random.Random(1)
    for limit in (16, 64, 4096):
        histogram = {n: draw.randint(1, 50) for n in draw.sample(range(1, limit + 1), min(limit, 40))}
        patterns = packing.packing_patterns(histogram, limit)
        assert all(sum(lengths) <= limit and packs > 0 for packs, lengths in patterns)
        used: Counter = Counter()
        for packs, lengths in patterns:
            used.update({n: packs * k for n, k in Counter(lengths).items()})
        assert used == Counter(histogram)
    assert packing.packing_patterns({}, 16) == []
    with pytest.raises(ValueError):
        packing.packing_patterns({17: 1}, 16)


def test_many_pieces_of_one_length_need_no_long_loop():
    patterns = packing.packing_patterns({1: 10**9 + 1, 7: 10**9}, 16)
    assert sum(p * sum(x) for p, x in patterns) == 8 * 10**9 + 1


def test_packed_documents(odd_docs):
    path = public_tokenizers.path(FILES[0])
    rows = packing.pack_documents(odd_docs, path, max_len=128).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    wanted = Counter()
    for doc_id, ids in zip([t["doc_id"] for t in texts], reference(path, [t["text"] for t in texts]), strict=True):
        for a in range(0, len(ids), 128):
            raw = np.array(ids[a : a + 128], "<u4").tobytes()
            wanted[(doc_id, a, len(raw) // 4, len(ids), zlib.crc32(raw), raw)] += 1
    got = Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in rows)
    assert got == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) < 1.1 * sum(r["length"] for r in rows) / 128 + 2


def test_empty_table_is_packed(odd_docs):
    assert packing.pack_documents(odd_docs.limit(0), public_tokenizers.path(FILES[0])).count() == 0


def test_place_replaces_clashing_columns(spark):
    placed = packing.place(spark.createDataFrame([(1, 2, 3)], "k long, length long, offset long"), ["k"]).collect()
    assert [tuple(r) for r in placed] == [(1, 2, 0, 0)]


def test_codes_come_back():
    draw = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 999):
        for most in (2**7, 2**16, 2**24, 2**32):
            ranks = draw.integers(0, most, n, dtype=np.uint64).astype(np.uint32)
            control, data = token_file.encode_ranks(ranks)
            assert len(control) == -(-n // 4)
            assert (token_file.decode_ranks(control, data, n) == ranks).all()


def test_token_file_round_trip(spark, odd_docs, tmp_path):
    path = public_tokenizers.path(FILES[1])
    docs = odd_docs
    target = str(tmp_path / "a b" / "tokens")
    token_file.write_token_file(docs, path, target, segment_ids=64)
    texts = docs.select("doc_id", "text").orderBy("doc_id", F.length("text")).collect()
    ids = reference(path, [t["text"] for t in texts])
    found = token_file.read_token_ids(spark, target).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((t["doc_id"], tuple(x)) for t, x in zip(texts, ids, strict=True))
    crc = Counter((t["doc_id"], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for t, x in zip(texts, ids, strict=True))
    start = 0
    last = None
    for r in token_file.read_token_digests(spark, target).orderBy("start").collect():
        assert r["start"] == start and (last is None or r["doc_id"] >= last)
        start, last = start + r["n_tokens"], r["doc_id"]
        crc[(r["doc_id"], r["n_tokens"], r["ids_crc32"])] -= 1
    assert set(crc.values()) == {0} and start == sum(map(len, ids))
    order = token_file.segments(spark, target).orderBy("part", "segment").select("doc_ids").collect()
    stored = np.concatenate([np.frombuffer(r["doc_ids"], "<i8") for r in order])
    assert (np.diff(stored) >= 0).all() and token_file.segments(spark, target).count() > 3


def test_frequent_ids_get_low_ranks(spark, odd_docs, tmp_path):
    token_file.write_token_file(odd_docs.where("doc_id = 7"), public_tokenizers.path(FILES[1]), str(tmp_path / "t"))
    row = token_file.segments(spark, str(tmp_path / "t")).first()
    ids = np.frombuffer(row["table"], "<u4")[token_file.decode_ranks(row["control"], row["data"], row["n_ids"])]
    times = Counter(ids.tolist())
    counts = [times[i] for i in np.frombuffer(row["table"], "<u4").tolist()]
    assert counts == sorted(counts, reverse=True)
    assert len(row["control"]) + len(row["data"]) < 1.6 * row["n_ids"]


def test_token_file_of_an_empty_table(spark, odd_docs, tmp_path):
    path = public_tokenizers.path(FILES[1])
    assert token_file.token_file_digests(odd_docs.limit(0), path, str(tmp_path / "e")).count() == 0


def test_rows_of_one_id_are_spread_over_tasks(spark, tmp_path):
    path, target = public_tokenizers.path(FILES[1]), str(tmp_path / "hot")
    texts = [f"row {i} of one id" for i in range(2000)]
    docs = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    token_file.write_token_file(docs, path, target)
    assert token_file.segments(spark, target).select("part").distinct().count() > 4
    digests = token_file.read_token_digests(spark, target).orderBy("start").collect()
    assert [r["doc_id"] for r in digests] == [None] * 1000 + [7] * 1000
    found = Counter((r["doc_id"], tuple(r["ids"])) for r in token_file.read_token_ids(spark, target).collect())
    assert found == Counter((None if i % 2 else 7, tuple(x)) for i, x in enumerate(reference(path, texts)))
