"""Phrase collocations: suffix pointers, routed by their leading words and split by multikey quicksort.

Every word position is a pointer to the phrase that begins there. Two counting passes abandon early what cannot
be frequent: words below the least count, then leading word pairs. What is left, cut before the first pair that
is not frequent, is routed by its leading words: by the first two, or, while pairs are so frequent that their
group would be large, by as many as are needed to reach a pair that is not; phrases of such pairs only are
routed whole. A task sorts the pointers it gets by three-way partitions of the first word, of the second word
inside the equal part, and so on to the longest phrase; the size of an equal part is the count of its phrase,
and parts below the least count are abandoned.

Words are 64-bit hashes of (language, word) until the last step. Equal pointers of a slice of text are one row
with a count, so copies and common lines collapse before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.batches import mix, partitions, sliced, span_hashes, store, utf8, word_bounds
from starloom.llm.decontaminate import bit_filter, passes

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2_000
#: A pair leads a group of its own up to this many occurrences, or one of 2**20 of all words if that is more; beyond
#: that the next word splits the group. So at most 2**20 pairs, and words to salt, are known to every task, 8 MB each
#: at any size. Pairs and not words, as common words lead most positions of a large table: a position gives one row
#: for each hot start, and far fewer pairs are hot.
GROUP_ROWS = 1 << 15
GROUP_SHARE = 20
#: Bits of the filters of frequent words and pairs, 2 MB and 8 MB at any size; more words or pairs raise the share of
#: pointers that pass, not their size, and change no result.
WORD_BITS, PAIR_BITS = 24, 26
#: Rows of one hot part of a phrase in the look-up of counts are dealt to this many keys.
SALTS = 16
#: Text whose pointers are gathered before a task hands them on, and rows that it sorts at a time.
GATHER_BYTES = 16 << 20
SORT_ROWS = 1 << 20

_CUTS = np.zeros(256, bool)
_CUTS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_BETWEEN = _CUTS.copy()
_BETWEEN[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Hashes of the words of a slice (lang, text), the row of each, whether the next word continues its piece,
    and the lower-cased bytes with the bounds of the words."""
    data, at = utf8(batch.column(1))
    data = _LOWER[data]
    starts, ends, row = word_bounds(data, at, ~_BETWEEN[data])
    langs = batch.column(0).dictionary_encode()
    keys = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") for v in langs.dictionary.to_pylist()]
    key = np.array(keys, np.uint64)[langs.indices.to_numpy()] if len(keys) else np.zeros(0, np.uint64)
    word = mix(span_hashes(data, starts, ends) + key[row])
    word[word == 0] = 1
    piece = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CUTS[data], out=piece[1:])
    follows = np.zeros(len(word), bool)
    if len(word):
        follows[:-1] = (row[1:] == row[:-1]) & (piece[starts[1:]] == piece[starts[:-1]])
    return word, row, follows, (data, starts, ends)


def count_words(texts: DataFrame) -> DataFrame:
    """lang, id, word and f of every word; a row without a word has the number of all words of its language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            word, row, _, (data, starts, ends) = words_of(part)
            if not len(word):
                continue
            ids, first, n = np.unique(word, return_index=True, return_counts=True)
            spelt = [data[starts[i] : ends[i]].tobytes().decode() for i in first]
            lang = part.column(0).take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays(
                [lang, pa.array(ids.view(np.int64)), pa.array(spelt, pa.string()), pa.array(n)], ["lang", "id", "word", "c"]
            )
            rows, n = np.unique(row, return_counts=True)
            none = pa.nulls(len(rows), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.array(np.zeros(len(rows), np.int64)), none, pa.array(n)],
                ["lang", "id", "word", "c"],
            )

    counted = texts.mapInArrow(count, "lang string, id long, word string, c long")
    return counted.groupBy("lang", "id", "word").agg(F.sum("c").alias("f"))


def _pairs(word: np.ndarray) -> np.ndarray:
    return mix(word[:-1] * _STEP + word[1:])


def count_pairs(texts: DataFrame, words: object) -> DataFrame:
    """Counts of hashed pairs of neighbours that both pass the filter of frequent words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            word, _, follows, _ = words_of(part)
            known = passes(words.value, word, WORD_BITS)
            pair = _pairs(word)[follows[:-1] & known[:-1] & known[1:]] if len(word) else word
            h, n = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "c"])

    return texts.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _among(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each id is one of the sorted ``known`` ones."""
    if not len(known):
        return np.zeros(len(ids), bool)
    return known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids


def _route(depth: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of the leading words that a pointer is routed by."""
    h = mix(depth.astype(np.uint64))
    for j in range(suffix.shape[1]):
        h = np.where(j < depth, mix(h * _STEP + suffix[:, j]), h)
    return h


def pointers(texts: DataFrame, words: object, pairs: object, hot: object, longest: int) -> DataFrame:
    """Phrases to count: route, depth (words that they are routed by), w1 to w5 (0 where they end), c. ``hot`` are pairs."""
    names = [f"w{j + 1}" for j in range(longest)]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held, size = [], 0
        for part in sliced(batches):
            word, _, follows, _ = words_of(part)
            if len(word):
                known, pair = passes(words.value, word, WORD_BITS), _pairs(word)
                follows[:-1] &= known[:-1] & known[1:] & passes(pairs.value, pair, PAIR_BITS)
                is_hot = np.zeros(len(word), bool)
                begin = np.flatnonzero(follows)
                is_hot[begin] = _among(pair[begin], hot.value)
                held.append((word, follows, is_hot))
                size += part.column(1).nbytes
            if size >= GATHER_BYTES:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, size = [], 0
        if held:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, follows, is_hot in gathered(batches):
            begin = np.flatnonzero(follows)
            if not len(begin):
                continue
            suffix = np.zeros((len(begin), longest), np.uint64)
            suffix[:, 0] = word[begin]
            goes = np.ones(len(begin), bool)
            leading = goes.copy()  # whether all pairs so far are hot
            depth = np.zeros(len(begin), np.int64)
            whole = []
            for j in range(1, longest):
                last = np.minimum(begin + j - 1, len(word) - 1)
                goes &= follows[last]
                suffix[:, j] = np.where(goes, word[np.where(goes, begin + j, 0)], 0)
                leading &= goes
                depth[leading & ~is_hot[last]] = j + 1
                leading &= is_hot[last]
                own = suffix[leading].copy()
                own[:, j + 1 :] = 0
                whole.append((own, np.full(len(own), j + 1)))
            split = depth > 0
            rows = np.concatenate([suffix[split]] + [s for s, _ in whole])
            depth = np.concatenate([depth[split]] + [d for _, d in whole])
            key = mix(depth.astype(np.uint64))
            for j in range(longest):
                key = mix(key * _STEP + rows[:, j])
            order = np.argsort(key, kind="stable")
            key, rows, depth = key[order], rows[order], depth[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(key)))
            rows, depth = rows[first], depth[first]
            route = _route(depth, rows)
            order = np.lexsort((rows[:, 1], rows[:, 0], route))  # neighbours share words: less to write
            route, rows, depth, n = route[order], rows[order], depth[order], n[order]
            for i in range(0, len(n), 50_000):
                cut = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route[cut].view(np.int64)), pa.array(depth[cut].astype(np.int32))]
                    + [pa.array(np.ascontiguousarray(rows[cut, j]).view(np.int64)) for j in range(longest)]
                    + [pa.array(n[cut])],
                    ["route", "depth", *names, "c"],
                )

    schema = "route long, depth int, " + ", ".join(f"{w} long" for w in names) + ", c long"
    return texts.mapInArrow(point, schema)


def equal_parts(keys: list[np.ndarray], weight: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Multikey three-way quicksort: (an element, number of its leading keys, weight) of every part of elements with
    equal leading keys that weighs ``least`` or more. A key of 0 from the second one on ends an element."""
    found, stack = [], [(np.arange(len(weight)), 0)] if len(weight) and weight.sum() >= least else []
    while stack:
        part, depth = stack.pop()
        key = keys[depth][part]
        a, b, c = key[0], key[len(key) // 2], key[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        same = key == pivot
        if not same.all():
            below = key < pivot
            for side in (part[below], part[~(below | same)]):
                if len(side) and weight[side].sum() >= least:
                    stack.append((side, depth))
            part = part[same]
        total = int(weight[part].sum())
        if total >= least and (depth == 0 or pivot):
            found.append((int(part[0]), depth + 1, total))
            if depth + 1 < len(keys):
                stack.append((part, depth + 1))
    return found


def sort_pointers(routed: DataFrame, hot: object, least: int, longest: int) -> DataFrame:
    """Phrases of two words and more with at least ``least`` occurrences: words, hot (bits of hot words), a.

    The rows of a route are neighbours in one task, which sorts whole routes, about ``SORT_ROWS`` rows at a time.
    """

    def counted(chunk: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(chunk).combine_chunks()
        depth = table["depth"].to_numpy().astype(np.uint64)
        keys = [depth] + [table[f"w{j + 1}"].to_numpy().view(np.uint64) for j in range(longest)]
        parts = [p for p in equal_parts(keys, table["c"].to_numpy(), least) if p[1] > 2 and p[1] > int(depth[p[0]])]
        rows = [[int(keys[j][i].view(np.int64)) for j in range(1, n)] for i, n, _ in parts]
        flags = [_among(np.array(r, np.int64).view(np.uint64), hot.value) for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.int64())), pa.array([int((f << np.arange(len(f))).sum()) for f in flags], pa.int32()),
             pa.array([a for _, _, a in parts], pa.int64())],
            ["words", "hot", "a"],
        )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= SORT_ROWS:  # the last route of the chunk may go on in this batch
                last = held[-1].column(0)[-1].as_py()
                route = batch.column(0).to_numpy()
                end = int(np.argmax(route != last)) if (route != last).any() else len(route)
                held.append(batch.slice(0, end))
                if end == len(route):
                    continue
                yield counted(held)
                batch = batch.slice(end)
                held, size = [], 0
            held.append(batch)
            size += batch.num_rows
        if held:
            yield counted(held)

    return routed.mapInArrow(split, "words array<long>, hot int, a long")


def _all_hot(hot: Column, start: Column, size: Column) -> Column:
    bits = F.call_function("shiftleft", F.lit(1), size) - 1
    return F.call_function("shiftright", hot, start).bitwiseAND(bits) == bits


def score_phrases(phrases: DataFrame, words: DataFrame, totals: DataFrame, limit: int, longest: int) -> DataFrame:
    """``phrases`` with lang, n, the counts of both parts of every cut, and score, k, l, r of the lowest one."""
    size = F.size("words")
    sides = [
        F.struct(k.alias("k"), F.lit(left).alias("left"), start.alias("start"), n.alias("n"))
        for left, k, start, n in (
            (True, F.col("k"), F.lit(0), F.col("k")), (False, F.col("k"), F.col("k"), size - F.col("k")),
        )
    ]
    parts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumn("side", F.explode(F.array(*sides)))
    spread = F.pmod(F.xxhash64("words"), F.lit(SALTS)).cast("int")
    parts = parts.select(
        "words", "a", "side.k", "side.left", F.slice("words", F.col("side.start") + 1, F.col("side.n")).alias("part"),
        F.when(_all_hot(F.col("hot"), F.col("side.start"), F.col("side.n")), spread).otherwise(0).alias("salt"),
    )
    whole = _all_hot(F.col("hot"), F.lit(0), size)
    none = F.lit(None).cast("string")
    facts = phrases.select(F.col("words").alias("part"), F.col("a").alias("f"), whole.alias("hot"), none.alias("lang")).union(
        words.select(F.array("id"), "f", F.col("f") > limit, "lang")
    )
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    facts = facts.select("part", "f", "lang", F.explode(salts).alias("salt"))
    at = [(k, left, F.when((F.col("k") == k) & (F.col("left") == left), F.col("f"))) for k in range(1, longest) for left in (True, False)]
    counts = [F.max(f).alias(f"{'l' if left else 'r'}{k}") for k, left, f in at]
    language = F.max(F.when((F.col("k") == 1) & F.col("left"), F.col("lang"))).alias("lang")
    cut = parts.join(facts, ["part", "salt"]).groupBy("words", "a").agg(language, *counts).join(totals, "lang")
    wide = "decimal(19,0)"

    def scored(k: int) -> Column:
        score = F.expr(f"(cast(1000 * cast(a as {wide}) as decimal(22,0)) * cast(n as decimal(16,0)))"
                       f" div (cast(l{k} as {wide}) * cast(r{k} as {wide}))")
        return F.when(size > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    least = F.array_min(F.array_compact(F.array(*[scored(k) for k in range(1, longest)])))
    return cut.withColumn("cut", least)


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP, text_col: str = "text",
    lang_col: str = "lang", group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and the breaks x0A to x0D, and pieces into words at
    blanks and tabs. A phrase has 2 to ``longest`` words and a >= ``min_count`` occurrences inside pieces, overlaps
    included. A cut after k words has l and r, the counts of both parts, and floor(1000 a n / (l r)); the lowest cut
    counts, the smallest k of ties. Phrases are left out if a longer candidate holds them as often as they occur.
    Order: score, a (both descending), then the phrase by its UTF-8 bytes, so there are no ties.

    A null language is ``und``; a null text is empty. Empty texts and tables give no rows. Repeated rows count each.
    Texts are read whole at any length, one at a time at least. Other columns are not read. Two words of one language
    with the same 64-bit hash would be counted as one (for 10 million words the chance is below 3 in a million).
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    known = store(count_words(texts).where((F.col("f") >= min_count) | F.col("word").isNull()), "words")
    totals = known.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    words = known.where(F.col("word").isNotNull())
    n = totals.agg(F.sum("n")).first()[0] or 0
    limit = max(n >> GROUP_SHARE, group_rows)
    ids = words.where(F.col("f") > limit).select("id").toArrow()["id"].to_numpy()
    hot = sc.broadcast(np.sort(ids.view(np.uint64)))
    word_filter = sc.broadcast(bit_filter(words.select(F.col("id").alias("h")), WORD_BITS))
    frequent = store(count_pairs(texts, word_filter).where(F.col("c") >= min_count), "pairs")
    pair_filter = sc.broadcast(bit_filter(frequent, PAIR_BITS))
    ids = frequent.where(F.col("c") > limit).select("h").toArrow()["h"].to_numpy()
    hot_pairs = sc.broadcast(np.sort(ids.view(np.uint64)))
    routed = pointers(texts, word_filter, pair_filter, hot_pairs, longest)
    routed = routed.repartition(partitions(spark), "route").sortWithinPartitions("route")
    phrases = store(sort_pointers(routed, hot, min_count, longest), "phrases")
    scored = store(score_phrases(phrases, words, totals, limit, longest), "scored")
    size = F.size("words")
    shorter = [
        F.when((size == m) & (F.col(f"l{m - 1}") == F.col("a")), F.slice("words", 1, m - 1)) for m in range(3, longest + 1)
    ] + [F.when((size > 2) & (F.col("r1") == F.col("a")), F.slice("words", 2, size - 1))] if longest > 2 else []
    left = scored.select("words", "lang", "a", "n", "cut.*")
    if shorter:
        held = scored.select(F.explode(F.array_compact(F.array(*shorter))).alias("words")).distinct()
        left = left.join(held, "words", "left_anti")
    by_score = [F.col("score").desc(), F.col("a").desc()]
    best = left.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*by_score))).where(F.col("place") <= top)
    best = store(best.drop("place"), "best")
    spelt = (
        best.select("words", F.posexplode("words").alias("at", "id"))
        .join(words.select("id", "word"), "id")
        .groupBy("words")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
        .select("words", F.array_join("spelt.word", " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(*by_score, "phrase")
    ranked = best.join(spelt, "words").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
