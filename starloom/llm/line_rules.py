"""Line-first cleaning: rules judge every line, failing lines go, and documents that lose too much go.

All counts of a batch come from running sums over its bytes, so whole texts of any length are judged
without a Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.llm.batches import as_before, beside_text, mix, shingles, sliced, span_hashes, utf8, word_bounds

#: Limits of the base rules and their character class (fixed by the contract of the query).
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, b"#*$%&|<>"
#: The distinct share of clean text falls with its length, so lines are cut into windows of so many words or up to
#: twice as many, all of the same length but for one word.
WINDOW = 50
#: Phrases of site furniture; a short line that holds one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "accept cookies", "click here", "read more", "sign up for", "subscribe to", "enable javascript", "follow us on",
    "share this", "back to top", "skip to content", "powered by", "lorem ipsum",
)


@dataclass(frozen=True)
class LineLimits:
    """When a line fails; shares are of its words, except for capitals (of its letters)."""

    odd_marks: float = 0.4  # symbols and exclamation or question marks, beyond one
    separators: float = 0.15  # words that begin with a menu separator, two at least
    capitals: float = 0.6  # with ten letters at least
    distinct: float = 0.3  # fewer distinct words than this in most windows, with ten words at least
    fragment: int = 4  # so few words without closing punctuation
    boilerplate: int = 25  # so many words at most in a line with a boilerplate phrase
    lost: float = 0.5  # a document that loses a larger share of its words is rejected


def _mask(chars: bytes) -> np.ndarray:
    held = np.zeros(256, bool)
    held[np.frombuffer(chars, np.uint8)] = True
    return held


_SYMBOL = _mask(SYMBOLS)
_ODD = _mask(SYMBOLS + b"!?~^=+\\{}@_")
_CLOSING = _mask(b".!?:;)\"'\xa6\x9d\x99\xbb")  # the last bytes of typographic closers as well
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([at[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.append(starts[1:] - 1, at[-1])
    last = np.append(rows[1:] != rows[:-1], True)
    ends[last] = at[rows[last] + 1]
    return starts, ends, rows


def _distinct(hashes: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Number of distinct hashes in each group."""
    first = np.unique(mix(hashes ^ mix(group.astype(np.uint64))), return_index=True)[1]
    return np.bincount(group[first], minlength=groups)


def degenerate(hashes: np.ndarray, line: np.ndarray, count: np.ndarray, share: float) -> np.ndarray:
    """Lines that repeat few words in most of their windows, or long passages over and over.

    ``hashes`` are those of the words, in the order of their ``line``; ``count`` has the words of each line.
    """
    windows = np.maximum(1, count // WINDOW)
    first = np.concatenate([[0], np.cumsum(windows)])
    place = np.arange(len(line)) - (np.cumsum(count) - count)[line]
    window = first[line] + place * windows[line] // np.maximum(count, 1)[line]
    size = np.bincount(window, minlength=first[-1])
    few = _distinct(hashes, window, first[-1]) < share * size
    found = 2 * np.bincount(np.repeat(np.arange(len(count)), windows), weights=few, minlength=len(count)) > windows
    # a passage longer than a window: few distinct words in the line, and few distinct runs of five words
    known = _distinct(hashes, line, len(count)) < share * count
    chosen = known[line]
    run, run_line = shingles(hashes[chosen], line[chosen])
    runs = np.bincount(run_line, minlength=len(count))
    return (count >= 10) & (found | (known & (_distinct(run, run_line, len(count)) < share * runs)))


def judge(column: pa.Array, limits: LineLimits) -> dict[str, np.ndarray]:
    """Base counts and verdicts of each text, and which lines of which text go."""
    data, at = utf8(column)
    n = len(at) - 1
    words, word_ends, row = word_bounds(data, at)
    hashes = span_hashes(data, words, word_ends)

    def per(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(mask)])
        return running[ends] - running[starts]

    n_words = np.bincount(row, minlength=n)
    points = (data & 0xC0) != 0x80
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    word_chars = per(points & ~space[data], at[:-1], at[1:])
    symbols = per(_SYMBOL[data], at[:-1], at[1:])

    window, window_row = shingles(hashes, row, 3)
    key = mix(window ^ mix(window_row.astype(np.uint64)))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    first_word = np.flatnonzero(row[: max(0, len(row) - 2)] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)
    repeated = np.zeros(len(row), bool)
    for j in range(3):
        repeated[first_word[times[inverse] > 1] + j] = True
    n_repeat = np.bincount(row[repeated], minlength=n)

    starts, ends, line_row = _lines(data, at)
    line = np.searchsorted(starts, words, "right") - 1
    count = np.bincount(line, minlength=len(starts))
    line_hash = mix(span_hashes(data, starts, ends) ^ mix(line_row.astype(np.uint64)))
    earlier = np.ones(len(starts), bool)
    earlier[np.unique(line_hash, return_index=True)[1]] = False
    duplicate = earlier & (count > 0)
    n_dup = np.bincount(line_row[duplicate], minlength=n)

    odd = per(_ODD[data], starts, ends)
    two_byte_upper = np.zeros(len(data), bool)
    two_byte_lower = np.zeros(len(data), bool)
    after_c3 = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    two_byte_upper[after_c3] = data[after_c3] < 0x9F
    two_byte_lower[after_c3] = data[after_c3] >= 0x9F
    upper = per(_UPPER[data] | two_byte_upper, starts, ends)
    lower = per(_LOWER[data] | two_byte_lower, starts, ends)
    marks = np.zeros(len(data), bool)
    lead = data[words]
    opens = (lead == 124) | (lead == 62)  # | and >
    for mark in ("»", "›", "•", "·"):
        raw = mark.encode()
        same = words + len(raw) <= len(data)
        for j, byte in enumerate(raw):
            same &= data[np.minimum(words + j, len(data) - 1)] == byte
        opens |= same
    marks[words[opens]] = True
    separators = per(marks, starts, ends)
    last_word = np.zeros(len(starts), np.int64)
    np.maximum.at(last_word, line, word_ends)
    closed = _CLOSING[data[np.maximum(last_word - 1, 0)]] if len(data) else np.zeros(len(starts), bool)
    lowered = data.tobytes().lower()
    phrase = np.zeros(len(starts), bool)
    for text in BOILERPLATE:
        raw, found = text.encode(), lowered.find(text.encode())
        while found >= 0:
            at_line = np.searchsorted(starts, found, "right") - 1
            whole = found + len(raw) <= ends[at_line]  # texts of a batch follow one another without a mark
            phrase[at_line] |= whole
            found = lowered.find(raw, found + (len(raw) if whole else 1))

    failed = (count > 0) & (
        (odd > np.maximum(1, limits.odd_marks * count))
        | ((separators >= 2) & (separators > limits.separators * count))
        | ((upper + lower >= 10) & (upper > limits.capitals * (upper + lower)))
        | degenerate(hashes, line, count, limits.distinct)
        | ((count < limits.fragment) & ~closed)
        | (phrase & (count <= limits.boilerplate))
        | duplicate
    )
    lost = np.bincount(line_row, weights=count * failed, minlength=n)
    base = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat, "base_failed": base, "kept": ~base & (lost <= limits.lost * n_words),
        "lost_words": lost.astype(np.int64), "failed": failed, "line_row": line_row,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def clean_lines(docs: DataFrame, limits: LineLimits = LineLimits(), text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the counts, ``base_failed``, ``kept``, ``lost_words`` and ``clean_text``.

    ``clean_text`` is the text without its failing lines. A null text counts as empty, so it fails the base
    rules, and its ``clean_text`` is empty; an empty table gives an empty one; repeated rows are judged
    alike. A column that has one of the new names is replaced.
    """
    flags = ("base_failed", "kept")
    made = [*COUNTS, "lost_words", *flags, "clean_text"]
    rest = [c for c in docs.columns if c not in made]
    docs = docs.select(*rest)
    at = rest.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, at):
            found = judge(part.column(at), limits)
            texts = part.column(at).to_pylist()
            bounds = np.searchsorted(found["line_row"], np.arange(len(texts) + 1))
            hit = np.bincount(found["line_row"], weights=found["failed"], minlength=len(texts)) > 0
            clean = []
            for i, text in enumerate(texts):
                if hit[i]:
                    gone = found["failed"][bounds[i] : bounds[i + 1]].tolist()
                    text = "\n".join(x for x, f in zip(text.split("\n"), gone, strict=True) if not f)
                clean.append(text or "")
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(found[c].astype(np.int64)) for c in (*COUNTS, "lost_words")),
                 *(pa.array(found[c]) for c in flags), pa.array(clean, pa.string())],
                [*rest, *made],
            )

    schema = StructType([*docs.schema.fields])
    for c in (*COUNTS, "lost_words"):
        schema = schema.add(c, "long")
    for c in flags:
        schema = schema.add(c, "boolean")
    return docs.mapInArrow(apply, schema.add("clean_text", "string"))


def cleaned_documents(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The kept documents with their clean text, in the columns of ``docs``; ``n_chars`` follows the text."""
    kept = clean_lines(beside_text(docs), limits).where("kept")
    return as_before(kept, docs, F.col("clean_text"))
