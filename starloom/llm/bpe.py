"""Token ids of whole texts by a public tokenizer file, with a cache of words.

A text is cut where the tokenizer starts a new token in any case, the distinct pieces are encoded by the
tokenizers library, and the ids of a text are put together from the pieces. Two kinds of file are known:
one drops white space, so any blank is a cut; the other joins a blank to the word behind it, so a cut is a
white-space character after another character. Texts that hold a special token are encoded directly.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np

#: Pieces that a worker keeps; beyond them it forgets those that were rarely met.
CACHED_PIECES = 600_000
END_ID = 2
_CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_LETTERS = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+"
_WORD = re.compile(_LETTERS).fullmatch
_MARKS = ".,!?;:|*&%$#"
BLANK = "\u0120"  # how byte-level files write a blank
#: Byte-level files write bytes as letters; those of the letters above (ASCII stands for itself).
_BYTES = {
    chr(c): "".join(chr(b if 0xA1 <= b != 0xAD else 0x100 + b - 0x7F + 33 if b < 0xA1 else 0x143) for b in chr(c).encode())
    for c in range(0xC0, 0x100)
}
_LEAD = "\u00C3"  # the letter that begins all of these, and one of them itself
_UNCLEAN, _NEW = -1, -2
_loaded: dict[tuple, CachedBpe] = {}


def cached_bpe(path: str, end_id: int | None = END_ID) -> CachedBpe:
    """The tokenizer of this worker process; its cache outlives a task."""
    key = (path, end_id)
    if key not in _loaded:
        _loaded[key] = CachedBpe(path, end_id)
    return _loaded[key]


class CachedBpe:
    def __init__(self, path: str, end_id: int | None = END_ID, cached: int = CACHED_PIECES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.drops_space = "ByteLevel" != (spec["pre_tokenizer"] or {}).get("type")
        self.known = self.drops_space is False or spec["model"].get("end_of_word_suffix") == "</w>"
        self.end_id, self.cached = end_id, cached
        bare = spec | {"normalizer": None, "post_processor": None, "added_tokens": []}
        bare["pre_tokenizer"] = {"type": "CharDelimiterSplit", "delimiter": " "}
        self.model = Tokenizer.from_str(json.dumps(bare))
        edge = (lambda t: t.endswith("</w>")) if self.drops_space else (lambda t: t.startswith(BLANK))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if edge(t)]] = True
        self.reset()

    def reset(self) -> None:
        self.inner: dict[str, int] = {}
        self.whole: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used, self.count = 0, 0
        self.starts, self.sizes, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))
        if self.end_id is not None:
            self._keep(np.array([self.end_id], np.uint32), np.array([1]))

    def forget(self) -> None:
        """Drops the pieces that were met least: all below the least count that leaves a third of the places."""
        met = self.met[: self.count]
        least = 2
        while np.count_nonzero(met >= least) > self.cached // 3:
            least *= 2
        kept = np.flatnonzero(met >= least)
        kept = kept if self.end_id is None else kept[kept > 0]
        tables = [self.inner, self.whole, self.words]
        if not len(kept):
            self.reset()
            return
        ids, ends = self._expand(kept)
        again = np.full(self.count, _NEW)
        first = 0 if self.end_id is None else 1  # the end id has number 0 in any case
        again[kept] = np.arange(len(kept)) + first
        number = again.tolist()
        met = met[kept] // 2
        self.reset()
        self.met[first : first + len(kept)] = 0
        self._keep(ids, np.diff(ends, prepend=0))
        self.met[first : self.count] = met
        self.inner, self.whole, self.words = (
            {p: number[n] for p, n in t.items() if n >= 0 and number[n] >= 0} for t in tables
        )

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new pieces with these ids."""
        first, total = self.count, len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(sizes) > len(self.starts):
            self.starts, self.sizes, self.met = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes, self.met))
        self.flat[self.used : self.used + total] = ids
        self.sizes[first : first + len(sizes)] = sizes
        self.starts[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.count += len(sizes)
        return np.arange(first, self.count)

    def _expand(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and where each piece ends."""
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, self.used) < 1 << 30 else np.int64
        shift = (self.starts[index] - ends + sizes).astype(kind)
        return self.flat[np.repeat(shift, sizes) + np.arange(total, dtype=kind)], ends

    def _batch(self, texts: list[str]) -> np.ndarray:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return self._keep(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes)

    def _joined(self, words: list[str]) -> np.ndarray:
        """As ``_batch`` for words of letters, in one call of the bare model: it works on the letters that
        stand for bytes, and its tokens show where a word ends (or begins, with its blank)."""
        text = " ".join(words)
        if not text.isascii():
            for c in sorted(set(text).intersection(_BYTES), key=lambda c: c != _LEAD):
                text = text.replace(c, _BYTES[c])
        if not self.drops_space:
            text = BLANK + text.replace(" ", " " + BLANK)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        mark = np.flatnonzero(self.edge[ids])
        if len(mark) != len(words):
            return self._batch(words if self.drops_space else [" " + w for w in words])
        return self._keep(ids, np.diff(mark, prepend=-1) if self.drops_space else np.diff(mark, append=len(ids)))

    def _encode(self, pieces: list[str], behind_blank: bool = False) -> np.ndarray:
        """Pieces of a word and closing marks share the ids of the word: marks begin a new token. Plain words
        are kept without the blank that belongs to them in files of the second kind."""
        words, plain, other, heads, tails, marked = self.words, {}, {}, [], [], []
        alike = behind_blank or self.drops_space
        for p in pieces:
            head = p.rstrip(_MARKS) if alike else ""
            if head.isalpha() if head.isascii() else _WORD(head):
                if head is not p and len(head) < len(p):
                    tail = p[len(head) :]
                    marked.append(len(heads))
                    tails.append(tail)
                    if tail not in words:
                        other[tail] = None
                if self.drops_space:  # this kind of file lowers letters as well
                    head = head.lower()
                if head not in words:
                    plain[head] = None
            else:
                head = " " + p if behind_blank and p[0] != "\n" else p
                head = "\0" + head  # a word behind a blank has the same letters and other ids
                if head not in words:
                    other[head] = None
            heads.append(head)
        if plain:
            words.update(zip(plain, self._joined(list(plain)).tolist(), strict=True))
        if other:
            texts = [k[1:] if k[0] == "\0" else k for k in other]
            words.update(zip(other, self._batch(texts).tolist(), strict=True))
        number = np.fromiter(map(words.__getitem__, heads), np.int64, len(heads))
        if marked:
            pairs = np.stack([number[marked], np.fromiter(map(words.__getitem__, tails), np.int64, len(tails))], 1)
            ids, ends = self._expand(pairs.ravel())
            number[marked] = self._keep(ids, np.diff(ends[1::2], prepend=0))
        return number

    def _parts(self, text: str) -> list[str] | None:
        """The text cut at blanks; None if it has to be cut in another way."""
        if not self.known or any(s in text for s in self.specials):
            return None
        return text.replace("\n", " " if self.drops_space else " \n").split(" ")

    def _chunks(self, text: str) -> list[str]:
        if not self.known or any(s in text for s in self.specials):
            return [text]
        return _CUT.split(text)

    def _lookup(self, table: dict[str, int], parts: list[str]) -> np.ndarray:
        """Numbers of the cached pieces. Pieces of ``inner`` stand behind a blank, unless blanks are dropped
        or the piece begins with the line break itself; one that ends in white space is no piece."""
        got = np.fromiter(map(table.get, parts, repeat(_NEW)), np.int64, len(parts))
        new = np.flatnonzero(got == _NEW).tolist()
        if new:
            missing = list(dict.fromkeys(map(parts.__getitem__, new)))
            behind_blank = table is self.inner and not self.drops_space
            if behind_blank:
                clean = [p for p in missing if p and not p[-1].isspace()]
                if len(clean) < len(missing):
                    table.update((p, _UNCLEAN) for p in missing if not p or p[-1].isspace())
                    missing = clean
            table.update(zip(missing, self._encode(missing, behind_blank).tolist(), strict=True))
            got[new] = np.fromiter(map(table.__getitem__, map(parts.__getitem__, new)), np.int64, len(new))
        self.met[: self.count] += np.bincount(got[got >= 0], minlength=self.count)
        return got

    def pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the cached pieces of all texts in a row, each text with its end id, and its bounds."""
        if self.count > self.cached:
            self.forget()
        parts = [self._parts(t or "") for t in texts]
        size = np.array([len(p) if p else 0 for p in parts], np.int64)
        flat = self._lookup(self.inner, list(chain.from_iterable(p for p in parts if p)))
        at = np.cumsum(size) - size
        plain = size > 0
        if not self.drops_space and plain.any():  # the first part of a text has no blank before it
            rows = np.flatnonzero(plain)
            unclean = np.add.reduceat(flat == _UNCLEAN, at[rows]) > 0
            plain[rows[unclean]] = False
            rows = rows[~unclean]
            flat[at[rows]] = self._lookup(self.whole, [parts[r][0] for r in rows])
        other = [None if plain[r] else self._lookup(self.whole, self._chunks(t or "")) for r, t in enumerate(texts)]
        end = np.zeros(0 if self.end_id is None else 1, np.int64)
        found = []
        for r, chunks in enumerate(other):
            found += [flat[at[r] : at[r] + size[r]] if chunks is None else chunks, end]
        lens = np.fromiter(map(len, found), np.int64, len(found)).reshape(-1, 2).sum(1)
        return np.concatenate(found) if found else end[:0], np.concatenate([[0], np.cumsum(lens)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        index, bounds = self.pieces(texts)
        ids, ends = self._expand(index)
        return ids, np.diff(np.concatenate([[0], ends])[bounds])

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """How often each id occurs in the texts."""
        index, _ = self.pieces(texts)
        number, times = np.unique(index, return_counts=True)
        return np.bincount(self._expand(number)[0], weights=np.repeat(times, self.sizes[number])).astype(np.int64)
