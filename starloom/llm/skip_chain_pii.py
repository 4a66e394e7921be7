"""Personal data by base patterns and a skip-chain conditional random field.

The nodes of the field are the tokens of a document that hold a digit or an at sign; all other tokens are
outside an entity. Neighbouring nodes share a chain potential. Distant nodes that repeat one another, or
are similar (the same digits, or the name before the at sign), share a skip potential, so what a pattern
finds in one place supports the same thing written in another way elsewhere in the document. Tokens of
base matches are observed. Loopy belief propagation gives the marginals of the others, and tokens that are
likelier inside an entity than outside become spans. Base spans always stay.

Weights are trained here, piece by piece (each factor by maximum likelihood on its own counts), on the base
matches in a bounded sample of documents. Skip edges join consecutive occurrences, so their number is linear
in the tokens; an occurrence without a base match also has an edge to the nearest one with a base match, as
evidence fades from repeat to repeat. Edges are dealt out to families of disjoint paths. A sweep passes
messages along whole paths, forward and back, for all documents of a batch at once, and sweeps go on until
the messages of a document stand still.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.llm.batches import as_before, beside_text, sliced, utf8, word_bounds

KINDS = ("email", "ip", "card", "phone")
PHONE = KINDS.index("phone")
# Base patterns (fixed by the contract of the query).
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

TRAINING_DOCS = 20_000
#: A document is done when no message (a logarithm) changes by more in a sweep.
TOLERANCE = 1e-4
#: Sweeps without damping, and when messages that go round in circles are given up.
UNDAMPED, ROUNDS = 20, 1_000
#: Strength of the prior (the overall share of the labels) against counts of a factor.
PRIOR = 2.0
#: A token is in an entity if its marginal says so with this probability.
MIN_PROBABILITY = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each at sign ends one run of name characters, so every run is looked at once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and then by kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(core: str) -> str:
    """Runs of letters and digits with the number of digits, marks as they are; long shapes are cut off."""
    parts = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|[\W_]", core[:64]):
        x = m[0]
        parts.append(f"9{min(len(x), 20)}" if x[0].isdigit() else "a" if x[0].isalpha() else x)
    digits = "".join(_DIGITS.findall(core[:64]))
    return "".join(parts[:12]) + ("L" if 14 <= len(digits) <= 19 and luhn(digits) else "")


def _keys(core: str) -> list[str]:
    """What makes tokens alike: their text, four digits or more, a name with a digit before an at sign."""
    digits = "".join(_DIGITS.findall(core))
    name = core.split("@")[0]
    keys = ["t" + core.lower()] if len(digits) >= 4 or "@" in core else []
    if len(digits) >= 4 and not any(c.isalpha() for c in core):
        keys.append("d" + digits)
    if len(name) >= 5 and any(c.isalpha() for c in name) and any(c.isdigit() for c in name):
        keys.append("n" + name.lower())
    return keys


class Graph:
    """Nodes and edges of the documents of one batch."""

    def __init__(self, column: pa.Array) -> None:
        data, at = utf8(column)
        starts, ends, row = word_bounds(data, at)
        mark = np.concatenate([[0], np.cumsum((data - 48 < 10) | (data == 64))]) if len(data) else np.zeros(1, np.int64)
        chosen = np.flatnonzero(mark[ends] > mark[starts])
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        row = row[chosen]
        begin = (points[starts[chosen]] - points[at[row]]).tolist()
        end = (points[ends[chosen]] - points[at[row]]).tolist()
        self.rows = np.unique(row).tolist()
        self.base: dict[int, list] = {}
        self.spans: list[tuple[int, int]] = []
        self.node_row, self.shapes, self.label = row, [], []
        chain, skip, anchor = [], [], []
        first = np.searchsorted(row, self.rows).tolist() + [len(row)]
        for r, low, high in zip(self.rows, first, first[1:], strict=False):
            text = column[r].as_py()
            found = self.base[r] = base_spans(text)
            seen: dict[str, int] = {}
            marked: dict[str, list[int]] = {}
            others: list[tuple[str, int]] = []
            p = 0
            for i in range(low, high):
                a, b = begin[i], end[i]
                while a < b and not (text[a].isalnum() or text[a] == "+"):
                    a += 1
                while b > a and not text[b - 1].isalnum():
                    b -= 1
                core = text[a:b]
                self.spans.append((a, b))
                self.shapes.append(_shape(core))
                while p < len(found) and found[p][2] <= begin[i]:
                    p += 1
                hit = [k for s, k, e in found[p : p + 4] if s < end[i] and e > begin[i]]
                self.label.append(hit[0] + 1 if hit else 0)
                if i > low and begin[i] - end[i - 1] <= 1:
                    chain.append((i - 1, i))
                for key in _keys(core):
                    if key in seen:
                        skip.append((seen[key], i))
                    seen[key] = i
                    if hit:
                        marked.setdefault(key, []).append(i)
                    else:
                        others.append((key, i))
            for key, i in others:
                if key in marked:
                    place = bisect(marked[key], i)
                    anchor.append((min(marked[key][max(0, place - 1) : place + 1], key=lambda j: abs(i - j)), i))
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.unique(np.array(skip, np.int64).reshape(-1, 2), axis=0)
        # (base match, occurrence) where no skip edge joins them yet; they do not count in the training
        anchor = np.unique(np.array(anchor, np.int64).reshape(-1, 2), axis=0)
        pair = lambda e: e.min(1) * len(row) + e.max(1)
        self.anchor = anchor[~np.isin(pair(anchor), pair(self.skip))] if len(anchor) else anchor
        self.label = np.array(self.label, np.int64)


def train(docs: DataFrame, text_col: str = "text", sample: int = TRAINING_DOCS) -> dict:
    """Weights from base matches in about ``sample`` documents, chosen by a hash of their text.

    What is fetched are counts of shapes and label pairs, bounded by the tokens of the sample.
    """
    share = min(1.0, sample / max(1, docs.count()))
    chosen = docs.select(F.col(text_col).cast("string").alias("text")).where(
        F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in sliced(batches, 0):
            g = Graph(part.column(0))
            found.update(("s", s, int(y), 0) for s, y in zip(g.shapes, g.label, strict=True))
            for name, edges in (("chain", g.chain), ("skip", g.skip)):
                found.update((name, "", int(a), int(b)) for a, b in g.label[edges])
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.int32()),
             pa.array([found[k] for k in keys], pa.int64())],
            ["factor", "shape", "y", "z", "n"],
        )

    counts = chosen.mapInArrow(count, "factor string, shape string, y int, z int, n long")
    rows = counts.groupBy("factor", "shape", "y", "z").agg(F.sum("n").alias("n")).collect()
    n_labels = len(KINDS) + 1
    prior = np.ones(n_labels)
    for r in rows:
        if r["factor"] == "s":
            prior[r["y"]] += r["n"]
    prior /= prior.sum()
    shapes: dict[str, np.ndarray] = {}
    pairs = {"chain": PRIOR * np.outer(prior, prior) + PRIOR * np.diag(prior), "skip": PRIOR * np.outer(prior, prior) + 20 * PRIOR * np.diag(prior)}
    for r in rows:
        if r["factor"] == "s":
            shapes.setdefault(r["shape"], np.zeros(n_labels))[r["y"]] += r["n"]
        else:
            pairs[r["factor"]][r["y"], r["z"]] += r["n"] / 2
            pairs[r["factor"]][r["z"], r["y"]] += r["n"] / 2
    weights = {"prior": np.log(prior), "shapes": {}}
    for shape, n in shapes.items():
        weights["shapes"][shape] = np.log((n + PRIOR * prior) / (n.sum() + PRIOR))
    for name, n in pairs.items():
        joint = (n + 0.05 * np.outer(prior, prior)) / (n.sum() + 0.05)
        weights[name] = np.log(joint / np.outer(joint.sum(1), joint.sum(0)))
    return weights


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _families(edges: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edges dealt out so that each family is a set of disjoint paths: lower node, upper node, place on the path."""

    def rank(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x, kind="stable")
        out = np.empty(len(x), np.int64)
        out[order] = np.arange(len(x)) - np.searchsorted(x[order], x[order])
        return out

    low, high = edges.min(1), edges.max(1)
    family = rank(low) * (len(edges) + 1) + rank(high)
    for f in np.unique(family):
        a, b = low[family == f], high[family == f]
        up, place = np.arange(n), np.zeros(n, np.int64)
        up[b], place[b] = a, 1
        while (up[up] != up).any():
            place += place[up]
            up = up[up]
        order = np.argsort(place[b], kind="stable")
        yield a[order], b[order], place[b][order]


def _along(field: np.ndarray, a: np.ndarray, b: np.ndarray, place: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Sum of the messages to each node along the paths from both ends, exact for these paths."""

    def send(x: np.ndarray) -> np.ndarray:
        y = np.log(np.exp(x - x.max(1, keepdims=True)) @ potential)
        return y - y.max(1, keepdims=True)

    onward, back = np.zeros_like(field), np.zeros_like(field)
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(a)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        onward[b[i:j]] = send(field[a[i:j]] + onward[a[i:j]])
    for i, j in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        back[a[i:j]] = send(field[b[i:j]] + back[b[i:j]])
    return onward + back


def marginals(
    unary: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, group: np.ndarray | None = None
) -> np.ndarray:
    """Loopy sum-product over pairs (edges, symmetric potential), in sweeps over families of paths until messages
    stand still; nodes of a ``group`` (no edge leaves one) that is done are left out of further sweeps."""
    group = np.zeros(len(unary), np.int64) if group is None else group
    families = [(*f, np.exp(p)) for e, p in edges for f in _families(e, len(unary))]
    held = [np.zeros_like(unary) for _ in families]
    belief = unary.copy()
    for sweep in range(rounds):
        change = np.zeros(len(unary))
        for f, (a, b, place, potential) in enumerate(families):
            if not len(a):
                continue
            nodes = np.union1d(a, b)
            local = np.zeros(len(unary), np.int64)
            local[nodes] = np.arange(len(nodes))
            new = _along(belief[nodes] - held[f][nodes], local[a], local[b], place, potential)
            step = (new - held[f][nodes]) * (1.0 if sweep < UNDAMPED else 0.5)
            held[f][nodes] += step
            belief[nodes] += step
            change[nodes] = np.maximum(change[nodes], np.abs(step).max(1))
        moving = np.unique(group[change > TOLERANCE])
        if not len(moving):
            break
        families = [(a[k], b[k], place[k], p) for a, b, place, p in families for k in [np.isin(group[a], moving)]]
    return np.exp(belief - _log_sum(belief, 1)[:, None])


def _spans(column: pa.Array, weights: dict) -> dict[int, list[tuple[int, int, int, bool]]]:
    """For each row with any span: (start, kind, end, base), in order."""
    g = Graph(column)
    if not len(g.shapes):
        return {}
    unary = np.array([weights["shapes"].get(s, weights["prior"]) for s in g.shapes])
    seen = g.label > 0
    unary[seen] = -40.0
    unary[seen, g.label[seen]] = 0.0
    base, other = g.anchor.T
    np.add.at(unary, other, weights["skip"][g.label[base]])  # the message of an observed node is fixed
    p = marginals(unary, [(g.chain, weights["chain"]), (g.skip, weights["skip"])], group=g.node_row)
    best = p.argmax(1)
    added = np.flatnonzero(~seen & (best > 0) & (p.max(1) > MIN_PROBABILITY))
    out = {r: [(a, k, b, True) for a, k, b in found] for r, found in g.base.items() if found}
    last = None
    for i in added.tolist():
        r, (a, b), k = int(g.node_row[i]), g.spans[i], int(best[i]) - 1
        if b <= a:
            continue
        mine = out.setdefault(r, [])
        if k == PHONE and last == (r, i - 1, k) and a - mine[-1][2] <= 2:  # groups of one number
            mine[-1] = (mine[-1][0], k, b, False)
        else:
            mine.append((a, k, b, False))
        last = (r, i, k)
    return {r: sorted(x) for r, x in out.items()}


def find_pii(docs: DataFrame, text_col: str = "text", sample: int = TRAINING_DOCS, redact: bool = False) -> DataFrame:
    """``docs`` with ``pii``, an array of (kind, start, end, base) in code points, by start and kind.

    With ``redact`` the text has ``<KIND>`` in place of each span, overlapping ones together. A null text has
    no span and stays null; a column named ``pii`` is replaced; an empty table gives an empty one.
    """
    names = [c for c in docs.columns if c != "pii"]
    docs = docs.select(*names)
    at = names.index(text_col)
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, sample))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, at):
            found = _spans(part.column(at), weights.value)
            lists = [[(KINDS[k], a, b, base) for a, k, b, base in found.get(r, ())] for r in range(part.num_rows)]
            flat = [x for s in lists for x in s]
            offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            values = pa.StructArray.from_arrays(
                [pa.array([x[j] for x in flat], span[j].type) for j in range(4)], fields=list(span)
            )
            columns = list(part.columns)
            if redact and found:
                texts = columns[at].to_pylist()
                for r, spans in found.items():
                    texts[r] = redacted(texts[r], spans)
                columns[at] = pa.array(texts, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, values)], [*names, "pii"])

    kind = StructType.fromDDL("pii array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    schema = StructType([*docs.schema.fields, *kind.fields])
    return docs.mapInArrow(find, schema)


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    out, done = [], 0
    for a, k, b, _ in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the base spans and all spans as text, by SQL functions."""
    base = F.filter("pii", lambda x: x["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The documents with every span redacted, in their columns; ``n_chars`` follows the text."""
    return as_before(find_pii(beside_text(docs), redact=True), docs, F.col("text"))
