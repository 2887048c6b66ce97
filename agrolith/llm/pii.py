"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. The field then labels the evidence tokens of a document (words with a digit or an at sign; all other
words are clamped to "none", which cuts the chain and costs nothing) as none, email, ip, card or phone. Words of a number written in
groups ("+1 415 555 2671") are one token: number words in a line, with groups of at most six digits (a country code may stand before any), the first word of at
most six, and with 7 to 19 digits in all; a plus begins a new one. Longer or shorter rows of numbers stay words. Its factors are

* a node potential from the token's shape and its neighbours' shapes,
* a chain potential between evidence tokens that stand next to each other,
* a skip potential between distant tokens that repeat or resemble each other: the same digits; digits that end alike, one number being the
  end of the other, in at least seven places; or the same name before or without an at sign, whatever the signs in it. It pulls their labels
  together. A token is linked to the last one of each of these keys, so the number of edges is linear.

Loopy sum-product message passing with damping gives marginals; a token that no base span touches and whose marginal for a kind is at
least `sure` becomes an added span. Weights are learned from base spans of a bounded sample of documents (`SAMPLE_DOCS` documents by a
hash of the key, at most `SAMPLE_TOKENS` evidence tokens of each), with their labels handed on along skips; if the sample has no base
span, base spans are all there is.

Defined results: null and empty texts have no spans; texts are searched whole; repeated rows have equal spans; a null key stays null;
offsets are code points, ends are exclusive; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.llm.common import arrow_map, blocks, buffers

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE_DOCS, SAMPLE_TOKENS = 40_000, 64

# A part is taken whole and begins where a run of its characters begins: the leftmost matches, found in linear time.
_EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
_EMAIL_REST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EVIDENCE = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[0-9().-]*[0-9)])?")
_LONG_GROUP = re.compile("[0-9]{7}")
_NAME_SIGNS = str.maketrans("", "", "._%+-")
_EDGE = "".join(map(chr, range(33, 48))).replace("+", "").replace("(", "") + ":;<=>?[\\]^_`{|}~"


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAME_CHARS:
            start -= 1
        m = _EMAIL_REST.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans by kind, then start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _EVIDENCE.search(text) is None:
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.groups())):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


@dataclass
class Token:
    """A word or a number of several words, without the signs around it; order and last: the places of its words among all words."""

    start: int
    end: int
    core: str
    digits: str
    order: int
    last: int


def _joined(text: str, words: list[Token]) -> list[Token]:
    """Number words of a row as one token if they have 7 to 19 digits, else as they are."""
    digits = "".join(t.digits for t in words)
    if len(words) < 2 or not 7 <= len(digits) <= 19:
        return words
    a, b = words[0], words[-1]
    return [Token(a.start, b.end, text[a.start : b.end], digits, a.order, b.last)]


def evidence(text: str) -> Iterator[Token]:
    """Words with a digit or an at sign, without the signs around them, and their place among all words; numbers in groups are one token."""
    row: list[Token] = []
    held, end, last, going = 0, 0, -1, False  # of the row: its digits, where it ends, its last word, whether a word may follow
    for order, m in enumerate(_TOKEN.finditer(text)):
        word = m[0]
        if not _EVIDENCE.search(word):
            continue
        left = len(word) - len(word.lstrip(_EDGE))
        core = word.strip(_EDGE)
        if not core:
            continue
        t = Token(m.start() + left, m.start() + left + len(core), core, re.sub("[^0-9]", "", core), order, order)
        number, short = core.count(".") < 3 and _NUMBER.fullmatch(core) is not None, len(t.digits) <= 6
        small = short or _LONG_GROUP.search(core) is None
        follows = number and going and left == 0 and order - last == 1 and m.start() - end <= 2 and "\n" not in text[end : m.start()] and not core.startswith("+")
        follows = follows and (small or (held <= 3 and bool(row) and row[0].core.startswith("+")))
        if not follows:
            yield from _joined(text, row)
            row, held = [], 0
        if not number or not (short or follows):
            yield t
            going = False
            continue
        row.append(t)
        held += len(t.digits)
        if held > 19:  # too long for a number: words, however the row goes on
            yield from row
            row = []
        end, last, going = m.end(), order, not text[t.end : m.end()].strip(")-")
    yield from _joined(text, row)


def _shape(t: Token) -> list[bool]:
    core, n = t.core, len(t.digits)
    parts = core.split(".")
    dotted = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    letters = any(c.isalpha() for c in core)
    return [
        True, "@" in core, "@" in core and "." in core.rpartition("@")[2], core.startswith("+"), core.startswith("("),
        not letters and n == len(core), letters and n > 0, letters and n >= len(core) / 2, dotted, dotted and all(len(p) < 4 and int(p) < 256 for p in parts),
        n == 0, 0 < n <= 2, n in (3, 4), 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19, 13 <= n <= 19 and not letters and luhn(t.digits), "-" in core, len(core) > 24,
    ]


WIDTH = len(_shape(Token(0, 1, "0", "0", 0, 0)))
#: Tokens or edges that are worked on at once.
PART = 1 << 15
_PLACES = 1 << np.arange(3 * WIDTH, dtype=np.int64)


class Tokens(NamedTuple):
    """Evidence tokens of texts, one text after another, without their words: about 50 bytes each, so that a text of nothing else fits a task.

    places: start and end in the text; near: whether the token before is the word before; links: (from, to, 0 for the chain or 1 for a
    skip); first: where each text's tokens begin (one more than texts).
    """

    places: np.ndarray
    near: np.ndarray
    shapes: np.ndarray
    links: np.ndarray
    first: list[int]

    def features(self, low: int, high: int) -> np.ndarray:
        """Own shapes of some tokens, and those of the evidence tokens directly before and after (zeros if there is none)."""
        x = np.zeros((min(high, len(self.near)) - low, 3 * WIDTH))
        x[:, :WIDTH] = self.shapes[low:high]
        at = np.flatnonzero(self.near[low:high])
        x[at, WIDTH : 2 * WIDTH] = self.shapes[at + low - 1]
        at = np.flatnonzero(self.near[low + 1 : high + 1])
        x[at, 2 * WIDTH :] = self.shapes[at + low + 1]
        return x


def similar(a: str, b: str) -> bool:
    """Whether one number is the end of the other, in at least seven places."""
    return min(len(a), len(b)) >= 7 and (a.endswith(b) or b.endswith(a))


def tokens_of(texts: list[str], most: int | None = None) -> Tokens:
    """The evidence of texts, `most` tokens of each if given. Similar tokens are linked one to the next, unless they are neighbours."""
    places, near, shapes, links, first = array("i"), bytearray(), bytearray(), array("i"), [0]
    k = 0
    for text in texts:
        last: dict[str, tuple[int, int, str]] = {}
        before = None
        for t in islice(evidence(text), most):
            beside = before is not None and t.order - before == 1
            before = t.last
            places.extend((t.start, t.end))
            near.append(beside)
            shapes.extend(_shape(t))
            if beside:
                links.extend((k - 1, k, 0))
            name = t.core.partition("@")[0].lower().translate(_NAME_SIGNS)
            keys = [f"#{t.digits}", f"/{t.digits[-7:]}"] if len(t.digits) >= 7 else []
            met = {last[c][:2] for c in keys if c in last and similar(t.digits, last[c][2])}
            if len(name) >= 5:
                keys.append(name)
                met |= {last[name][:2]} if name in last else set()
            for j, order in sorted(met):
                if t.order - order > 1:
                    links.extend((j, k, 1))
            last.update(dict.fromkeys(keys, (k, t.last, t.digits)))
            k += 1
        first.append(k)
    table = lambda values, kind, width: np.frombuffer(values, kind).reshape(-1, width)
    return Tokens(table(places, np.int32, 2), np.frombuffer(near, bool), table(shapes, np.uint8, WIDTH), table(links, np.int32, 3), first)


def labels_of(places: np.ndarray, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """For each token of a text the kind of the first base span, in the order of KINDS, that overlaps it."""
    found = np.zeros(len(places), np.int64)
    for kind in reversed(KINDS):
        own = np.array([s[1:] for s in spans if s[0] == kind], np.int64).reshape(-1, 2)
        if len(own):
            k = np.searchsorted(own[:, 1], places[:, 0], side="right")
            found[(k < len(own)) & (own[np.minimum(k, len(own) - 1), 0] < places[:, 1])] = LABELS.index(kind)
    return found


def consistent(y: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Labels with those of tokens in base spans handed on to unlabelled tokens of the same core; links come in the order of their ends."""
    y, skips = y.copy(), [(a, b) for a, b, kind in links.tolist() if kind == 1]
    for a, b in skips:
        y[b] = y[b] or y[a]
    for a, b in reversed(skips):
        y[a] = y[a] or y[b]
    return y


@dataclass
class Field:
    """Weights of the node potentials, and log potentials of chain and skip edges."""

    nodes: np.ndarray
    pairs: np.ndarray

    def potentials(self, tokens: Tokens) -> np.ndarray:
        n = len(tokens.near)
        return np.concatenate([tokens.features(k, k + PART) @ self.nodes for k in range(0, max(n, 1), PART)])

    def marginals(self, node: np.ndarray, links: np.ndarray, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Loopy sum-product over the node potentials of all documents of a block at once, in log space, some edges at a time."""
        if not len(links):
            return _softmax(node)
        e = np.asarray(links)
        src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        tables, kind = np.concatenate([self.pairs, self.pairs.transpose(0, 2, 1)]), np.concatenate([e[:, 2], e[:, 2] + len(self.pairs)])
        said, new = np.zeros((len(src), len(LABELS))), np.zeros((len(src), len(LABELS)))

        def beliefs() -> np.ndarray:
            return node + np.stack([np.bincount(dst, said[:, k], len(node)) for k in range(len(LABELS))], axis=1)

        for _ in range(rounds):
            belief = beliefs()
            for low in range(0, len(src), PART):
                own = slice(low, low + PART)
                back = (np.arange(low, min(low + PART, len(src))) + len(e)) % len(src)
                out = _logsum(tables[kind[own]] + (belief[src[own]] - said[back])[:, :, None], 1)
                new[own] = damping * said[own] + (1 - damping) * (out - _logsum(out, 1)[:, None])
            said, new = new, said
        return _softmax(beliefs())


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(codes: np.ndarray, n: np.ndarray, pairs: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> Field:
    """Piecewise training: node weights by multinomial logistic regression, pair potentials from smoothed co-occurrence.

    codes: distinct rows of features as bits, n: how many tokens of each label have them (rows, labels); pairs: counts (2, labels, labels)
    of the labels of linked tokens. A potential is the log of observed over expected frequency. Those of the chain are cut to [-2, 2], for
    node and chain potentials see the same evidence; those of skips, which see what no node does, to [-6, 6].
    """
    w = np.zeros((3 * WIDTH, len(LABELS)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    parts = [(slice(k, k + PART), n[k : k + PART].sum(axis=1, keepdims=True)) for k in range(0, len(codes), PART)]
    unpacked = lambda own: ((codes[own, None] & _PLACES) > 0).astype(float)
    held = unpacked(parts[0][0]) if len(parts) == 1 else None
    for t in range(1, steps + 1):
        g = ridge * w
        for own, total in parts:
            x = unpacked(own) if held is None else held
            g += x.T @ (_softmax(x @ w) * total - n[own]) / n.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    counts = pairs + pairs.transpose(0, 2, 1) + 0.5
    joint = counts / counts.sum(axis=(1, 2), keepdims=True)
    own = joint.sum(axis=2)
    most = np.array([2.0, 6.0])[:, None, None]
    return Field(w, np.clip(np.log(joint / (own[:, :, None] * own[:, None, :])), -most, most))


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", most_docs: int = SAMPLE_DOCS, most_tokens: int = SAMPLE_TOKENS) -> Field | None:
    """Learn from base spans of about `most_docs` documents, which a hash of the key chooses.

    Features are bits, so Spark counts equal rows of features with their label, and the labels of linked tokens; only counts reach the driver.
    """
    share = min(1.0, most_docs / max(1, docs.count()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            texts = [t for t in block.column(0).to_pylist() if t]
            tokens = tokens_of(texts, most_tokens)
            y = np.concatenate([np.zeros(0, np.int64), *(labels_of(tokens.places[a:b], base_spans(t)) for t, a, b in zip(texts, tokens.first, tokens.first[1:], strict=False))])
            y = consistent(y, tokens.links)
            found = [(0, (tokens.features(k, k + PART) > 0) @ _PLACES * len(LABELS) + y[k : k + PART]) for k in range(0, len(y), PART)]
            found += [(1 + kind, y[own[:, 0]] * len(LABELS) + y[own[:, 1]]) for kind in (0, 1) for own in [tokens.links[tokens.links[:, 2] == kind]]]
            for kind, codes in found:
                code, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int32)), pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["kind", "code", "n"])

    chosen = docs.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(round(share * (1 << 20)))).where(F.col(text).rlike("[0-9@]"))
    counted = arrow_map(chosen.select(F.col(text).alias("text")), rows, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    found = counted.toPandas().sort_values(["kind", "code"])  # the order in which tasks end doesn't matter then
    pairs = np.zeros((2, len(LABELS), len(LABELS)))
    for kind in (0, 1):
        own = found[found.kind == 1 + kind]
        pairs[kind].reshape(-1)[own.code.to_numpy(int)] = own.n
    own = found[found.kind == 0]
    codes, row = np.unique(own.code.to_numpy(np.int64) // len(LABELS), return_inverse=True)
    n = np.zeros((len(codes), len(LABELS)))
    n[row, own.code.to_numpy(np.int64) % len(LABELS)] = own.n
    return fit(codes, n, pairs) if n[:, 1:].any() else None


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], field: Field, sure: float) -> list[list[tuple[str, int, int]]]:
    """Spans that the field adds to the base spans of each text."""
    tokens = tokens_of(texts)
    if not len(tokens.near):
        return [[] for _ in texts]
    p = field.marginals(field.potentials(tokens), tokens.links)
    best, sure_of = p.argmax(axis=1), p.max(axis=1) >= sure
    out = []
    for base, a, b in zip(bases, tokens.first, tokens.first[1:], strict=False):
        free = labels_of(tokens.places[a:b], base) == 0
        at = np.flatnonzero(free & (best[a:b] > 0) & sure_of[a:b]) + a
        out.append([(LABELS[best[k]], *tokens.places[k].tolist()) for k in at])
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", sure: float = 0.9) -> DataFrame:
    """(key, spans array<struct<kind, start, end, base>>) for each row, by kind as in KINDS and then by start."""
    field = train(docs, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        mark = np.zeros(256, bool)
        mark[[*b"0123456789@"]] = True
        for block in blocks(batches, text):
            data, offsets = buffers(block.column(1))
            hits = np.searchsorted(offsets, np.flatnonzero(mark[data]), side="right") - 1
            spans: list[list[dict]] = [[] for _ in range(block.num_rows)]
            at = np.unique(hits).tolist()
            texts = [block.column(1)[i].as_py() for i in at]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, field, sure) if field else [[] for _ in at]
            for i, base, extra in zip(at, bases, more, strict=True):
                both = [(KINDS.index(k), a, b, True) for k, a, b in base] + [(KINDS.index(k), a, b, False) for k, a, b in extra]
                spans[i] = [{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in sorted(both)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(spans, struct)], ["key", "spans"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("spans", T.ArrayType(SPAN))])
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text)), run, schema).withColumnRenamed("key", key)
