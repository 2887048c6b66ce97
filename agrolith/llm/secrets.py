"""Secret scan over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived, which every match satisfies. Documents are indexed a
block at a time (a document-partitioned index, as search engines keep it: postings never leave the task): a trigram's postings are a
bitmap over the block's documents, queries intersect and unite bitmaps, and only the candidates are verified with the expression.
A rule without mandatory trigrams, such as one for long hexadecimal runs, scans all documents.

Trigrams are folded to lower-case ASCII, so rules of either case use one index; folding only adds candidates.

Defined results: null and empty texts have no spans; texts of any length are searched whole, in time linear in their length; repeated
rows have the same spans; a null key stays null; an empty table gives an empty result; offsets are code points, ends are exclusive; spans
of one rule don't overlap, those of several may; other columns don't matter.
"""

from __future__ import annotations

import re
import re._constants as K
import re._parser as sre
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.llm.common import arrow_map, blocks, buffers


@dataclass(frozen=True)
class Rule:
    """kind; pattern; the shortest text of `group` that counts; whether the contract's digest holds it."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


#: Base rules in the order of the contract, then the rules that the method adds. Open runs begin where a run of their characters begins
#: and give nothing back, so that scanning stays linear in a text's length: a token inside a longer run of word characters is none.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("userinfo", r"[a-z][a-z0-9+]{1,10}://[A-Za-z0-9._~-]++:[A-Za-z0-9._~!$&*+=-]{6,}+@[A-Za-z0-9.-]++"),
)

# A query is True (all documents), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple
#: An expression's exact strings are followed up to so many.
MOST_STRINGS = 64


def _all(parts: list[Query]) -> Query:
    flat = frozenset(y for x in parts if x is not True for y in (x[1] if isinstance(x, tuple) and x[0] == "and" else [x]))
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", flat)


def _any(parts: list[Query]) -> Query:
    if any(x is True for x in parts):
        return True
    sets = {x[1] if isinstance(x, tuple) and x[0] == "and" else frozenset([x]) for x in parts}
    least = [s for s in sets if not any(o < s for o in sets)]  # what asks for more than another one adds nothing
    return _all(list(least[0])) if len(least) == 1 else ("or", frozenset(_all(list(s)) for s in least))


def _strings_query(strings: set[str]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _exact(op: object, value: object) -> set[str] | None:
    """All strings that a node can match, folded, or None if there are too many."""
    if op is K.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if op is K.IN:
        found: set[str] = set()
        for kind, x in value:
            if kind is K.LITERAL and x < 128:
                found.add(chr(x).lower())
            elif kind is K.RANGE and x[1] < 128 and x[1] - x[0] < 16:
                found.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None
        return found if len(found) <= 16 else None
    if op is K.SUBPATTERN:
        return _exact_of(value[3])
    if op is K.BRANCH:
        each = [_exact_of(x) for x in value[1]]
        return None if any(x is None for x in each) else set().union(*each)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[1] <= 1:
        inner = _exact_of(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return {""} if op in (K.AT, K.ASSERT, K.ASSERT_NOT) else None


def _exact_of(nodes: object) -> set[str] | None:
    strings = {""}
    for op, value in nodes:
        x = _exact(op, value)
        if x is None or len(strings) * len(x) > MOST_STRINGS:
            return None
        strings = {a + b for a, b in product(strings, x)}
    return strings


def _query_of(nodes: object) -> Query:
    parts: list[Query] = []
    strings = {""}

    def flush() -> None:
        nonlocal strings
        parts.append(_strings_query(strings))
        strings = {""}

    for op, value in nodes:
        x = _exact(op, value)
        if x is not None and len(strings) * len(x) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, x)}
            continue
        flush()
        if x is not None:
            strings = x
        elif op is K.SUBPATTERN:
            parts.append(_query_of(value[3]))
        elif op is K.BRANCH:
            parts.append(_any([_query_of(b) for b in value[1]]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] >= 1:
            parts.append(_query_of(value[2]))
    flush()
    return _all(parts)


def trigram_query(pattern: str) -> Query:
    """A Boolean query over folded trigrams that holds for every text in which the pattern matches; True if there is none."""
    return _query_of(sre.parse(pattern))


def trigrams_of(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Postings of the trigrams that the rules ask for, over a block of texts."""

    def __init__(self, wanted: set[str]) -> None:
        self.number = {t: k for k, t in enumerate(sorted(wanted))}
        letters = sorted({c for t in wanted for c in t})
        assert len(letters) < 64, "bytes are folded to six bits"
        self.fold = np.zeros(256, np.uint32)
        for k, c in enumerate(letters, 1):
            self.fold[ord(c)] = self.fold[ord(c.upper())] = k
        self.slot = np.full(1 << 18, -1, np.int16)
        for t, k in self.number.items():
            a, b, c = (int(self.fold[ord(x)]) for x in t)
            self.slot[a << 12 | b << 6 | c] = k

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of bits for each trigram: which texts hold it."""
        found = np.zeros((len(self.number), len(offsets) - 1), bool)
        if len(data) < 3 or not self.number:
            return found
        x = self.fold[data]
        slots = self.slot[x[:-2] << 12 | x[1:-1] << 6 | x[2:]]
        at = np.flatnonzero(slots >= 0)
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[text + 1]
        found[slots[at[inside]], text[inside]] = True
        return found

    def answer(self, query: Query, postings: np.ndarray) -> np.ndarray:
        """Which texts satisfy a query."""
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, str):
            return postings[self.number[query]]
        unite = np.logical_and if query[0] == "and" else np.logical_or
        return reduce(unite, (self.answer(x, postings) for x in query[1]))


class Scanner:
    """Rules with their queries, compiled once in a worker."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = TrigramIndex(set().union(*map(trigrams_of, self.queries)))
        self.patterns = [re.compile(r.pattern, re.ASCII) for r in rules]

    def block(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end), sorted."""
        data, offsets = buffers(column)
        postings = self.index.postings(data, offsets)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        texts: dict[int, str] = {}
        for k, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.patterns, strict=True)):
            for i in np.flatnonzero(self.index.answer(query, postings)).tolist():
                if i not in texts:
                    texts[i] = column[i].as_py() or ""
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in found]


@lru_cache(maxsize=4)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]
)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans array<struct<kind, start, end, base>>) for each row, spans by start and then by rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for block in blocks(batches, text):
            spans = [[{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, k, b in x] for x in scanner.block(block.column(1))]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(spans, kind)], ["key", "spans"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("spans", T.ArrayType(SPAN))])
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text)), run, schema).withColumnRenamed("key", key)


def masked(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """The text with each union of overlapping spans replaced by the first rule's name in brackets."""
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out.append(text[at:start] + f"[{rules[k].kind} removed]")
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", chars: str | None = None) -> DataFrame:
    """The same rows and columns with secrets masked in `text`; the column `chars`, if named, gets the new lengths of changed texts."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(rules)
        for block in blocks(batches, text):
            at = block.schema.get_field_index(text)
            found = scanner.block(block.column(at))
            if not any(found):
                yield block
                continue
            columns = dict(zip(names, block.columns, strict=True))
            texts = columns[text].to_pylist()
            new = [masked(t, spans, rules) if spans else t for t, spans in zip(texts, found, strict=True)]
            columns[text] = pa.array(new, columns[text].type)
            if chars in columns:
                was = columns[chars].to_pylist()
                columns[chars] = pa.array([len(t) if spans else n for t, spans, n in zip(new, found, was, strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return arrow_map(docs, run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
