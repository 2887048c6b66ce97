"""BPE encoding by content-defined chunks that documents share, and decoding.

A rolling hash over bytes cuts each text where its content says so, so the same passage is cut alike wherever it stands. Of a chunk, the core
from its first to its last white space doesn't depend on what stands around it. Cores that occur more than once in the corpus are encoded once,
in a table by their hash; others are encoded where they stand. A join of two cores is repaired by encoding the text around it as it
is, from a word inside the left core to a word inside the right one: its ids must begin and end with those words' ids, else it is widened
by more words, and at last the whole text is encoded in one. A text's ids are those of its cores and joins by position.

Which cores are shared is told by a bitmap of 4 MB (a few others count as shared too, or all of them once it is over half full; results are
the same). Texts without a shared core end in the task that reads them; of the others, ids of their own parts and places of shared
cores are written, and the cores' ids are joined to them. Inside a core, distinct words between white space are looked up in a table that each
Python worker keeps.

Defined results: null and empty texts have no ids and decode to an empty text; texts of any length are encoded whole; strings of special
tokens in a text get the special ids, as the library does; the rows' order, repeated rows and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from agrolith.llm.common import BITS, arrow_map, bitmap_at, blocks, buffers, in_bitmap, mix, unused, written
from agrolith.llm.sentencepiece_codec import ChunkTable

#: Bytes that the rolling hash sees, and the bits of it that are zero at a cut: a chunk has about 2,048 bytes.
SEEN, CUT_BITS = 16, 11
#: Bytes hashed at once.
_AT_ONCE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
#: White space that surely ends a word, whatever stands around it; no code point that it belongs to has other bytes.
IS_END = np.zeros(256, bool)
IS_END[[0x20, 0x09, 0x0A, 0x0D]] = True
_WORD = re.compile(r"[^ \t\n\r]+")


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _AT_ONCE + SEEN
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))


def cut_places(data: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places before which a text is cut: the polynomial hash of the SEEN bytes before them ends a run of `bits` zeros, and a character begins."""
    up, down = _powers()
    found = []
    for start in range(0, len(data), _AT_ONCE):
        low = max(0, start - SEEN)
        own = data[low : start + _AT_ONCE]
        sums = np.cumsum((own.astype(np.uint64) + np.uint64(1)) * down[: len(own)])
        rolled = sums[SEEN - 1 :].copy()
        rolled[1:] -= sums[:-SEEN]
        at = np.flatnonzero(mix(rolled * up[SEEN - 1 : len(own)]) >> np.uint64(64 - bits) == 0) + low + SEEN
        found.append(at)
    places = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    for _ in range(3):  # not inside a character
        inside = np.flatnonzero(places < len(data))
        inside = inside[data[places[inside]] & 0xC0 == 0x80]
        places[inside] += 1
    return np.unique(places[places < len(data)])


@dataclass(frozen=True)
class Cores:
    """Cores of a block of texts: their bytes data[start:end], and each one's text; ends: places of white space."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    owner: np.ndarray
    ends: np.ndarray

    def text(self, a: int, b: int) -> str:
        return self.data[a:b].tobytes().decode()

    def keys(self) -> np.ndarray:
        """Two longs for each core, from a hash of 128 bits."""
        found = b"".join(hashlib.blake2b(self.data[a:b], digest_size=16).digest() for a, b in zip(self.starts.tolist(), self.stops.tolist(), strict=True))
        return np.frombuffer(found, np.int64).reshape(-1, 2)


def cores(column: pa.Array, bits: int = CUT_BITS) -> Cores:
    data, offsets = buffers(column)
    places = cut_places(data, bits)
    near = places - offsets[np.searchsorted(offsets, places, side="right") - 1]
    cuts = np.unique(np.concatenate([places[near >= SEEN], offsets]))
    ends = np.flatnonzero(IS_END[data])
    first, last = np.searchsorted(ends, cuts[:-1]), np.searchsorted(ends, cuts[1:]) - 1
    held = last > first
    starts, stops = ends[first[held]], ends[last[held]]
    return Cores(data, offsets, starts, stops, np.searchsorted(offsets, starts, side="right") - 1, ends)


class WordTable(ChunkTable):
    """Distinct words between white space with their ids; emptied when it holds `most`."""

    def __init__(self, lib: Tokenizer, most: int = 250_000) -> None:
        self.lib, self.cuts, self.most = lib, True, most
        self.clear()

    @staticmethod
    def chunks(text: str) -> list[str]:
        return _WORD.findall(text)

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Words are given to the library 128 at a time, with spaces between; tokens go to the word in which they begin."""
        found = []
        groups = [chunks[k : k + 128] for k in range(0, len(chunks), 128)]
        for words, e in zip(groups, self.lib.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            cuts = np.searchsorted(begins, np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
            ids = e.ids
            found += [ids[a:b] for a, b in zip([0, *cuts[:-1]], [*cuts[:-1], len(ids)], strict=True)]
        return found


def whole(lib: Tokenizer, texts: list[str]) -> list[list[int]]:
    """The library's own ids."""
    return [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def library(model: str) -> Tokenizer:
    """One tokenizer in a Python worker, with one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    lib = Tokenizer.from_str(model)
    lib.no_truncation()
    lib.no_padding()
    return lib


@lru_cache(maxsize=1)
def word_table(model: str, most: int) -> WordTable:
    """One table in a Python worker; it outlives a task, so that the next one begins with the words of the last."""
    return WordTable(library(model), most)


def _edge(found: Cores, core: int, words: int, left: bool) -> int:
    """Where a join's text begins in the core on its left (or ends in the one on its right), with at least so many words of it if it has them."""
    a, b = int(found.starts[core]), int(found.stops[core])
    low, high = np.searchsorted(found.ends, (a, b))
    places = found.ends[low : high + 1]
    seen = np.flatnonzero(np.diff(places) > 1)  # words of the core: between places[k] and places[k + 1]
    if len(seen) <= words:
        return a if left else b
    return int(places[seen[-words]]) if left else int(places[seen[words - 1] + 1])


def joins(found: Cores, table: WordTable, lib: Tokenizer, texts: np.ndarray) -> dict[int, list[list[int]] | None]:
    """For each of the texts, ids of what stands before, between and after its cores; None where no width agrees with the cores."""
    first, stop = np.searchsorted(found.owner, texts), np.searchsorted(found.owner, texts, side="right")
    out: dict[int, list] = {int(t): [None] * int(b - a + 1) for t, a, b in zip(texts, first, stop, strict=True)}
    open_ = [(int(t), int(a), int(b), k) for t, a, b in zip(texts, first, stop, strict=True) for k in range(b - a + 1)]
    words = 1
    while open_:
        spans, edges, full = [], [], []
        for t, a, b, k in open_:
            left, right = a + k - 1, a + k
            begin, end = int(found.offsets[t]), int(found.offsets[t + 1])
            p = _edge(found, left, words, True) if k else begin
            q = _edge(found, right, words, False) if right < b else end
            spans.append(found.text(p, q))
            edges += [found.text(p, int(found.stops[left])) if k else "", found.text(int(found.starts[right]), q) if right < b else ""]
            full.append((not k or p == found.starts[left]) and (right == b or q == found.stops[right]))
        flat, at = table.ids(edges)
        rest = []
        for n, (own, ids) in enumerate(zip(open_, whole(lib, spans), strict=True)):
            before, after = flat[at[2 * n] : at[2 * n + 1]].tolist(), flat[at[2 * n + 1] : at[2 * n + 2]].tolist()
            end = len(ids) - len(after)
            if len(before) <= end and ids[: len(before)] == before and ids[end:] == after:
                if out[own[0]] is not None:
                    out[own[0]][own[3]] = ids[len(before) : end]
            elif full[n]:
                out[own[0]] = None
            else:
                rest.append(own)
        open_, words = rest, words * 4
    return out


def _places(found: Cores, shared: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Which cores are shared."""
    return np.ones(len(keys), bool) if shared is None else in_bitmap(shared, keys[:, 0] & (BITS - 1))


def packed(ids: np.ndarray) -> bytes:
    """Two bytes for each id, or four after one byte more."""
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\xff" + ids.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], "<u4") if len(data) % 2 else np.frombuffer(data, "<u2")


@lru_cache(maxsize=2)
def joined_tokens(model: str) -> pa.Array | None:
    """The tokens by id, if the library's decoding is to join them with spaces; it is asked about all ids at once, one by one in turn with the first."""
    lib = library(model)
    tokens = [lib.id_to_token(i) for i in range(lib.get_vocab_size())]
    ids = [i for k in range(len(tokens)) for i in (0, k)]
    if None in tokens or lib.decode(ids, skip_special_tokens=False) != " ".join(tokens[i] for i in ids):
        return None
    return pa.array(tokens)


def decoded(model: str, flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of runs of ids."""
    tokens = joined_tokens(model)
    if tokens is None:
        return pa.array(library(model).decode_batch([flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], skip_special_tokens=False), pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens.take(pa.array(flat, pa.int32()))), " ")


def _bit(key: Column) -> Column:
    return key.bitwiseAND(F.lit(BITS - 1))


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", carried: tuple[str, ...] = (), bits: int = CUT_BITS, most_words: int = 400_000) -> DataFrame:
    """(key, ids array<int>, decoded string, carried columns) for each row. The tokenizer's file is read on the driver and travels with the tasks.

    A carried column that is named like one of the others comes back as <name>_carried.
    """
    model = Path(model_path).read_text(encoding="utf-8")
    names = [key, "ids", "decoded"]
    names += [f"{c}_carried" if c in names else c for c in carried]
    body = unused("_text", names)
    rows = docs.select(F.col(key).alias(key), *(F.col(c).alias(n) for c, n in zip(carried, names[3:], strict=True)), F.col(text).alias(body))
    held = rows.schema.fields[:-1]
    numbered = [f"c{k}" for k in range(len(held))]  # carried columns may have any name

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, body):
            own, n = np.unique(cores(block.column(block.num_columns - 1), bits).keys(), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(n)], ["k1", "k2", "n"])

    counts = arrow_map(rows.select(body), counted, "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    shared = bitmap_at(written(counts.where("n > 1").select("k1")), _bit(F.col("k1")))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for block in blocks(batches, body):
            found = cores(block.column(block.num_columns - 1), bits)
            keys = found.keys()
            new = {}
            for k in np.flatnonzero(_places(found, shared, keys)):
                if (at := tuple(keys[k].tolist())) not in seen:
                    seen.add(at)
                    new[at] = found.text(int(found.starts[k]), int(found.stops[k]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in new], pa.int64()), pa.array([b for _, b in new], pa.int64()), pa.array(list(new.values()), pa.string())], ["k1", "k2", "core"])
            if len(seen) > 500_000:
                seen.clear()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(model, most_words)
        for block in blocks(batches, "core"):
            flat, at = table.ids(block.column(2).to_pylist())
            ids = [packed(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*block.columns[:2], pa.array(ids, pa.binary())], ["k1", "k2", "core_ids"])

    once = arrow_map(rows.select(body), texts_of, "k1 long, k2 long, core string").groupBy("k1", "k2").agg(F.first("core").alias("core"))
    known = arrow_map(once, encoded, "k1 long, k2 long, core_ids binary")

    def parted(block: pa.RecordBatch, table: WordTable, closed: bool) -> tuple[pa.RecordBatch, list[tuple[np.ndarray, list[int], list[np.ndarray]]]]:
        """The block's texts without a shared core, or those with one; and of each its own ids, where shared cores come in, and their numbers in keys."""
        found = cores(block.column(block.num_columns - 1), bits)
        keys = found.keys()
        hits = _places(found, shared, keys)
        is_open = np.zeros(block.num_rows, bool)
        is_open[found.owner[hits]] = True
        texts = np.flatnonzero(is_open != closed)
        mine = np.flatnonzero(np.isin(found.owner, texts) & ~hits)
        flat, at = table.ids([found.text(a, b) for a, b in zip(found.starts[mine].tolist(), found.stops[mine].tolist(), strict=True)])
        core_ids = {int(k): flat[a:b] for k, a, b in zip(mine, at[:-1], at[1:], strict=True)}
        between, out = joins(found, table, table.lib, texts), []
        for t in texts.tolist():
            if (gaps := between[t]) is None:
                out.append((np.array(whole(table.lib, [found.text(int(found.offsets[t]), int(found.offsets[t + 1]))])[0], np.int32), [], []))
                continue
            first, n = int(np.searchsorted(found.owner, t)), len(gaps[0])
            ids, at, which = [np.array(gaps[0], np.int32)], [], []
            for k, gap in enumerate(gaps[1:], first):
                if hits[k]:
                    at.append(n)
                    which.append(keys[k])
                else:
                    ids.append(core_ids[k])
                ids.append(np.array(gap, np.int32))
                n += len(ids[-1]) + (0 if hits[k] else len(ids[-2]))
            out.append((np.concatenate(ids), at, which))
        return block.take(pa.array(texts)), out

    def result(kept: list[pa.Array], ids: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([kept[0], lists, decoded(model, flat, offsets), *kept[1:]], names)

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(model, most_words)
        for block in blocks(batches, body):
            kept, found = parted(block, table, True)
            if found:
                yield result(kept.columns[:-1], [ids for ids, _, _ in found])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(model, most_words)
        for block in blocks(batches, body):
            kept, found = parted(block, table, False)
            if found:
                lists = [pa.array([f[1] for f in found], pa.list_(pa.int32()))]
                lists += [pa.array([[int(k[c]) for k in f[2]] for f in found], pa.list_(pa.int64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array([packed(f[0]) for f in found], pa.binary()), *lists], [*numbered, "own", "at", "k1", "k2"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, all_ids = len(held), []
            for own, at, parts in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True):
                own, ids, last = unpacked(own), [], 0
                for a, part in zip(at, parts or [], strict=True):
                    ids += [own[last:a], unpacked(part["core_ids"])]
                    last = a
                all_ids.append(np.concatenate([*ids, own[last:]]).astype(np.int32))
            yield result(batch.columns[:n], all_ids)

    longs = T.ArrayType(T.LongType())
    out = T.StructType([held[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), *held[1:]])
    middle = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(numbered, held, strict=True)), T.StructField("own", T.BinaryType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("k1", longs), T.StructField("k2", longs)])
    kept = written(arrow_map(rows, opened, middle).withColumn("row", F.monotonically_increasing_id()))
    wanted = kept.select("row", F.posexplode(F.arrays_zip("k1", "k2")).alias("no", "k")).select("row", "no", "k.k1", "k.k2")
    parts = wanted.join(known, ["k1", "k2"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "core_ids"))).alias("parts"))
    whole_rows = kept.join(parts, "row", "left").select(*numbered, "own", "at", "parts")
    return arrow_map(rows, complete, out).unionByName(arrow_map(whole_rows, joined, out))
