"""SentencePiece encoding through a table of distinct marked words, and decoding.

A SentencePiece BPE model marks each space with U+2581 and, where no piece holds a marker after another character, merges nothing
across the beginning of a run of markers. Nor does it merge across a line feed where no piece holds one. So a text is cut at these
places, each distinct chunk is segmented once for a task's table, and a text's ids are the chunks' ids joined by position. Whether
the model allows this is read from its vocabulary; if not, whole texts are segmented.

Defined results: null and empty texts have no ids and decode to an empty text; texts of any length are encoded whole, a block at a
time; the rows' order, repeated rows and other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.llm.common import arrow_map, blocks, unused

MARK = "▁"


@lru_cache(maxsize=4)
def model_of(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """One model in a Python worker; it outlives a task."""
    return sentencepiece.SentencePieceProcessor(model_proto=model)


class ChunkTable:
    """Distinct chunks of a model's texts with their ids, in one growing pool; emptied when it holds `most` chunks."""

    def __init__(self, model: bytes, most: int = 250_000) -> None:
        self.model = model_of(model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = False
        if not any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p in pieces):
            probe = " a  a\n\n b \n"  # tells a normaliser that drops or adds white space
            self.cuts = self.model.encode(probe) == [i for c in self.chunks(probe) for i in self.segment([c])[0]]
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.pool, self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A run of markers with what follows up to the next marker or line feed, or a line feed with what follows."""
        return re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text.replace(MARK, " ")) if text else []

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks. The model puts a marker in front of each text: it stands for a chunk's first one, or is taken off again."""
        mark = self.model.piece_to_id(MARK)
        found = self.model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [([mark] if c == " " else ids) if c[0] == " " else ids[1:] for c, ids in zip(chunks, found, strict=True)]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more than texts)."""
        if not self.cuts:
            each = self.model.encode(texts, num_threads=1)
            return np.array([i for ids in each for i in ids], np.int32), np.cumsum([0, *map(len, each)])
        if len(self.at) >= self.most:
            self.clear()
        by_text = [self.chunks(t) for t in texts]
        words = [c for chunks in by_text for c in chunks]
        at = self.at
        if new := [c for c in dict.fromkeys(words) if c not in at]:
            for c in new:
                at[c] = len(at)
            found = self.segment(new)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
            self.pool[self.used : self.used + len(flat)] = flat
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used += len(flat)
        k = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[k]
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(self.starts[k] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.concatenate([[0], ends])[np.cumsum([0, *map(len, by_text)])]


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", carried: tuple[str, ...] = (), most_chunks: int = 250_000) -> DataFrame:
    """(key, ids array<int>, decoded string, carried columns) for each row. The model file is read on the driver and travels with the tasks.

    A carried column that is named like one of the others comes back as <name>_carried.
    """
    model = Path(model_path).read_bytes()
    names = [key, "ids", "decoded"]
    names += [f"{c}_carried" if c in names else c for c in carried]
    whole = unused("_text", names)
    rows = docs.select(F.col(key).alias(key), F.col(text).alias(whole), *(F.col(c).alias(n) for c, n in zip(carried, names[3:], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model, most_chunks)
        for block in blocks(batches, whole):
            flat, offsets = table.ids([t or "" for t in block.column(1).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            decoded = table.model.decode([flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], num_threads=1)
            yield pa.RecordBatch.from_arrays([block.column(0), ids, pa.array(decoded, pa.string()), *block.columns[2:]], names)

    schema = T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), *rows.schema.fields[2:]])
    return arrow_map(rows, run, schema)
