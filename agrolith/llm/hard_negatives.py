"""Hard negatives by product quantisation with stored residual norms.

Every row is indexed: its vector is cut into sub-vectors, each replaced by the nearest of at most 256 centroids, and the norm of what that
leaves out is stored beside the codes. A block of anchors meets all rows in two passes without a shuffle of rows. Look-up tables give a row's
approximate score, the product of both norms (Cauchy-Schwarz) how far the exact one may lie from it, so a row is passed over only where
it surely isn't among the best; all others get their exact integer score. The first pass finds an anchor's positives, the second the
windows that the positives' scores open. Only what is best in a task is shuffled.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; an empty vector scores 0, and of
vectors of different lengths the shorter one counts as padded with zeros. Ties go to the smaller key, a null key last; rows without a key are
never anchors. Rows of the anchor's own key aren't "others". Repeated rows keep a place each, repeated anchors are asked once. A vector so
large that scores might leave the range of a long ends the job with an error. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.common import arrow_map, written

#: Stands for a null key inside tasks, where it comes last.
NO_KEY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Rules:
    """positives and negatives: how many; low and high: percent of the positive's score between which a negative's lies."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    #: Components of a sub-vector, centroids of each, rows of the sample that centroids are fitted on, anchors of a block.
    width: int = 2
    centroids: int = 256
    sample: int = 4096
    block: int = 4096


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def usable(rows: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """(key, label, v): the rows that take part, with whole numbers for components."""
    kept = rows.select(F.col(key).cast("bigint").alias("key"), label.cast("bigint").alias("label"), F.col(vector).alias("v")).where("label IS NOT NULL AND v IS NOT NULL")
    kept = kept.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) * 65536.0
    large = F.raise_error(F.lit("a vector is so large that its scores may not fit a long")).cast("array<bigint>")
    return kept.select("key", "label", F.when(norm2 < 2.0**60, whole_numbers(F.col("v"))).otherwise(large).alias("v"))


@dataclass(frozen=True)
class Codebook:
    """centroids: (sub-vectors, centroids, width); size: components of a vector, which may be padded to full sub-vectors."""

    centroids: np.ndarray
    size: int

    def padded(self, v: np.ndarray) -> np.ndarray:
        """(rows, sub-vectors, width)."""
        m, _, w = self.centroids.shape
        wide = np.zeros((len(v), m * w))
        wide[:, : self.size] = v
        return wide.reshape(len(v), m, w)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, sub-vectors) and the norm of the residual, rounded up."""
        parts, codes = self.padded(v), np.zeros((len(v), len(self.centroids)), np.uint8)
        left = np.zeros(len(v))
        for m, own in enumerate(self.centroids):
            x = parts[:, m]
            d = (own * own).sum(1) - 2 * x @ own.T
            codes[:, m] = d.argmin(1)
            left += ((x - own[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left) * (1 + 1e-9)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(sub-vectors, centroids, anchors): products of each anchor's part with each centroid."""
        return np.einsum("mkw,amw->mka", self.centroids, self.padded(anchors)).astype(np.float32)


def fit(sample: np.ndarray, rules: Rules, turns: int = 8) -> Codebook:
    """Centroids by Lloyd's iterations on each sub-vector of a bounded sample; the same sample gives the same codebook."""
    size = sample.shape[1]
    parts = -(-max(size, 1) // rules.width)
    wide = np.zeros((len(sample), parts * rules.width))
    wide[:, :size] = sample
    found = np.zeros((parts, rules.centroids, rules.width))
    for m in range(parts):
        x = wide[:, m * rules.width : (m + 1) * rules.width]
        own = np.unique(x, axis=0)
        c = own[np.linspace(0, len(own) - 1, rules.centroids).round().astype(int)]
        for _ in range(turns if len(own) > rules.centroids else 0):
            at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            n = np.bincount(at, minlength=rules.centroids)
            for w in range(rules.width):
                c[n > 0, w] = (np.bincount(at, x[:, w], rules.centroids)[n > 0]) / n[n > 0]
        found[m] = c
    return Codebook(found, size)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros; float64, exact up to 2^53."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(lengths) and (lengths == size).all():
        return flat.reshape(len(lengths), size)
    found = np.zeros((len(lengths), size))
    found[np.arange(size) < lengths[:, None]] = flat
    return found


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products (left, right). Floats are exact while no sum can reach 2^53; beyond it Python's integers are."""
    if len(a) and len(b) and np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max() >= 2.0**52:
        return (a.astype(np.int64).astype(object) @ b.T.astype(np.int64).astype(object)).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` of each group: higher scores first, then smaller keys."""
    order = np.lexsort((key, -score, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.concatenate([first, [len(g)]])))
    return order[rank < most]


class Windows:
    """What is best so far in windows of scores: for window w of anchor owner[w], rows that `mate` admits with low[w] <= score <= high[w]."""

    def __init__(self, book: Codebook, anchors: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, mate: Callable) -> None:
        self.anchors, self.owner, self.low, self.high, self.most, self.mate = anchors, owner, low, high, most, mate
        self.tables, self.norms = book.tables(anchors), np.linalg.norm(anchors, axis=1)
        # What float32 may lose in the tables' entries and in adding them up.
        self.slack = (1 + (len(self.tables) + 2) * 2.0**-23 * np.abs(self.tables).max(1).sum(0)).astype(np.float32)
        self.window, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = low.astype(float)  # no row below it can still enter a window

    def add(self, keys: np.ndarray, labels: np.ndarray, v: np.ndarray, codes: np.ndarray, left: np.ndarray) -> None:
        near = np.zeros((len(keys), len(self.anchors)), np.float32)
        for m, table in enumerate(self.tables):
            near += table[codes[:, m]]
        gap = left.astype(np.float32)[:, None] * (self.norms * (1 + 1e-6)).astype(np.float32) + self.slack
        lower, upper, mates = (np.ascontiguousarray(x.T) for x in (near - gap, near + gap, self.mate(keys, labels)))
        most_lower, wanted = np.where(mates, lower, -np.inf), np.zeros(mates.shape, bool)
        for w, a in enumerate(self.owner):
            sure = most_lower[a]
            sure = sure[(sure >= self.low[w]) & (upper[a] <= self.high[w])]
            if len(sure) >= self.most:
                self.floor[w] = max(self.floor[w], np.partition(sure, len(sure) - self.most)[len(sure) - self.most])
            wanted[a] |= (upper[a] >= self.floor[w]) & (lower[a] <= self.high[w])
        wanted &= mates
        at, rows = wanted.any(1), np.flatnonzero(wanted.any(0))
        scores = exact(self.anchors[at], v[rows])
        place, asked, keys = np.cumsum(at) - 1, wanted[:, rows], keys[rows]
        kept = [(self.window, self.score, self.key)]
        for w, a in enumerate(self.owner):
            if at[a]:
                own = scores[place[a]]
                ok = np.flatnonzero(asked[a] & (own >= self.floor[w]) & (own >= self.low[w]) & (own <= self.high[w]))
                kept.append((np.full(len(ok), w), own[ok], keys[ok]))
        window, score, key = (np.concatenate(x) for x in zip(*kept, strict=True))
        top = best(window, score, key, self.most)
        self.window, self.score, self.key = window[top], score[top], key[top]
        full = np.bincount(self.window, minlength=len(self.owner)) >= self.most
        last = np.full(len(self.owner), np.inf)
        np.minimum.at(last, self.window, self.score)
        self.floor = np.where(full, np.maximum(self.floor, last), self.floor)


def index(rows: DataFrame, rules: Rules) -> tuple[DataFrame, Codebook]:
    """A written table (key, label, v, codes, left) of all rows of `usable`, and the codebook, fitted on a sample of rules.sample rows."""
    rows = written(rows)
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    picked = rows.orderBy(F.xxhash64("key", "v")).limit(rules.sample).select("v").toArrow().column(0).combine_chunks()
    picked = picked.chunk(0) if isinstance(picked, pa.ChunkedArray) and picked.num_chunks else picked
    sample = matrix(picked, size) if len(picked) else np.zeros((1, size))
    book = fit(sample, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, left = book.encode(matrix(batch.column(2), size))
            flat = pa.array(codes.tobytes()[k : k + codes.shape[1]] for k in range(0, codes.size, codes.shape[1])) if len(codes) else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, flat.cast(pa.binary()), pa.array(left)], ["key", "label", "v", "codes", "left"])

    return written(arrow_map(rows, run, "key long, label long, v array<bigint>, codes binary, left double")), book


def _searched(table: DataFrame, book: Codebook, made: Callable[[], Windows]) -> DataFrame:
    """(w, score, key): the best of each task's rows in each window."""
    parts = len(book.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = made()
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).fill_null(int(NO_KEY)).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts)
                found.add(keys, batch.column(1).to_numpy(), matrix(batch.column(2), book.size), codes, batch.column(4).to_numpy())
        key = pa.array(found.key, pa.int64(), mask=found.key == NO_KEY)
        yield pa.RecordBatch.from_arrays([pa.array(found.window, pa.int64()), pa.array(found.score, pa.int64()), key], ["w", "score", "key"])

    best_first = Window.partitionBy("w").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return arrow_map(table.select("key", "label", "v", "codes", "left"), run, "w long, score long, key long").withColumn("rank", F.row_number().over(best_first))


def _block(table: DataFrame, book: Codebook, keys: np.ndarray, labels: np.ndarray, anchors: np.ndarray, rules: Rules) -> DataFrame:
    """The negatives of one block of anchors."""
    spark, n = table.sparkSession, len(keys)
    open_low, open_high = np.full(n, np.iinfo(np.int64).min // 2), np.full(n, np.iinfo(np.int64).max // 2)
    same = lambda k, x: (x[:, None] == labels) & (k[:, None] != keys)
    other = lambda k, x: x[:, None] != labels
    found = _searched(table, book, lambda: Windows(book, anchors, np.arange(n), open_low, open_high, rules.positives, same)).where(F.col("rank") <= rules.positives).orderBy("w", "rank").collect()
    owner, score = np.array([r["w"] for r in found], np.int64), np.array([r["score"] for r in found], np.int64)
    low, high = -((-rules.low * score) // 100), (rules.high * score) // 100
    names = spark.createDataFrame([(w, int(keys[r["w"]]), r["key"], r["score"]) for w, r in enumerate(found)], "w long, anchor_id long, positive_id long, positive_score long")
    if not found:
        return names.select("anchor_id", "positive_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("negative_id"), "positive_score", F.lit(0).cast("long").alias("negative_score"))
    near = _searched(table, book, lambda: Windows(book, anchors, owner, low, high, rules.negatives, other)).where(F.col("rank") <= rules.negatives)
    return near.join(F.broadcast(names), "w").select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, label: Column, anchor: Column, key: str = "vec_id", vector: str = "embedding", rules: Rules = Rules()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    label: a row's class; anchor: which keys are anchors, over the column `key`. Anchors are asked in blocks of about rules.block rows, each of
    which reads the index twice; a block and its positives are what reaches the driver.
    """
    table, book = index(usable(rows, key, label, vector), rules)
    asked = table.where(F.col("key").isNotNull()).withColumn(key, F.col("key")).where(anchor).select("key", "label", "v").distinct()
    asked = written(asked)
    blocks = max(1, -(-asked.count() // rules.block))
    placed, found = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))), None
    for b in range(blocks):
        own = placed.where(F.col("block") == b).orderBy("key", "label").collect()
        anchors = np.zeros((len(own), book.size))
        for k, r in enumerate(own):
            anchors[k, : len(r["v"])] = r["v"]
        part = _block(table, book, np.array([r["key"] for r in own], np.int64), np.array([r["label"] for r in own], np.int64), anchors, rules)
        part = written(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found
