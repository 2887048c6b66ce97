"""Document quality from a linear-chain conditional random field over lines.

Every line of a text gets features of its own characters and words (shares of character classes, shares of words that belong to
five-word runs repeated in the document, whether the line repeats another one) and those of the lines before and after. A two-state
chain, good and bad, with learned node and transition potentials gives each line's marginal by forward-backward; the document's score
is the mean of the lines' marginals weighted by their lengths, passed through a fitted logistic curve.

The forward and backward passes are segmented scans of 2 x 2 matrices over `PART` lines at a time, with the last message carried on;
features are made for as many lines. So a text of any number of lines costs in proportion to its length, and of its lines only a few numbers each are held.

Learned from a bounded sample: about `SAMPLE_ROWS` labelled rows for each label, chosen by a hash of the key, of at most
`SAMPLE_LINES` lines each (longer documents are not learned from). Lines begin with their document's label; then lines of bad documents
that look good are relabelled, at least a quarter of such a document's length staying bad.

Defined results: null and empty texts count as one empty line; texts are scored whole; if one label is missing, all scores are the
share of label 1 (0.5 without labels); labels for one key that contradict each other count as the smaller one; rows with a null key have
no label and are scored; repeated rows get equal scores; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.llm.common import arrow_map, blocks, buffers, run_hashes, windows, word_runs

SAMPLE_ROWS, SAMPLE_LINES = 1_500, 400

#: Character classes by byte; the bytes of other characters than ASCII are one class.
CLASSES = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t", "stop": ".,;:?", "shout": "!", "bar": "|", "symbol": "#*$%&<>", "quote": "\"'()[]{}"}
_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
_CLASS_OF[128:] = len(CLASSES) + 1
for _k, _chars in enumerate(CLASSES.values()):
    _CLASS_OF[[*_chars.encode()]] = _k
N_CLASSES = len(CLASSES) + 2
_CLASS_OF[10] = N_CLASSES  # line feeds belong to no line
OWN = N_CLASSES + 5
#: Lines whose features or messages are held at once, and bytes that are counted at once.
PART, BYTES = 1 << 14, 1 << 20


@dataclass
class Lines:
    """All lines of a block; features are made for some lines at a time.

    Of each line: where it starts and ends, how many words it has and how many of them lie in repeated runs of five, and whether it repeats another one;
    first: where each text's lines begin (one more than texts).
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    in_runs: np.ndarray
    repeats: np.ndarray
    first: np.ndarray

    @property
    def length(self) -> np.ndarray:
        return self.ends - self.starts

    def _own(self, low: int, high: int) -> np.ndarray:
        starts, length, words = self.starts[low:high], self.length[low:high], self.words[low:high]
        counts = np.zeros((high - low) * (N_CLASSES + 1))
        for at in range(int(starts[0]), int(self.ends[high - 1]), BYTES):
            part = self.data[at : min(at + BYTES, int(self.ends[high - 1]))]
            cuts = np.searchsorted(starts, (at, at + len(part)), side="right")
            bounds = np.concatenate([[at], starts[cuts[0] : cuts[1]], [at + len(part)]])
            line = np.repeat(np.arange(cuts[0] - 1, cuts[1]), np.diff(bounds))
            counts += np.bincount(line * (N_CLASSES + 1) + _CLASS_OF[part], minlength=len(counts))
        own = np.zeros((high - low, OWN))
        own[:, :N_CLASSES] = counts.reshape(-1, N_CLASSES + 1)[:, :N_CLASSES] / np.maximum(length, 1)[:, None]
        own[:, N_CLASSES] = self.in_runs[low:high] / np.maximum(words, 1)
        own[:, N_CLASSES + 1] = self.repeats[low:high]
        own[:, N_CLASSES + 2] = np.log1p(length) / 8
        own[:, N_CLASSES + 3] = words == 0
        own[:, N_CLASSES + 4] = 1
        return own

    def features(self, low: int, high: int) -> np.ndarray:
        """Own features of lines low to high, high exclusive, and those of the lines before and after in the same text."""
        before, after = max(low - 1, 0), min(high + 1, len(self.starts))
        own = self._own(before, after)
        x = np.zeros((high - low, 3 * OWN))
        x[:, :OWN] = own[low - before : high - before]
        inner = np.ones(after - before + 1, bool)  # not the first line of its text
        edges = self.first[np.searchsorted(self.first, before) : np.searchsorted(self.first, after, side="right")]
        inner[edges - before] = False
        at = np.flatnonzero(inner[low - before : high - before])
        x[at, OWN : 2 * OWN] = own[at + low - before - 1]
        at = np.flatnonzero(inner[low - before + 1 : high - before + 1])
        x[at, 2 * OWN :] = own[at + low - before + 1]
        return x


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Split at line feeds, as str.split does, and describe each line."""
    n_texts = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    per_text = 1 + np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1])
    first = np.concatenate([[0], np.cumsum(per_text)])
    # A feed's end can be the start of the next text: sorting keeps each text's own starts together, for they are counted by text.
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    # Words in repeated runs of five, and repeated lines, within a document.
    w_start, w_end, w_text = word_runs(data, offsets)
    w_line = np.searchsorted(starts, w_start, side="right") - 1
    words = np.bincount(w_line, minlength=len(starts))
    seen, at = windows(run_hashes(data, w_start, w_end), w_text, 5)
    twice = _repeated(seen, w_text[at])
    touched = np.zeros(len(w_line) + 5, bool)
    for k in range(5):
        touched[at[twice] + k] = True
    in_runs = np.bincount(w_line[touched[: len(w_line)]], minlength=len(starts))
    repeats = _repeated(run_hashes(data, starts, ends), np.repeat(np.arange(n_texts), per_text)) & (ends > starts)
    return Lines(data, starts, ends, words, in_runs, repeats, first)


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which hashes occur more than once for their owner."""
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    found = np.zeros(len(hashes), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def scan(matrices: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Products M1 M2 ... Mt within each segment, scaled to a largest entry of 1, by doubling."""
    out = matrices / matrices.max(axis=(1, 2), keepdims=True)
    place = np.arange(len(out)) - np.repeat(first[:-1], np.diff(first))
    step = 1
    while step <= (place.max() if len(place) else 0):
        at = np.flatnonzero(place >= step)
        product = out[at - step] @ out[at]
        product /= product.max(axis=(1, 2), keepdims=True)
        out[at] = product
        step *= 2
    return out


def messages(odds: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """What reaches each line from the lines before it in its text, its own potential included; a part of the lines after another."""
    out = np.empty((len(odds), 2))
    for low in range(0, len(odds), PART):
        node = np.stack([np.exp(-odds[low : low + PART] / 2), np.exp(odds[low : low + PART] / 2)], axis=1)
        begins = first[np.searchsorted(first, low) : np.searchsorted(first, low + len(node))] - low
        steps = move[None] * node[:, None, :]
        steps[begins] = node[begins][:, None, :] * np.eye(2)  # no move before a text's first line
        goes_on = not len(begins) or begins[0] > 0
        bounds = np.concatenate([[0] if goes_on else [], begins, [len(node)]]).astype(int)
        products = scan(steps, bounds)
        said = products.sum(axis=1)
        if goes_on:
            said[: bounds[1]] = out[low - 1] @ products[: bounds[1]]
        out[low : low + PART] = said / said.max(axis=1, keepdims=True)
    return out


@dataclass
class Chain:
    """Weights of the log odds of a good line, log potentials [before, after] of transitions, and the final logistic curve."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, lines: Lines) -> np.ndarray:
        n = len(lines.starts)
        return np.concatenate([lines.features(k, min(k + PART, n)) @ self.weights for k in range(0, n, PART)])

    def marginals(self, odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        odds, move = np.clip(odds, -30, 30), np.exp(self.moves)
        both = messages(odds, first, move)
        both *= messages(odds[::-1], len(odds) - first[::-1], move.T)[::-1]
        both[:, 0] *= np.exp(odds / 2)  # both passes hold the line's own potential
        both[:, 1] *= np.exp(-odds / 2)
        return both[:, 1] / both.sum(axis=1)

    @staticmethod
    def documents(marginals: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals of each text."""
        weight = length + 1.0
        return np.add.reduceat(weight * marginals, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def score(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (means - self.shift), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, length: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 2, prior: float = 0.5) -> Chain:
    """Piecewise training with relabelling on lines' features x; both labels must be there.

    Node weights come from logistic regression on lines (each label's lines weigh the same in all), transitions from counts of
    neighbouring lines' labels, smoothed, as log of observed over expected frequency. The final curve is fitted to documents that
    weigh as the labels are spread: `prior` is the share of label 1.
    """
    text = np.repeat(np.arange(len(labels)), np.diff(first))
    y = labels[text].astype(float)
    size = length + 1.0
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)))
    for turn in range(rounds + 1):
        share = np.array([size[y == 0].sum(), size[y == 1].sum()])
        weight = size / share[y.astype(int)] * len(y) / 2
        chain.weights = _logistic(x, y, weight, chain.weights, ridge=0.3)
        inner = text[1:] == text[:-1]
        counts = np.full((2, 2), 1.0)
        np.add.at(counts, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
        joint = counts / counts.sum()
        chain.moves = np.clip(np.log(joint / np.outer(joint.sum(1), joint.sum(0))), -1, 1)
        if turn < rounds:
            p = chain.marginals(x @ chain.weights, first)
            for k in np.flatnonzero(labels == 0):
                own = slice(first[k], first[k + 1])
                order = np.argsort(p[own], kind="stable")
                kept = np.cumsum(size[own][order]) - size[own][order] < size[own].sum() / 4
                bad = p[own] < 0.5
                bad[order[kept]] = True
                y[own] = ~bad
    mean = chain.documents(chain.marginals(x @ chain.weights, first), length, first)
    balance = np.where(labels == 1, prior / max(1, (labels == 1).sum()), (1 - prior) / max(1, (labels == 0).sum())) * len(labels)
    b, a = _logistic(np.stack([np.ones(len(mean)), mean], 1), labels.astype(float), balance, np.zeros(2), ridge=0.05)
    chain.slope, chain.shift = float(a), float(-b / a) if a else 0.5
    return chain


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", most_rows: int = SAMPLE_ROWS, most_lines: int = SAMPLE_LINES) -> Chain | float:
    """A chain from the labelled rows that `learn` allows, or the constant score if there aren't two labels to learn."""
    marks = labels.where(learn & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        return counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1 << 20, round(most_rows / n * (1 << 20))))).otherwise(share)
    marks = marks.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share)
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(marks.withColumnRenamed(key, "key")), "key")  # a sample of bounded size: texts are not shuffled

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 20):
            lines = lines_of(*buffers(block.column(block.schema.get_field_index("text"))))
            for k in range(block.num_rows):
                own = slice(lines.first[k], lines.first[k + 1])
                if own.stop - own.start <= most_lines:
                    yield pa.RecordBatch.from_arrays(
                        [block.slice(k, 1).column(0).cast(pa.string()), block.slice(k, 1).column(2), pa.array([lines.features(own.start, own.stop).astype(np.float32).tobytes()], pa.binary()), pa.array([lines.length[own].astype(np.int64).tobytes()], pa.binary())],
                        ["key", "label", "x", "length"],
                    )

    found = arrow_map(chosen.select("key", "text", "label"), describe, "key string, label int, x binary, length binary").toPandas()
    found = found.sort_values(["key", "x"])
    if found.label.nunique() < 2:
        return counts[1] / sum(counts.values())
    lengths = [np.frombuffer(b, np.int64) for b in found.length]
    x = np.frombuffer(b"".join(found.x), np.float32).reshape(-1, 3 * OWN).astype(float)
    return fit(x, np.concatenate(lengths), np.cumsum([0, *map(len, lengths)]), found.label.to_numpy(), prior=counts[1] / sum(counts.values()))


def score(docs: DataFrame, model: Chain | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, n_lines, bad_chars) for each row: the score, and how many bytes stand in lines that are rather bad."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, 1 << 20):
            lines = lines_of(*buffers(block.column(1)))
            n = np.diff(lines.first)
            if isinstance(model, float):
                scores, bad = np.full(block.num_rows, model), np.zeros(block.num_rows)
            else:
                p = model.marginals(model.odds(lines), lines.first)
                scores = model.score(model.documents(p, lines.length, lines.first))
                bad = np.add.reduceat((p < 0.5) * lines.length, lines.first[:-1])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(scores, pa.float64()), pa.array(n, pa.int64()), pa.array(bad.astype(np.int64), pa.int64())], ["key", "score", "n_lines", "bad_chars"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_lines", T.LongType()), T.StructField("bad_chars", T.LongType())])
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text)), run, schema).withColumnRenamed("key", key)
