"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct n-grams of 1 to 4 bytes that both hold, over
the root of the product of how many each holds. Texts are folded to lower case (ASCII and Latin-1 letters) and their n-grams hashed to
`BUCKETS` columns. A Nystroem map over landmark texts of every language and one-versus-rest ridge regression on it make the classifier.
Scores are batched products of presence matrices with the landmarks: P(x) . (landmarks . weights) / sqrt(|x|), the same numbers as
kernel rows times weights, in another order of multiplication.

Presence saturates in long texts, so a text is scored in windows of equal length, `WINDOW` bytes at most, that cover it whole, and its
outputs are the mean of theirs by length. So length changes neither scores nor memory.

Learned from a bounded sample: at most about `SAMPLE_ROWS` rows, evenly over the values of `lang`, chosen by a hash of the key; of each,
one window, chosen by the same hash.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text if there is nothing to learn from;
texts count whole; rows with a null language or a null key are never learned from, and those with a null key are scored all the same;
repeated rows get equal results; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.llm.common import LOWER, arrow_map, blocks, buffers, give_back

BUCKETS_LOG2, LONGEST = 15, 4
BUCKETS = 1 << BUCKETS_LOG2
SAMPLE_ROWS, LANDMARKS, RIDGE = 2_400, 192, 1e-3
#: Bytes of the longest window, and windows whose presence rows are held at once.
WINDOW, PART = 2_048, 128
UNKNOWN = "und"
_SPREAD = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_IS_ASCII_LETTER = np.zeros(256, bool)
_IS_ASCII_LETTER[65:91] = _IS_ASCII_LETTER[97:123] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 in lower case."""
    low = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[lead]
    capital = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
    low[capital] += 0x20
    return low


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: which buckets its n-grams fall into."""
    n_texts = len(offsets) - 1
    found = np.zeros(n_texts * BUCKETS, bool)
    if len(data):
        text = np.repeat(np.arange(n_texts, dtype=np.int64) << BUCKETS_LOG2, np.diff(offsets))
        low = folded(data).astype(np.uint32)
        code = np.zeros(len(low), np.uint32)
        for n in range(1, LONGEST + 1):
            if len(low) < n:
                break
            code = code[: len(low) - n + 1] << np.uint32(8) | low[n - 1 :]
            bucket = (code * _SPREAD[n - 1] + _SPREAD[n - 1]) >> np.uint32(32 - BUCKETS_LOG2)
            inside = text[: len(code)] == text[n - 1 :]
            found[(text[: len(code)] + bucket)[inside]] = True
    return found.reshape(n_texts, BUCKETS)


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of equal length begin that cover each text (one more than windows), and how many each text has."""
    length = np.diff(offsets)
    per = -(-length // WINDOW)
    text = np.repeat(np.arange(len(per)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return np.append(offsets[text] + k * length[text] // per[text], offsets[-1]), per


def has_letter(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_IS_ASCII_LETTER[data])])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[i] = any(c.isalpha() for c in column[i].as_py())
    return found


@dataclass
class Model:
    """Languages, and for each bucket and language its weight."""

    languages: list[str]
    weights: np.ndarray

    def outputs(self, found: np.ndarray) -> np.ndarray:
        norms = np.sqrt(np.maximum(found.sum(axis=1), 1)).astype(np.float32)
        return found.astype(np.float32) @ self.weights / norms[:, None]

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Outputs of each text: the mean of its windows' by length."""
        starts, per = windows_of(offsets)
        each = np.zeros((len(starts) - 1, len(self.languages)))
        for k in range(0, len(each), PART):
            own = starts[k : k + PART + 1]
            each[k : k + PART] = self.outputs(presence(data[own[0] : own[-1]], own - own[0]))
        text, weight = np.repeat(np.arange(len(per)), per), np.diff(starts)
        total = [np.bincount(text, weight * each[:, k], len(per)) for k in range(len(self.languages))]
        return np.stack(total, axis=1) / np.maximum(np.diff(offsets), 1)[:, None]

    def predict(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row of outputs and its share of the positive ones."""
        best = out.argmax(axis=1)
        positive = np.clip(out, 0, None)
        total = positive.sum(axis=1)
        top = positive[np.arange(len(out)), best]
        return best, np.where(total > 0, top / np.where(total > 0, total, 1), 1 / len(self.languages))


def fit(packed: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nystroem features of packed presence rows, a few rows at a time.

    Rows come in the order in which landmarks are taken, language by language.
    """
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    each = max(4, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))])

    def unit(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(rows, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    marks = unit(packed[chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > values.max() * 1e-7
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = np.concatenate([(unit(packed[k : k + 128]) @ marks.T).astype(np.float64) for k in range(0, len(packed), 128)]) @ root
    goal = np.eye(len(names))[y]
    w = np.linalg.solve(features.T @ features + ridge * len(packed) * np.eye(features.shape[1]), features.T @ goal)
    return Model(names, (marks.T @ (root @ w)).astype(np.float32))


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", most_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from the rows that `learn` allows. The number of languages bounds the model; counts of each come to the driver."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    each = max(8, most_rows // len(counts))
    shares = docs.sparkSession.createDataFrame([(x, min(1 << 20, round(each / n * (1 << 20)))) for x, n in counts.items()], "lang string, share int")
    chosen = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h")).join(F.broadcast(shares), "lang")
    chosen = chosen.where(F.pmod("h", F.lit(1 << 20)) < F.col("share")).select("lang", "text", "h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 20):
            data, offsets = buffers(block.column(1))
            starts, per = windows_of(offsets)
            first, number = np.cumsum(per) - per, block.column(2).to_numpy(zero_copy_only=False) % np.maximum(per, 1)
            for i in np.flatnonzero(per > 0).tolist():
                own = starts[first[i] + number[i] : first[i] + number[i] + 2]
                bits = np.packbits(presence(data[own[0] : own[1]], own - own[0]), axis=1)
                yield pa.RecordBatch.from_arrays([*(block.column(k).slice(i, 1) for k in (0, 2)), pa.array([bits.tobytes()], pa.binary())], ["lang", "h", "bits"])

    found = arrow_map(chosen, pack, "lang string, h long, bits binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["lang", "h", "bits"])
    model = fit(np.frombuffer(b"".join(found.bits), np.uint8).reshape(len(found), -1), found.lang.tolist())
    give_back()
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, 1 << 20):
            names, scores = predict_texts(model, block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text)), run, schema).withColumnRenamed("key", key)


def predict_texts(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and the score of each text of a block."""
    if model is None:
        return [UNKNOWN] * len(column), np.zeros(len(column))
    data, offsets = buffers(column)
    best, score = model.predict(model.of_texts(data, offsets))
    letters = has_letter(data, offsets, column)
    return [model.languages[b] if x else UNKNOWN for b, x in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, score, 0.0).astype(float)


def keep_identified(docs: DataFrame, model: Model | None, above_chance: float, text: str = "text") -> DataFrame:
    """The rows whose language is known with a score that is at least `above_chance` of the way from chance (one over the number of
    languages) to 1, columns as they were."""
    chance = 1 / len(model.languages) if model else 1.0
    least = chance + above_chance * (1 - chance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, 1 << 20):
            names, scores = predict_texts(model, block.column(block.schema.get_field_index(text)))
            yield block.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores.tolist(), strict=True)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
