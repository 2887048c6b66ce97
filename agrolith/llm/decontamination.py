"""Benchmark decontamination by latent semantic retrieval.

1. Texts become sequences of 32-bit word hashes (runs of letters and digits, lower case), kept in a narrow table. The benchmark is searched
   in parts of about `BLOCK` items or `BLOCK_BYTES` of text, so that what reaches driver and tasks doesn't grow with it. Document frequencies of a part's words are
   exact counts over all documents. A word's weight is log(1 + N / (1 + df)); those of a part's words that are in more than
   `MOST_SHARE` of the documents (and more than `LEAST_STOP`) weigh nothing, and words that the part lacks weigh as the rarest do.
2. Passages are windows of `SVD_WIDTH` words of all documents. With A the unit TF-IDF rows over the part's terms, each task
   adds up A' (A G) for one random matrix G; the sums make a randomised (Nystroem) decomposition of A'A, with the benchmark's own
   passages given more weight than the corpus. Its leading `RANK` right singular vectors span the latent space. (Above `MOST_COLUMNS` terms,
   terms share columns, which loosens the bound of step 3 and loses nothing.)
3. Windows of two widths of every document are projected; a window is a candidate for an item if latent cosine plus the bound on what
   the projection leaves out reaches `LEAST_COSINE`. So no window of that TF-IDF cosine is lost, whatever the rank.
   Stretches of 1.5 times an item's length that hold enough of its words, of any weight, are candidates too (`Counted`). So neither an item
   that is in so many documents that its own words are frequent is lost, nor one far longer or shorter than the windows.
4. A candidate is a leak if the longest common subsequence of item and window holds `COPY` of the item's words, or `PARAPHRASE` of them and the
   item's answer in order: its last `ANSWER` words that at most `ANSWER_SHARE` of the other items have, or its last words if none is so
   rare. So answers depend on the benchmark alone, and an item of one word leaks wherever the word stands.

Defined results: null and empty texts and items, items without a key and documents without words leak nothing; texts and items are read
whole; rows with a null key are searched, too, and never dropped; repeated rows give repeated results; equal items each give results; an
empty table gives an empty one; other columns don't matter. Where both tables' keys have one name, the item's key is called item_<name>.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from agrolith.llm.common import arrow_map, blocks, buffers, distinct, run_hashes, runs_of, split_by_keys, written
from agrolith.llm.language_id import folded

MOST_SHARE, LEAST_STOP = 0.05, 20
SVD_WIDTH, WIDTHS, RANK, OVERSAMPLING, MOST_COLUMNS = 48, (24, 64), 192, 16, 1 << 14
LEAST_COSINE, COPY, PARAPHRASE, ANSWER, ANSWER_SHARE, BLOCK, BLOCK_BYTES = 0.3, 0.8, 0.5, 4, 0.1, 2_048, 16 << 20
#: Items of fewer words are searched by all of their words, longer ones by their rarest. Pairs of items and places that are held at once.
SHORT, MOST_PAIRS = 8, 1 << 20
#: Bits of the table that tells most words aside before an exact look-up.
SIEVE_BITS = 18
#: The benchmark's weight in the decomposition against all documents' together.
BENCHMARK_WEIGHT = 64
#: Words that one task of the decomposition reads at least; its sums are of fixed size.
WORDS_PER_TASK = 4_000_000

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all words of a block, and where each text's begin (one more than texts)."""
    data, offsets = buffers(column)
    low = folded(data) if len(data) else data
    starts, ends, text = runs_of(_IN_WORD[low], offsets)
    ids = (run_hashes(low, starts, ends) >> np.uint64(32)).astype(np.uint32)
    return ids, np.searchsorted(text, np.arange(len(offsets)))


def _hashed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, words as bytes, their number) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            ids, first = word_ids(block.column(1))
            words = pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column(0), words, pa.array(np.diff(first).astype(np.int64))], ["key", "words", "n"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("words", T.BinaryType()), T.StructField("n", T.LongType())])
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema)


@dataclass
class Vocabulary:
    """Sorted distinct word hashes, and a sieve."""

    words: np.ndarray
    sieve: np.ndarray

    @staticmethod
    def of(words: np.ndarray) -> Vocabulary:
        words = np.unique(words)
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[words >> np.uint32(32 - SIEVE_BITS)] = True
        return Vocabulary(words, sieve)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vocabulary's words in a sequence, and which words they are."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.flatnonzero(self.sieve[ids >> np.uint32(32 - SIEVE_BITS)])
        term = np.minimum(np.searchsorted(self.words, ids[place]), len(self.words) - 1)
        hit = self.words[term] == ids[place]
        return place[hit], term[hit]


def document_frequencies(rows: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """In how many of the hashed rows each word of the vocabulary occurs; at most as many counts as it has words reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary.words), np.int64), len(vocabulary.words)
        for block in _cut(batches):
            ids, first = _decode(block.column(1))
            place, term = vocabulary.find(ids)
            df += np.bincount(distinct((np.searchsorted(first, place, side="right") - 1) * n + term) % n, minlength=n)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "n"])

    df = np.zeros(len(vocabulary.words), np.int64)
    if len(df):
        counted = arrow_map(rows.select("key", "words", "n"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        df[counted.term.to_numpy(int)] = counted.n.to_numpy(int)
    return df


@dataclass
class Terms:
    """A vocabulary with the exact frequency, weight and column of each word, and the weight of all other words."""

    vocabulary: Vocabulary
    df: np.ndarray
    weights: np.ndarray
    columns: np.ndarray
    width: int
    other: float

    @staticmethod
    def of(vocabulary: Vocabulary, df: np.ndarray, n_docs: int) -> Terms:
        weights = np.where(df > max(LEAST_STOP, MOST_SHARE * n_docs), 0.0, np.log1p(n_docs / (1.0 + df)))
        column = np.cumsum(weights > 0) - 1  # words without weight need none
        width = min(MOST_COLUMNS, max(1, int((weights > 0).sum())))
        return Terms(vocabulary, df, weights, column % width, width, float(np.log1p(n_docs)))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of all words; places of the vocabulary's weighty words among them, and their columns."""
        place, term = self.vocabulary.find(ids)
        weights = np.full(len(ids), self.other)
        weights[place] = self.weights[term]
        some = self.weights[term] > 0
        return weights, place[some], self.columns[term[some]]

    def index(self, ids: np.ndarray) -> np.ndarray:
        """Which words of the vocabulary these, all of them in it, are."""
        return np.searchsorted(self.vocabulary.words, ids)


def _windows(first: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of windows that cover each text, the last one at its end, and their texts; none for texts without words."""
    n = np.diff(first)
    per = np.where(n > 0, 1 + np.ceil(np.maximum(n - width, 0) / stride).astype(np.int64), 0)
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = first[:-1][text] + np.minimum(k * stride, np.maximum(n - width, 0)[text])
    return start, np.minimum(start + width, first[1:][text]), text


def _sums(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of rows a to b, b exclusive, for each pair; pairs of equal length are added up together."""
    out = np.zeros((len(a), rows.shape[1]), rows.dtype)
    length = b - a
    order = np.argsort(length, kind="stable")
    bounds = np.flatnonzero(np.diff(length[order], prepend=-1, append=np.iinfo(np.int64).max))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = order[lo:hi]
        n = int(length[own[0]]) if len(own) else 0
        if n > 64:
            for k in own:
                out[k] = rows[a[k] : b[k]].sum(axis=0)
        elif n > 0:
            total = rows[a[own]]
            for step in range(1, n):
                total += rows[a[own] + step]
            out[own] = total
    return out


def unit_items(items: list[np.ndarray], terms: Terms) -> np.ndarray:
    """A row for each item: its TF-IDF vector over the vocabulary's columns, of unit length unless no word has weight."""
    rows = np.zeros((len(items), terms.width))
    for row, ids in zip(rows, items, strict=True):
        w, at, column = terms.find(ids)
        np.add.at(row, column, w[at])
        row /= max(1e-12, float(np.linalg.norm(row)))
    return rows


def _norms2(w: np.ndarray, at: np.ndarray, column: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Squared lengths of windows' vectors over the columns; occurrences a to b of each window, b exclusive, stand in up to `width` words.

    Where no column occurs twice, the sum of squares; else the squares of the columns' sums.
    """
    found = np.concatenate([[0], np.cumsum(w[at] ** 2)])
    found = found[b] - found[a]
    order = np.argsort(column, kind="stable")
    again = order[1:][(column[order][1:] == column[order][:-1]) & (at[order][1:] - at[order][:-1] < width)]
    seen = np.concatenate([[0], np.cumsum(np.bincount(again, minlength=len(at)))])
    some = np.flatnonzero(seen[b] > seen[a])
    if len(some):
        n = b[some] - a[some]
        window = np.repeat(np.arange(len(some)), n)
        place = np.arange(len(window)) + np.repeat(a[some] - (np.cumsum(n) - n), n)
        order = np.lexsort((column[place], window))
        window, place = window[order], place[order]
        heads = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (column[place][1:] != column[place][:-1])]))
        found[some] = np.bincount(window[heads], np.add.reduceat(w[at[place]], heads) ** 2, len(some))
    return found


def _decode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = [np.frombuffer(b.as_py() or b"", np.uint32) for b in words]
    return (np.concatenate(raw) if raw else np.zeros(0, np.uint32)), np.cumsum([0, *map(len, raw)])


def _cut(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of (key, words, n) cut to blocks of about `most` bytes of words; long texts stand alone."""
    for batch in batches:
        size = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False) * 4)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def latent_space(rows: DataFrame, n_words: int, items: np.ndarray, terms: Terms, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (columns, rank) of all documents' passages with the weighted benchmark."""
    size = min(terms.width, rank + OVERSAMPLING)
    g = np.random.default_rng(7).standard_normal((terms.width, size)).astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, energy = np.zeros((terms.width, size), np.float32), 0.0
        for block in _cut(batches):
            ids, first = _decode(block.column(1))
            w, at, column = terms.find(ids)
            if not len(at):
                continue
            start, end, _ = _windows(first, SVD_WIDTH, SVD_WIDTH)
            norm2 = np.concatenate([[0], np.cumsum(w * w)])
            norm2 = np.maximum(norm2[end] - norm2[start], 1e-12)
            a, b = np.searchsorted(at, start), np.searchsorted(at, end)
            some = np.flatnonzero(b > a)
            b = np.maximum(b, a)
            scaled = w[at].astype(np.float32)
            projected = _sums(g[column] * scaled[:, None], a[some], b[some]) / norm2[some, None].astype(np.float32)
            # Windows of a text don't overlap but for the last two, so each term's windows are few.
            n = b[some] - a[some]
            window = np.repeat(np.arange(len(some)), n)
            place = np.arange(len(window)) + np.repeat(a[some] - (np.cumsum(n) - n), n)
            order = np.argsort(column[place], kind="stable")
            c = column[place][order]
            heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            total[c[heads]] += _sums((projected[window] * scaled[place][:, None])[order], heads, np.append(heads[1:], len(c)))
            energy += float((np.add.reduceat(scaled[place] ** 2, np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))) / norm2[some]).sum())
        used = np.flatnonzero(np.abs(total).sum(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int32()), pa.array([*(total[k].tobytes() for k in used), np.array([energy], np.float32).tobytes()], pa.binary())], ["term", "v"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, np.float32).astype(np.float64)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["term", "v"])

    tasks = max(1, -(-n_words // WORDS_PER_TASK))
    parts = arrow_map(rows.select("key", "words", "n").coalesce(tasks), sketch, "term int, v binary")
    summed = arrow_map(parts.repartition("term"), add, "term int, v binary").collect()
    y, energy = np.zeros((terms.width, size)), 0.0
    for k, v in ((r["term"], np.frombuffer(r["v"], np.float64)) for r in summed):
        if k < 0:
            energy = float(v[0])
        else:
            y[k] = v
    # The benchmark outweighs the corpus, so that the space keeps what tells its items apart.
    share = BENCHMARK_WEIGHT * max(energy, 1.0) / max(1.0, float((items**2).sum()))
    y += share * items.T @ (items @ g.astype(np.float64))
    shift = 1e-6 * float(np.linalg.norm(y))
    y += shift * g
    root = np.linalg.cholesky(_symmetric(g.T.astype(np.float64) @ y) + 1e-9 * shift * np.eye(size))
    u, _, _ = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)
    return u[:, :rank].astype(np.float32)


def _symmetric(x: np.ndarray) -> np.ndarray:
    return (x + x.T) / 2


def common_length(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


@dataclass
class Items:
    """A block of the benchmark: ids, words, latent vectors, what these leave out, and answers."""

    keys: list
    words: list[list[int]]
    latent: np.ndarray
    rest: np.ndarray
    answers: list[list[int]]


def stretch_of(n: int) -> int:
    """Words of the stretches in which an item of n words is looked for."""
    return n + (n + 1) // 2


def least_common(n: int, answer: list[int]) -> int:
    """The least common subsequence with which an item of n words can leak."""
    return max(1, int(np.ceil((PARAPHRASE if answer else COPY) * n - 1e-9)))


@dataclass
class Counted:
    """Each item's rarest words, and how many of them any stretch that leaks the item holds.

    A leak has `need` of the item's n words, so if all but m are left aside, it still has need - (n - m) of these m. This holds for words of
    any weight and items of any length.
    """

    words: Vocabulary
    first: np.ndarray
    terms: np.ndarray
    least: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(items: list[np.ndarray], answers: list[list[int]], terms: Terms) -> Counted:
        chosen, least, length = [np.zeros(0, np.uint32)], [], []
        for ids, answer in zip(items, answers, strict=True):
            n, need = len(ids), least_common(len(ids), answer)
            k = need if n < SHORT else -(-need // 3)
            rarest = ids[np.lexsort((ids, terms.df[terms.index(ids)]))][: n - need + k]
            chosen.append(np.unique(rarest))
            least.append(k)
            length.append(stretch_of(n))
        words = Vocabulary.of(np.concatenate(chosen))
        return Counted(words, np.cumsum([0, *map(len, chosen[1:])]), np.searchsorted(words.words, np.concatenate(chosen)), np.array(least, np.int64), np.array(length, np.int64))

    def find(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first, end) of stretches with enough of an item's words; those of a text and item in order."""
        place, term = self.words.find(ids)
        if not len(place):
            return
        far = int(self.length.max())
        # Texts and items lie so far apart that no stretch holds two of them.
        spread = place + (np.searchsorted(first, place, side="right") - 1) * far
        span = len(ids) + len(first) * far
        spread = spread[np.argsort(term, kind="stable")]
        counts = np.bincount(term, minlength=len(self.words.words))
        starts = np.cumsum(counts) - counts
        sizes = np.concatenate([[0], np.cumsum(counts[self.terms])])[self.first]
        item = 0
        while item < len(self.least):
            stop = max(item + 1, int(np.searchsorted(sizes, sizes[item] + MOST_PAIRS, side="right")) - 1)
            terms = self.terms[self.first[item] : self.first[stop]]
            n = counts[terms]
            owner = np.repeat(np.arange(stop - item), np.diff(self.first[item : stop + 1]))
            at = np.arange(int(n.sum())) + np.repeat(starts[terms] - (np.cumsum(n) - n), n)
            key = np.sort(spread[at] + np.repeat(owner, n) * span)
            own = key // span + item
            last = np.arange(len(key)) + self.least[own] - 1
            k = np.flatnonzero(last < len(key))
            k = k[key[last[k]] - key[k] < self.length[own[k]]]
            a, b = key[k] % span, key[last[k]] % span
            text = np.searchsorted(first + np.arange(len(first)) * far, a, side="right") - 1
            lo, hi = a - text * far - first[text], b - text * far - first[text] + 1
            # Overlapping stretches become one.
            new = np.ones(len(k), bool)
            new[1:] = (own[k][1:] != own[k][:-1]) | (text[1:] != text[:-1]) | (lo[1:] > hi[:-1])
            heads = np.flatnonzero(new)
            if len(heads):
                yield from zip(text[heads].tolist(), own[k][heads].tolist(), lo[heads].tolist(), np.maximum.reduceat(hi, heads).tolist(), strict=True)
            item = stop


def enough(item: Counter, n: int, need: int, words: list[int], first: int, last: int) -> bool:
    """Whether a stretch that meets words first to last holds `need` words of the item, each as often as the item at most."""
    begin, length, free, held = max(0, first - n), stretch_of(n), dict(item), 0
    for k in range(begin, min(last + n, len(words))):
        if (w := words[k]) in free:
            held += free[w] > 0
            free[w] -= 1
            if held >= need:
                return True
        if k - length + 1 >= begin and (w := words[k - length + 1]) in free:
            free[w] += 1
            held -= free[w] > 0
    return False


def verify(item: list[int], answer: list[int], words: list[int], first: int, last: int) -> tuple[float, int, int, str] | None:
    """The best stretch of words first to last that leaks the item: (share of the item, start, end, kind)."""
    n = len(item)
    length, stride = stretch_of(n), max(1, n // 2)
    best = None
    for start in range(max(0, first - n), max(1, min(last + n, len(words)) - length + stride), stride):
        stretch = words[start : start + length]
        share = common_length(item, stretch) / n
        kind = "copy" if share >= COPY else "paraphrase" if share >= PARAPHRASE and answer and common_length(answer, stretch) == len(answer) else None
        if kind and (best is None or share > best[0]):
            best = (share, start, start + len(stretch), kind)
    return best


def _search(rows: DataFrame, key_type: T.DataType, item_type: T.DataType, items: Items, terms: Terms, space: np.ndarray, counted: Counted) -> DataFrame:
    bags = [Counter(w) for w in items.words]
    needs = [least_common(len(w), a) for w, a in zip(items.words, items.answers, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _cut(batches):
            ids, first = _decode(block.column(1))
            w, at, column = terms.find(ids)
            energy = np.concatenate([[0], np.cumsum(w * w)])
            inside = np.concatenate([[0], np.cumsum(w[at] ** 2)])
            regions: dict[tuple[int, int], list[tuple]] = {}

            for width in WIDTHS:
                start, end, text = _windows(first, width, width // 2)
                a, b = np.searchsorted(at, start), np.searchsorted(at, end)
                own2 = _norms2(w, at, column, a, b, width)
                norm2 = np.maximum(own2 + energy[end] - energy[start] - (inside[b] - inside[a]), 1e-12)  # words without a column count one by one
                share2 = own2 / norm2
                k = np.flatnonzero((share2 >= LEAST_COSINE**2) & (b > a))
                for part in range(0, len(k), 2048):
                    own = k[part : part + 2048]
                    # Only what these windows hold is projected; windows come in order and overlap their neighbours.
                    used = np.flatnonzero(np.cumsum(np.bincount(a[own], minlength=len(at) + 1) - np.bincount(b[own], minlength=len(at) + 1))[: len(at)] > 0)
                    projected = space[column[used]] * w[at[used]].astype(np.float32)[:, None]
                    x = _sums(projected, np.searchsorted(used, a[own]), np.searchsorted(used, b[own])) / np.sqrt(norm2[own])[:, None].astype(np.float32)
                    left = np.sqrt(np.maximum(share2[own] - (x * x).sum(axis=1), 0)).astype(np.float32)
                    cosine = x @ items.latent.T
                    for i, j in zip(*np.nonzero(cosine + left[:, None] * items.rest[None, :] >= LEAST_COSINE - 1e-4), strict=True):
                        t = int(text[own[i]])
                        lo, hi = int(start[own[i]] - first[t]), int(end[own[i]] - first[t])
                        regions.setdefault((t, int(j)), []).append((lo, hi, float(cosine[i, j])))
            out = []
            lists: dict[int, list[int]] = {}

            def words_of(t: int) -> list[int]:
                if t not in lists:
                    lists[t] = ids[first[t] : first[t + 1]].tolist()
                return lists[t]

            held: dict[tuple[int, int], list[tuple]] = {}
            for t, j, lo, hi in counted.find(ids, first):
                if enough(bags[j], len(items.words[j]), needs[j], words_of(t), lo, hi):
                    a, b = np.searchsorted(at, (first[t] + lo, first[t] + hi))
                    x = (space[column[a:b]] * w[at[a:b]].astype(np.float32)[:, None]).sum(axis=0)
                    own2 = _norms2(w, at[a:b], column[a:b], np.array([0]), np.array([b - a]), hi - lo)[0]
                    norm2 = own2 + energy[first[t] + hi] - energy[first[t] + lo] - (inside[b] - inside[a])
                    held.setdefault((t, j), []).append((lo, hi, float(x @ items.latent[j] / np.sqrt(max(norm2, 1e-12)))))
            for t, j in sorted({*regions, *held}):
                spans = regions.get((t, j), [])
                words = words_of(t)
                merged: list[list] = []
                for lo, hi, c in sorted(spans):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1], merged[-1][2] = max(merged[-1][1], hi), max(merged[-1][2], c)
                    else:
                        merged.append([lo, hi, c])
                for own in (merged, held.get((t, j), [])):
                    if found := [(v, c) for lo, hi, c in own if enough(bags[j], len(items.words[j]), needs[j], words, lo, hi) and (v := verify(items.words[j], items.answers[j], words, lo, hi))]:
                        break
                if found:
                    (share, lo, hi, kind), c = max(found)
                    out.append((t, items.keys[j], c, share, lo, hi, kind))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [None, item_arrow, pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
            keys = block.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, kind) for c, kind in zip(columns[1:], kinds[1:], strict=True))], [f.name for f in schema])

    item_arrow = to_arrow_type(item_type)
    schema = T.StructType(
        [
            T.StructField("key", key_type), T.StructField("item", item_type), T.StructField("cosine", T.DoubleType()), T.StructField("lcs_share", T.DoubleType()),
            T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("kind", T.StringType()),
        ]
    )
    return arrow_map(rows.select("key", "words", "n"), run, schema)


def _leaks(docs: DataFrame, benchmark: DataFrame, text: str, key: str, item_text: str, item_key: str) -> DataFrame:
    rows = written(_hashed(docs, text, key))
    n_docs, n_words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    items = benchmark.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull() & (F.length("text") > 0)).distinct()
    n_items, n_bytes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n_items // BLOCK), -(-n_bytes // BLOCK_BYTES))
    item_rows = written(_hashed(items, "text", "item"))
    found = None
    for part in range(parts):  # about equal ones
        query = sorted(map(tuple, items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()))
        ids, first = word_ids(pa.array([t for _, t in query], pa.string()))
        some = np.flatnonzero(np.diff(first))
        words = [ids[first[k] : first[k + 1]] for k in some]
        vocabulary = Vocabulary.of(ids)
        terms = Terms.of(vocabulary, document_frequencies(rows, vocabulary), n_docs)
        vectors = unit_items(words, terms)
        space = latent_space(rows, n_words, vectors, terms) if vectors.any() else np.zeros((terms.width, 1), np.float32)
        latent = (vectors @ space).astype(np.float32)
        rest = np.sqrt(np.maximum((vectors**2).sum(axis=1) - (latent**2).sum(axis=1), 0)).astype(np.float32)
        rare = document_frequencies(item_rows, vocabulary) - 1 <= ANSWER_SHARE * (n_items - 1)
        answers = [w[rare[terms.index(w)]][-ANSWER:].tolist() or w[-ANSWER:].tolist() for w in words]
        block = Items([query[k][0] for k in some], [w.tolist() for w in words], latent, rest, answers)
        own = _search(rows, docs.schema[key].dataType, benchmark.schema[item_key].dataType, block, terms, space, Counted.of(words, answers, terms))
        found = own if found is None else found.unionByName(own)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(key, item_key, cosine, lcs_share, first_word, end_word, kind) for each document and item that leaks into it."""
    return _leaks(docs, benchmark, text, key, item_text, item_key).withColumnsRenamed({"key": key, "item": f"item_{item_key}" if item_key == key else item_key})


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of `docs`, columns as they were, into which no benchmark item leaks; rows without a key stay."""
    leaks = written(_leaks(docs, benchmark, text, key, item_text, item_key).select(F.col("key").alias(key)).where(F.col(key).isNotNull()).distinct())
    clean, rest = split_by_keys(docs, leaks, key)
    return clean.unionByName(rest.join(leaks, key, "left_anti").select(docs.columns))
