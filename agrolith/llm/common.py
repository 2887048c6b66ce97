"""Helpers that the operators share: Arrow jobs and buffers, bitmaps of keys, ASCII words and stable hashes; scratch tables come along."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.operators.scratch import forget, ship, written  # noqa: F401  the operators take them from here

#: Regex class of the ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]"


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and the driver between jobs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return


#: Rows of a batch that goes to a Python worker; Spark's default of 10,000 texts takes too much memory in JVM and worker.
BATCH_ROWS = 2_000


def arrow_map(df: DataFrame, run: Callable, schema: object) -> DataFrame:
    """df.mapInArrow(run, schema) on executors that have this package; workers give memory back after each task.

    Where the session has the default size of batches, it gets a smaller one.
    """
    ship(df.sparkSession)
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


#: Bits of a bitmap of keys: 4 MB.
BITS = 1 << 25


def bit_of(node: Column, bits: int = BITS) -> Column:
    """A place among `bits` for a key."""
    return F.pmod(F.xxhash64(node), F.lit(bits))


def bitmap(nodes: DataFrame, column: str, bits: int = BITS) -> np.ndarray | None:
    """A bit for each key (a Bloom filter with one hash): at most bits / 8 bytes reach the driver. None if over half are set."""
    return bitmap_at(nodes, bit_of(F.col(column), bits), bits)


def bitmap_at(nodes: DataFrame, at: Column, bits: int = BITS) -> np.ndarray | None:
    """bitmap for places among `bits` instead of keys."""
    rows = nodes.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    found = np.zeros((bits // 32768 + 1, 4096), np.uint8)
    for r in rows:
        found[r["b"]] = np.frombuffer(r["m"], np.uint8)
    if np.unpackbits(found).sum() * 2 > bits:
        return None
    return found.reshape(-1)


def in_bitmap(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places (bit_of) are set; Spark's buckets begin with place 1, and place 0 has a bucket of its own."""
    at = np.where(at > 0, at + 32767, 0)
    return (found[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def split_by_keys(docs: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely none of `keys`, all others), without a shuffle; the second part holds a few other rows too.

    keys: one column `key`. If the bitmap is too full to tell, the first part is empty.
    """
    found, names = bitmap(keys, key), docs.columns
    if found is None:
        return docs.limit(0), docs

    def part(sure: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_bitmap(found, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(hit != sure))

        return arrow_map(docs.select("*", bit_of(F.col(key)).alias(unused("_place", names))), run, docs.schema)

    return part(True), part(False)


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores in front until no column has it (Spark's names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a block has about `most` bytes of text; one longer text makes a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row begins (one more than rows); null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII white space, and A-Z in lower case.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

with np.errstate(over="ignore"):
    _BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _PLACE_KEYS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _place_keys(place: np.ndarray) -> np.ndarray:
    keys = _PLACE_KEYS[place & 4095]
    if len(place) and place.max() > 4095:  # very long runs
        far = place > 4095
        keys[far] *= mix((place[far] >> 12).astype(np.uint64)) | np.uint64(1)
    return keys


#: Bytes of runs that are hashed at once.
HASHED = 1 << 18


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end]: a sum of keyed bytes and places, then mixed with the run's length. Runs don't overlap."""
    found, total = np.zeros(len(starts), np.uint64), np.cumsum(ends - starts)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + HASHED, side="right")))
        found[low:high] = _hashes(data, starts[low:high], ends[low:high])
        low = high
    return found


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    at = place + np.repeat(starts, lengths)
    keyed = _BYTE_KEYS[data[at]] * _place_keys(place)
    sums = np.zeros(len(starts), np.uint64)
    some = lengths > 0
    if some.any():
        sums[some] = np.add.reduceat(keyed, first[some])
    return mix(sums + lengths.astype(np.uint64))


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked bytes: where they start and end, and the text each is in. A text's end ends a run."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[1:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, as runs_of gives them."""
    return runs_of(~IS_SPACE[data], offsets)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a sort is faster here than np.unique's hash table."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` words in a row within one text, and the number of the first word of each."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = (total ^ hashes[k : k + n]) * _PLACE_KEYS[k + 1]
        total ^= total >> np.uint64(29)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(total[at]), at
