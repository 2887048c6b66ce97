"""Hard negatives, Merkle manifests and chunked BPE against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agrolith.llm import chunked_bpe, hard_negatives, merkle, oracles

VECTORS = "vec_id long, embedding array<float>, label int, key long, v string, w int, score double"


# --- op11 ------------------------------------------------------------------------------------------------------------------------------


def vectors(seed: int = 1, n: int = 700) -> list[tuple]:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(10, 6))
    made = [(k, (centres[k % 10] + r.normal(size=6) * 0.8).astype("f4").tolist(), k % 10) for k in range(n)]
    made += [(n + k, made[5][1], k % 3) for k in range(60)]  # one vector many times: ties
    made += [(900, None, 1), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] * 6, 2), (904, [0.5] * 6, None), (1000, [1.0, 1.0], 3), (1001, [], 3)]
    return [(*m, 1, "v", 2, 0.5) for m in made]


def asked(df):
    key = F.col("vec_id")
    return hard_negatives.hard_negatives(df, F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), key % 100 == 0)


def by_sql(rows: list[tuple]) -> set[tuple]:
    db = duckdb.connect()
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    db.register("embeddings", table)
    return {tuple(r) for r in db.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({oracles.hard_negatives()})").fetchall()}


def test_negatives_equal_all_scores(spark):
    rows = vectors()
    got = [tuple(r) for r in asked(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == by_sql(rows) and len(got) > 100


def test_negatives_by_blocks(spark):
    rows = vectors(2, 400)
    df = spark.createDataFrame(rows, VECTORS)
    found = hard_negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % 20 == 0, rules=hard_negatives.Rules(block=8))
    whole = hard_negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % 20 == 0)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in whole.collect()}


def test_bounds_hold_for_every_row():
    """Exact scores lie within the product of norms of the looked-up ones, also far from the sample that centroids are fitted on."""
    r = np.random.default_rng(0)
    sample, rows, anchors = (np.floor(256 * r.normal(size=(n, 7)) * s) for n, s in ((300, 1), (500, 40), (20, 3)))
    book = hard_negatives.fit(sample, hard_negatives.Rules(centroids=16))
    codes, left = book.encode(rows)
    near = sum(t[codes[:, m]] for m, t in enumerate(book.tables(anchors))).astype(float)
    exact = hard_negatives.exact(rows, anchors)
    assert (np.abs(exact - near) <= left[:, None] * np.linalg.norm(anchors, axis=1) * (1 + 1e-6) + 1 + 2e-6 * np.abs(near).max()).all()
    large = np.full((1, 7), 2.0**29)
    assert hard_negatives.exact(large, large)[0, 0] == 7 * 2**58


def test_negatives_edges(spark):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    nothing = asked(spark.createDataFrame([], VECTORS))
    assert nothing.columns == columns and nothing.count() == 0
    alone = asked(spark.createDataFrame([(100, [1.0], 1, 1, "v", 2, 0.5)], VECTORS))
    assert alone.count() == 0
    repeated = asked(spark.createDataFrame([(k, [x], y, 1, "v", 2, 0.5) for k, x, y in ((100, 1.0, 1), (100, 1.0, 1), (1, 1.0, 1), (2, 0.5, 2), (2, 0.5, 2), (None, 0.5, 2))], VECTORS)).collect()
    assert [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in sorted(repeated, key=lambda r: r["rank"])] == [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 2, 65536, 32768), (100, 1, 3, None, 65536, 32768)]
    with pytest.raises(Exception, match="so large"):
        asked(spark.createDataFrame([(100, [1e30], 1, 1, "v", 2, 0.5)], VECTORS)).collect()


# --- op12 ------------------------------------------------------------------------------------------------------------------------------

ROWS = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf int, salt int, place int"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row: tuple, lower: bool = False) -> str:
    text = row[4].translate({c: c + 32 for c in range(65, 91)}) if lower and row[4] is not None else row[4]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    """Each row's results, with trees as nested lists."""

    def grow(nodes: list[str]) -> list[list[str]]:
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def beside(levels: list[list[str]], k: int) -> list[tuple[str, str]]:
        found = []
        for level in levels[:-1]:
            first = k // 8 * 8
            found.append(("".join(level[first:k]), "".join(level[k + 1 : first + 8])))
            k //= 8
        return found

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in langs}
    grown = {x: grow([leaf_of(r) for r in own]) for x, own in trees.items()}
    top, out = grow([grown[x][-1][0] for x in langs]), []
    for n, x in enumerate(langs):
        for k, r in enumerate(trees[x]):
            path = beside(grown[x], k) + beside(top, n)
            folded = leaf_of(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for before, after in path:
                folded = sha(before + folded + after)
            root = top[-1][0]
            out.append((r[0], leaf_of(r), grown[x][-1][0], root, sha("".join(b + a for b, a in path)), folded, folded == root))
    return out


def proved(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return merkle.merkle_manifest(df, FIELDS, "lang", "doc_id", {"text": lower}, tampered)


def keyed(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_manifest_equals_brute_force(spark, seed):
    r = random.Random(seed)
    langs = [("en", 1300), (None, 9), ("", 8), ("é", 1), ("z", 65), ("Z", 513)]
    rows = [(r.randrange(10**6), r.choice(["s", None]), x, r.choice([1, None]), r.choice(["Text", "text", "", None, "É" * 70_000]) and f"Text {r.random()}") for x, n in langs for _ in range(n)]
    rows += [rows[0], rows[0], rows[1], (None, None, None, None, None), (None, None, None, None, None), (None, "s", "en", 1, "A"), (rows[2][0], *rows[3][1:])]
    rows += [(10**7 + k, "s", "en", 1, t) for k, t in enumerate(("", "A" * 300_000, None, "ÀÉ"))]
    got = [tuple(x) for x in proved(spark.createDataFrame([(*x, "t", 1, 2, 3) for x in rows], ROWS).repartition(5)).collect()]
    assert keyed(got) == keyed(brute_manifest(rows))
    assert {x[6] for x in got} == {True, False}


def test_manifest_edges(spark):
    empty = proved(spark.createDataFrame([], ROWS))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0
    one = (3, None, None, None, "lower")
    assert [tuple(x) for x in proved(spark.createDataFrame([(*one, "t", 1, 2, 3)], ROWS)).collect()] == brute_manifest([one])
    assert brute_manifest([one])[0][4] == sha("")


def test_manifest_of_copies(spark):
    """A third of all rows alike are dealt among ranges, and stay leaves of their own."""
    rows = [(7, "s", "en", 1, "Same")] * 1500 + [(k, "s", "en", 1, f"T{k}") for k in range(3000)]
    got = [tuple(x) for x in proved(spark.createDataFrame([(*x, "t", 1, 2, 3) for x in rows], ROWS)).collect()]
    assert keyed(got) == keyed(brute_manifest(rows))


# --- op13 ------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, chunked_bpe.library(open(path, encoding="utf-8").read())


def odd_texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    alphabet = [*"aBcé 's\t\n\r  ,.!?'012<|>İΣς\u0085 Å≮", "<|endoftext|>", "'ll ", "don't ", "́", " ́", "\x1c", "\x0b", "한글", "कि", " ", "word " * 3]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(300))) for _ in range(n)]


@pytest.mark.parametrize("bits", [2, 4, 6])
def test_cores_and_joins_equal_the_library(bpe, bits):
    lib = bpe[1]
    table, texts = chunked_bpe.WordTable(lib, most=50), odd_texts(bits, 600)
    found = chunked_bpe.cores(pa.array(texts), bits)
    between = chunked_bpe.joins(found, table, lib, np.arange(len(texts)))
    for t, want in enumerate(chunked_bpe.whole(lib, texts)):
        first = int(np.searchsorted(found.owner, t))
        ids = list(between[t][0])
        for k, gap in enumerate(between[t][1:], first):
            ids += chunked_bpe.whole(lib, [found.text(int(found.starts[k]), int(found.stops[k]))])[0] + gap
        assert ids == want, texts[t]


def test_joins_that_disagree_are_widened_or_given_up(bpe):
    """With a table that is wrong for a word, joins beside it are widened beyond it, and without any agreement the text has no joins."""

    class Wrong(chunked_bpe.WordTable):
        def segment(self, chunks):
            return [[1] if "zz" in c else ids for c, ids in zip(chunks, super().segment(chunks), strict=True)]

    texts = [" ".join(["zz" if every or k % 9 == 0 else f"w{k}" for k in range(400)]) for every in (False, True)]
    found = chunked_bpe.cores(pa.array(texts), 3)
    between = chunked_bpe.joins(found, Wrong(bpe[1]), bpe[1], np.arange(2))
    assert between[0] is None or all(g is not None for g in between[0])
    assert between[1] is None


def test_chunks_are_cut_by_content():
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(6000))
    texts = [passage, "x" * 37 + passage, passage[11:] + " and more", "é" * 50 + passage]
    found = chunked_bpe.cores(pa.array(texts), 8)
    by_text = [{found.text(int(a), int(b)) for a, b, o in zip(found.starts, found.stops, found.owner, strict=True) if o == t} for t in range(4)]
    assert all(len(by_text[0] & own) >= 0.8 * len(by_text[0]) for own in by_text[1:])


@pytest.mark.parametrize("bits", [5, 11])
def test_bpe_round_trip(spark, bpe, bits):
    path, lib = bpe
    texts = [*odd_texts(9, 60), None, "", " \n\t ", "a" * 30_000, "no white space " * 6000, *["a passage that many share, in one form, again and again. " * 8] * 40]
    rows = [(k, t, "i", "d", "o", 1) for k, t in enumerate(texts)] + [(3, texts[3], "i", "d", "o", 1), (None, texts[-1], None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string, own string, at int").repartition(4)
    got = chunked_bpe.encode_decode(docs, path, carried=("ids", "at"), bits=bits, most_words=100)
    assert got.columns == ["doc_id", "ids", "decoded", "ids_carried", "at"]
    want = chunked_bpe.whole(lib, [r[1] or "" for r in rows])
    decoded = lib.decode_batch(want, skip_special_tokens=False)
    key = lambda x: str(x)
    assert sorted(([r.doc_id, r.ids, r.decoded, r.ids_carried] for r in got.collect()), key=key) == sorted(([r[0], i, d, r[2]] for r, i, d in zip(rows, want, decoded, strict=True)), key=key)
    assert chunked_bpe.encode_decode(docs.limit(0), path).count() == 0


def test_packed_ids():
    for ids in ([], [0, 65535], [1, 65536, 7]):
        assert chunked_bpe.unpacked(chunked_bpe.packed(np.array(ids, np.int32))).tolist() == ids
