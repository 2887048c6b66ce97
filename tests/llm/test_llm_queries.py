"""The registered queries on the test tables: DuckDB where there is SQL, brute force or held-out accuracy elsewhere; and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agrolith.llm import decontamination, language_id, queries
from agrolith.llm.common import held_fold, written

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def frame(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].astype(str).replace({"<NA>": "nan", "None": "nan"}).sort_values("doc_id", ignore_index=True) for x in (got.assign(up=got["up"].astype("Int64")) if "up" in got else got, want))
    assert a.equals(b)


def test_columns_and_rows(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    want = {
        "op1_": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_": "doc_id size text_crc32 law shard slot grown_shard", "op3_": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op4_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op5_": "doc_id held_out score predicted", "op7_": "doc_id n_shingles component_id kept",
        "op9_": "doc_id held_out lang_pred score", "op10_": "doc_id n_assign n_access n_hex base_sha256 spans",
    }
    for start, columns in want.items():
        name = next(q for q in queries.QUERIES if q.startswith(start))
        found = queries.QUERIES[name](spark, SMALL)
        assert set(columns.split()) <= set(found.columns), name
        assert found.count() == n, name


def test_held_out_quality(spark):
    found = queries.op5_line_crf_quality(spark, SF).toPandas().merge(frame(spark, "labels"), on="doc_id")
    assert (found.held_out == found.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 3 == 1)).all()
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_held_out_language(spark):
    found = queries.op9_string_kernel_language(spark, SF).toPandas().merge(frame(spark, "documents"), on="doc_id")
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98


def test_long_texts_keep_their_language(spark):
    """Held-out texts joined to 1 MB, and German with half as many random ids, keep their language clearly."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = held_fold(F.col("doc_id"), 4)
    model = language_id.train(docs, fold != 2)
    held = docs.where(fold == 2).toPandas()
    r, rows = random.Random(1), []
    for lang, own in held.groupby("lang"):
        joined = " ".join(own.text)
        rows += [(len(rows), (joined * (1 + (1 << 20) // len(joined)))[at : at + size], lang) for size in (2_000, 200_000, 1 << 20) for at in (0, 777)]
        words = joined.split()[:30_000]
        rows.append((len(rows), " ".join(w + (f" {r.getrandbits(64):x}" if k % 4 == 0 else "") for k, w in enumerate(words)), lang))
    found = {x.doc_id: x for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert all(found[k].lang_pred == lang for k, _, lang in rows)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame([(10**9 + k, t, lang, "s", len(t)) for k, t, lang in rows], docs.schema)), SF)
    assert kept.where(F.col("doc_id") >= 10**9).count() == len(rows)


def test_leaks_equal_shared_shingles(spark):
    docs, bench = frame(spark, "documents"), frame(spark, "benchmark")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    fives = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    items = {i: fives(words(t)) for i, t in zip(bench.item_id, bench.text, strict=True)}
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text, strict=True) for own in [fives(words(t))] for i, f in items.items() if f and len(f & own) >= 0.8 * len(f)}
    got = queries.op6_latent_decontamination(spark, SF).toPandas()
    assert set(zip(got.doc_id, got.item_id, strict=True)) == want


def test_leaks_equal_brute_force(spark):
    """All pairs of a document and an item, every stretch of it: all leaks within the item's length are found, and nothing that is none."""
    docs, bench = frame(spark, "documents", SMALL), frame(spark, "benchmark", SMALL)
    ids, first = decontamination.word_ids(pa.array([*docs.text, *bench.text]))
    words = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    texts, items = words[: len(docs)], words[len(docs) :]
    df = Counter(w for t in items for w in set(t))
    most = 1 + decontamination.ANSWER_SHARE * (len(items) - 1)
    must, may = set(), set()
    for item_id, item in zip(bench.item_id, items, strict=True):
        answer = [w for w in item if df[w] <= most][-decontamination.ANSWER :] or item[-decontamination.ANSWER :]
        bag, n = Counter(item), len(item)
        for doc_id, text in zip(docs.doc_id, texts, strict=True):
            if sum((bag & Counter(text)).values()) < 0.5 * n:
                continue
            for length, found in ((n, must), (decontamination.stretch_of(n), may)):
                for k in range(max(1, len(text) - length + 1)):
                    own = text[k : k + length]
                    share = decontamination.common_length(item, own) / n
                    if share >= decontamination.COPY or (share >= decontamination.PARAPHRASE and decontamination.common_length(answer, own) == len(answer)):
                        found.add((doc_id, item_id))
                        break
    got = {(r.doc_id, r.item_id) for r in queries.op6_latent_decontamination(spark, SMALL).collect()}
    assert must and must <= got <= may, (len(must), len(got), len(may))


def test_components_equal_brute_force(spark):
    docs = frame(spark, "documents", SMALL)
    sets = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    near = defaultdict(set)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    root: dict = {}
    for i in ids:
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = i
                stack += near[x]
    got = queries.op7_signature_join_minhash(spark, SMALL).toPandas()
    assert {i: (n, c) for i, n, c in zip(got.doc_id, got.n_shingles, got.component_id, strict=True)} == {i: (len(sets[i]), root[i]) for i in ids}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["language_id"]) == set(texts)  # all have letters and one of the languages
    components = queries.op7_signature_join_minhash(spark, SMALL).where("kept").select("doc_id").collect()
    assert set(kept["near_duplicates"]) == {r.doc_id for r in components}
    leaks = {r.doc_id for r in queries.op6_latent_decontamination(spark, SMALL).collect()}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - leaks
    assert set(kept["secrets"]) == set(kept["decontamination"])
    for i, r in kept["secrets"].items():
        assert r.text == texts[i] or "removed]" in r.text
        assert not re.search(r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}", r.text) and r.n_chars == len(r.text)
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id: tuple(r.ids) for r in final} == {i: tuple(model.encode(r.text)) for i, r in kept["secrets"].items()}
    assert all(r.decoded_sha256 == hashlib.sha256(model.decode(list(r.ids)).encode()).hexdigest() for r in final)


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, rows without an id and columns of other names; and an empty table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 80")
    first = docs.orderBy("doc_id").first()
    odd = [(None, first.text + " and some more words here", "en", "s", 9), (900, None, "en", None, None), (901, "", None, "s", 0), (902, "12 34 !", "fr", "s", 7), (903, first.text.replace(" ", "\t"), None, None, None), (first.doc_id, first.text, first.lang, first.source, first.n_chars)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("_place", F.lit("x")).withColumn("ids", F.lit(None).cast("int")).withColumn("kind", F.lit(1))
    for at, rows in (("full", both), ("none", both.limit(0))):
        rows.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/{at}/benchmark.parquet")
    stage = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = written(f(spark, stage, f"{tmp_path}/full"))
        assert stage.columns == both.columns, name
    ids = [r.doc_id for r in stage.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and not {900, 901, 902, 903} & set(ids)
    assert len(ids) > 40
    final = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in final.collect())
    nothing = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert nothing.columns == final.columns and nothing.count() == 0
