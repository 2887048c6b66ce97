"""Merkle manifest of a table: a hash tree for each group of rows, and one over the groups' roots.

A leaf is the digest of a row's fields. Leaves of a tree stand in the order of their key and are numbered without gaps; 512 neighbours (eight to
the power of three) make an aligned bucket, whose levels a DuckDB connection in an executor computes from an Arrow table with ordered string_agg
and sha256. Spark combines the buckets' roots, a small table, and joins each bucket's outer proof back to it, so that the bucket's second
visit gives every leaf its whole proof and folds what is claimed of the row up to a root. Only digests are shuffled, never texts.

Defined results: a null field is `-`, so it differs from an empty one; null keys come first in their tree, and the null tree comes first;
rows with equal keys stand in the order of their leaves, and copies of one row are leaves of their own; a tree of one row is its leaf, which has
no siblings in it; an empty table has no rows. Texts of any length are hashed whole, by Spark. Columns beside the named ones don't matter.
"""

from __future__ import annotations

from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.common import ship, written

#: Nodes of a run, and levels inside a bucket.
FAN, LEVELS = 8, 3
BUCKET = FAN**LEVELS
DIGEST = 64


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def numbered_leaves(rows: DataFrame) -> DataFrame:
    """rows: (tree, key, leaf, claim), to which are added tno, the tree's number in the order of trees, total, its leaves, and place, a leaf's number.

    Rows are sorted by ranges; a range is numbered where it lies and moved by what earlier ranges hold of its tree, which a table of
    (ranges + trees) rows tells. Copies of a row are dealt out at random among ranges: they are interchangeable.
    """
    order = ["tree", "key", "leaf", "salt"]
    ranged = rows.withColumn("salt", F.rand(7)).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = written(ranged.select("tree", "key", "leaf", "claim", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    by_tree, ranges = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part")
    held = ranged.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    held = held.select("part", "tree", "first", F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(by_tree).alias("total"))
    held = written(held.withColumn("begins", F.min("part").over(by_tree)))
    # A tree's number: those that begin in earlier ranges, and those before it in the range where it begins.
    new = held.where(F.col("part") == F.col("begins"))
    earlier = new.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    trees = new.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("tree"))).join(earlier, "part").select(F.col("tree").alias("t"), (F.col("before") + F.col("rank") - 1).alias("tno"))
    known = held.join(trees, F.col("tree").eqNullSafe(F.col("t"))).select(F.col("part").alias("p"), F.col("tree").alias("t"), "tno", "total", "first", "start")
    placed = ranged.join(known, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")))
    return placed.select("tno", "total", (F.col("at") - F.col("first") + F.col("start")).alias("place"), "key", "leaf", "claim")


@lru_cache(maxsize=1)
def engine() -> duckdb.DuckDBPyConnection:
    """One connection in a Python worker, with one thread and no files."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})


def level_queries(levels: int) -> str:
    """Common table expressions l0 (nodes i, h), r0 (runs i with the text t of their digests), l1, and so on."""
    steps = ["l0 AS (SELECT i, leaf AS h FROM leaves)"]
    for k in range(levels):
        steps.append(f"r{k} AS (SELECT i // {FAN} AS i, string_agg(h, '' ORDER BY i) AS t FROM l{k} GROUP BY ALL)")
        steps.append(f"l{k + 1} AS (SELECT i, sha256(t) AS h FROM r{k})")
    return "WITH " + ", ".join(steps)


def _answer(sql: str, parameters: list[object], **tables: pa.Table) -> pa.Table:
    con = engine()
    for name, table in tables.items():
        con.register(name, table)
    found = con.sql(sql, params=parameters or None).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return found


def _leaves(bucket: pa.Table) -> tuple[pa.Table, int, int]:
    """(i, key, leaf, claim) with places inside the bucket, the levels to compute, and the bucket's number."""
    number = bucket["bucket"][0].as_py()
    total = bucket["total"][0].as_py()
    sql = f"SELECT place - {number * BUCKET} AS i, key, leaf, coalesce(claim, leaf) AS claim FROM bucket"
    return _answer(sql, [], bucket=bucket), sum(total > FAN**k for k in range(LEVELS)), number


def bucket_root(bucket: pa.Table) -> pa.Table:
    """(tno, bucket, total, h) of one bucket of leaves."""
    leaves, levels, number = _leaves(bucket)
    (root,) = _answer(f"{level_queries(levels)} SELECT h FROM l{levels}", [], leaves=leaves)["h"].to_pylist()
    return pa.table({"tno": bucket["tno"].slice(0, 1), "bucket": pa.array([number], pa.int64()), "total": bucket["total"].slice(0, 1), "h": [root]})


def side(text: str, place: str) -> tuple[str, str]:
    """What stands before and after a place in a run's text."""
    return f"substr({text}, 1, {DIGEST} * ({place}))", f"substr({text}, {DIGEST} * ({place} + 1) + 1)"


def bucket_proofs(bucket: pa.Table, outer: pa.Table) -> pa.Table:
    """(key, leaf, subroot, root, proof_sha256, folded_root) of one bucket of leaves and its one row (steps, subroot, root)."""
    leaves, levels, _ = _leaves(bucket)
    steps, subroot, root = (outer[c][0].as_py() for c in ("steps", "subroot", "root"))
    proof, fold, joins, sides = "''", ["claim AS f0"], "", []
    for k in range(levels):
        before, after = side(f"r{k}.t", f"x.i // {FAN**k} % {FAN}")
        joins += f" JOIN r{k} ON r{k}.i = x.i // {FAN ** (k + 1)}"
        sides += [f"{before} AS b{k}", f"{after} AS a{k}"]
        proof += f" || b{k} || a{k}"
        fold.append(f"sha256(b{k} || f{k} || a{k}) AS f{k + 1}")
    fold += [f"sha256(? || f{levels + k} || ?) AS f{levels + k + 1}" for k in range(len(steps))]
    sql = f"{level_queries(levels)}, s AS (SELECT x.key, x.leaf, x.claim, {', '.join([*sides, '0 AS none'])} FROM leaves x{joins})"
    sql += f" SELECT key, leaf, ? AS subroot, ? AS root, sha256({proof} || ?) AS proof_sha256, {', '.join(fold)} FROM s"
    ends = [(s["before"], s["after"]) for s in steps]
    found = _answer(sql, [subroot, root, "".join(b + a for b, a in ends), *(x for pair in ends for x in pair)], leaves=leaves)
    return found.select(["key", "leaf", "subroot", "root", "proof_sha256", f"f{levels + len(steps)}"]).rename_columns(["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


_STEPS = "array<struct<before:string,after:string>>"


def climb(nodes: DataFrame) -> DataFrame:
    """(tree, place, steps, top): for nodes (tree, place, n, h), n to a tree, what stands beside each one's ancestors, level by level, and the tree's root.

    As many rounds as the largest tree has levels; a round's runs are an eighth of the nodes before.
    """
    paths = nodes.select("tree", "place", F.array().cast(_STEPS).alias("steps"))
    level, most, k = nodes, nodes.agg(F.max("n")).first()[0] or 1, 0
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]), "")
    while most > 1:
        by = ["tree", F.floor(F.col("place") / FAN).alias("run")]
        runs = written(level.where("n > 1").groupBy(*by).agg(F.max("n").alias("n"), texts.alias("t")))
        before, after = (F.expr(x) for x in side("t", f"floor(place / {FAN**k}) % {FAN}"))
        beside = F.when(F.col("t").isNotNull(), F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(F.array().cast(_STEPS))
        run = F.floor(F.col("place") / FAN ** (k + 1))
        paths = paths.withColumn("run", run).join(runs.select("tree", "run", "t"), ["tree", "run"], "left").select("tree", "place", F.concat("steps", beside).alias("steps"))
        up = runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.col("t").cast("binary"), 256).alias("h"))
        level = level.where("n = 1").unionByName(up)
        most, k = -(-most // FAN), k + 1
    return paths.join(level.select("tree", F.col("h").alias("top")), "tree")


def manifest(rows: DataFrame) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root) of rows (tree, key, leaf, claim); claim: another leaf to fold instead, or null."""
    leaves = written(numbered_leaves(rows).withColumn("bucket", F.floor(F.col("place") / BUCKET)))
    ship(leaves.sparkSession)
    by = leaves.groupBy("tno", "bucket")
    roots = written(by.applyInArrow(bucket_root, "tno long, bucket long, total long, h string"))
    inside = climb(roots.select(F.col("tno").alias("tree"), F.col("bucket").alias("place"), F.ceil(F.col("total") / BUCKET).alias("n"), "h"))
    inside = written(inside.select(F.col("tree").alias("tno"), F.col("place").alias("bucket"), "steps", F.col("top").alias("subroot")))
    trees = inside.groupBy("tno").agg(F.first("subroot").alias("h"))
    n = trees.count()
    whole = climb(trees.select(F.lit(0).alias("tree"), F.col("tno").alias("place"), F.lit(n).alias("n"), "h")).select(F.col("place").alias("tno"), F.col("steps").alias("above"), F.col("top").alias("root"))
    outer = inside.join(whole, "tno").select("tno", "bucket", F.concat("steps", "above").alias("steps"), "subroot", "root")
    kind = rows.schema["key"].dataType.simpleString()
    return by.cogroup(outer.groupBy("tno", "bucket")).applyInArrow(bucket_proofs, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...], tree: str, key: str, claims: dict[str, Column], claimed: Column) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    fields: columns of a leaf, in this order. Where `claimed` holds, the folded leaf has the values `claims` instead of the columns of
    that name; verified tells whether the fold from it along the original siblings still gives the root.
    """
    own, other = digest(*(F.col(c) for c in fields)), digest(*(claims.get(c, F.col(c)) for c in fields))
    rows = docs.select(F.col(tree).cast("string").alias("tree"), F.col(key).alias("key"), own.alias("leaf"), F.when(claimed, other).alias("claim"))
    found = manifest(rows)
    return found.withColumnRenamed("key", key).withColumn("verified", F.col("folded_root") == F.col("root"))
