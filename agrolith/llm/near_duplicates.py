"""Near-duplicate documents: MinHash signatures, an inverted join of signature coordinates, and exact confirmation.

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes). Equal sets are one class and go on as one node.
2. A node is posted under each of its `COORDINATES` (coordinate, minimum) pairs. Two sets with a similarity of 0.75 agree in
   48 of 64 coordinates on average; fewer than `MATCHES` = 31 have a chance below one in a million.
3. Prefix: with tokens in a global order from rare to frequent, nodes that agree in at least `MATCHES` tokens share one among the first
   COORDINATES - MATCHES + 1 of each. Only these are joined, so long lists are skipped except where nearly all of a node's tokens are
   frequent. Tokens that occur once never leave the count.
4. Within a list no pairs are emitted. In a round each list has a leader (the same for all lists that hold it), with which the
   members of other components are compared: agreeing coordinates are counted first, then the full sets are compared.
   Confirmed links join components. Rounds go on while they shorten what is open.
5. What is left, pairs of one list in different components, is compared directly, after nodes are left out whose shingles show that
   they can have no link. So every pair that shares a prefix token is compared or is
   in one component already: no link is lost, and a group's cost is about its size, not its square.

Defined results: a text without words (null, empty, white space) has no shingles and is alone; a text of one to four words has its
whole sequence as one shingle; texts are read whole; rows with one key are one document;
rows without a key are kept unless keyed ones have the same shingles, and have that component; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.llm.common import BITS, LOWER, arrow_map, bit_of, bitmap, blocks, buffers, distinct, forget, in_bitmap, mix, run_hashes, split_by_keys, unused, windows, word_runs, written
from agrolith.operators.graph import star_components

WORDS, COORDINATES, MATCHES = 5, 64, 31
#: Similarity as a ratio of integers: LEAST of 100.
LEAST = 75
MOST_ROUNDS = 8
#: A list is long from this many rows on, or from a share of all rows on, so that at most MOST_LONG lists are: these few are broadcast.
LEAST_LONG, MOST_LONG = 64, 1 << 15
#: Nodes of a part of a pivot's group in the comparison of what the rounds left open.
PART_NODES = 512
_XOR = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = mix(_XOR) | np.uint64(1)


def shingles(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    data, offsets = buffers(column)
    low = LOWER[data]
    starts, ends, text = word_runs(low, offsets)
    words = run_hashes(low, starts, ends)
    full, at = windows(words, text, WORDS)
    bounds = np.searchsorted(text[at], np.arange(len(offsets)))
    first = np.searchsorted(text, np.arange(len(offsets)))
    found = []
    for i in range(len(offsets) - 1):
        n = first[i + 1] - first[i]
        if n >= WORDS:
            found.append(distinct(full[bounds[i] : bounds[i + 1]]))
        elif n:
            found.append(windows(words[first[i] : first[i + 1]], text[first[i] : first[i + 1]], int(n))[0] ^ np.uint64(n))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def signature(own: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's permutation, mixed with the coordinate's number into a token."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        least = np.minimum(least, ((own[None, at : at + 1024] ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1))
    return mix(least ^ _XOR)


def _signed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, n_shingles, d1, d2, tokens): the set's size, a 128-bit digest of it and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            sets = shingles(block.column(1))
            n = [len(s) for s in sets]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            some = [s for s in sets if len(s)]
            flat = np.concatenate([signature(s) for s in some]) if some else np.zeros(0, np.uint64)
            offsets = np.cumsum([0, *(COORDINATES if x else 0 for x in n)])
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), tokens], ["key", "n", "d1", "d2", "tokens"])

    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]
    )
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text)), run, schema)


def _sets(docs: DataFrame, nodes: DataFrame, text: str, key: str) -> DataFrame:
    """(node, set) for the nodes asked for; texts of others are passed over by a bitmap of bounded size, before any shuffle."""
    wanted = bitmap(nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(in_bitmap(wanted, batch.column(2).to_numpy(zero_copy_only=False))))
            for block in blocks(iter([batch]), text):
                sets = shingles(block.column(1))
                offsets = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["node", "set"])

    schema = T.StructType([T.StructField("node", docs.schema[key].dataType), T.StructField("set", T.ArrayType(T.LongType()))])
    rows = docs.select(F.col(key).alias("node"), F.col(text))
    if wanted is None:
        return arrow_map(rows.withColumn("at", F.lit(0).cast("long")).join(nodes, "node", "left_semi"), run, schema)
    return arrow_map(rows.withColumn("at", bit_of(F.col("node"), BITS)), run, schema).join(nodes, "node", "left_semi")


def _with_lists(rows: DataFrame, lists: DataFrame, n_rows: int, by: str = "token") -> DataFrame:
    """rows joined with their list's one row; lists: (by, long, ...) with `long` the list's rows, `n_rows` the rows of all.

    Rows of long lists stay where they are and meet a broadcast table of at most MOST_LONG rows, so no task gets a list whole.
    """
    limit = max(LEAST_LONG, n_rows // MOST_LONG)
    long = F.broadcast(lists.where(F.col("long") > limit))
    short = rows.join(F.broadcast(lists.where(F.col("long") > limit).select(by)), by, "left_anti").join(lists.where(F.col("long") <= limit).hint("merge"), by)
    return rows.join(long, by).unionByName(short)


def _agreement(a: str, b: str) -> Column:
    """In how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, same: n + same)


def _size_fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * LEAST


def _overlaps(pairs: DataFrame) -> DataFrame:
    """(x, y) of the pairs (x, y, sx, sy) whose sets are similar enough."""
    both = F.size(F.array_intersect("sx", "sy"))
    return pairs.withColumn("_both", both).where(F.col("_both") * 100 >= (F.size("sx") + F.size("sy") - F.col("_both")) * LEAST).select("x", "y")


class _Links:
    """Confirms pairs of nodes; the sets of nodes that were asked for once are kept in tables."""

    def __init__(self, docs: DataFrame, members: DataFrame, text: str, key: str) -> None:
        self.docs, self.members, self.text, self.key = docs, members, text, key
        self.sets: DataFrame | None = None

    def ask(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of distinct nodes."""
        fresh = written(nodes if self.sets is None else nodes.join(self.sets.select("node"), "node", "left_anti"))
        if not fresh.isEmpty():
            more = written(_sets(self.docs, fresh, self.text, self.key))
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        forget(fresh)
        return self.sets if self.sets is not None else self.members.limit(0).select("node", F.col("tokens").alias("set"))

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (x, y), those that agree in enough coordinates and whose sets are similar enough; written."""
        own = self.members.select("node", "tokens")
        close = written(
            pairs.join(own.select(F.col("node").alias("x"), F.col("tokens").alias("tx")), "x")
            .join(own.select(F.col("node").alias("y"), F.col("tokens").alias("ty")), "y")
            .where(_agreement("tx", "ty") >= MATCHES)
            .select("x", "y")
        )
        sets = self.ask(close.select(F.explode(F.array("x", "y")).alias("node")).distinct())
        both = close.join(sets.select(F.col("node").alias("x"), F.col("set").alias("sx")), "x").join(sets.select(F.col("node").alias("y"), F.col("set").alias("sy")), "y")
        found = written(_overlaps(both))
        forget(close)
        return found


def _postings(nodes: DataFrame) -> DataFrame:
    """(token, node, n, weight): each node under the tokens of its prefix, lists of one left out; written. weight sums the logs of all its lists' lengths."""
    posted = nodes.select("node", "n", F.explode("tokens").alias("token"))
    often = written(posted.groupBy("token").agg(F.count(F.lit(1)).alias("long")).where(F.col("long") > 1))
    n_rows = often.agg(F.sum("long")).first()[0] or 0
    by_node = Window.partitionBy("node", "n")  # at most COORDINATES rows, but for keys that stand for several sets
    ranked = _with_lists(posted, often, n_rows).withColumn("place", F.row_number().over(by_node.orderBy("long", "token")))
    ranked = ranked.withColumn("shared", F.count(F.lit(1)).over(by_node)).withColumn("weight", F.sum(F.log("long")).over(by_node))
    prefix = written(ranked.where(F.col("place") + (COORDINATES - F.col("shared")) <= COORDINATES - MATCHES + 1).select("token", "node", "n", "weight"))
    lists = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("long")).where(F.col("long") > 1)
    kept = written(_with_lists(prefix, lists, n_rows).drop("long"))
    forget(often)
    forget(prefix)
    return kept


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row: the least key that confirmed links reach, and whether it is the row's own."""
    signed = written(_signed(docs, text, key))
    nodes = written(signed.where(F.col("n") > 0).groupBy("d1", "d2").agg(F.min("key").alias("node"), F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    labels = _linked(docs, nodes, _postings(nodes), text, key)
    named = signed.select("key", F.col("n").alias("n_shingles"), "d1", "d2").join(
        nodes.select("d1", "d2", "node").join(labels, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id")), ["d1", "d2"], "left"
    )
    least = F.least("key", "component_id")
    return named.select(F.col("key").alias(key), "n_shingles", least.alias("component_id"), F.coalesce(F.col("key") == least, least.isNull()).alias("kept"))


def keep_representatives(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, columns as they were, that stay: one for each component, and all rows without a key.

    Of rows with one key, that with the least text stays. Texts of other rows than the dropped and the repeated ones aren't shuffled.
    """
    found = written(near_duplicates(docs, text, key).where(F.col(key).isNotNull()).groupBy(key).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows")))
    marked = found.where(~F.col("kept") | (F.col("rows") > 1))
    clean, rest = split_by_keys(docs, marked.select(key), key)
    rest = rest.join(found.where(~F.col("kept")).select(key), key, "left_anti").select(docs.columns)
    named = rest.where(F.col(key).isNotNull())
    place = unused("_place", docs.columns)
    first = named.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(text))).where(F.col(place) == 1).select(docs.columns)
    return clean.unionByName(first).unionByName(rest.where(F.col(key).isNull()))


def _linked(docs: DataFrame, nodes: DataFrame, postings: DataFrame, text: str, key: str) -> DataFrame:
    """(node, component) of the nodes with confirmed links."""
    members = written(nodes.select("node", "tokens").join(postings.select("node").distinct().hint("merge"), "node", "left_semi"))
    links = _Links(docs, members, text, key)
    labels: DataFrame | None = None
    open_before = None
    for turn in range(MOST_ROUNDS):
        # The first leader is the node whose tokens are the most frequent: the middle of a group of copies. Later ones go by a hash.
        rank = F.struct((-F.round("weight", 6)).alias("w") if turn == 0 else F.xxhash64("node", F.lit(turn)).alias("w"), "node", "n", "component")
        rows = _labelled(postings, labels)
        lists = written(_open_lists(rows, rank))
        n_open = lists.agg(F.sum("long")).first()[0] or 0
        if not n_open or (open_before is not None and n_open > 0.7 * open_before):
            forget(lists)
            break
        open_before = n_open
        pairs = (
            _with_lists(rows, lists, n_open)
            .where((F.col("component") != F.col("leader.component")) & _size_fits(F.col("n"), F.col("leader.n")))
            .select(F.least("node", "leader.node").alias("x"), F.greatest("node", "leader.node").alias("y"))
            .distinct()
        )
        labels = _joined(labels, links.confirm(pairs))
        forget(lists)
    return _joined(labels, links.confirm(_rest(postings, labels, links)))


def _rest(postings: DataFrame, labels: DataFrame | None, links: _Links) -> DataFrame:
    """Distinct pairs (x, y) that may still be links: in one list, in different components, of fitting sizes.

    A node's shingles that no other node of the open lists has count against any link: a pair needs an overlap of
    LEAST / (100 + LEAST) of both sizes together. Each list has a pivot, the node in its middle, and a node's shared shingles are o in the
    pivot and r outside it; a pair's overlap is at most the lesser o plus the lesser r. That keeps a family of texts around one
    common passage, or copies too far apart, from being compared pair by pair. For each pivot only nodes outside the
    largest component are compared with the others.
    """
    rows = _labelled(postings, labels)
    lists = written(_open_lists(rows, F.struct((-F.round("weight", 6)).alias("w"), "node")))
    n_open = lists.agg(F.sum("long")).first()[0] or 0
    rows = written(_with_lists(rows, lists.select("token", "long"), n_open).drop("long"))
    forget(lists)
    if not n_open:
        return rows.select(F.col("node").alias("x"), F.col("node").alias("y"))
    asked = written(rows.select("node").distinct())
    each = links.ask(asked).join(asked, "node", "left_semi").select("node", F.explode("set").alias("h"))
    lone = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where(F.col("c") == 1)
    lone = lone.groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    rows = rows.join(lone, "node", "left").withColumn("s", F.col("n") - F.coalesce("lone", F.lit(0))).where(F.col("s") * 100 >= F.col("n") * LEAST)
    rows = written(rows.select("token", "node", "n", "s", "weight", "component"))
    # Lists with one pivot are one group from here on: a pair of any of them is in it, and comes once.
    pivots = _open_lists(rows, F.struct((-F.round("weight", 6)).alias("w"), "node")).select("token", "long", F.col("leader.node").alias("pivot"))
    groups = written(_with_lists(rows, pivots, n_open).select("pivot", "node", "n", "s", "component").distinct())
    # A large group is dealt out by parts of its nodes.
    sizes = written(groups.groupBy("pivot").agg(F.count(F.lit(1)).alias("long")).withColumn("parts", F.ceil(F.col("long") / PART_NODES).cast("int")))
    groups = _with_lists(groups, sizes, n_open, "pivot").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("long")
    sets = links.ask(asked)
    middles = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets.select(F.col("node").alias("pivot"), F.col("set").alias("p")), "pivot")
    near = groups.join(sets.select("node", "set"), "node").join(middles, ["pivot", "part"])
    near = near.withColumn("o", F.size(F.array_intersect("set", "p"))).select("pivot", "node", "n", "o", (F.col("s") - F.col("o")).alias("r"), "component", "part", "parts")
    groups = written(near.join(links.members, "node"))
    largest = groups.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("pivot").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.sum("c").alias("long"))
    # Only nodes outside a group's largest component meet all of its parts; the signatures are compared where they meet.
    few = _with_lists(groups, largest, n_open, "pivot").where(F.col("component") != F.col("largest"))
    few = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left, right = (g.select("pivot", "part", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "o", "r", "component", "tokens"))) for g, side in ((few, "x"), (groups, "y")))
    enough = (F.least("o_x", "o_y") + F.least("r_x", "r_y")) * (100 + LEAST) >= (F.col("n_x") + F.col("n_y")) * LEAST
    pairs = left.join(right, ["pivot", "part"]).where((F.col("component_x") != F.col("component_y")) & _size_fits(F.col("n_x"), F.col("n_y")) & enough & (_agreement("tokens_x", "tokens_y") >= MATCHES))
    return pairs.select(F.least("node_x", "node_y").alias("x"), F.greatest("node_x", "node_y").alias("y")).distinct()


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("component", F.col("node"))
    return postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open_lists(rows: DataFrame, rank: Column) -> DataFrame:
    """(token, long, leader) of the lists whose members are in several components: their length and the least of rank."""
    ends = rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("long"), F.min(rank).alias("leader"))
    return ends.where(F.col("a") != F.col("b")).select("token", "long", "leader")


def _joined(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components after new links."""
    edges = found.select(F.col("x").alias("a"), F.col("y").alias("b"))
    if labels is not None:
        edges = edges.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return star_components(edges)
