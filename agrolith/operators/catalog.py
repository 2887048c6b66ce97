"""Scene catalogues: search, best scene, local against remote, sidecars, newest file, priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.geometry import box_touches


def search(scenes: DataFrame, now: Column, max_age_days: int, max_cloud: float, collections: list[str] | None = None, area: list[tuple[float, float]] | None = None) -> DataFrame:
    """Scenes young and clear enough, of these collections and touching this area, if given; all but the area's exact test reach the scan.

    scenes: (scene_id, acquired, cloud, ...), with collection and the box (west, south, east, north) where these are asked for. area: a
    closed ring of (x, y). A box touches it if a corner of either lies in the other, or edges cross.
    """
    found = scenes.where((F.col("acquired") >= now - F.make_dt_interval(F.lit(max_age_days))) & (F.col("acquired") <= now) & (F.col("cloud") <= max_cloud))
    if collections is not None:
        found = found.where(F.col("collection").isin(collections))
    if area is not None:
        xs, ys = [p[0] for p in area], [p[1] for p in area]
        near = (F.col("west") <= max(xs)) & (F.col("east") >= min(xs)) & (F.col("south") <= max(ys)) & (F.col("north") >= min(ys))
        found = found.where(near).where(box_touches(area, *(F.col(c) for c in ("west", "south", "east", "north"))))
    return found


def best(scenes: DataFrame, n: int = 1) -> DataFrame:
    """Least cloud first, then the youngest, then the least id."""
    return scenes.orderBy("cloud", F.desc("acquired"), "scene_id").limit(n)


def choose_source(local: DataFrame, remote: DataFrame, force: bool = False, cloud_gain: float = 5.0, newer_days: int = 3) -> DataFrame:
    """One row: (choice, reason, local_id, remote_id). Each side has at most one scene.

    A remote scene is taken if forced, if there is no local one, if it is clearer by more than `cloud_gain`, or if it is newer by more
    than `newer_days` and no cloudier.
    """
    one = local.sparkSession.range(1).select(F.lit(1).alias("_k"))
    sides = [df.select(F.lit(1).alias("_k"), *(F.col(c).alias(f"{side}_{c}") for c in ("scene_id", "acquired", "cloud"))) for side, df in (("local", local), ("remote", remote))]
    joined = reduce(lambda a, b: a.join(F.broadcast(b), "_k", "left"), sides, one)  # one row each
    has_local, has_remote = F.col("local_scene_id").isNotNull(), F.col("remote_scene_id").isNotNull()
    same = F.col("local_scene_id") == F.col("remote_scene_id")
    reason = (
        F.when(~has_local & ~has_remote, "none")
        .when(~has_remote, "local only")
        .when(F.lit(force), "forced")
        .when(~has_local, "no local scene")
        .when(same, "same scene")
        .when(F.col("remote_cloud") < F.col("local_cloud") - cloud_gain, "clearer")
        .when((F.col("remote_acquired") > F.col("local_acquired") + F.make_dt_interval(F.lit(newer_days))) & (F.col("remote_cloud") <= F.col("local_cloud")), "newer")
        .otherwise("local is good")
    )
    choice = F.when(reason == "none", "none").when(reason.isin("forced", "no local scene", "clearer", "newer"), "remote").otherwise("local")
    return joined.select(choice.alias("choice"), reason.alias("reason"), F.col("local_scene_id").alias("local_id"), F.col("remote_scene_id").alias("remote_id"))


#: Names of a file's description, the first that exists counts.
SIDECARS = ["{stem}.json", "{head}_meta.json", "{stem}_meta.json"]


def with_sidecar(files: DataFrame, sidecars: DataFrame, patterns: list[str], default_cloud: float = 100.0) -> DataFrame:
    """Files with the first sidecar that exists among names made from the stem; without one, cloud is `default_cloud` and the date the file's.

    files: (path, stem, modified); sidecars: (name, cloud, acquired); a pattern has {stem}, or {head} for the stem up to its last
    underscore.
    """
    head = F.when(F.contains("stem", F.lit("_")), F.regexp_replace("stem", "_[^_]*$", "")).otherwise(F.col("stem"))

    def name(pattern: str) -> Column:
        return F.replace(F.replace(F.lit(pattern), F.lit("{stem}"), F.col("stem")), F.lit("{head}"), head)

    names = F.array(*(F.struct(F.lit(k).alias("priority"), name(p).alias("name")) for k, p in enumerate(patterns)))
    asked = files.select("path", F.explode(names).alias("n")).select("path", "n.priority", "n.name")
    first = asked.join(sidecars, "name").groupBy("path").agg(F.min_by(F.struct("cloud", "acquired"), "priority").alias("s"), F.min("priority").alias("priority"))
    joined = files.join(first, "path", "left")
    return joined.select("path", "priority", F.coalesce("s.cloud", F.lit(default_cloud)).alias("cloud"), F.coalesce("s.acquired", "modified").alias("acquired"))


def newest(files: DataFrame, group: str) -> DataFrame:
    """(group, path, modified) of each group's newest file, ties by path."""
    return files.groupBy(group).agg(F.max(F.struct("modified", "path")).alias("m")).select(group, "m.path", "m.modified")


def first_available(candidates: DataFrame, key: str) -> DataFrame:
    """Of each key's candidates (priority, modified, path) the newest of the best priority."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("priority", F.desc("modified"), "path"))
    return candidates.withColumn("_r", rank).where("_r = 1").drop("_r")


def first_asset(assets: Column, names: list[str]) -> Column:
    """The first of these assets that a map of them has."""
    return F.coalesce(*(F.try_element_at(assets, F.lit(n)) for n in names))


def wanted_assets(scenes: DataFrame, names: list[str]) -> DataFrame:
    """(scene_id, asset, href) of each scene and each wanted asset, in their order; href is null where the scene has none of that name.

    scenes: (scene_id, assets map<string, string>).
    """
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("asset"), F.try_element_at(F.col("assets"), F.lit(n)).alias("href")) for n in names)))
    return scenes.select("scene_id", each.alias("a")).select("scene_id", "a.*")


def cloud_of(properties: Column) -> Column:
    """Cloud cover by any of the names it goes by, else 0."""
    return F.coalesce(*(F.try_element_at(properties, F.lit(n)).cast("double") for n in ("eo:cloud_cover", "cloudCoverage", "cloud_cover")), F.lit(0.0))


def reusable_orders(orders: DataFrame, scenes: DataFrame) -> DataFrame:
    """Orders whose image id is in a scene's id or the other way round; empty ids match nothing.

    Ids are cut into all pieces of the lengths that ids have, and pieces are joined with whole ids: an equi-join, not a product.
    """
    lengths = [r[0] for r in orders.select(F.length("image_id").alias("n")).union(scenes.select(F.length("scene_id").alias("n"))).where("n > 0").distinct().collect()]

    def of_length(column: str, n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(column) - n + 1), lambda i: F.substring(F.col(column), i, F.lit(n)))
        return F.when(F.length(column) >= n, each).otherwise(F.array().cast("array<string>"))

    def pieces(column: str) -> Column:
        return F.array_distinct(F.flatten(F.array(*(of_length(column, n) for n in sorted(lengths))))) if lengths else F.array().cast("array<string>")

    by_scene = scenes.select("scene_id", F.explode(pieces("scene_id")).alias("piece")).join(orders.select("order_id", F.col("image_id").alias("piece"), "image_id"), "piece")
    by_order = orders.select("order_id", "image_id", F.explode(pieces("image_id")).alias("piece")).join(scenes.select("scene_id", F.col("scene_id").alias("piece")), "piece")
    return by_scene.select("scene_id", "order_id", "image_id").union(by_order.select("scene_id", "order_id", "image_id")).distinct()


def last_path(files: DataFrame, group: str) -> DataFrame:
    """(group, path): the last path in the order of texts."""
    return files.groupBy(group).agg(F.max("path").alias("path"))


def largest_part(parts: DataFrame, key: str, area: str = "area", part: str = "part") -> DataFrame:
    """(key, part, area) of each shape's largest part, the first of equal ones."""
    return parts.groupBy(key).agg(F.min(F.struct((-F.col(area)).alias("a"), F.col(part).alias("part"))).alias("m")).select(key, F.col("m.part").alias(part), (-F.col("m.a")).alias(area))
