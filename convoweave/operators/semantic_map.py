"""The semantic map: projection, clusters, their tags and names, and their succession between runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from convoweave.functions.vectors import dot

SEED, TOP, LEAST_OVERLAP = 42, 4, 0.2


def centred(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """`vectors` with the mean of all taken off; the means are one row for each dimension."""
    each = vectors.select(F.posexplode(embedding).alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = [r["m"] for r in each.orderBy("d").collect()]  # as many numbers as a vector has
    off = F.zip_with(embedding, F.array(*map(F.lit, means)), lambda x, m: x.cast("double") - m)
    return vectors.withColumn(embedding, off)


def visible(vectors: DataFrame, hidden: DataFrame) -> DataFrame:
    """`vectors` (chunk_key) with turn_id, without those of hidden turns (turn_id), which would else shift all other points."""
    rows = vectors.withColumn("turn_id", F.regexp_replace("chunk_key", r"#[^#]*$", ""))
    return rows.join(hidden.select("turn_id"), "turn_id", "left_anti")


def projected(vectors: DataFrame, dims: int = 2, embedding: str = "embedding") -> DataFrame:
    """`vectors` with coords: the first principal components of the centred vectors; signs are arbitrary."""
    rows = centred(vectors, embedding).withColumn("_v", array_to_vector(embedding))
    return PCA(k=dims, inputCol="_v", outputCol="_c").fit(rows).transform(rows).withColumn("coords", vector_to_array("_c")).drop("_v", "_c")


def clustered(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """`vectors` with cluster: all 0 below six rows, else k-means with 3 to 16 clusters, one for 300 rows."""
    n = vectors.count()
    if n < 6:
        return vectors.withColumn("cluster", F.lit(0))
    rows = vectors.withColumn("_v", array_to_vector(F.transform(embedding, lambda x: x.cast("double"))))
    model = KMeans(k=max(3, min(16, n // 300)), seed=SEED, featuresCol="_v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_v")


def tag_counts(tags: DataFrame) -> DataFrame:
    """cluster, tag, tf, and size (points of the cluster), from cluster, point, tag."""
    size = tags.groupBy("cluster").agg(F.countDistinct("point").alias("size"))
    return tags.where("tag IS NOT NULL").groupBy("cluster", "tag").agg(F.count("*").alias("tf")).join(F.broadcast(size), "cluster")


def least_tf():
    """A tag that a cluster of ten or more has but once is not its topic."""
    return F.when(F.col("size") >= 10, 2).otherwise(1)


def distinctive_tags(counts: DataFrame, clusters: int) -> DataFrame:
    """cluster, place, tag, score: the TOP tags by tf * ln(clusters / clusters that have the tag); tags of all clusters score nothing."""
    df = counts.groupBy("tag").agg(F.countDistinct("cluster").alias("df"))
    weight = F.log(F.lit(float(clusters)) / F.col("df")) if clusters > 1 else F.lit(1.0)
    rows = counts.join(df, "tag").withColumn("_w", weight).where((F.col("tf") >= least_tf()) & (F.col("_w") > 0)).withColumn("score", F.col("tf") * F.col("_w"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), F.desc("tf"), "tag"))
    return rows.withColumn("place", place).where(F.col("place") <= TOP).select("cluster", "place", "tag", "score")


def common_tags(counts: DataFrame) -> DataFrame:
    """cluster, place, tag: the first TOP of its six most frequent tags that are frequent enough."""
    order = Window.partitionBy("cluster").orderBy(F.desc("tf"), "tag")
    rows = counts.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= 6) & (F.col("tf") >= least_tf()))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP).select("cluster", "place", "tag")


def summary(points: DataFrame) -> DataFrame:
    """cluster, points, turns and centroid, from cluster, turn_id and coords."""
    whole = points.groupBy("cluster").agg(F.count("*").alias("points"), F.countDistinct("turn_id").alias("turns"))
    each = points.select("cluster", F.posexplode("coords").alias("d", "x")).groupBy("cluster", "d").agg(F.avg("x").alias("m"))
    centre = each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("centroid"))
    return whole.join(centre, "cluster")


def medoids(points: DataFrame, centres: DataFrame) -> DataFrame:
    """cluster and headline of the point nearest to the centroid, cut to 40 characters."""
    off = F.zip_with("coords", "centroid", lambda a, b: a - b)
    rows = points.join(F.broadcast(centres.select("cluster", "centroid")), "cluster")
    return rows.groupBy("cluster").agg(F.substring(F.min_by("headline", F.struct(dot(off, off), F.col("key"))), 1, 40).alias("headline"))


def paths(points: DataFrame) -> DataFrame:
    """session_id and keys of its points in (timestamp, chunk) order, for sessions of two points or more."""
    rows = points.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "idx", "key"))).alias("p"))
    return rows.where(F.size("p") >= 2).select("session_id", F.transform("p", lambda x: x["key"]).alias("keys"))


def members(points: DataFrame) -> DataFrame:
    """cluster, turn_id and the turn's first point."""
    return points.groupBy("cluster", "turn_id").agg(F.min("key").alias("key"))


def overlaps(new: DataFrame, old: DataFrame) -> DataFrame:
    """new_id, old_id, jaccard of clusters that share members (cluster, key) to at least LEAST_OVERLAP."""
    shared = new.join(old.withColumnRenamed("cluster", "old_id"), "key").groupBy(F.col("cluster").alias("new_id"), "old_id").agg(F.count("*").alias("n"))
    sizes = lambda d, name: d.groupBy(F.col("cluster").alias(name)).agg(F.count("*").alias(f"n_{name}"))
    rows = shared.join(F.broadcast(sizes(new, "new_id")), "new_id").join(F.broadcast(sizes(old, "old_id")), "old_id")
    jaccard = F.col("n") / (F.col("n_new_id") + F.col("n_old_id") - F.col("n"))
    return rows.select("new_id", "old_id", jaccard.alias("jaccard")).where(F.col("jaccard") >= LEAST_OVERLAP)


def succession(new: DataFrame, old: DataFrame) -> dict[int, int]:
    """The id that each new cluster takes: that of the old cluster it overlaps most, one to one; else a new one.

    Clusters are tens, so the greedy choice among their overlaps is made on the driver.
    """
    taken: dict[int, int] = {}
    for r in sorted(overlaps(new, old).collect(), key=lambda r: (-r["jaccard"], -r["new_id"], -r["old_id"])):
        if r["new_id"] not in taken and r["old_id"] not in taken.values():
            taken[r["new_id"]] = r["old_id"]
    free = max((r["cluster"] for r in old.select("cluster").distinct().collect()), default=-1) + 1
    for (cluster,) in sorted(new.select("cluster").distinct().collect()):
        if cluster not in taken:
            taken[cluster], free = free, free + 1
    return taken


def names(sizes: Mapping[int, int], own: Mapping[int, list[str]], common: Mapping[int, list[str]], headlines: Mapping[int, str]) -> dict[int, str]:
    """A name for each cluster: its first tag, with further tags or its id where names are equal.

    Large clusters (at least 80 and 1.8 times the upper median size) take common tags, others distinctive ones; a
    cluster without tags takes its medoid's headline. Few clusters, in one order: this runs on the driver.
    """
    median = sorted(sizes.values())[len(sizes) // 2] if sizes else 0
    used, out = set(), {}
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):
        large = sizes[c] >= max(80, int(1.8 * median))
        lists = (common.get(c), own.get(c)) if large else (own.get(c), common.get(c))
        tags = next(filter(None, lists), [])
        tried = [*tags[:1], *(f"{tags[0]} · {tag}" for tag in tags[1:])] or [headlines.get(c) or f"군집 {c + 1}"]
        name = next((t for t in tried if t not in used), tried[-1])
        out[c] = name if name not in used else f"{name} ({c})"
        used.add(out[c])
    return out


def stale(points_then: int, points_now: int, marked: bool = False) -> bool:
    """Whether the map is to be made again: marked, or changed by 50 points and a twentieth at least."""
    return marked or abs(points_now - points_then) >= max(50, points_then * 0.05)
