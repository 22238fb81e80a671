"""Cluster merges and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.runtime import checkpoint


def merge_sets(pairs: DataFrame) -> DataFrame:
    """Transitive merge sets of pairs (recording_id, a, b): (recording_id, cluster_id, new_id).

    ``new_id`` is the smallest id of the set. Labels sink along the pairs, and twice as far each round
    as labels of labels are taken.
    """
    edges = pairs.select("recording_id", "a", "b").where("a is not null and b is not null").distinct()
    edges = checkpoint(edges.unionByName(edges.select("recording_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(edges.groupBy("recording_id", F.col("a").alias("cluster_id")).agg(F.least(F.first("a"), F.min("b")).alias("new_id")))
    while True:
        near = edges.join(labels.select("recording_id", F.col("cluster_id").alias("b"), F.col("new_id").alias("l")), ["recording_id", "b"]).groupBy("recording_id", F.col("a").alias("cluster_id")).agg(F.min("l").alias("l"))
        jump = labels.select("recording_id", F.col("cluster_id").alias("new_id"), F.col("new_id").alias("j"))
        nxt = labels.join(near, ["recording_id", "cluster_id"], "left").join(jump, ["recording_id", "new_id"], "left")
        nxt = checkpoint(nxt.select("recording_id", "cluster_id", F.least("new_id", "l", "j").alias("new_id"), (F.least("new_id", "l", "j") < F.col("new_id")).alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.select("recording_id", "cluster_id", "new_id")
        labels = nxt.drop("moved")


def apply_merges(spikes: DataFrame, merges: DataFrame) -> DataFrame:
    """Spikes with merged cluster ids; the old id is kept in ``cluster_before``."""
    joined = spikes.withColumn("cluster_before", F.col("cluster_id")).join(merges, ["recording_id", "cluster_id"], "left")
    return joined.withColumn("cluster_id", F.coalesce("new_id", "cluster_id")).drop("new_id")


def merge_ratings(ratings: DataFrame, merges: DataFrame) -> DataFrame:
    """Ratings after merges: the best rating of a set, and flags that hold for any member."""
    joined = ratings.join(merges, ["recording_id", "cluster_id"], "left").withColumn("cluster_id", F.coalesce("new_id", "cluster_id"))
    return joined.groupBy("recording_id", "cluster_id").agg(F.max("rating").alias("rating"), F.bool_or("include_cutoff").alias("include_cutoff"))


def rating_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def usable(flags: DataFrame, ratings: DataFrame, accepted: list[int], subgroups: list[int]) -> DataFrame:
    """Clusters with an accepted rating that are usable in all of ``subgroups``."""
    wide = flags.where(F.col("subgroup").isin(subgroups)).groupBy("recording_id", "cluster_id").agg(F.bool_and("usable").alias("_u"), F.count_distinct("subgroup").alias("_n"))
    good = wide.where(F.col("_u") & (F.col("_n") == len(set(subgroups))))
    return ratings.where(F.col("rating").isin(accepted)).join(good, ["recording_id", "cluster_id"], "left_semi").select("recording_id", "cluster_id", "rating")


def realign(ratings: DataFrame, clusters: DataFrame, defaults: dict) -> DataFrame:
    """Ratings of the given clusters: those without one get ``defaults``, those of other clusters go."""
    rows = clusters.select("recording_id", "cluster_id").join(ratings, ["recording_id", "cluster_id"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def upsert(ratings: DataFrame, changes: DataFrame) -> DataFrame:
    """Ratings with ``changes`` written over; a null in a change keeps what is there, new clusters are added."""
    keys = ["recording_id", "cluster_id"]
    others = [c for c in ratings.columns if c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in others if c in changes.columns))
    return ratings.join(new, keys, "full").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in others))


def merge_partners(merges: DataFrame) -> DataFrame:
    """(recording_id, cluster_id, new_id, partners): for each cluster of a merge set the others it goes together with."""
    sets = merges.groupBy("recording_id", "new_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("_all")).where(F.size("_all") > 1)
    return sets.select("recording_id", F.explode("_all").alias("cluster_id"), "new_id", "_all").select("recording_id", "cluster_id", "new_id", F.array_except("_all", F.array("cluster_id")).alias("partners"))


def resort(spikes: DataFrame, merges: DataFrame, ratings: DataFrame, accepted: list[int], duplicates: DataFrame) -> DataFrame:
    """Spikes of merged clusters whose merged rating is accepted, without the duplicates (recording_id, spike_id)."""
    good = merge_ratings(ratings, merges).where(F.col("rating").isin(accepted)).select("recording_id", "cluster_id")
    kept = apply_merges(spikes, merges).join(good, ["recording_id", "cluster_id"], "left_semi")
    return kept.join(duplicates.select("recording_id", "spike_id"), ["recording_id", "spike_id"], "left_anti")
