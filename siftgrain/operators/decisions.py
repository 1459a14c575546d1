"""Append-only decisions and the state that they come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, CHALLENGER = "user_keep", "user_challenger"


def initial_state(ui_state: str) -> Column:
    s = F.col(ui_state)
    return F.when(s == "recommended_keep", KEEP).when(s.isin("recommended_alternate", "not_prioritized"), CHALLENGER).otherwise(s)


def latest_decisions(log: DataFrame) -> DataFrame:
    """(display_id, user_state) of the last line of each photo; lines without either are left out. log: (seq, display_id, user_state)."""
    return log.filter("display_id IS NOT NULL AND user_state IS NOT NULL").groupBy("display_id").agg(F.max_by("user_state", "seq").alias("user_state"))


def resolved(photos: DataFrame, log: DataFrame) -> DataFrame:
    """photos (display_id, ui_initial_state) with state: the last decision, or else the initial state."""
    last = latest_decisions(log).select(F.col("display_id").alias("_id"), F.col("user_state").alias("_state"))
    return photos.join(last, F.col("display_id") == F.col("_id"), "left").withColumn("state", F.coalesce("_state", initial_state("ui_initial_state"))).drop("_id", "_state")


def keep_set(seeds: DataFrame, log: DataFrame) -> DataFrame:
    """(display_id) of the photos to keep. seeds: those kept before any decision; decisions follow in the order of the log."""
    first = seeds.select(F.lit(-1).cast("long").alias("seq"), "display_id", F.lit(KEEP).alias("user_state"))
    all_ = first.union(log.select(F.col("seq").cast("long"), "display_id", "user_state"))
    return latest_decisions(all_).filter(F.col("user_state") == KEEP).select("display_id")


def pools(photos: DataFrame) -> DataFrame:
    """photos with pool: keeper where the state is keep, else challenger; everything that is no keeper is to be deleted."""
    return photos.withColumn("pool", F.when(F.col("state") == KEEP, "keeper").otherwise("challenger")).withColumn("to_delete", ~(F.col("state") == KEEP))


def pool_counts(photos: DataFrame) -> DataFrame:
    """One row: keepers, challengers, and the bytes of either."""
    keep = F.col("state") == KEEP
    return photos.agg(F.count_if(keep).alias("keepers"), F.count_if(~keep).alias("challengers"), F.sum(F.when(keep, F.col("bytes")).otherwise(0)).alias("keeper_bytes"), F.sum(F.when(~keep, F.col("bytes")).otherwise(0)).alias("challenger_bytes"))


def replace_keeper(actions: DataFrame) -> DataFrame:
    """Decision rows of actions (seq, review_set_id, keeper_id, challenger_id, action): two for each.

    `replace`: the keeper becomes a challenger and the challenger the keeper; `keep_both`: both are kept.
    """
    before = F.when(F.col("action") == "replace", CHALLENGER).otherwise(KEEP)
    rows = F.array(F.struct(F.col("keeper_id").alias("display_id"), before.alias("user_state"), F.lit(0).alias("k")), F.struct(F.col("challenger_id").alias("display_id"), F.lit(KEEP).alias("user_state"), F.lit(1).alias("k")))
    return actions.select("seq", "review_set_id", F.explode(rows).alias("r")).select((F.col("seq") * 2 + F.col("r.k")).alias("seq"), "review_set_id", "r.display_id", "r.user_state")


def preferences(actions: DataFrame) -> DataFrame:
    """The preference row of each action, under both names that readers use."""
    keeper, action = F.col("keeper_id"), F.col("action")
    return actions.select("seq", "review_set_id", keeper.alias("keeper_photo_id"), keeper.alias("active_keeper_photo_id"), F.col("challenger_id").alias("challenger_photo_id"), action.alias("decision"), action.alias("user_action"))


def toggled(completed: Column, review_set_id: Column) -> Column:
    """A list of completed sets with the set taken out, or put at its end."""
    return F.when(F.array_contains(completed, review_set_id), F.array_remove(completed, review_set_id)).otherwise(F.array_append(completed, review_set_id))


def neighbours(photos: DataFrame, key: str, order: str) -> DataFrame:
    """photos with the next and the previous one of their group, the ends meeting."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return photos.withColumns({
        "next_id": F.coalesce(F.lead("display_id").over(w), F.first("display_id").over(whole)),
        "previous_id": F.coalesce(F.lag("display_id").over(w), F.last("display_id").over(whole)),
    })


def selected_range(photos: DataFrame, key: str, order: str, anchor: Column, target: Column) -> DataFrame:
    """The photos between anchor and target of each group, both included, in either direction; none where one of them is missing."""
    whole = Window.partitionBy(key)
    rn = F.row_number().over(whole.orderBy(order))
    at = lambda c: F.max(F.when(c, F.col("_rn"))).over(whole)
    out = photos.withColumn("_rn", rn).withColumn("_a", at(anchor)).withColumn("_t", at(target))
    return out.filter(F.col("_rn").between(F.least("_a", "_t"), F.greatest("_a", "_t")) & F.col("_a").isNotNull() & F.col("_t").isNotNull()).drop("_rn", "_a", "_t")


def in_first_order(first: DataFrame, rest: DataFrame) -> DataFrame:
    """(id, ord) of both, each id once where it stands first; those of `rest` after those of `first`."""
    both = first.select("id", F.struct(F.lit(0), F.col("ord")).alias("at")).union(rest.select("id", F.struct(F.lit(1), F.col("ord"))))
    return both.groupBy("id").agg(F.min("at").alias("at"))
