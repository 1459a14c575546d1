"""Sessions, neighbours, similarity edges and review sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftgrain.config import Config
from siftgrain.functions import exprs as X
from siftgrain.operators.components import components
from siftgrain.operators.stats import row_numbers
from siftgrain.operators.store import write_table

#: Photos of a block of a set.
PAIR_BLOCK = 256


def segments(photos: DataFrame, config: Config) -> DataFrame:
    """photos (capture_time, display_id, make, model) with day, segment (within the day) and rn (within the segment, from 1).

    A segment ends at a change of date, at a gap, and where both cameras are
    known and differ. Photos without a time come first, as a day of their own.

    Photos are dealt out by ranges of time and name, so that a busy day is spread
    over tasks. Of each range only its ends and counts go on, one row a range,
    from which the others learn what stands ahead of them.
    """
    spark = photos.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    place = ["capture_time", "display_id"]
    dealt, _ = write_table(photos.repartitionByRange(n, *place).withColumn("_range", F.spark_partition_id()), "segmented")
    mark = F.struct("capture_time", "display_id", "make", "model")
    edges = dealt.groupBy("_range").agg(F.max_by(mark, F.struct(F.col("capture_time").isNotNull(), *place)).alias("_last"), F.count("*").alias("_n"))
    ahead = Window.orderBy("_range")  # over one row a range
    edges = edges.select("_range", F.lag("_last").over(ahead).alias("_ahead"), (F.sum("_n").over(ahead) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("_range").orderBy(*place)
    out = dealt.join(F.broadcast(edges), "_range").withColumn("_prev", F.coalesce(F.lag(mark).over(order), "_ahead"))
    out = out.withColumn("day", F.to_date("capture_time")).withColumn("_no", F.row_number().over(order) + F.col("_before"))
    prev = F.col("_prev")
    gap = X.seconds_apart("capture_time", prev["capture_time"]) > config.segment_gap_s
    camera = ((F.col("make") != prev["make"]) | (F.col("model") != prev["model"])) & F.col("model").isNotNull() & prev["model"].isNotNull() & F.col("make").isNotNull() & prev["make"].isNotNull()
    new_day = prev.isNull() | ~F.col("day").eqNullSafe(F.to_date(prev["capture_time"]))
    begins = new_day | F.coalesce(gap | camera, F.lit(False))
    out, _ = write_table(out.withColumn("_begins", begins).drop("_prev", "_ahead", "_before"), "segments")
    # of each range how many segments began before it, and where the last of them began
    begun = out.groupBy("_range").agg(F.count_if("_begins").alias("_k"), F.max(F.when(F.col("_begins"), F.col("_no"))).alias("_at"))
    begun = begun.select("_range", (F.sum("_k").over(ahead) - F.col("_k")).alias("_past"), F.max("_at").over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = out.join(F.broadcast(begun), "_range").withColumn("_segment", F.sum(F.col("_begins").cast("long")).over(upto) + F.col("_past"))
    start = F.coalesce(F.max(F.when(F.col("_begins"), F.col("_no"))).over(upto), F.col("_open"))
    out = out.withColumn("rn", (F.col("_no") - start + 1).cast("long"))
    # days are few: one row each
    first = out.groupBy("day").agg(F.min("_segment").alias("_first")).withColumnRenamed("day", "_day")
    out = out.join(F.broadcast(first), F.col("day").eqNullSafe(F.col("_day"))).withColumn("segment", F.col("_segment") - F.col("_first"))
    return out.drop("_range", "_no", "_begins", "_past", "_open", "_segment", "_first", "_day")


def band_pairs(photos: DataFrame, config: Config, carry: list[str]) -> DataFrame:
    """Pairs (a_..., b_...) of photos of a segment, b among the next neighbor_limit and within the time window.

    Runs of neighbor_limit photos are dealt out as blocks, and a block meets
    itself and the next: a long session is spread over tasks, and what is carried
    is copied twice, whatever the limit.
    """
    n = config.neighbor_limit
    keep = ["display_id", "capture_time", "rn", *carry]
    block = F.floor((F.col("rn") - 1) / n)
    left = photos.select("day", "segment", *[F.col(c).alias(f"a_{c}") for c in keep], F.explode(F.array(block, block + 1)).alias("block"))
    right = photos.select(F.col("day").alias("b_day"), F.col("segment").alias("b_segment"), *[F.col(c).alias(f"b_{c}") for c in keep], block.alias("b_block"))
    near = (F.col("b_rn") > F.col("a_rn")) & (F.col("b_rn") - F.col("a_rn") <= n)
    same = F.col("day").eqNullSafe(F.col("b_day")) & (F.col("segment") == F.col("b_segment")) & (F.col("block") == F.col("b_block"))
    met = left.join(right, same & near)
    return met.filter(X.seconds_apart("a_capture_time", "b_capture_time") <= config.pair_window_s).drop("block", "b_block", "b_day", "b_segment")


def with_unit_vectors(photos: DataFrame) -> DataFrame:
    """photos with embedding, fg and bg at length 1: done once a photo, a pair's cosine is one product."""
    return photos.withColumns({c: X.l2_normalize(c) for c in ("embedding", "fg", "bg")})


def edge_decision(pairs: DataFrame, config: Config, unit: bool = False) -> DataFrame:
    """pairs with global_sim, fg_sim, bg_sim, combined, veto and edge.

    pairs carries embedding, fg, bg and area of both photos; fg and bg may be
    null. unit: the vectors are those of with_unit_vectors.
    """
    has = lambda s: F.col(f"{s}_fg").isNotNull() & F.col(f"{s}_bg").isNotNull()
    alike = X.dot if unit else X.cosine
    both, one = has("a") & has("b"), has("a") != has("b")
    out = pairs.withColumns({"global_sim": alike("a_embedding", "b_embedding"), "fg_sim": F.when(both, alike("a_fg", "b_fg")), "bg_sim": F.when(both, alike("a_bg", "b_bg"))})
    w = config.weights
    combined = F.when(both, X.weighted([("global_sim", w[0]), ("bg_sim", w[1]), ("fg_sim", w[2])]))
    area = F.least(F.coalesce("a_area", F.lit(0.0)), F.coalesce("b_area", F.lit(0.0)))
    multi = F.lit(config.multi)
    veto = F.when(multi & both & (F.col("bg_sim") < config.background_veto), "background").when(multi & both & (area >= config.foreground_area) & (F.col("fg_sim") < config.foreground_veto), "foreground")
    edge = (
        F.when(~multi | (~both & ~one), F.col("global_sim") >= config.global_threshold)
        .when(one, F.col("global_sim") >= config.mixed_threshold)
        .when(F.col("veto").isNotNull(), F.lit(False))
        .otherwise(F.col("combined") >= config.combined_threshold)
    )
    return out.withColumn("combined", combined).withColumn("veto", veto).withColumn("edge", edge)


def review_sets(photos: DataFrame, edges: DataFrame) -> DataFrame:
    """photos (with a whole-number photo_no by time and name) with set_no, the least photo_no of its component."""
    label = components(edges, "a_photo_no", "b_photo_no").select(F.col("id").alias("photo_no"), F.col("component").alias("_set"))
    return photos.join(label, "photo_no", "left").withColumn("set_no", F.coalesce("_set", "photo_no")).drop("_set")


def by_size(sets: DataFrame) -> DataFrame:
    """sets (photo_count, set_no) with place: from 1, the largest first, equal ones by their number."""
    return row_numbers(sets.withColumn("_rest", -F.col("photo_count")), ["_rest", "set_no"], "place").drop("_rest")


def counters(photos: DataFrame, pairs: DataFrame, edges: DataFrame, sets: DataFrame) -> DataFrame:
    """One row: hard_segments (of photos with day and segment), compared_pairs, accepted_edges and review_sets."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    own = n(photos.select("day", "segment").distinct(), "hard_segments")
    for df, name in ((pairs, "compared_pairs"), (edges, "accepted_edges"), (sets, "review_sets")):
        own = own.join(F.broadcast(n(df, name)))  # one row each
    return own


def set_names(photos: DataFrame) -> DataFrame:
    """(set_no, review_set_id): sets numbered by the time and name of their first photo."""
    first = photos.groupBy("set_no").agg(F.min(F.struct("capture_time", "display_id")).alias("first")).select("set_no", "first.*")
    return row_numbers(first, ["capture_time", "display_id"], "n").select("set_no", F.format_string("set_%06d", "n").alias("review_set_id"))


def set_similarity(photos: DataFrame) -> DataFrame:
    """(set_no, n, sim_min, sim_mean, sim_max) over all pairs of a set's vectors; 1 for a single photo.

    A set's photos are dealt into blocks of about PAIR_BLOCK, and each pair of
    blocks is compared by itself, so that a large set is spread over tasks.
    """
    unit, _ = write_table(photos.select("set_no", "photo_no", X.l2_normalize("embedding").alias("u")), "set-vectors")
    sizes = unit.groupBy("set_no").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / PAIR_BLOCK).cast("int")
    dealt = unit.join(sizes.filter("n > 1"), "set_no").withColumn("own", F.pmod(F.xxhash64("photo_no"), blocks).cast("int")).withColumn("last", blocks - 1)
    left = dealt.select("set_no", F.col("own").alias("x"), F.explode(F.sequence("own", "last")).alias("y"), F.col("photo_no").alias("a"), F.col("u").alias("ua"))
    right = dealt.select("set_no", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("x"), F.col("own").alias("y"), F.col("photo_no").alias("b"), F.col("u").alias("ub"))
    sims = left.join(right, ["set_no", "x", "y"]).filter("x < y OR a < b").select("set_no", X.dot("ua", "ub").alias("sim"))
    out = sizes.join(sims.groupBy("set_no").agg(F.min("sim").alias("lo"), F.avg("sim").alias("mean"), F.max("sim").alias("hi")), "set_no", "left")
    one = F.lit(1.0)
    return out.select("set_no", "n", F.coalesce("lo", one).alias("sim_min"), F.coalesce("mean", one).alias("sim_mean"), F.coalesce("hi", one).alias("sim_max"))


def set_type(signals: DataFrame, config: Config) -> DataFrame:
    kind = F.when(F.col("n") == 1, "single").when(F.col("sim_min") >= config.near_duplicate, "near_duplicate").otherwise("similar_scene")
    return signals.withColumn("set_type", kind)


def set_signals(photos: DataFrame) -> DataFrame:
    """(set_no, photo_count, start, end, duration_seconds, best_overall, score_spread)."""
    best, worst = F.max("overall"), F.min("overall")
    out = photos.groupBy("set_no").agg(F.count("*").alias("photo_count"), F.min("capture_time").alias("start"), F.max("capture_time").alias("end"), F.round(best, 6).alias("best_overall"), F.round(best - worst, 6).alias("score_spread"))
    return out.withColumn("duration_seconds", F.floor(X.seconds_apart("end", "start")).cast("long"))
