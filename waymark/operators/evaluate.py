"""Scoring of decodes against the truth of crops."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CROP = ("source", "frame", "crop_idx")


def truth_in_crops(cells: DataFrame, crops: DataFrame) -> DataFrame:
    """Tags whose position lies in a crop (bounds included): source, frame, crop_idx, tag_id, ass_type."""
    c = cells.where("center_x IS NOT NULL").select("source", "frame", "tag_id", "ass_type", "center_x", "center_y")
    inside = F.col("center_x").between(F.col("crop_x1"), F.col("crop_x2")) & F.col("center_y").between(F.col("crop_y1"), F.col("crop_y2"))
    return crops.join(c, ["source", "frame"]).where(inside).select(*CROP, "tag_id", "ass_type")


def decodes_in_crops(decodes: DataFrame, crops: DataFrame) -> DataFrame:
    """Each decode with the first crop it lies in (upper bounds excluded)."""
    inside = (F.col("center_x") >= F.col("crop_x1")) & (F.col("center_x") < F.col("crop_x2")) & (F.col("center_y") >= F.col("crop_y1")) & (F.col("center_y") < F.col("crop_y2"))
    hits = decodes.join(crops, ["source", "frame"]).where(inside)
    return hits.groupBy("source", "frame", "decode_idx").agg(F.min("crop_idx").alias("crop_idx"), F.first("tag_id").alias("tag_id"))


def id_difficulty(truth: DataFrame) -> DataFrame:
    """1 - originals / all, for each tag."""
    total = F.count("*")
    return truth.groupBy("tag_id").agg(total.alias("n_total"), F.sum((F.col("ass_type") == 1).cast("long")).alias("n_original")).withColumn("difficulty", 1.0 - F.col("n_original") / F.col("n_total"))


def crop_results(truth: DataFrame, decoded: DataFrame) -> DataFrame:
    """True and decoded ids of each crop, and their true, false and missed ones."""
    t = truth.groupBy(*CROP).agg(F.array_sort(F.collect_set("tag_id")).alias("gt_ids"))
    d = decoded.groupBy(*CROP).agg(F.array_sort(F.collect_set("tag_id")).alias("ids"))
    empty = F.array().cast("array<bigint>")
    j = t.join(d, list(CROP), "full").withColumns({"gt_ids": F.coalesce("gt_ids", empty), "ids": F.coalesce("ids", empty)})
    return j.withColumns({"tp": F.size(F.array_intersect("gt_ids", "ids")), "fp": F.size(F.array_except("ids", "gt_ids")), "missed": F.size(F.array_except("gt_ids", "ids"))})


def recall_table(results: DataFrame) -> DataFrame:
    t = results.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "missed")], F.sum((F.size("ids") > 0).cast("long")).alias("n_decoded_crops"))
    true, found = F.col("tp") + F.col("missed"), F.col("tp") + F.col("fp")
    return t.withColumns({"recall": F.when(true > 0, F.col("tp") / true).otherwise(0.0), "false_rate": F.when(found > 0, F.col("fp") / found).otherwise(0.0)})


def yield_table(crops: DataFrame, decoded: DataFrame) -> DataFrame:
    """Crops, those with a decode, and those with several ids, by source."""
    ids = decoded.groupBy(*CROP).agg(F.countDistinct("tag_id").alias("k"))
    j = crops.select(*CROP).join(ids, list(CROP), "left")
    return j.groupBy("source").agg(F.count("*").alias("n_crops"), F.sum((F.col("k") >= 1).cast("long")).alias("n_hits"), F.sum((F.col("k") > 1).cast("long")).alias("n_multi")).fillna(0)


def image_counts(decodes: DataFrame) -> DataFrame:
    """Distinct ids and repeated decodes of each image."""
    a = decodes.groupBy("source", "frame").agg(F.count("*").alias("n_decodes"), F.countDistinct("tag_id").alias("n_distinct"))
    return a.withColumn("n_duplicates", F.col("n_decodes") - F.col("n_distinct"))


def detection_totals(decodes: DataFrame) -> DataFrame:
    return image_counts(decodes).agg(F.sum("n_decodes").alias("n_detections"), F.sum("n_distinct").alias("sum_distinct"))


def preset_differences(presets: DataFrame) -> DataFrame:
    """Keys (of preset, key, value rows) on which presets differ or that some lack; underscored keys don't count."""
    p = presets.where(~F.col("key").startswith("_"))
    n = presets.select("preset").distinct().count()
    a = p.groupBy("key").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("preset").alias("n_presets"))
    return a.where((F.col("n_values") > 1) | (F.col("n_presets") < n))


def top_trials(trials: DataFrame, k: int = 5) -> DataFrame:
    return trials.where("value IS NOT NULL").orderBy(F.col("value").desc(), "number").limit(k)


def cover(truth: DataFrame, target: int, min_appearances: int) -> list[tuple[str, int]]:
    """Composites (source, frame) chosen greedily so that hard and rare ids appear often enough.

    A tag weighs 1 + 2 difficulty, 30 times that until it first appears, 10 times
    until ``min_appearances``, then less with each appearance.  A round sums the
    weights by composite in Spark and takes the best (ties: first source and
    frame); only that composite comes to the driver, ``target`` in all.
    """
    spark = truth.sparkSession
    hard = id_difficulty(truth).select("tag_id", (1 + 2 * F.col("difficulty")).alias("hard"))
    tags = truth.select("source", "frame", "tag_id").distinct().join(hard, "tag_id").persist()
    chosen: list[tuple[str, int]] = []
    seen: Counter[int] = Counter()  # tags of the chosen composites alone
    try:
        while len(chosen) < target:
            times, left = F.lit(0), tags
            if chosen:
                left = tags.join(F.broadcast(spark.createDataFrame(chosen, "source string, frame int")), ["source", "frame"], "left_anti")
                known = spark.createDataFrame(sorted(seen.items()), "tag_id long, times int")
                left, times = left.join(F.broadcast(known), "tag_id", "left"), F.coalesce("times", F.lit(0))
            pull = F.col("hard") * F.when(times >= min_appearances, 1 / (times + 1)).when(times == 0, 30.0).otherwise(10.0)
            gain = left.groupBy("source", "frame").agg(F.round(F.sum(pull), 9).alias("gain"), F.collect_set("tag_id").alias("ids"))
            best = gain.orderBy(F.col("gain").desc(), "source", "frame").first()
            if best is None:
                break
            chosen.append((best["source"], best["frame"]))
            seen.update(best["ids"])
    finally:
        tags.unpersist()
    return chosen


def compare_decodes(results: DataFrame) -> DataFrame:
    """True, false and missed ids of each preset (results with a ``preset`` column)."""
    return results.groupBy("preset").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "missed")])


def ranked_runtime(runs: DataFrame) -> DataFrame:
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy("preset").orderBy(F.col("seconds").desc(), "source")))


def testset_counters(crops: DataFrame, truth: DataFrame, decoded: DataFrame, valid: DataFrame) -> DataFrame:
    """Counters and rates of a test set, one row a source.

    In crops with true ids, found ids count as recall and others as false.  In
    crops without, an id that the frame has elsewhere, or that isn't among the
    ``valid`` tag_ids, is a hallucination, any other a discovery.
    """
    found = decoded.select(*CROP, "tag_id").distinct()
    true = truth.select(*CROP, "tag_id").distinct()
    n_true = true.groupBy(*CROP).agg(F.count("*").alias("n_true"))
    hits = found.join(true.withColumn("_hit", F.lit(1)), [*CROP, "tag_id"], "left")
    in_frame = truth.select("source", "frame", "tag_id").distinct().withColumn("_here", F.lit(1))
    known = valid.select("tag_id").distinct().withColumn("_valid", F.lit(1))
    marked = hits.join(in_frame, ["source", "frame", "tag_id"], "left").join(known, "tag_id", "left")
    novel = F.col("_here").isNull() & F.col("_valid").isNotNull()
    n_found = marked.groupBy(*CROP).agg(F.count("*").alias("n_found"), F.count("_hit").alias("n_hit"), F.count_if(novel).alias("n_novel"))
    c = crops.select(*CROP).join(n_true, list(CROP), "left").join(n_found, list(CROP), "left").fillna(0, ["n_true", "n_found", "n_hit", "n_novel"])
    has = F.col("n_true") > 0
    total = lambda when, what: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0))
    t = c.groupBy("source").agg(
        F.count_if(has).alias("total_with_gt"), total(has, "n_true").alias("total_gt_ids"), total(has, "n_hit").alias("individual_found"),
        F.count_if(has & (F.col("n_hit") > 0)).alias("correct_detections"), F.count_if(has & (F.col("n_hit") == F.col("n_true"))).alias("all_gt_found"),
        (total(has, "n_found") - total(has, "n_hit")).alias("false_positives"), F.count_if(~has).alias("total_no_gt"),
        (total(~has, "n_found") - total(~has, "n_novel")).alias("no_gt_hallucinations"), total(~has, "n_novel").alias("no_gt_discoveries"),
        F.countDistinct("frame").alias("total_composites"),
    )
    rate = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return t.withColumns({
        "detection_rate": rate("correct_detections", "total_with_gt"), "all_gt_rate": rate("all_gt_found", "total_with_gt"),
        "individual_recall": rate("individual_found", "total_gt_ids"), "false_positive_rate": rate("false_positives", "total_with_gt"),
    })


def with_times(counters: DataFrame, times: DataFrame) -> DataFrame:
    """Mean milliseconds a composite and a crop, from ``times`` (source, preprocess_s, detect_s) in seconds."""
    total = times.groupBy("source").agg(F.sum("preprocess_s").alias("_p"), F.sum("detect_s").alias("_d"))
    n = F.greatest("total_composites", F.lit(1))
    j = counters.join(total, "source", "left").fillna(0.0, ["_p", "_d"])
    per = {"avg_preprocess_ms": 1000 * F.col("_p") / n, "avg_detect_ms": 1000 * F.col("_d") / n, "avg_total_ms": 1000 * (F.col("_p") + F.col("_d")) / n}
    crops = F.greatest(F.col("total_with_gt") + F.col("total_no_gt"), F.lit(1))
    return j.withColumns(per | {"avg_time_per_crop_ms": 1000 * (F.col("_p") + F.col("_d")) / crops}).drop("_p", "_d")


def manifest_totals(crops: DataFrame) -> DataFrame:
    """Videos, composites and crops of test sets (rows of ``read_manifest``)."""
    return crops.agg(F.countDistinct("video_key").alias("n_videos"), F.countDistinct("video_key", "frame").alias("n_composites"), F.count("*").alias("n_crops"))


def manifest_info(crops: DataFrame) -> DataFrame:
    """One row for test sets: whether they have no truth (yield mode), the tag family if there is just one, and the valid ids."""
    each = crops.select(F.explode("gt_ids").alias("id")).distinct()  # one row an id before they meet
    ids = each.agg(F.array_sort(F.collect_list("id")).alias("valid_ids"))
    a = crops.agg(
        F.count("*").alias("n_crops"), F.count_if(F.size("gt_ids") > 0).alias("n_with_gt"), F.coalesce(F.bool_or(F.col("gt_mode") == "yolo"), F.lit(False)).alias("_flag"),
        F.countDistinct("tag_family").alias("_n"), F.max("tag_family").alias("_family"),
    )
    a = a.join(ids, F.lit(True))  # one row each
    bare = (F.col("n_crops") > 0) & (F.col("n_with_gt") == 0)
    return a.select((F.col("_flag") | bare).alias("yield_mode"), F.when(F.col("_n") == 1, F.col("_family")).alias("tag_family"), "valid_ids", "n_crops", "n_with_gt")


def run_summary(runs: DataFrame) -> DataFrame:
    """Of runs (source, seconds, error): how many succeeded and failed, and the summed seconds."""
    return runs.agg(F.count_if(F.col("error").isNull()).alias("n_succeeded"), F.count("error").alias("n_failed"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("worker_seconds"))


def id_coverage(appearances: DataFrame) -> DataFrame:
    """Least, upper median and most appearances of the ids (tag_id, n)."""
    ranked = appearances.groupBy("n").agg(F.count("*").alias("ids")).agg(F.array_sort(F.collect_list(F.struct("n", "ids"))).alias("h"), F.sum("ids").alias("total"))
    step = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("n"))
    place = F.floor(F.col("total") / 2)
    walk = F.aggregate("h", step, lambda a, x: F.struct((a["below"] + x["ids"]).alias("below"), F.when(a["n"].isNull() & (a["below"] + x["ids"] > place), x["n"]).otherwise(a["n"]).alias("n")))
    return ranked.where("total > 0").select(F.get("h", F.lit(0))["n"].alias("least"), walk["n"].alias("median"), F.element_at("h", -1)["n"].alias("most"))


def preset_table(presets: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Preset, key, shown, explicit and differs for all presets and keys.

    ``presets`` has rows (preset, key, value) that were set explicitly,
    ``defaults`` rows (key, value) that hold elsewhere; keys with an underscore
    in front don't count.  Explicit values are marked with an asterisk; a key
    differs if its values, a missing one counting as empty, aren't all equal.
    """
    p = presets.where(~F.startswith("key", F.lit("_")))
    names = presets.select("preset").distinct()
    keys = p.select("key").distinct()
    if defaults is not None:
        d = defaults.where(~F.startswith("key", F.lit("_"))).select("key", F.col("value").alias("_default"))
        keys = keys.unionByName(d.select("key")).distinct().join(d, "key", "left")
    else:
        keys = keys.withColumn("_default", F.lit(None).cast("string"))
    every = keys.withColumn("preset", F.explode(F.array(*[F.lit(r["preset"]) for r in names.orderBy("preset").collect()])))  # a handful of presets, named on the command line
    j = every.join(p.select("preset", "key", "value", F.lit(True).alias("explicit")), ["preset", "key"], "left").withColumn("explicit", F.coalesce("explicit", F.lit(False)))
    j = j.withColumn("value", F.coalesce("value", "_default", F.lit("")))
    w = Window.partitionBy("key")
    return j.select("preset", "key", F.concat("value", F.when(F.col("explicit"), "*").otherwise("")).alias("shown"), "explicit", (F.min("value").over(w) != F.max("value").over(w)).alias("differs"))


def best_presets(scores: DataFrame, lower_is_better: tuple[str, ...] = ("fp_rate", "avg_ms")) -> DataFrame:
    """The best preset of each metric (preset, place, metric, value): highest, or lowest for the metrics named; ties to the first place."""
    sign = F.when(F.col("metric").isin(*lower_is_better), -1.0).otherwise(1.0)
    w = Window.partitionBy("metric").orderBy((F.col("value") * sign).desc_nulls_last(), "place")
    return scores.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("metric", "preset", "value")
