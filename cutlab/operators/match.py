"""One-to-one matching of two event sequences within a tolerance, verdicts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth_cuts(cuts: Column, single: Column) -> Column:
    """The list of cuts if there is one, else the single cut, else an empty list."""
    return F.when(F.coalesce(F.size(cuts), F.lit(0)) > 0, cuts).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<double>"))


def predictions_or_flips(starts: Column, in_segments: Column, flips: Column) -> Column:
    """Segment starts after the first where the clip has segments, else label flips."""
    none = F.array().cast("array<double>")
    return F.when(in_segments, F.slice(F.coalesce(starts, none), 2, 2**30)).otherwise(F.coalesce(flips, none))


def predictions_or_pick(starts: Column, picked: Column) -> Column:
    """Segment starts after the first if there are several segments, else the picked cut."""
    none = F.array().cast("array<double>")
    return F.when(F.size(F.coalesce(starts, none)) > 1, F.slice(starts, 2, 2**30)).when(picked.isNotNull(), F.array(picked)).otherwise(none)


def predictions_or_none(starts: Column) -> Column:
    """Segment starts after the first; nothing for a clip without segments."""
    return F.slice(F.coalesce(starts, F.array().cast("array<double>")), 2, 2**30)


def greedy_match(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Adds tp, missed, extra (counts) and errors (array) to rows with arrays ``truth`` and ``pred``.

    In the order of the truth, each event takes the nearest prediction that is
    still free and at most ``tolerance`` away, the first of equals. Greedy, not
    optimal, by definition. A fold over each row's arrays; nothing is shuffled.
    """

    def step(s: Column, g: Column) -> Column:
        near = F.array_min(F.transform(s["pool"], lambda p, i: F.struct(F.abs(p - g).alias("d"), i.alias("i"))))
        hit = F.coalesce(near["d"] <= tolerance, F.lit(False))
        rest = F.filter(s["pool"], lambda p, i: i != near["i"])
        return F.struct(F.when(hit, rest).otherwise(s["pool"]).alias("pool"), F.when(hit, F.concat(s["errors"], F.array(near["d"]))).otherwise(s["errors"]).alias("errors"))

    none = F.array().cast("array<double>")
    start = F.struct(F.coalesce("pred", none).alias("pool"), none.alias("errors"))
    out = pairs.withColumn("m", F.aggregate(F.coalesce("truth", none), start, step))
    tp = F.size("m.errors")
    return out.select(*pairs.columns, tp.alias("tp"), (F.size(F.coalesce("truth", none)) - tp).alias("missed"), F.size("m.pool").alias("extra"), F.col("m.errors").alias("errors"))


#: How predictions follow from segments and records; see ``evaluation``.
RULES = {
    "flips": lambda: predictions_or_flips(F.col("starts"), F.col("starts").isNotNull(), F.col("flips")),
    "pick": lambda: predictions_or_pick(F.col("starts"), F.col("picked")),
    "none": lambda: predictions_or_none(F.col("starts")),
}


def evaluation(truth: DataFrame, segments: DataFrame, records: DataFrame, tolerance: float = 0.5, rule: str = "flips") -> DataFrame:
    """One row per clip of the truth: truth, pred, tp, missed, extra, errors, verdict, first_right.

    truth: clip, cuts (array), cut (single); segments: clip, seg_idx, start;
    records: clip, flips (array), picked (single). Clips without segments or
    records have no predictions of that kind; clips outside the truth do not
    count. ``rule`` says what stands in for missing segments: label flips, the
    picked cut, or nothing.
    """
    starts = segments.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start"))).getField("start").alias("starts"))
    rows = truth.select("clip", truth_cuts(F.col("cuts"), F.col("cut")).alias("truth")).join(starts, "clip", "left").join(records.select("clip", "flips", "picked"), "clip", "left")
    rows = with_verdict(greedy_match(rows.select("clip", "truth", RULES[rule]().alias("pred")), tolerance))
    return rows.withColumn("first_right", first_cut_right(F.col("truth"), F.col("pred"), tolerance))


def grade_totals(graded: DataFrame) -> DataFrame:
    """Counts of the grades of ``grade`` over rows with ``grade`` and ``flipped``, with shares in percent."""
    of = lambda *g: F.count_if(F.col("grade").isin(*g))
    t = graded.agg(F.count("*").alias("clips"), of("ok").alias("ok"), of("close").alias("close"), of("bad").alias("bad"), F.count_if("flipped").alias("flipped"))
    share = lambda c: F.round(F.try_divide(100.0 * c, F.col("clips")), 1)
    return t.select("*", share(F.col("ok")).alias("ok_percent"), share(F.col("ok") + F.col("close")).alias("within_percent"))


def first_flips(graded: DataFrame, most: int = 40) -> DataFrame:
    """The first ``most`` flipped rows in input order, as the report lists them, with all their columns (old, new and true times)."""
    return graded.filter("flipped").orderBy("pos").limit(most)


def verdict(n_truth: Column, tp: Column, missed: Column, extra: Column) -> Column:
    return (
        F.when((n_truth == 0) & (extra == 0), "correct_none").when(n_truth == 0, "false_positive").when(tp == 0, "missed").when((missed == 0) & (extra == 0), "correct").otherwise("partial")
    )


def with_verdict(matched: DataFrame) -> DataFrame:
    return matched.withColumn("verdict", verdict(F.size(F.coalesce("truth", F.array().cast("array<double>"))), F.col("tp"), F.col("missed"), F.col("extra")))


def totals(matched: DataFrame, *by: str) -> DataFrame:
    """tp, missed, extra, precision and recall in percent (100 without a denominator), share of clips wholly right, mean error."""
    g = matched.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("missed").alias("missed"), F.sum("extra").alias("extra"), F.count("*").alias("clips"),
        F.count_if((F.col("missed") == 0) & (F.col("extra") == 0)).alias("full"), F.sum(F.aggregate("errors", F.lit(0.0), lambda a, e: a + e)).alias("error"),
    )
    share = lambda d: F.when(F.col("tp") + F.col(d) == 0, F.lit(100.0)).otherwise(100.0 * F.col("tp") / (F.col("tp") + F.col(d)))
    return g.select(*by, "tp", "missed", "extra", "clips", "full", share("extra").alias("precision"), share("missed").alias("recall"), F.try_divide(F.col("error"), F.col("tp")).alias("mean_error"), F.try_divide(100.0 * F.col("full"), F.col("clips")).alias("full_percent"))


def first_cut_right(truth: Column, pred: Column, tolerance: float) -> Column:
    """Both empty, or both first events there and within the tolerance."""
    g, p = F.get(truth, F.lit(0)), F.get(pred, F.lit(0))
    return F.when(g.isNull() & p.isNull(), True).otherwise(F.coalesce(F.abs(g - p) <= tolerance, F.lit(False)))


def first_offsets(pairs: DataFrame, limit: float = 1.0) -> DataFrame:
    """Count, mean, median and mean size of the offset of the first event, truth less prediction, where both exist and it is at most ``limit``."""
    d = F.get("truth", F.lit(0)) - F.get("pred", F.lit(0))
    return pairs.withColumn("d", d).filter(F.abs("d") <= limit).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.avg(F.abs("d")).alias("mae"))


def grade(old: Column, new: Column, close: float = 1.5, good: float = 0.5) -> Column:
    """ok if both are null or at most ``good`` apart, close up to ``close``, else bad."""
    d = F.abs(old - new)
    return F.when((old.isNull() & new.isNull()) | (d <= good), "ok").when(d <= close, "close").otherwise("bad")


def flipped(old: Column, new: Column, moved: float = 0.5) -> Column:
    """One of both is null, or they are more than ``moved`` apart."""
    return (old.isNull() != new.isNull()) | F.coalesce(F.abs(old - new) > moved, F.lit(False))
