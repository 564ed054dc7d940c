"""Sections, categories, counts, split plans and other bookkeeping around the cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlab.functions.text import html_escape, percent_of, seconds, stem, verdict_colour
from cutlab.operators.series import label_counter
from cutlab.sources.shared import keep

SECTIONS = ("problem", "none", "multicut", "clean")
CATEGORIES = ("unlabeled", "problem", "none", "multicut", "clean")
PROBLEMS = ("wrong_time", "missed", "false_positive")


def section(verdict: Column, cut: Column, n_shots: Column, problems: tuple[str, ...] = PROBLEMS, many: int = 4) -> Column:
    return F.when(verdict.isin(*problems), "problem").when(cut.isNull(), "none").when(n_shots >= many, "multicut").otherwise("clean")


def category(edited: Column, verdict: Column, cut: Column, n_segments: Column, good: tuple[str, ...] = ("correct", "correct_none")) -> Column:
    """Unlabeled only where ``edited`` is false; a missing mark is not false."""
    return F.when(edited == F.lit(False), "unlabeled").when(verdict.isNotNull() & ~verdict.isin(*good), "problem").when(cut.isNull(), "none").when(n_segments > 2, "multicut").otherwise("clean")


def rank_of(value: Column, names: tuple[str, ...]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, name in enumerate(names):
        out = out.when(value == name, k)
    return out.otherwise(len(names))


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds place: the row's position, from 1, in the order of the whole table.

    Rows are dealt out by ranges of the order and numbered within each range,
    from the counts of the ranges before it; no task sees more than a range.
    ``order`` should leave no ties.
    """
    dealt = keep(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy("range_").agg(F.count("*").alias("n")).select("range_", before.alias("before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return dealt.withColumn("own_", own).join(counts, "range_").withColumn("place", F.col("own_") + F.col("before")).drop("range_", "own_", "before")


def by_section(rows: DataFrame) -> DataFrame:
    """In section order, then by time with missing times last, then by input position."""
    return rows.orderBy(rank_of(F.col("section"), SECTIONS), F.col("cut").asc_nulls_last(), "pos")


def by_category(rows: DataFrame) -> DataFrame:
    return rows.orderBy(rank_of(F.col("category"), CATEGORIES), F.col("cut").asc_nulls_last(), "pos")


def workbench(records: DataFrame, truth: DataFrame, segments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per record (clip, pos, cut) with what the workbench shows of it.

    truth: clip, edited; segments: clip, start, end; verdicts: clip, verdict; none
    of them has to know the clip. A clip without segments counts one. ``dur`` is
    the end of the last segment, at least 1.
    """
    s = segments.groupBy("clip").agg(F.count("*").alias("n"), F.max("end").alias("last"))
    r = records.join(truth.select("clip", "edited"), "clip", "left").join(s, "clip", "left").join(verdicts.select("clip", "verdict"), "clip", "left")
    r = r.withColumn("n_segments", F.coalesce("n", F.lit(1))).withColumn("dur", F.greatest(F.coalesce("last", F.lit(1.0)), F.lit(1.0)))
    r = r.withColumn("category", category(F.col("edited"), F.col("verdict"), F.col("cut"), F.col("n_segments")))
    return r.select("clip", "pos", "cut", "n_segments", "dur", percent_of(F.col("cut"), F.col("dur")).alias("percent"), "category")


def bad_clips(flags: DataFrame) -> DataFrame:
    """The clips flagged bad, for export."""
    return flags.filter("flag = 'bad'").select("clip")


def counts_by(rows: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """Counts, most frequent first; of equals the one seen first."""
    g = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))
    return g.orderBy(F.desc("n"), "first_pos").select(column, "n")


def verdict_summary(rows: DataFrame) -> DataFrame:
    """One row of counts of each verdict group."""
    of = lambda *names: F.count_if(F.col("verdict").isin(*names))
    g = rows.agg(F.count("*").alias("total"), of("correct").alias("correct"), of("close").alias("close"), of("correct_none").alias("correct_none"), of("missed", "false_positive", "wrong_time").alias("problems"))
    strict = 100.0 * (F.col("correct") + F.col("correct_none"))
    return g.withColumn("strict_percent", F.round(F.try_divide(strict, F.col("total")), 1)).withColumn("within_percent", F.round(F.try_divide(strict + 100.0 * F.col("close"), F.col("total")), 1))


def workbench_counts(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Counts per category, of labelled rows, of verdict groups, and of flags (not of flagged rows)."""
    g = rows.agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES], F.count_if(F.col("category") != "unlabeled").alias("labelled"),
        F.count_if(F.col("verdict").isin("correct", "correct_none")).alias("good"), F.count_if(F.col("verdict") == "partial").alias("partial"), F.count_if(F.col("verdict").isin("missed", "false_positive")).alias("bad"),
    )
    f = flags.agg(F.count_if(F.col("flag").isNotNull()).alias("flagged"), F.count_if(F.col("flag") == "bad").alias("flagged_bad"))
    return g.crossJoin(f)  # two single rows


def cards(rows: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Texts of a report's cards, and the thumbnail of each clip if a file of that name exists."""
    wanted = F.concat(stem(F.col("clip")), F.lit("_"), F.col("section"), F.lit(".jpg"))
    files = thumbnails.select(F.col("path").alias("thumbnail")).distinct().withColumn("wanted", F.element_at(F.split("thumbnail", "/"), -1))
    r = rows.withColumn("wanted", wanted).join(files, "wanted", "left").drop("wanted")
    return r.select("clip", "section", "thumbnail", html_escape(F.col("clip")).alias("title"), seconds(F.col("cut")).alias("cut_text"), html_escape(F.coalesce("notes", F.lit(""))).alias("notes_html"), verdict_colour(F.col("verdict")).alias("colour"))


def split_plan(segments: DataFrame, clips: DataFrame, root: str = "split") -> DataFrame:
    """One action a segment, and one row for every clip that gets none.

    clips: clip, name, exists. A missing source comes first, then a clip without
    segments; a single segment copies the whole file, several are cut.
    """
    n = F.count("*").over(Window.partitionBy("clip"))
    s = label_counter(segments).withColumn("n", n).select("clip", "seg_idx", "label", "k", "start", "end", "n")
    r = clips.join(s, "clip", "left").withColumn("stem", stem(F.col("name")))
    usable = F.col("exists") & F.col("n").isNotNull()
    disposition = F.when(~F.col("exists"), "skip_missing_src").when(F.col("n").isNull(), "skip_no_segments").when(F.col("n") == 1, "single_segment").otherwise(F.format_string("multi_%dseg", "n"))
    file = F.concat(F.lit(f"{root}/"), F.col("label"), F.lit("/"), F.col("stem"), F.lit("_"), F.col("label"), F.lit("_"), F.col("k").cast("string"), F.lit(".mp4"))
    r = r.select(
        "clip", "name", disposition.alias("disposition"), F.when(usable, F.col("seg_idx")).alias("seg_idx"), F.when(usable, F.col("label")).alias("label"), F.when(usable, F.col("k")).alias("index"), F.when(usable, file).alias("file"),
        F.when(usable, F.col("start")).alias("start"), F.when(usable, F.col("end")).alias("end"), F.when(usable, F.col("end") - F.col("start")).alias("dur"),
        F.when(usable & (F.col("n") == 1), "copy").when(usable, "cut").alias("mode"),
    )
    # A missing source gives one row, however many segments it has.
    first = F.row_number().over(Window.partitionBy("clip", F.col("disposition") == "skip_missing_src").orderBy("seg_idx", "start")) == 1
    return r.withColumn("one", first).filter((F.col("disposition") != "skip_missing_src") | F.col("one")).drop("one")


def clip_video_plan(segments: DataFrame, clips: DataFrame, root: str = "segments") -> DataFrame:
    """Numbered segment files in a folder a clip, never shorter than 0.05."""
    s = segments.join(clips, "clip").withColumn("stem", stem(F.col("name")))
    file = F.concat(F.lit(f"{root}/"), F.col("stem"), F.lit("/"), F.format_string("%02d_%s.mp4", F.col("seg_idx") + 1, F.col("label")))
    return s.select("clip", "seg_idx", file.alias("file"), "start", F.greatest(F.lit(0.05), F.col("end") - F.col("start")).alias("dur"))


def manifest(plan: DataFrame, records: DataFrame) -> DataFrame:
    """One nested row for every record (clip, short, pattern, n_segments), with its disposition and the files of its split plan."""
    fields = ("label", "index", "file", "start", "end", "dur", "mode")
    row = F.struct("seg_idx", *fields[:2], F.element_at(F.split("file", "/"), -1).alias("file"), *fields[3:])
    out = F.array_sort(F.collect_list(F.when(F.col("file").isNotNull(), row)))
    listed = plan.groupBy("clip", "disposition").agg(F.transform(out, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("outputs"))
    return records.select("clip", "short", "pattern", F.coalesce("n_segments", F.lit(0)).alias("n_segments")).join(listed, "clip").select("clip", "short", "pattern", "n_segments", "disposition", "outputs")


def qa_frames(cuts: DataFrame, step: float = 0.15) -> DataFrame:
    """Times just before and after each cut, not below 0."""
    return cuts.filter("cut is not null").select("clip", "cut", F.greatest(F.lit(0.0), F.col("cut") - step).alias("qa_before"), (F.col("cut") + step).alias("qa_after"))


def with_errors(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Good rows and error rows of another shape, in one table."""
    return good.unionByName(bad, allowMissingColumns=True)
