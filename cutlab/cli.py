"""Command line over the documents that the stages exchange: relabel, curves, segment, evaluate, sweep, inspect, split, report, blank, debug."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlab.functions.text import short_id
from cutlab.operators import curves, identity, match, place, relabel, report, series, truth
from cutlab.plans.sweep import sweep
from cutlab.sources import documents as D
from cutlab.sources.shared import keep


def curves_of(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(clips, samples, luma, cuts) of a curve document, keyed by short name."""
    # A curve names a first time where the key is there, even with a null; a schema alone cannot tell that.
    raw = D.required(lambda: spark.read.option("wholetext", True).text(path), f"no curves at {path}: run the curves stage first")
    raw = raw.select(F.explode(F.from_json("value", "map<string, string>")).alias("key", "raw"))
    docs = raw.select(F.col("key").alias("short"), F.array_contains(F.json_object_keys("raw"), "first_true").alias("has_first"), F.from_json("raw", D.CURVE).alias("v"))
    docs = docs.select("short", "has_first", "v.*").withColumnRenamed("clip", "name").withColumnRenamed("short", "clip")
    return docs.select("clip", "name", "dur", "has_first", "first_true", "method"), *D.long_curves(docs)


def base_of(spark: SparkSession, path: str) -> DataFrame:
    rows = D.optional(spark, lambda: D.read_rows(spark, path, D.TRANSITIONS), D.TRANSITIONS)
    return rows.select(short_id(F.col("clip")).alias("clip"), F.col("transition_sec").alias("base_cut"), F.col("method").alias("base_method"), "shots", "error")


def records(clips: DataFrame, base: DataFrame) -> DataFrame:
    """Curves left join the base records."""
    r = clips.join(base.select("clip", "base_cut", "base_method"), "clip", "left")
    return r.withColumn("method", F.coalesce(F.nullif("method", F.lit("")), "base_method"))


def truth_of(spark: SparkSession, path: str) -> DataFrame:
    t = D.required(lambda: D.read_truth(spark, path), f"no labels at {path}")
    return t.select(F.col("short").alias("clip"), F.col("cuts.sec").alias("cuts"), F.col("cut_sec").alias("cut"), "edited", "pattern", "notes")


def segment_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = D.optional(spark, lambda: D.read_rows(spark, path, D.SEGMENTS), D.SEGMENTS)
    rows = rows.select(F.col("short").alias("clip"), F.posexplode("segments").alias("seg_idx", "s"))
    return rows.select("clip", "seg_idx", "s.start", "s.end", "s.label", "s.dur", "s.face_sim")


def do_segment(spark: SparkSession, a: argparse.Namespace) -> None:
    clips, samples, luma, cuts = curves_of(spark, a.curves)
    config = place.Config(a.threshold, a.penalty, not a.no_snap, a.snap_window, not a.no_refine)
    segments, decisions = place.segment_clips(records(clips, base_of(spark, a.base)), samples, cuts, luma, config)
    docs = place.segment_documents(segments)
    named = docs.join(clips.select("clip", "name"), "clip").join(decisions, "clip")
    fields = lambda *names: F.transform("segments", lambda s: F.struct(*[s[old].alias(new) for old, new in names]))
    own = fields(("start", "start"), ("end", "end"), ("label", "label"), ("dur", "dur"), ("face_sim", "face_sim"))
    D.write_document(named.select(F.col("name").alias("clip"), F.col("clip").alias("short"), "n_segments", "pattern", own.alias("segments")).orderBy("clip"), a.out_segments)
    shots = fields(("start", "start_sec"), ("end", "end_sec"), ("label", "label"), ("face_sim", "face_sim"))
    D.write_document(named.select(F.col("name").alias("clip"), F.col("cut").alias("transition_sec"), "method", F.col("n_segments").alias("num_shots"), shots.alias("shots")).orderBy("clip"), a.out_transitions)


def do_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    base = base_of(spark, a.transitions)
    shots = base.select("clip", F.posexplode("shots").alias("shot_idx", "s")).select("clip", "shot_idx", F.col("s.start_sec").alias("start"), "s.label")
    flips = series.label_flips(shots).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("shot_idx", "start"))).getField("start").alias("flips"))
    rows = match.evaluation(truth_of(spark, a.truth), segment_rows(spark, a.segments), base.select("clip", F.col("base_cut").alias("picked")).join(flips, "clip", "left"), a.tolerance, a.rule)
    match.totals(rows).show(truncate=False)
    rows.groupBy("verdict").agg(F.count("*").alias("n")).orderBy(F.desc("n")).show()
    rows.filter(~F.col("verdict").isin("correct", "correct_none")).select("clip", "truth", "pred", "verdict").orderBy("clip").show(a.most, truncate=False)


def do_sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    clips, samples, luma, cuts = curves_of(spark, a.curves)
    truth = truth_of(spark, a.truth).select("clip", match.truth_cuts(F.col("cuts"), F.col("cut")).alias("truth"))
    sweep(spark, records(clips, base_of(spark, a.base)), samples, cuts, luma, truth, a.tolerance, a.top).show(a.top, truncate=False)


def do_inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    _, samples, _, cuts = curves_of(spark, a.curves)
    truth = truth_of(spark, a.truth).select("clip", F.explode(match.truth_cuts(F.col("cuts"), F.col("cut"))).alias("t"), F.lit("truth").alias("kind"))
    place.inspect(samples, truth.unionByName(cuts.select("clip", "t", F.lit("cut").alias("kind"))), a.clip).orderBy("i").show(100_000, truncate=False)


def do_relabel(spark: SparkSession, a: argparse.Namespace) -> None:
    """Faces and frames are tables that the models' adapters write: faces (clip, idx, face_no, bbox, det_score, embedding), frames (clip, fps, total, height)."""
    records = D.only(D.required(lambda: D.read_rows(spark, a.transitions, D.TRANSITIONS), f"no records at {a.transitions}: run the detection first"), limit=a.limit)
    files = D.list_files(spark, a.clips).select(F.col("name").alias("clip"))
    frames = spark.read.parquet(a.frames)
    faces = spark.read.parquet(a.faces)
    if a.min_det_score > 0:
        faces = faces.filter(F.coalesce("det_score", F.lit(1.0)) >= a.min_det_score)
    if a.min_face_frac > 0:
        height = F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1))
        faces = faces.join(frames.select("clip", "height"), "clip").filter(height / F.greatest("height", F.lit(1)) >= a.min_face_frac).drop("height")
    usable = D.usable(records, files.withColumnRenamed("clip", "name"))
    one = keep(identity.enrol(faces.join(usable.select("clip"), "clip", "left_semi"), frames))
    scores = identity.frame_scores(faces, one)
    options = relabel.Options(a.threshold, a.frames_per_shot, soft=not a.no_soft, second=not a.no_second)
    second = long_shots(D.read_rows(spark, a.second, D.TRANSITIONS)) if a.second else None
    shots, decided = relabel.relabel(long_shots(usable), frames, scores, second, options)
    out = keep(relabel.documents(records, files, shots, decided))
    D.write_document(out.orderBy("clip"), a.out, optional=("qa_image", "error", "face_error"))
    report.counts_by(out, "method", "clip").show(truncate=False)
    one.select("n", "n_inliers", "coverage").show()
    if a.truth:
        graded = keep(against_truth(records, out, truth_of(spark, a.truth)))
        match.grade_totals(graded).show(truncate=False)
        match.first_flips(graded).select("clip", "old", "new", "true").show(40, truncate=False)


def against_truth(old: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """(pos, clip, old, new, true, grade, flipped) of each record: the cut before, after, and the first true one."""
    cut = lambda rows, name: rows.select("clip", F.col("transition_sec").alias(name))
    rows = cut(new, "new").join(cut(old, "old"), "clip", "left").select(F.col("clip").alias("pos"), short_id(F.col("clip")).alias("clip"), "old", "new")
    rows = rows.join(known.select("clip", F.get(match.truth_cuts(F.col("cuts"), F.col("cut")), F.lit(0)).alias("true")), "clip", "left")
    return rows.select("*", match.grade(F.col("true"), F.col("new")).alias("grade"), match.flipped(F.col("old"), F.col("new")).alias("flipped"))


def long_shots(records: DataFrame) -> DataFrame:
    s = records.select("clip", F.posexplode("shots").alias("i", "s"))
    return s.select("clip", "i", F.col("s.start_sec").alias("start"), F.col("s.end_sec").alias("end"), "s.start_frame", "s.end_frame")


def do_curves(spark: SparkSession, a: argparse.Namespace) -> None:
    """Frames, scores and luma are tables that the models' adapters write: (clip, idx, pts), (clip, idx, sim), (clip, idx, mean)."""
    records = D.required(lambda: D.read_rows(spark, a.transitions, D.TRANSITIONS), f"no records at {a.transitions}: run the detection first")
    tables = curves.dump(records, *(spark.read.parquet(p) for p in (a.frames, a.scores, a.luma)), a.sample_fps, a.luma_fps)
    if a.table:
        curves.save(tables, a.table)
    rows = curves.documents(tables, a.sample_fps, a.luma_fps)
    # The document names a clip by its short id, as the key, and in full, as a field.
    D.write_document(rows.orderBy("short"), a.out, "short")


def do_split(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every record gets a row, whether its file is there or not."""
    records = D.only(D.required(lambda: D.read_rows(spark, a.segments, D.SEGMENTS), f"no segments at {a.segments}: run the segmentation first"), a.only, a.limit, "short")
    files = D.list_files(spark, a.clips).select("name", F.lit(True).alias("there"))
    s = records.select("clip", F.posexplode("segments").alias("seg_idx", "s")).select("clip", "seg_idx", "s.start", "s.end", "s.label")
    clips = records.select("clip", F.col("clip").alias("name")).join(files, "name", "left").select("clip", "name", F.coalesce("there", F.lit(False)).alias("exists"))
    rows = records.withColumn("n_segments", F.coalesce(F.size("segments"), F.lit(0)))
    D.write_document(report.manifest(report.split_plan(s, clips), rows).orderBy("clip"), a.out)


def do_report(spark: SparkSession, a: argparse.Namespace) -> None:
    schema = "key string, s string, true_sec double, verdict string, confidence string, notes string, corrected boolean"
    v = D.optional(spark, lambda: D.read_map(spark, a.verification, D.VERDICT, "by_clip"), schema).select(F.col("key").alias("clip"), "verdict", "notes")
    r = base_of(spark, a.transitions).select("clip", F.col("base_cut").alias("cut"), F.size("shots").alias("n_shots"), F.col("clip").alias("pos")).join(v, "clip", "left")
    report.verdict_summary(v).show()
    report.by_section(r.withColumn("section", report.section(F.col("verdict"), F.col("cut"), F.col("n_shots")))).show(a.most, truncate=False)


def do_blank(spark: SparkSession, a: argparse.Namespace) -> None:
    """The first version of the labels stays beside them; running it again changes nothing."""
    document = keep(D.required(lambda: D.read_rows(spark, f"{a.folder}/{a.name}", D.TRUTH), f"no labels at {a.folder}/{a.name}"))
    truth.blanking_counts(document.select(F.inline("clips"))).show()
    D.save_truth(truth.blanked_document(document), a.folder, a.name, (a.name,))


def do_debug(spark: SparkSession, a: argparse.Namespace) -> None:
    """A folder of JSON lines that says what to draw on each frame. Tables as for relabel, frames with a row a frame in ``every``: (clip, idx, fps)."""
    records = D.required(lambda: D.read_rows(spark, a.transitions, D.TRANSITIONS), f"no records at {a.transitions}: run the detection first")
    faces, frames, every = (spark.read.parquet(p) for p in (a.faces, a.frames, a.every))
    one = keep(identity.enrol(faces.join(records.select("clip"), "clip", "left_semi"), frames))
    chosen = D.only(records.select("clip", short_id(F.col("clip")).alias("short")), a.only, a.limit, "short").select("clip")
    seen = identity.face_similarities(faces.join(chosen, "clip", "left_semi"), one)
    D.write_documents(identity.overlay(every.join(chosen, "clip", "left_semi"), seen, a.threshold, a.stride), a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cutlab", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, act, /, *paths: str, **options) -> None:
        c = sub.add_parser(name)
        c.set_defaults(act=act)
        for path in paths:
            c.add_argument(f"--{path}", required=True)
        for option, default in options.items():
            flag = f"--{option.replace('_', '-')}"
            if default is False:
                c.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                c.add_argument(flag, nargs="*", default=default)
            else:
                c.add_argument(flag, type=type(default), default=default)

    command("relabel", do_relabel, "transitions", "clips", "frames", "faces", "out", second="", truth="", threshold=0.35, frames_per_shot=3, no_soft=False, no_second=False, min_det_score=0.0, min_face_frac=0.0, limit=0)
    command("curves", do_curves, "transitions", "frames", "scores", "luma", "out", table="", sample_fps=10.0, luma_fps=15.0)
    command("segment", do_segment, "curves", "base", "out-segments", "out-transitions", threshold=0.32, penalty=1.0, snap_window=0.35, no_snap=False, no_refine=False)
    command("evaluate", do_evaluate, "truth", "segments", "transitions", tolerance=0.5, rule="flips", most=1000)
    command("sweep", do_sweep, "curves", "base", "truth", tolerance=0.5, top=15)
    command("inspect", do_inspect, "curves", "truth", "clip")
    command("split", do_split, "segments", "clips", "out", only=[], limit=0)
    command("report", do_report, "transitions", "verification", most=1000)
    command("blank", do_blank, "folder", name="ground_truth.json")
    command("debug", do_debug, "transitions", "frames", "every", "faces", "out", threshold=0.35, stride=2, only=[], limit=0)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.act(SparkSession.builder.appName("cutlab").getOrCreate(), a)


if __name__ == "__main__":
    main()
