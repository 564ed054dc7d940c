"""Faces in frames: gates, scores, and a robust centroid of one identity. Vectors are opaque arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlab.functions.text import nominal_frame
from cutlab.functions.vectors import dot, doubles, normalise, similarity
from cutlab.operators.series import nearest
from cutlab.sources.shared import keep


def retry_empty(frames: DataFrame) -> DataFrame:
    """Where a frame has no faces, those found on its enhanced copy; ``rescued`` marks where that helped."""
    tried = F.size("faces") == 0
    return frames.withColumn("tried", tried).withColumn("rescued", tried & (F.coalesce(F.size("faces_enhanced"), F.lit(0)) > 0)).withColumn("faces", F.when(tried, F.coalesce("faces_enhanced", "faces")).otherwise(F.col("faces"))).drop("faces_enhanced")


def gate_faces(frames: DataFrame, least_score: float = 0.0, least_share: float = 0.0) -> DataFrame:
    """Drops faces scored too low (a missing score is 1) or too small for the frame's height; a limit of 0 is off."""
    h = F.greatest(F.col("height"), F.lit(1))

    def fine(f):
        ok = F.lit(True)
        if least_score > 0:
            ok = ok & (F.coalesce(f["det_score"], F.lit(1.0)) >= least_score)
        if least_share > 0:
            ok = ok & ((F.get(f["bbox"], F.lit(3)) - F.get(f["bbox"], F.lit(1))) / h >= least_share)
        return ok

    return frames.withColumn("all_faces", F.col("faces")).withColumn("faces", F.filter("faces", fine))


def detection_stats(frames: DataFrame) -> DataFrame:
    """Counters before (det_) and after the gates, and shares of frames in percent, 0 without frames."""
    g = frames.agg(
        F.count("*").alias("frames"), F.coalesce(F.sum(F.size("all_faces")), F.lit(0)).alias("det_faces"), F.count_if(F.size("all_faces") > 0).alias("det_frames_with_face"),
        F.coalesce(F.sum(F.size("faces")), F.lit(0)).alias("faces"), F.count_if(F.size("faces") > 0).alias("frames_with_face"), F.count_if("tried").alias("lowlight_tried"), F.count_if("rescued").alias("lowlight_rescued"),
    )
    share = lambda c: F.coalesce(F.round(F.try_divide(100.0 * F.col(c), F.col("frames")), 2), F.lit(0.0)).alias(f"{c}_percent")
    return g.select("*", share("det_frames_with_face"), share("frames_with_face"))


def best_similarity(frames: DataFrame, scores: DataFrame, *by: str) -> DataFrame:
    """The highest score of each frame, at least 0; frames without any keep 0."""
    best = scores.groupBy(*by).agg(F.max(F.when(~F.isnan("sim"), F.col("sim"))).alias("best"))
    return frames.join(best, list(by), "left").withColumn("best_sim", F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0)))).drop("best")


def largest_face(faces: DataFrame, *by: str) -> DataFrame:
    """The face with the largest area of each frame, the first of equals."""
    top = faces.groupBy(*by).agg(F.max(F.struct("area", (-F.col("face_no")).alias("minus"))).alias("top"))
    return top.select(*by, (-F.col("top.minus")).alias("face_no"), F.col("top.area").alias("area"))


def shot_medians(shots: DataFrame, curve: DataFrame, samples: int = 3) -> DataFrame:
    """Shots with sim: the median score at ``samples`` times spread evenly over the shot."""
    k = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    p = shots.withColumn("k", k).withColumn("at", F.col("start") + (F.col("end") - F.col("start")) * (F.col("k") + 0.5) / samples)
    near = nearest(p, curve.select("clip", F.col("i").alias("idx"), F.col("t").alias("pts"))).join(curve.select("clip", F.col("i").alias("idx"), F.col("sim").alias("s")), ["clip", "idx"], "left")
    return near.groupBy(*shots.columns).agg(F.median(F.coalesce("s", F.lit(0.0))).alias("sim"))


def _mean_direction(vectors: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """(by, centroid) of the groups with at least ``least`` vectors.

    Sums are one aggregation with a sum a component, merged on the way: a task
    sends one vector a group, however many rows it has.
    """
    first = vectors.select(F.size("unit").alias("n")).first()
    sums = F.array(*[F.sum(F.get("unit", F.lit(i))) for i in range(first.n if first else 0)]).cast("array<double>")
    mean = vectors.groupBy(*by).agg(sums.alias("total"), F.count("*").alias("k")).filter(F.col("k") >= least)
    return mean.select(*by, normalise(F.transform("total", lambda x: x / F.col("k"))).alias("centroid"))


def _beside(vectors: DataFrame, centres: DataFrame, by: list[str]) -> DataFrame:
    """Vectors with their group's centroid; without groups there is one row of it."""
    return vectors.join(centres, by) if by else vectors.crossJoin(F.broadcast(centres))


def trimmed_centroid(vectors: DataFrame, by: list[str], vector_col: str = "embedding", inlier: float = 0.35, least: int = 5, passes: int = 4) -> DataFrame:
    """(by, centroid, n, n_inliers, coverage): the mean direction, trimmed to its inliers again and again.

    A pass that leaves fewer than ``least`` inliers keeps the centroid of the
    pass before it. No vector gives no row. Unit vectors and the centroids of
    each pass (one row a group) are kept, so that passes add up. Without ``by``
    all rows are one group.
    """
    units = keep(vectors.select(*by, normalise(doubles(F.col(vector_col))).alias("unit")))
    centre = keep(_mean_direction(units, by))
    for _ in range(passes):
        near = _beside(units, centre, by).filter(dot(F.col("unit"), F.col("centroid")) >= inlier)
        trimmed = _mean_direction(near, by, least).withColumnRenamed("centroid", "trimmed")
        both = centre.join(trimmed, by, "left") if by else centre.join(trimmed, F.lit(True), "left")
        centre = keep(both.select(*by, F.coalesce("trimmed", "centroid").alias("centroid")))
    scored = _beside(units, centre, by).withColumn("near", dot(F.col("unit"), F.col("centroid")) >= inlier)
    counts = scored.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("near").alias("n_inliers"))
    return _beside(counts, centre, by).select(*by, "centroid", "n", "n_inliers", (F.col("n_inliers") / F.col("n")).alias("coverage"))


def area(bbox: Column) -> Column:
    side = lambda a, b: F.get(bbox, F.lit(b)) - F.get(bbox, F.lit(a))
    return side(0, 2) * side(1, 3)


def enrol(faces: DataFrame, clips: DataFrame, at: float = 1.0, **options) -> DataFrame:
    """One row (centroid, n, n_inliers, coverage): the identity that opens most clips; no row without faces.

    faces: clip, idx, face_no, bbox, embedding; clips: clip, fps, total. Of each
    clip the largest face of the frame at ``at`` seconds counts, the first of
    equals; clips without one are left out.
    """
    frame = clips.select("clip", nominal_frame(F.lit(at), F.col("fps"), F.col("total")).alias("idx"))
    seen = faces.join(frame, ["clip", "idx"]).withColumn("area", area(F.col("bbox")))
    largest = largest_face(seen, "clip").select("clip", "face_no")
    return trimmed_centroid(seen.join(largest, ["clip", "face_no"]).select("embedding"), [], **options)


def face_similarities(faces: DataFrame, identity: DataFrame) -> DataFrame:
    """Faces with sim, the similarity to the one row of ``identity``; none without that row."""
    return faces.crossJoin(F.broadcast(identity.select("centroid"))).withColumn("sim", similarity(F.col("embedding"), F.col("centroid"))).drop("centroid")


def frame_scores(faces: DataFrame, identity: DataFrame) -> DataFrame:
    """(clip, idx, sim): the highest similarity of each frame's faces to the one row of ``identity``, at least 0; frames without faces have no row."""
    return face_similarities(faces, identity).groupBy("clip", "idx").agg(F.max("sim").alias("sim"))


def similarity_colour(sim: Column, threshold: float = 0.35, band: float = 0.10) -> Column:
    """green from the threshold on, yellow within ``band`` below it, else red (a null or NaN similarity too)."""
    known = F.when(~F.isnan(sim), sim)
    return F.when(known >= threshold, "green").when(known >= threshold - band, "yellow").otherwise("red")


def overlay(frames: DataFrame, faces: DataFrame, threshold: float = 0.35, stride: int = 2, band: float = 0.10) -> DataFrame:
    """What to draw on each frame: (clip, idx, t, boxes, best, label, caption).

    frames: clip, idx, fps; faces: clip, idx, face_no, bbox, sim. Faces are
    looked at on every ``stride``-th frame, and the frames up to the next one
    hold them. boxes are ordered by face_no, equal ones by bbox and similarity, each with its
    colour and the similarity as text; best is the highest one, at least 0, and ``CREATOR``
    from the threshold on, else ``meme``. A frame without faces has no boxes.
    A missing or zero rate counts as 25. A similarity that is null or NaN is
    drawn as 0. Frames in the outcome are as many as given.

    A frame's boxes are one small group; frames meet them by (clip, frame looked
    at), one shuffle of each side.
    """
    sim = F.coalesce(F.when(~F.isnan("sim"), F.col("sim")), F.lit(0.0))
    box = F.struct("face_no", "bbox", sim.alias("sim"), similarity_colour(sim, threshold, band).alias("colour"), F.format_string("%.2f", sim).alias("text"))
    seen = faces.filter(F.col("idx") % stride == 0).groupBy("clip", F.col("idx").alias("from")).agg(F.array_sort(F.collect_list(box)).alias("boxes"), F.max(sim).alias("top"))
    rate = F.coalesce(F.when(F.col("fps") > 0, F.col("fps")), F.lit(25.0))
    held = frames.withColumn("from", F.col("idx") - F.col("idx") % stride).join(seen, ["clip", "from"], "left")
    none = F.array().cast(seen.schema["boxes"].dataType)
    r = held.select("clip", "idx", (F.col("idx") / rate).alias("t"), F.coalesce("boxes", none).alias("boxes"), F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0)).alias("best"))
    r = r.withColumn("label", F.when(F.col("best") >= threshold, "CREATOR").otherwise("meme"))
    # Fixed format of the line below a frame.
    return r.withColumn("caption", F.format_string("t=%4.2fs  max=%.2f  thr=%.2f  -> %s", "t", "best", F.lit(float(threshold)), "label"))


def rank_within(rows: DataFrame, by: list[str], *order) -> DataFrame:
    return rows.withColumn("face_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
