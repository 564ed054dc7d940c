"""What stages hand on: versions, actions with outcomes, the curve cache, and the commands between detection and segmentation."""

import json
import os
import random
import threading

import pytest
from cutlab import cli
from cutlab.operators import curves, identity, place
from cutlab.sources import adapters, documents
from pyspark.sql import functions as F


def test_a_job_rewrites_what_it_reads_beside_a_reader(spark, tmp_path):
    root = str(tmp_path / "data")
    with pytest.raises(FileNotFoundError, match="no version"):
        documents.current_version(spark, root)
    documents.write_version(spark.range(100), root)
    pinned = spark.read.parquet(documents.current_version(spark, root))
    seen, stop = [], threading.Event()

    def reader():
        while not stop.is_set():
            seen.append(spark.read.parquet(documents.current_version(spark, root)).count())

    thread = threading.Thread(target=reader)
    thread.start()
    for _ in range(3):
        now = spark.read.parquet(documents.current_version(spark, root))
        documents.write_version(now.union(now), root)
    stop.set()
    thread.join()
    assert set(seen) <= {100, 200, 400, 800} and pinned.count() == 100
    current = documents.current_version(spark, root)
    assert spark.read.parquet(current).count() == 800
    assert documents.expire_versions(spark, root, 2) == 2 and documents.current_version(spark, root) == current and spark.read.parquet(current).count() == 800


def test_actions_give_outcomes_and_resume(spark, tmp_path):
    folder = str(tmp_path)

    def act(row):
        if row["n"] % 3 == 0 and not os.path.exists(f"{folder}/mended"):
            raise OSError(f"no source for {row['file']}")

        def write(name):
            with open(name, "w") as f:
                f.write(str(row["n"]))

        adapters.aside(f"{folder}/{row['file']}", write)

    plan = spark.createDataFrame([(f"out/{k}.mp4", k) for k in range(12)], "file string, n int").repartition(3)
    first = spark.createDataFrame(adapters.execute(plan, act).collect())
    got = {r.n: (r.outcome, r.error) for r in first.collect()}
    assert {n for n, (o, _) in got.items() if o == "error"} == {0, 3, 6, 9} and got[3][1] == "OSError: no source for out/3.mp4" and got[1] == ("done", None)
    (tmp_path / "mended").write_text("")
    (tmp_path / "out" / "1.mp4").write_text("kept")
    again = {r.n: r.outcome for r in adapters.execute(plan, act, first).collect()}
    assert {n for n, o in again.items() if o == "done"} == {0, 3, 6, 9} and set(again.values()) == {"done", "skipped"}
    assert (tmp_path / "out" / "1.mp4").read_text() == "kept" and sorted(os.listdir(tmp_path / "out")) == sorted(f"{k}.mp4" for k in range(12))

    def broken(name):
        open(name, "w").close()
        raise ValueError

    with pytest.raises(ValueError):
        adapters.aside(f"{folder}/out/x.mp4", broken)
    assert not os.path.exists(f"{folder}/out/x.mp4") and len(os.listdir(tmp_path / "out")) == 12


def test_kept_tables_go_when_released(spark):
    from cutlab.sources import shared

    shared.release(spark)
    kept = shared.keep(spark.range(5))
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert kept.count() == 5 and os.path.exists(path)
    assert shared.release(spark) == 1 and not os.path.exists(path) and shared.release(spark) == 0


def clip_tables(spark):
    """Two clips of 60 frames at a varying rate; one record has no frames."""
    pts = [0.1 * k + (0.04 if k % 3 == 1 else 0.0) for k in range(60)]
    frames = spark.createDataFrame([(c, k, t) for c in ("a.mp4", "b.mp4") for k, t in enumerate(pts)], "clip string, idx int, pts double")
    scores = spark.createDataFrame([(c, k, 0.8 if k < 30 else 0.1) for c in ("a.mp4", "b.mp4") for k in range(60) if k % 10], "clip string, idx int, sim double")
    luma = spark.createDataFrame([(c, k, 100.0 + k) for c in ("a.mp4", "b.mp4") for k in range(60)], "clip string, idx int, mean double")
    shots = lambda *starts: [{"start_sec": s, "end_sec": s + 1.0} for s in starts]
    rows = [{"clip": "a.mp4", "transition_sec": 3.03, "method": "m", "shots": shots(0.0, 1.12, 3.03)}, {"clip": "b.mp4", "transition_sec": None, "method": None, "shots": shots(0.0)}, {"clip": "gone.mp4", "shots": shots(0.0)}]
    return pts, frames, scores, luma, spark.createDataFrame(rows, documents.TRANSITIONS)


def test_curve_cache_equals_a_restatement(spark):
    pts, frames, scores, luma, records = clip_tables(spark)
    docs = {r.clip: r for r in curves.documents(curves.dump(records, frames, scores, luma)).collect()}
    assert set(docs) == {"a.mp4", "b.mp4"}
    nearest = lambda t: min(range(60), key=lambda k: (abs(pts[k] - t), k))
    dur = pts[-1] + pts[-1] - pts[-2]
    at = lambda rate: [nearest(dur * (k + 0.5) / n) for n in [max(2, int(dur * rate))] for k in range(n)]
    for c, cuts, first, method in (("a.mp4", [1.12, 3.03], 3.03, "m"), ("b.mp4", [], None, "")):
        d = docs[c]
        assert (d.short, d.dur, d.method, d.sample_fps, d.luma_fps) == (c[:-4], round(dur, 3), method, 10.0, 15.0)
        assert d.times == [round(pts[k], 3) for k in at(10)] and d.sims == [(0.8 if k < 30 else 0.1) if k % 10 else 0.0 for k in at(10)]
        assert d.times_l == [round(pts[k], 3) for k in at(15)] and d.luma == [100.0 + k for k in at(15)]
        assert d.transnet_cuts == [round(pts[nearest(t)], 3) for t in cuts] and d.first_true == (None if first is None else round(pts[nearest(first)], 3))


def test_saved_cache_needs_no_exchange_by_clip(spark, tmp_path):
    _, frames, scores, luma, records = clip_tables(spark)
    curves.save(curves.dump(records, frames, scores, luma), "cache_test", buckets=4)
    try:
        s, c = spark.table("cache_test_samples"), spark.table("cache_test_clips")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = s.join(c, "clip").groupBy("clip").agg(F.count("*").alias("n"))
        assert {r.clip: r.n for r in joined.collect()} == {"a.mp4": 59, "b.mp4": 59}
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in curves.TABLES:
            spark.sql(f"drop table if exists cache_test_{t}")


def test_relabel_and_curves_commands(spark, tmp_path, capsys):
    pts, frames, scores, luma, records = clip_tables(spark)
    path = lambda name: str(tmp_path / name)
    for name, df in (("pts", frames), ("scores", scores), ("luma", luma)):
        df.write.parquet(path(name))
    face = lambda k: ([0.0, 0.0, 2.0, 9.0], 0.9, [1.0, 0.0] if k < 30 else [0.0, 1.0])
    rows = [(c, k, 0, *face(k)) for c in ("a.mp4", "b.mp4") for k in range(60)] + [("b.mp4", 10, 1, [0.0, 0.0, 9.0, 9.0], 0.1, [0.0, 1.0])]
    spark.createDataFrame(rows, "clip string, idx int, face_no int, bbox array<double>, det_score double, embedding array<double>").write.parquet(path("faces"))
    spark.createDataFrame([(c, 10.0, 60, 20) for c in ("a.mp4", "b.mp4")], "clip string, fps double, total int, height int").write.parquet(path("frames"))
    shots = [{"start_sec": 0.0, "end_sec": 3.0, "start_frame": 0, "end_frame": 30}, {"start_sec": 3.0, "end_sec": 6.0, "start_frame": 30, "end_frame": 60}]
    body = [{"clip": "a.mp4", "transition_sec": None, "method": None, "shots": shots}, {"clip": "b.mp4", "shots": [{"start_sec": 0.0, "end_sec": 6.0}]}, {"clip": "gone.mp4", "shots": shots}, {"clip": "bad.mp4", "error": "no frames"}]
    (tmp_path / "t.json").write_text(json.dumps(body))
    # Two of four records are within the tolerance: a.mp4, and gone.mp4, which has no cut on either side.
    (tmp_path / "gt.json").write_text(json.dumps({"clips": [{"clip": "a.mp4", "short": "a", "cut_sec": 3.25, "cuts": [{"sec": 3.25}]}, {"clip": "b.mp4", "short": "b", "cut_sec": 9.0}, {"clip": "bad.mp4", "short": "bad", "cut_sec": 1.0}]}))
    for name in ("a.mp4", "b.mp4", "bad.mp4"):
        (tmp_path / name).write_text("x")
    cli.main(["relabel", "--transitions", path("t.json"), "--clips", str(tmp_path), "--frames", path("frames"), "--faces", path("faces"), "--out", path("out.json"), "--min-det-score", "0.5", "--min-face-frac", "0.4", "--truth", path("gt.json")])
    printed = capsys.readouterr().out.replace(" ", "")
    assert "|a|NULL|3.0|3.25|" in printed and "|4|2|0|2|2|50.0|50.0|" in printed
    out = {r["clip"]: r for r in json.loads((tmp_path / "out.json").read_text())}
    assert (out["a.mp4"]["transition_sec"], out["a.mp4"]["method"], [s["label"] for s in out["a.mp4"]["shots"]]) == (3.0, "creator_to_meme", ["person", "meme"])
    assert "error" not in out["a.mp4"] and "face_error" not in out["a.mp4"]
    # A single shot: the gradual change is found in the samples of the whole clip.
    assert out["b.mp4"]["method"] == "creator_to_meme_soft" and out["b.mp4"]["transition_sec"] == pytest.approx(3.0, abs=0.2)
    assert out["gone.mp4"]["face_error"] and out["bad.mp4"]["error"] == "no frames" and out["bad.mp4"]["face_error"]
    cli.main(["curves", "--transitions", path("out.json"), "--frames", path("pts"), "--scores", path("scores"), "--luma", path("luma"), "--out", path("curves.json")])
    cache = json.loads((tmp_path / "curves.json").read_text())
    assert set(cache) == {"a", "b"} and cache["a"]["first_true"] == round(min(pts, key=lambda t: abs(t - 3.0)), 3) and cache["a"]["clip"] == "a.mp4"
    with pytest.raises(FileNotFoundError, match="run the detection first"):
        cli.main(["curves", "--transitions", path("none.json"), "--frames", path("pts"), "--scores", path("scores"), "--luma", path("luma"), "--out", path("c.json")])


def test_debug_command(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    rows = [(c, k, 0, [0.0, 0.0, 2.0, 9.0], 0.9, [1.0, 0.0] if k < 15 else [0.3, 0.954]) for c in ("a.mp4", "b.mp4") for k in range(20)]
    spark.createDataFrame(rows, "clip string, idx int, face_no int, bbox array<double>, det_score double, embedding array<double>").write.parquet(path("faces"))
    spark.createDataFrame([(c, 10.0, 20, 20) for c in ("a.mp4", "b.mp4")], "clip string, fps double, total int, height int").write.parquet(path("frames"))
    spark.createDataFrame([(c, k, 10.0) for c in ("a.mp4", "b.mp4") for k in range(20)], "clip string, idx int, fps double").write.parquet(path("every"))
    (tmp_path / "t.json").write_text(json.dumps([{"clip": "a.mp4", "shots": []}, {"clip": "b.mp4", "shots": []}]))
    cli.main(["debug", "--transitions", path("t.json"), "--frames", path("frames"), "--every", path("every"), "--faces", path("faces"), "--out", path("debug"), "--only", "b", "--stride", "5"])
    got = {(r.clip, r.idx): r for r in spark.read.json(path("debug")).collect()}
    assert set(got) == {("b.mp4", k) for k in range(20)}
    assert [got["b.mp4", k].boxes[0].colour for k in (0, 14, 15, 19)] == ["green", "green", "yellow", "yellow"]
    assert got["b.mp4", 12].caption == "t=1.20s  max=1.00  thr=0.35  -> CREATOR" and got["b.mp4", 19].caption == "t=1.90s  max=0.30  thr=0.35  -> meme"


def test_overlay_against_a_loop_over_frames(spark):
    rng = random.Random(3)
    frames = [(c, k, fps) for c, fps in (("a", 30.0), ("b", None), ("c", 0.0)) for k in range(23)]
    faces = [(c, k, n, [float(n)], rng.choice([None, float("nan"), -0.2, 0.1, 0.25, 0.26, 0.35, 0.9])) for c in "abz" for k in range(23) for n in range(rng.randrange(4))]
    expected = {}
    for c in "abc":
        boxes = []
        for _, k, fps in (f for f in frames if f[0] == c):
            if k % 3 == 0:
                boxes = sorted((n, 0.0 if s is None or s != s else s) for cc, kk, n, _, s in faces if (cc, kk) == (c, k))
            best = max([0.0, *(s for _, s in boxes)])
            expected[c, k] = (round(k / (fps or 25.0), 9), [(n, "green" if s >= 0.35 else "yellow" if s >= 0.25 else "red") for n, s in boxes], best, "CREATOR" if best >= 0.35 else "meme")
    f = spark.createDataFrame(faces, "clip string, idx int, face_no int, bbox array<double>, sim double").repartition(3)
    of = spark.createDataFrame(frames, "clip string, idx int, fps double")
    got = {(r.clip, r.idx): (round(r.t, 9), [(b.face_no, b.colour) for b in r.boxes], r.best, r.label) for r in identity.overlay(of, f, stride=3).collect()}
    assert got == expected
    assert identity.overlay(of.limit(0), f).count() == 0 and {r.label for r in identity.overlay(of, f.limit(0)).collect()} == {"meme"}


def test_blank_command(spark, tmp_path):
    clips = [{"clip": "a.mp4", "short": "a", "cut_sec": 1.0, "cuts": [{"sec": 1.0, "to": "meme"}], "has_transition": True, "pattern": "p", "returns_to_creator": True, "notes": "n", "confidence": "high", "edited": e} for e in (True, False, None)]
    place = tmp_path / "ground_truth.json"
    place.write_text(json.dumps({"source": "s", "clips": clips}))
    before = place.read_text()
    for _ in range(2):
        cli.main(["blank", "--folder", str(tmp_path)])
        out = json.loads(place.read_text())
        assert out["source"] == "s" and [c["edited"] for c in out["clips"]] == [True, False, None]
        bare = {"cut_sec": None, "cuts": [], "has_transition": False, "pattern": "", "returns_to_creator": False}
        assert [{k: v for k, v in c.items() if k in clips[0] and k != "edited"} for c in out["clips"]] == [{k: v for k, v in {**clip, **(bare if k else {})}.items() if k != "edited"} for k, clip in enumerate(clips)]
    assert (tmp_path / "ground_truth.json.bak").read_text() == before
    with pytest.raises(ValueError, match="of one row, not of 2"):
        documents.save_truth(spark.range(2), str(tmp_path), "ground_truth.json")
    assert json.loads(place.read_text()) == out


def test_a_clip_without_samples_is_one_segment(spark):
    clips = spark.createDataFrame([("x", 4.0, False, None, 1.0, "m")], "clip string, dur double, has_first boolean, first_true double, base_cut double, method string")
    none = lambda s: spark.createDataFrame([], s)
    s, d = place.segment_clips(clips, none("clip string, i int, t double, sim double"), none("clip string, t double"), none("clip string, i int, t double, luma double"))
    assert [(r.clip, r.seg_idx, r.start, r.end, r.label, r.face_sim) for r in s.collect()] == [("x", 0, 0.0, 4.0, "person", 0.0)]
    assert [(r.clip, r.cut, r.method) for r in d.collect()] == [("x", None, "m")]
