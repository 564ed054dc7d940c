"""The clip driver and the grid search against a plain restatement, on small made-up clips."""

import itertools
import json
import random
import statistics
import time

import pytest

from cutlab.operators import decode, match, place, series
from cutlab.plans.sweep import sweep
from pyspark.sql import functions as F
from test_series import viterbi


def half_up(x, digits):
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def fade_at(clip, b, c):
    near = lambda t: min(range(len(clip["times"])), key=lambda k: (abs(clip["times"][k] - t), k))
    window = [k for k, t in enumerate(clip["luma_times"]) if b - c.fade_back <= t <= b + c.fade_forward]
    light = clip["luma"]
    if len(window) < 3 or any(abs(light[k + 1] - light[k]) > c.hard_step for k in window[:-1]):
        return None
    absent = [k for k in window if clip["sims"][near(clip["luma_times"][k])] < 0.35]
    if not absent:
        return None
    low, high = min(absent, key=lambda k: (light[k], k)), min(absent, key=lambda k: (-light[k], k))
    return clip["luma_times"][low] if light[low] <= 48 else clip["luma_times"][high] if light[high] >= 212 else None


def drive(clip, c):
    """(segments, cut, method): one clip, step by step."""
    first = clip["first_true"] if clip["has_first"] else clip["base_cut"]
    method = clip["method"] or ""
    times, sims = clip["times"], clip["sims"]
    if first is None:
        segments = [[0.0, half_up(clip["dur"], 3), "meme" if method == "all_meme_no_creator" else "person"]]
    else:
        seed = max((k for k, t in enumerate(times) if t <= first), default=0)
        states = viterbi(sims, c.threshold, c.penalty, seed)
        edges = [k for k in range(1, len(states)) if states[k] != states[k - 1]]
        middles = [half_up((times[k - 1] + times[k]) / 2, 3) for k in edges]
        starts, ends = [0.0, *middles], [*middles, half_up(clip["dur"], 3)]
        segments = [[s, e, "person" if states[k] == 0 else "meme"] for s, e, k in zip(starts, ends, [0, *edges])]
        old = [s[0] for s in segments]
        for k in range(1, len(segments)):
            b, new = old[k], None
            if c.snap and segments[k - 1][2] == "meme" and segments[k][2] == "person":
                new = min((x for x in clip["cuts"] if b - c.return_back <= x <= b + c.return_forward), key=lambda x: (abs(x - b), x), default=None)
            if new is None and c.refine:
                new = fade_at(clip, b, c)
            if new is None and c.snap:
                near = min(clip["cuts"], key=lambda x: (abs(x - b), x), default=None)
                new = near if near is not None and abs(near - b) <= c.snap_window else None
            if new is not None:
                segments[k][0] = segments[k - 1][1] = half_up(new, 3)
        method = "creator_returns" if sum(s[2] == "person" for s in segments) > 1 else method or "creator_to_meme"
    out = []
    for s, e, label in segments:
        inside = [v for v, t in zip(sims, times) if s <= t < e]
        out.append((s, e, label, half_up(statistics.median(inside), 3) if inside else 0.0))
    return out, out[1][0] if len(out) > 1 else None, method


def made_up(n=40, seed=7):
    rng = random.Random(seed)
    clips = {}
    for k in range(n):
        size = rng.randrange(2, 90)
        times = [round(0.1 * i + rng.random() * 0.05, 3) for i in range(size)]
        edges = sorted(rng.sample(range(size), min(size, rng.choice([0, 1, 1, 2, 3]))))
        sims = [round(min(1.0, max(0.0, (0.6 if sum(i >= e for e in edges) % 2 == 0 else 0.05) + rng.gauss(0, 0.12))), 3) for i in range(size)]
        luma_times = [round(0.067 * i, 3) for i in range(int(times[-1] / 0.067) + 1)]
        light = [100.0]
        for _ in luma_times[1:]:
            light.append(max(0.0, min(255.0, round(light[-1] + rng.uniform(-33, 33), 2))))
        clips[f"c{k}"] = {
            "dur": round(times[-1] + 0.1, 3), "has_first": rng.random() < 0.4, "first_true": rng.choice([None, times[size // 3]]), "base_cut": rng.choice([None, times[size // 2]]), "method": rng.choice([None, "", "all_meme_no_creator", "creator_to_meme"]),
            "times": times, "sims": sims, "luma_times": luma_times, "luma": light, "cuts": sorted(rng.sample(times, min(size, rng.randrange(0, 4)))),
        }
    return clips


def tables(spark, clips):
    c = spark.createDataFrame([(k, v["dur"], v["has_first"], v["first_true"], v["base_cut"], v["method"]) for k, v in clips.items()], "clip string, dur double, has_first boolean, first_true double, base_cut double, method string")
    curve = spark.createDataFrame([(k, i, t, s) for k, v in clips.items() for i, (t, s) in enumerate(zip(v["times"], v["sims"]))], "clip string, i int, t double, sim double")
    luma = spark.createDataFrame([(k, i, t, s) for k, v in clips.items() for i, (t, s) in enumerate(zip(v["luma_times"], v["luma"]))], "clip string, i int, t double, luma double")
    cuts = spark.createDataFrame([(k, t) for k, v in clips.items() for t in v["cuts"]], "clip string, t double")
    return c, curve, cuts, luma


def test_driver_equals_the_restatement(spark):
    clips, config = made_up(), place.Config(penalty=0.7331, threshold=0.3217)
    c, curve, cuts, luma = tables(spark, clips)
    segments, decisions = place.segment_clips(c, curve, cuts, luma, config)
    got = {r.clip: [(s.start, s.end, s.label, s.face_sim) for s in r.segments] for r in place.segment_documents(segments).collect()}
    told = {r.clip: (r.cut, r.method) for r in decisions.collect()}
    want = {k: drive(v, config) for k, v in clips.items()}
    assert got == {k: w[0] for k, w in want.items()} and told == {k: w[1:] for k, w in want.items()}
    moved = [w for k, w in want.items() if w[0] != drive(clips[k], place.Config(penalty=0.7331, threshold=0.3217, snap=False, refine=False))[0]]
    assert len(moved) > 5 and any(w[1] is None for w in want.values())


def test_worked_timeline_through_the_driver(spark):
    """person until 2.625, meme until 6.625, person until 7.917, meme until 10.5; hard cuts at each change."""
    edges, times = [2.625, 6.625, 7.917], [round(0.05 + 0.1 * k, 3) for k in range(105)]
    clip = {"dur": 10.5, "has_first": True, "first_true": 2.6, "base_cut": None, "method": "creator_to_meme", "times": times, "sims": [0.9 if sum(t >= e for e in edges) % 2 == 0 else 0.0 for t in times], "luma_times": [], "luma": [], "cuts": edges}
    segments, decisions = place.segment_clips(*tables(spark, {"v": clip, "w": made_up(1)["c0"]}))
    got = next(r for r in place.segment_documents(segments).collect() if r.clip == "v")
    assert [s.start for s in got.segments] == [0.0, *edges] and got.pattern == "pers→meme→pers→meme"
    assert [(r.cut, r.method) for r in decisions.collect() if r.clip == "v"] == [(2.625, "creator_returns")]


def test_sweep_equals_the_restatement(spark):
    clips = made_up(12, 3)
    c, curve, cuts, luma = tables(spark, clips)
    rng = random.Random(2)
    truth = {k: sorted(rng.sample(v["times"], min(len(v["times"]), rng.randrange(0, 3)))) for k, v in clips.items()}
    grid = list(itertools.product((0.2871, 0.35), (0.51, 1.53), (True, False)))
    rows = []
    for n, (t, p, refine) in enumerate(grid):
        tp = missed = extra = full = 0
        for k, v in clips.items():
            pool = [s[0] for s in drive(v, place.Config(threshold=t, penalty=p, refine=refine))[0][1:]]
            hit = 0
            for g in truth[k]:
                near = [x for x in range(len(pool)) if abs(pool[x] - g) <= 0.5]
                if near:
                    pool.pop(min(near, key=lambda x: abs(pool[x] - g)))
                    hit += 1
            tp, missed, extra, full = tp + hit, missed + len(truth[k]) - hit, extra + len(pool), full + (hit == len(truth[k]) and not pool)
        share = lambda d: 100.0 * tp / (tp + d) if tp + d else 100.0  # noqa: B023, E731
        rows.append((-full, -(share(extra) + share(missed)), n, tp, missed, extra))
    df = spark.createDataFrame([(k, v) for k, v in truth.items()], "clip string, truth array<double>")
    got = sweep(spark, c, curve, cuts, luma, df, 0.5, 5, (0.2871, 0.35), (0.51, 1.53)).collect()
    assert [(r.cfg, r.tp, r.missed, r.extra) for r in got] == [r[2:] for r in sorted(rows)[:5]]


def test_blocks_change_nothing(spark):
    rng = random.Random(4)
    data = [(c, i, i * 0.1, rng.random()) for c, n in (("a", 1), ("b", 3), ("c", 50), ("d", 401)) for i in range(n)]
    df = spark.createDataFrame(data, "clip string, i int, t double, sim double").repartition(3)
    seeds = spark.createDataFrame([("d", 20), ("c", 49)], "clip string, seed int")
    states = lambda **k: sorted(tuple(r) for r in decode.viterbi_states(df, 0.49, 0.7331, seeds, **k).collect())
    assert states(block=3) == states(block=7) == states()


def test_long_clips_take_linear_time(spark):
    df = spark.range(40_000).select(F.lit("x").alias("clip"), F.col("id").cast("int").alias("i"), (F.col("id") * 0.1).alias("t"), F.abs(F.sin(F.col("id") / 40)).alias("sim"))
    began = time.time()
    runs = series.runs(decode.viterbi_states(df)).count()
    probes = df.select("clip", (F.col("t") + 0.03).alias("at"))
    near = series.nearest(probes, df.select("clip", F.col("i").alias("idx"), F.col("t").alias("pts"))).filter("idx is null").count()
    assert runs > 100 and near == 0 and time.time() - began < 30


def test_evaluation_rules(spark):
    gt = spark.createDataFrame([("a", [1.0, 3.0], None), ("b", None, 2.0), ("c", [], None), ("d", None, 5.0)], "clip string, cuts array<double>, cut double")
    seg = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.2), ("a", 2, 3.1), ("c", 0, 0.0), ("z", 0, 0.0)], "clip string, seg_idx int, start double")
    rec = spark.createDataFrame([("b", [2.1, 9.0], 2.2), ("c", [4.0], 4.0), ("a", [7.0], 7.0)], "clip string, flips array<double>, picked double")
    rule = lambda name: {r.clip: (r.pred, r.verdict, r.first_right) for r in match.evaluation(gt, seg, rec, 0.5, name).collect()}
    a = ([1.2, 3.1], "correct", True)
    assert rule("flips") == {"a": a, "b": ([2.1, 9.0], "partial", True), "c": ([], "correct_none", True), "d": ([], "missed", False)}
    assert rule("pick") == {"a": a, "b": ([2.2], "correct", True), "c": ([4.0], "false_positive", False), "d": ([], "missed", False)}
    assert rule("none") == {"a": a, "b": ([], "missed", False), "c": ([], "correct_none", True), "d": ([], "missed", False)}


def test_command_line(spark, tmp_path, capsys):
    from cutlab import cli

    clips = made_up(6)
    curves = {}
    for k, v in clips.items():
        curves[k] = {"clip": f"{k}.mp4", "dur": v["dur"], "times": v["times"], "sims": v["sims"], "transnet_cuts": v["cuts"], "times_l": v["luma_times"], "luma": v["luma"], "method": v["method"]}
        if v["has_first"]:
            curves[k]["first_true"] = v["first_true"]
    base = [{"clip": f"{k}.mp4", "transition_sec": v["base_cut"], "method": "x", "num_shots": 0, "shots": []} for k, v in clips.items()]
    files = {"curves": curves, "base": base, "truth": {"clips": [{"clip": f"{k}.mp4", "short": k, "cut_sec": 1.0} for k in clips]}, "ver": {"by_clip": {"c0": {"verdict": "missed", "notes": "n"}}}}
    path = lambda name: str(tmp_path / f"{name}.json")
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        (tmp_path / "c0.mp4").write_text("x")
    cli.main(["segment", "--curves", path("curves"), "--base", path("base"), "--out-segments", path("segments"), "--out-transitions", path("transitions")])
    out = {r["short"]: r for r in json.loads((tmp_path / "segments.json").read_text())}
    for k, v in clips.items():
        segments, cut, _ = drive({**v, "method": v["method"] or "x"}, place.Config())
        assert [(s["start"], s["end"], s["label"], s["face_sim"]) for s in out[k]["segments"]] == segments
    assert {r["clip"]: r["transition_sec"] for r in json.loads((tmp_path / "transitions.json").read_text())} == {f"{k}.mp4": drive({**v, "method": v["method"] or "x"}, place.Config())[1] for k, v in clips.items()}
    cli.main(["evaluate", "--truth", path("truth"), "--segments", path("segments"), "--transitions", path("transitions")])
    cli.main(["sweep", "--curves", path("curves"), "--base", path("base"), "--truth", path("truth"), "--top", "2"])
    cli.main(["inspect", "--curves", path("curves"), "--truth", path("truth"), "--clip", "c1"])
    cli.main(["split", "--segments", path("segments"), "--clips", str(tmp_path), "--out", path("manifest")])
    cli.main(["report", "--transitions", path("transitions"), "--verification", path("ver")])
    listed = {r["clip"]: r for r in json.loads((tmp_path / "manifest.json").read_text())}
    assert set(listed) == {f"{k}.mp4" for k in clips}
    for k in clips:
        r = listed[f"{k}.mp4"]
        assert (r["short"], r["pattern"], r["n_segments"]) == (k, out[k]["pattern"], out[k]["n_segments"])
        assert (len(r["outputs"]) == r["n_segments"]) if k == "c0" else (r["disposition"], r["outputs"]) == ("skip_missing_src", [])
    with pytest.raises(FileNotFoundError, match="run the curves stage first"):
        cli.main(["sweep", "--curves", path("nothing"), "--base", path("base"), "--truth", path("truth")])
    assert "precision" in capsys.readouterr().out
