import bisect
import random

from cutlab.operators import decode, series
from pyspark.sql import functions as F


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


def test_nearest_matches_bisect_with_ties_and_clashing_columns(spark):
    rng = random.Random(5)
    frames = [(c, i, float(t)) for c in "ab" for i, t in enumerate(sorted(rng.choices(range(0, 60, 2), k=25)))]
    probes = [(c, k, float(rng.randrange(-4, 66)), "x") for c in "abz" for k in range(60)]
    f = spark.createDataFrame(frames, "clip string, idx int, pts double")
    p = spark.createDataFrame(probes, "clip string, probe int, at double, frame string")
    got = {(r.clip, r.probe): (r.idx, r.pts) for r in series.nearest(p, f).collect()}
    assert len(got) == len(probes)
    for clip, k, at, _ in probes:
        own = [(abs(t - at), t, i) for c, i, t in frames if c == clip]
        want = min(own)[2:0:-1] if own else (None, None)
        assert got[clip, k] == want


def test_nearest_of_empty_tables(spark):
    f = spark.createDataFrame([], "clip string, idx int, pts double")
    p = spark.createDataFrame([("a", 1.0)], "clip string, at double")
    assert rows(series.nearest(p, f), "clip", "idx", "pts") == [("a", None, None)]
    assert series.nearest(p.limit(0), f).count() == 0


def test_sample_times_are_bin_centres(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 0.1)], "clip string, dur double")
    got = sorted(rows(series.sample_times(d, 4.0), "clip", "k", "at"))
    assert got == [("a", 0, 0.125), ("a", 1, 0.375), ("a", 2, 0.625), ("a", 3, 0.875), ("b", 0, 0.025), ("b", 1, 0.07500000000000001)]


def viterbi(sims, thr, pen, seed):
    """Two-state dynamic programme with back pointers."""
    score, back = [0.0, -1e9], []
    for i, s in enumerate(sims):
        e = (s - thr, thr - s)
        if i == 0:
            score = [e[0], -1e9]
            back.append((0, 1))
            continue
        new, b = [], []
        for k in (0, 1):
            stay, switch = score[k], score[1 - k] - pen
            b.append(k if stay >= switch else 1 - k)
            new.append(max(stay, switch) + e[k])
        if i <= seed:
            new[1] = -1e9
        score = new
        back.append(tuple(b))
    k = 0 if score[0] >= score[1] else 1
    path = []
    for b in reversed(back):
        path.append(k)
        k = b[k]
    return path[::-1]


def test_viterbi_equals_the_dynamic_programme(spark):
    rng = random.Random(3)
    clips = {f"c{k}": [round(rng.random(), 2) for _ in range(rng.randrange(1, 40))] for k in range(60)}
    seeds = {c: rng.randrange(0, len(s)) if rng.random() < 0.5 else 0 for c, s in clips.items()}
    data = [(c, i, i * 0.1, s) for c, sims in clips.items() for i, s in enumerate(sims)]
    df = spark.createDataFrame(data, "clip string, i int, t double, sim double").repartition(5)
    sd = spark.createDataFrame(list(seeds.items()), "clip string, seed int")
    got = {}
    for c, i, s in rows(decode.viterbi_states(df, 0.411, 0.7331, sd), "clip", "i", "state"):
        got.setdefault(c, {})[i] = s
    for c, sims in clips.items():
        assert [got[c][i] for i in range(len(sims))] == viterbi(sims, 0.411, 0.7331, seeds[c]), c


def test_split_is_the_first_best_index(spark):
    rng = random.Random(9)
    clips = {f"c{k}": [rng.random() < 0.5 for _ in range(rng.randrange(1, 12))] for k in range(80)} | {"t": [True] * 4, "f": [False] * 4}
    df = spark.createDataFrame([(c, i, f) for c, fs in clips.items() for i, f in enumerate(fs)], "clip string, i int, flag boolean")
    for c, n, best in rows(decode.best_split(df), "clip", "n", "best"):
        f = clips[c]
        scores = [sum(f[:i]) + sum(not x for x in f[i:]) for i in range(len(f) + 1)]
        assert (n, best) == (len(f), scores.index(max(scores))), c


def test_worked_timeline_becomes_four_segments(spark):
    """person until 2.625, meme until 6.625, person until 7.917, meme until 10.5."""
    edges = [2.625, 6.625, 7.917, 10.5]
    times = [round(0.05 + 0.1 * k, 3) for k in range(105)]
    data = [("v", i, t, 0.9 if sum(t >= e for e in edges) % 2 == 0 else 0.0) for i, t in enumerate(times)]
    c = spark.createDataFrame(data, "clip string, i int, t double, sim double")
    s = series.run_segments(series.runs(decode.viterbi_states(c)), spark.createDataFrame([("v", 10.5)], "clip string, dur double"))
    got = sorted(rows(s, "seg_idx", "start", "end", "state"))
    assert [g[3] for g in got] == [0, 1, 0, 1] and got[0][1] == 0.0 and got[-1][2] == 10.5
    assert all(abs(g[2] - e) <= 0.06 for g, e in zip(got, edges))


def test_runs_partition_all_rows_and_nulls_are_equal(spark):
    vals = [1, 1, None, None, 2, 1]
    df = spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate(vals)], "clip string, i int, t double, state int")
    got = sorted(rows(series.runs(df), "run", "state", "i0", "i1"), key=lambda r: r[0])
    assert got == [(0, 1, 0, 1), (1, None, 2, 3), (2, 2, 4, 4), (3, 1, 5, 5)]


def test_pick_table(spark):
    cases = {
        "one_bare": ([0.1], (1, 0, None, "all_meme_no_creator")),
        "one": ([0.9], (1, 1, None, "single_shot_creator")),
        "all": ([0.9, 0.8], (2, 2, None, "all_creator_no_transition")),
        "none": ([0.1, 0.0], (2, 0, None, "all_meme_no_creator")),
        "prior": ([0.2, 0.3, 0.1], (3, 0, 1.0, "creator_to_meme_prior")),
        "cut": ([0.9, 0.9, 0.0], (3, 2, 2.0, "creator_to_meme")),
    }
    df = spark.createDataFrame([(c, i, float(i), s) for c, (sims, _) in cases.items() for i, s in enumerate(sims)], "clip string, i int, start double, sim double")
    got = {r[0]: r[1:] for r in rows(decode.pick(df), "clip", "n", "best", "cut", "method")}
    assert got == {c: want for c, (_, want) in cases.items()}


def test_decoding_plan_has_no_python_and_few_exchanges(spark):
    """By block (planned twice, run once), by clip for the maps of blocks, to bring them back, and by clip for the runs."""
    df = spark.createDataFrame([("a", 0, 0.0, 1.0)], "clip string, i int, t double, sim double")
    plan = series.runs(decode.viterbi_states(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") <= 5


def test_label_flips_and_counters(spark):
    df = spark.createDataFrame([("a", 0, "p"), ("a", 1, None), ("a", 2, None), ("a", 3, "p")], "clip string, shot_idx int, label string")
    assert sorted(rows(series.label_flips(df), "shot_idx")) == [(1,), (3,)]
    s = spark.createDataFrame([("a", 0, "p"), ("a", 1, "m"), ("a", 2, "p")], "clip string, seg_idx int, label string")
    assert sorted(rows(series.label_counter(s), "seg_idx", "k")) == [(0, 1), (1, 1), (2, 2)]
    assert s.select(F.count("*")).first()[0] == 3
