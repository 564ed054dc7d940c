import hashlib
import random
import re

import pytest
import xxhash
from cutlab.llm import components, exact_dedup, line_chunks, minhash
from pyspark.sql import functions as F

SPACE = re.compile("[\x20\x09-\x0d]")


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(900, 901), (901, 902), (902, 900), (7, 7)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    head = {}

    def find(x):
        while head.get(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        head[max(x, y)] = min(x, y)
    nodes = {n for e in edges for n in e}
    assert got == {n: find(n) for n in nodes if find(n) != n}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


DOCS = [(0, "a b"), (1, "ab "), (2, "a\tb\n"), (3, None), (4, ""), (5, " "), (6, " ab"), (7, "x" * 100_000), (8, "x" * 50_000 + " " + "x" * 50_000), (9, "ab c"), (9, "ab c")]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, min(g)[3], len(g), i == min(g)[3], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for *_, i in g), key=repr)


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda t: F.unhex(F.md5(F.left(t, F.lit(1)).cast("binary")))])
def test_exact_duplicates(spark, hashed):
    rows = DOCS + [(k, "hot text") for k in range(100, 1400)] + [(2000 + k, f"xx{k % 3}") for k in range(9)] + [(None, "ab"), (None, "only null"), (None, "only  null"), (None, "x y long one"), (3000, "xylongone")]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, hash int, n string")
    got = exact_dedup.exact_duplicates(df, hashed=hashed)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()), key=repr) == brute_exact(rows)


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_near(rows, percent=75):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())) for i, t in rows for w in [words(t)]]
    head = {i: i for i, _ in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                head[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 150]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus(4) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one TWO"), (9005, "one two three"), (9006, "É é"), (9007, "é É"), (9008, "z" * 300_000), (9009, "z" * 300_000)]
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, bands string, component int").repartition(4)
    got = minhash.near_duplicates(df)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute_near(rows)


def test_chain_of_near_copies_and_rounds(spark, monkeypatch):
    """Neighbours are similar, the ends are not; a bucket cannot be settled by its first member alone."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join([f"v{j}" for j in range(2 * k)] + base[2 * k :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()) == brute_near(rows)


def test_texts_that_share_passages_in_blocks(spark, monkeypatch):
    """Buckets of one hash, so that texts share them which share a passage, some of them enough of it."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    met = []
    inner = minhash._met_in_blocks
    monkeypatch.setattr(minhash, "_met_in_blocks", lambda left, *rest: met.append(left.groupBy("bucket").agg(F.min("block"), F.max("block")).collect()) or inner(left, *rest))
    rng, rows = random.Random(8), []
    passages = [[f"{name}{k}" for k in range(60)] for name in "pq"]
    for i in range(120):
        own = [f"o{i // 2 if i % 3 == 0 else i}x{k}" for k in range(rng.choice((5, 12, 16, 30, 90)))]
        text = passages[i % 2][: rng.choice((40, 60))] + own
        if i % 5 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1].split() + [f"t{i}"]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, bands=24, rows=1)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute_near(rows)
    assert min(r[1] for r in met[0]) < -3 and max(r[2] for r in met[0]) > 3


def test_null_ids_belong_with_equal_sets(spark):
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (None, "x y z u v w"), (None, None), (7, "A b C d e F g")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == sorted([(None, 3, 5, False), (5, 3, 5, True), (None, 2, None, True), (None, 0, None, True), (7, 3, 5, False)], key=repr)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_do_not_depend_on_windows(monkeypatch):
    text = " ".join(f"Wort{k}" for k in range(500)) + " " + "q" * 300 + " end"
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "WINDOW", 64)
    small = minhash.word_hashes(text)
    assert len(whole) == len(small) == 502 and (whole[:499] == small[:499]).all() and len(set(whole.tolist())) == 502


def test_circulant_minima_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    x, y = minhash.circulant_minima(np.unique(a), 2048), minhash.circulant_minima(np.unique(np.concatenate((a[100:], b))), 2048)
    assert abs((x == y).mean() - 300 / 500) < 0.05


def brute_lines(rows, long_words=50):
    """(id, text, lines, removed): lines go that stand earlier, in a run of two or more or as a long one."""
    order = sorted({(i is not None, i or 0, xxhash.xxh64_intdigest(t.encode(), 42) - (2**64 if xxhash.xxh64_intdigest(t.encode(), 42) >= 2**63 else 0), t) for i, t in rows if t is not None})
    first, spans = {}, {}
    for at, (_, _, _, t) in enumerate(order):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if words(x)]
        spans[at] = [(a, b, "\n".join(lines[a : b + 1])) for a, b in zip(full, full[1:])] + [(k, k, lines[k]) for k in full if len(words(lines[k])) > long_words]
        for a, b, x in spans[at]:
            first[x] = min(first.get(x, (at, a, b)), (at, a, b))
    cut = {}
    for at, (has, i, _, t) in enumerate(order):
        gone = set()
        for a, b, x in spans[at]:
            if first[x][0] != at or a > first[x][2]:
                gone |= set(range(a, b + 1))
        cut[(i if has else None, t)] = gone
    out = []
    for i, t in rows:
        gone = cut.get((i, t), set())
        out.append((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), 0 if t is None else len(t.split("\n")), len(gone)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(8)
    passages = [[f"p{n} line {k} " + " ".join(rng.choices("abcdef", k=4)) for k in range(rng.randrange(2, 9))] for n in range(6)]
    long = " ".join(f"long{k}" for k in range(60))
    rows = []
    for i in range(80):
        lines = [f"own {i} {k}" for k in range(rng.randrange(0, 5))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(lines) + 1)
            lines[at:at] = rng.choice(passages)
        if rng.random() < 0.3:
            lines.append(long)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, "All rights reserved."), (105, "All rights reserved."), (106, "a\n" * 5000), (107, "\r\nx\r\ny"), (108, "a\n\nb"), (109, "a\n\nb"), (110, "a\n \nb"), (110, "z\na\n \nb"), (110, "z\na\n \nb"), (None, "n one\nn two"), (None, "n two\nn one\nn two"), (111, "n one\nn two\nend"), (112, "c\nd\ne\nc\nd\nc\nd\ne"), (113, "word " * 200_000)]
    return rows + [(200 + k, "hot one\nhot two\nhot three\nhot four") for k in range(700)]


CLASHING = {"doc_id": "long", "text": "string", "hash": "int", "key": "string", "doc": "int", "at": "int", "to": "int", "src": "string", "cuts": "array<int>", "marks": "string", "chunks": "array<int>", "lines": "int", "asks": "int", "full": "int", "Text2": "int", "a.b": "int"}


@pytest.mark.parametrize("hashed", [line_chunks._hash, lambda *x: F.pmod(F.xxhash64(*x), F.lit(13))], ids=["hash", "clashes"])
def test_line_dedup_equals_brute_force(spark, hashed):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, *[None] * (len(CLASHING) - 2)) for i, t in rows], ", ".join(f"`{c}` {k}" for c, k in CLASHING.items())).repartition(5)
    got = line_chunks.dedup_lines(df, hashed=hashed)
    assert got.columns == [*CLASHING, "n_lines", "n_removed"]
    want = brute_lines(rows)
    assert sum(r[3] for r in want) > 100
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("n_lines", [2, 3, 4, 6, 10])
def test_planted_passages_go_whole(spark, n_lines):
    rng = random.Random(n_lines)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    passages = [[line() for _ in range(n_lines)] for _ in range(30)]
    rows = [(k + 100 * c, "\n".join([f"head {k} {c}", *p, f"tail {k} {c}"])) for k, p in enumerate(passages) for c in range(3)]
    got = {r.doc_id: r.text for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == dict(rows)[k] and got[k + 100 * c] == f"head {k} {c}\ntail {k} {c}" for k in range(30) for c in (1, 2))


def test_line_dedup_is_native_and_handles_an_empty_table(spark):
    empty = line_chunks.dedup_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    assert "Python" not in empty._jdf.queryExecution().executedPlan().toString()
