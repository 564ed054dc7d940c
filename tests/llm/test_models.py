import math
import os
import random
import zlib

import numpy as np
import pytest
from cutlab.llm import contents, cube_mix, ego_join, langid, site_style, toxicity
from cutlab.llm.common import held_out

SYLLABLES = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["shlo", "vre", "gnu", "pfa"], "zz": ["éa", "où", "çi", "âe"]}


def sentence(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_language_id_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, sentence(l, rng, 20), l) for i in range(300) for l in [rng.choice(sorted(SYLLABLES))]]
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 ... ؟", None), (1003, "karomi", None), (1004, sentence("yy", rng, 200_000), "yy"), (1005, None, None)]
    df = spark.createDataFrame([(*r, "e", 0.5) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double").withColumn("held_out", held_out())
    out = {r.doc_id: r for r in langid.predict(df, langid.fit(df.filter("not held_out"))).collect()}
    assert len(out) == len(rows) + len(odd)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert np.mean([out[i].lang_pred == l for i, _, l in rows if out[i].held_out]) > 0.98
    assert [out[k].lang_pred for k in (1000, 1001, 1002, 1005)] == ["und"] * 4 and out[1004].lang_pred == "yy" and out[1003].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in out.values())
    nothing = langid.fit(df.filter("lang is null"))
    assert {r.lang_pred for r in langid.predict(df.limit(3), nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), nothing).count() == 0


def grams(text):
    """The buckets of a text's runs of letters, gram by gram."""
    line = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "") + " "
    while "  " in line:
        line = line.replace("  ", " ")
    for n in (1, 2, 3) if line != " " else ():
        for gram in (line[k : k + n] for k in range(len(line) - n + 1)):
            h = 0
            for place, c in enumerate(gram, 1):
                h = (h * 0x9E3779B1 + (ord(c) + place) * 0x85EBCA6B) % 2**32
            yield ((h ^ (h >> 15)) * 0xC2B2AE35 % 2**32 >> 7) % 2**16


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_language_id_equals_naive_bayes_in_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").filter("doc_id % 3 <> 1 or lang is null")
    rows = docs.collect()
    counts, n_docs = {}, {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            n_docs[r.lang] = n_docs.get(r.lang, 0) + 1
            own = counts.setdefault(r.lang, {})
            for g in grams(r.text):
                own[g] = own.get(g, 0) + 1
    langs = sorted(counts)
    total = {l: sum(counts[l].values()) + 0.5 * 2**16 for l in langs}
    expected = {}
    for r in rows:
        seen = list(grams(r.text))
        logs = [math.log((n_docs[l] + 1) / (sum(n_docs.values()) + len(langs))) + math.fsum(math.log((counts[l].get(g, 0) + 0.5) / total[l]) for g in seen) for l in langs]
        best = max(range(len(langs)), key=lambda k: (logs[k], -k))
        expected[r.doc_id] = (langs[best], 1 / sum(math.exp(x - logs[best]) for x in logs)) if seen else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs.filter(~held_out()))).collect()}
    assert set(got) == set(expected) and len(langs) > 1
    assert all(got[k][0] == expected[k][0] and got[k][1] == pytest.approx(expected[k][1], abs=1e-6) for k in got)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    bad = ["vilkur", "smagdor", "tunfeck"]
    rows = []
    for i in range(4000):  # a trained dictionary needs more text than a list of words
        w = sentence("xx", rng, rng.randrange(10, 60)).split()
        toxic = int(rng.random() < 0.25)
        for _ in range(rng.randrange(1, 4) * toxic):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(8000, None), (8001, ""), (8002, "karo " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7777, 1), (8000, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels.filter(~held_out()))).collect()}
    fresh = [(out[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == y for p, y in fresh]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values()) and len(out) == 4003
    assert toxicity.windows("語" * 55_000) == [f" {'語' * n} ".encode() for n in [toxicity.LONG_WORD] * (55_000 // toxicity.LONG_WORD) + [55_000 % toxicity.LONG_WORD] * (55_000 % toxicity.LONG_WORD > 0)]
    assert toxicity.windows("a " * 9 + "b" * 50 + " C") == [b" a a a a a a a a ", b" a ", b" " + b"b" * 40 + b" ", b" " + b"b" * 10 + b" ", b" c "]
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs.limit(5), none).collect()} == {0}
    assert toxicity.score(docs.limit(0), none).count() == 0


def brute_vectors(rows, limit):
    ok = [(i, l, np.array(v, float)) for i, l, v in rows if l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(v)]
    links = {k: [] for k in range(len(ok))}
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][2], ok[b][2]
            if ok[a][1] == ok[b][1] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= limit:
                links[a].append(b)
                links[b].append(a)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[k] = (len(links[k]), min(ok[j][0] for j in seen))
    usable = {id(r[2]) for r in rows if r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and np.any(r[2])}
    found = [(ok[k][0], *v) for k, v in out.items()] + [(i, 0, i) for i, l, v in rows if l is None or id(v) not in usable]
    return sorted((i, n, c, c == i) for i, n, c in found)


@pytest.mark.parametrize("block, leaf", [(4096, 256), (4096, 5), (7, 256), (30, 4)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block, leaf):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ego_join, "BLOCK", block)
    monkeypatch.setattr(ego_join, "LEAF", leaf)
    monkeypatch.setattr(ego_join, "AXES_DIMS", 16 if leaf > 4 else 10)
    rows = []
    for c in range(25):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 14)):
            rows.append((len(rows), int(c % 3), (centre + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.16])).astype(np.float32).tolist()))
    same = rows[0][2]
    rows += [(1000 + k, 0, same) for k in range(40)] + [(2000, None, same), (2001, 0, None), (2002, 0, [0.0] * 16), (2003, 0, [float("nan")] * 16), (2004, 0, [None] + same[1:]), (2005, 0, [float("inf")] * 16), (2006, 0, []), (2007, 0, same[:3]), (2008, 0, [x * 3 for x in same]), (2009, 0, [-x for x in same])]
    # Ids that repeat over labels and vectors are vectors each.
    rows += [(1, 1, rows[3][2]), (1, 2, [-x for x in same]), (4, 2, [-x for x in same]), (1, 2, [-x for x in same])]
    df = spark.createDataFrame([(i, l, v, 5) for i, l, v in rows], "vec_id long, label int, embedding array<float>, n int").repartition(4)
    got = ego_join.near_vectors(df)
    exact = [(i, l, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == brute_vectors(exact, 0.98)


def test_repeated_ids_keep_their_own_links(spark):
    rows = [(1, "l", [1.0, 0.0]), (1, "m", [0.0, 1.0]), (2, "l", [1.0, 0.01]), (3, "m", [0.01, 1.0])]
    got = ego_join.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_distant_intervals_are_never_opened(spark, monkeypatch):
    """Vectors on an arc: each meets its neighbours in the sequence, so pairs of blocks grow with the blocks, not with their square."""
    monkeypatch.setattr(ego_join, "BLOCK", 4)
    n = 2000
    angle = np.linspace(0, 1.9, n)
    df = spark.createDataFrame([(k, 0, [float(np.cos(a)), float(np.sin(a)), 0.0]) for k, a in enumerate(angle)], "vec_id long, label int, embedding array<double>")
    seen = []
    pairs = ego_join._near_pairs
    monkeypatch.setattr(ego_join, "_near_pairs", lambda b, e: seen.append((b.count(), (p := pairs(b, e)).count())) or p)
    got = ego_join.near_vectors(df, cosine=1 - 2e-5).collect()
    assert {r.component_id for r in got} == {0} and sum(r.n_links for r in got) > 10 * n
    assert seen[0][0] >= n / 4 and seen[0][1] < 10 * seen[0][0]


def test_near_leaves_hold_all_near_places():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(900, 8)) * 0.3, rng.normal(size=(700, 8)) * 0.3
    a, b = a[a[:, 0].argsort()], b[b[:, 0].argsort()]
    near = np.argwhere(((a[:, None] - b[None]) ** 2).sum(axis=2) <= 0.2**2) // 64
    found = set(ego_join._near_leaves(a, b, False, 0.2, 64))
    assert {tuple(p) for p in near.tolist()} <= found and len(found) < 15 * 11
    assert all(i <= j for i, j in ego_join._near_leaves(a, a, True, 0.2, 64))


def test_near_vectors_of_nothing(spark):
    assert ego_join.near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
    odd = spark.createDataFrame([(1, None, [1.0])], "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in ego_join.near_vectors(odd).collect()] == [(1, 0, 1, True)]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    target, rest, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        free -= over
    return target


def test_targets_and_mix(spark, monkeypatch):
    monkeypatch.setattr(cube_mix, "BLOCK", 64)
    rng = random.Random(6)
    rows = []
    for s, n in (("a", 900), ("b", 30), ("Z", 200), ("é", 3), (None, 60), ("empty", 5)):
        for _ in range(n):
            k = 0 if s == "empty" else int(rng.lognormvariate(3, 1)) + (5000 if rng.random() < 0.003 else 0)
            rows.append((len(rows), None if k == 0 else " ".join(["w"] * k), s, k))
    df = spark.createDataFrame([(i, t, s, 3.0) for i, t, s, _ in rows], "doc_id long, text string, source string, target double")
    out = cube_mix.mix_sources(df).collect()
    again = cube_mix.mix_sources(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again) and len(out) == len(rows)
    sizes = {}
    for _, _, s, k in rows:
        sizes[s] = sizes.get(s, 0) + k
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for r in own)
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(400.0, 0.02 * want[s])
        if want[s] == 3 * sizes[s]:
            assert all(r.copies == 3 for r in own if r.size)
    assert cube_mix.mix_sources(df.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 500, 300).astype(float)
    p = rng.random(300)
    q = cube_mix.fly(p, size, rng)
    free = (q > 1e-9) & (q < 1 - 1e-9)
    assert free.sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
    assert set(np.round(cube_mix.land(q, size), 9)) <= {0.0, 1.0}
    assert set(cube_mix.fly(np.full(5, 0.5), np.ones(5), rng)[:3]) <= {0.0, 1.0}


def page(host, k, body, head=""):
    return (k, f"https://{host}/{k}", f"<html><head><title>t</title>{head}</head><body>{body}</body></html>")


def test_main_text_of_marked_pages(spark):
    body = (
        "<nav>Menu</nav><header>Top</header><div class='cookie-notice'>We use cookies</div><form><p>Sign up</p></form>"
        "<article><h1>Title &amp; more</h1><p><b>First  line<br><p>Second&nbsp;line <i>it</i>alic</p><div class=ad>Buy</div><script>var x='</p>'</script><!-- c --><ul><li>one<li>two</ul></article>"
        "<aside>Side</aside><div id=comments><p>Nice post</p></div><footer>&copy; me</footer>"
    )
    rows = [page("h.example", 1, body), (2, None, None), (3, "::bad::url[", ""), (4, "https://h.example/4", "plain < text"), page("h.example", 5, "<div class='has-sidebar'><main>Kept</main></div>"), page("h.example", 6, "<p>" + "long word " * 50_000 + "</p>"), (None, None, "<p>no id</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:1]], "page_id long, url string, html string, text string")
    got = site_style.main_text(df).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "Title & more First line Second line italic one two" and by[2] == by[3] == "" and by[5] == "Kept" and by[None] == "no id"
    assert by[4].startswith("plain <") and by[6] == ("long word " * 50_000).strip()
    assert site_style.main_text(df.limit(0)).count() == 0


def article_of(html):
    return " ".join(t for _, w, t in site_style.parse_page(html) if w > site_style.NAMED)


@pytest.mark.parametrize("html, text", [
    ("a<![foo[ x ]]>b<![CDATA[ y > z", "ab z"), ("<p>x</p><!-- oops <p>y", "x"), ("<p>x</p><!--> y", "x y"), ("x <b", "x"), ("x </b", "x"), ("1 < 2", "1 < 2"),
    ("<article class='news alert'><h1>T</h1><p>body of it</p></article><article class=teaser>More</article>", "T body of it"),
    ("<article>One</article><article class='teaser'>" + "long " * 50 + "</article>", "One"),
    ("<article><div class='post-header'><h1>T</h1></div><p class='form-note'>n</p><p>a <span class=ad>buy</span> b</p></article>", "T n a b"),
    ("<div class='sidebar'><main>Kept</main></div><div>out</div>", "Kept"),
])
def test_pages_that_parsers_stumble_on(html, text):
    assert " ".join(article_of(html).split()) == text


def test_deep_pages_take_linear_time():
    for html, n in (("<div>x" * 100_000, 100_000), ("<div><b>x" * 30_000 + "</section></i>" * 30_000, 30_000), ("<h1><b>x" * 30_000, 30_000)):
        assert len(site_style.parse_page(html)) == n


def test_tree_finds_unmarked_templates_and_spares_copies(spark):
    """div.x1 reads alike on all pages of the host; nothing in its markup says so."""
    tpl = lambda k: f"<div class=x1><p>Welcome to our site</p></div><div class=x2><p>Article {k} says {k * k} things</p><p>and {k} more</p></div><div class=x3>All about us</div>"
    copy = "<div class=x1><p>Same</p></div><div class=x2><p>Everywhere</p></div>"
    rows = [page("tpl.example", k, tpl(k)) for k in range(30)] + [page("copy.example", 100 + k, copy) for k in range(30)]
    # Three pages a host tell little, but the same branch of 40 hosts does.
    rows += [page(f"few{h}.example", 200 + 3 * h + k, f"<div class=y1>Our partners</div><div class=y2>Story {h}-{k} of {h * 7 + k} days</div>") for h in range(40) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in site_style.main_text(df).collect()}
    assert all(got[k].text == f"Article {k} says {k * k} things and {k} more" and got[k].n_removed == got[k].n_by_tree == 2 for k in range(30))
    assert all(got[100 + k].text == "Same Everywhere" for k in range(30))
    assert all(got[200 + 3 * h + k].text == f"Story {h}-{k} of {h * 7 + k} days" for h in range(40) for k in range(3))
    joined = {r.page_id: r for r in site_style.main_text(df, most_shared=0).collect()}
    assert joined == got


def test_importance_is_the_entropy_of_the_definition(spark):
    """One node on 16 pages, with a feature on 4 of them and one on all; three forms of presentation."""
    rows = [(1, 1, 1, 100)] * 16 + [(1, 1, 1, 101)] * 4 + [(1, 1, 0, f) for f in [7] * 8 + [8] * 4 + [9] * 4]
    got = site_style.node_importance(spark.createDataFrame(rows, "node long, path long, kind int, feature long")).collect()
    p = np.array([8, 4, 4]) / 16
    own = 0.1 * -(p * np.log(p)).sum() / np.log(16) + 0.9 * (1 - (16 * 1.0 + 4 * 0.5) / 20)
    assert [r.node for r in got] == [1] and abs(got[0].importance - (16 * own + 8) / 24) < 1e-9


@pytest.mark.parametrize("bits, most", [(0, 1 << 18), (5, 100)])
def test_every_word_pair_counts(spark, monkeypatch, bits, most):
    """Packed sums equal those of plain rows of all pairs of words, on hosts of many, few and single pages, with copies."""
    monkeypatch.setattr(contents, "PAGES_PER_BUCKET", 120 >> bits or 1)
    monkeypatch.setattr(contents, "SUMMED_FEATURES", most)
    monkeypatch.setattr(contents, "HASHED_BYTES", 50)
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["a", "ü", "of", "words", "日本", "x" * 70]) for _ in range(rng.choice([1, 2, 60])))
    rows = [page(f"h{rng.choice([0, 0, 0, k])}.example", k, f"<h1>{text()}</h1><p>{text()}</p><div class=c{k % 3}>{text()}<p>{text()}</p></div>") for k in range(90)]
    rows += [(100 + i, *r[1:]) for i, r in enumerate(rows[:20])] + [page("none.example", 200, "")]
    tree = site_style.parsed(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), "page_id", "url", "html").cache()
    plain, copies = set(), set()
    for n, r in enumerate(tree.collect()):
        if r.digest in copies:
            continue
        copies.add(r.digest)
        for s in r.seen:
            plain.add((n, s.node, s.path, 0, s.form))
        paths = {s.node: s.path for s in r.seen}
        for b in r.blocks:
            words = b.text.split(" ")
            plain |= {(n, b.node, paths[b.node], 1, hash((v, w))) for v, w in zip(words, words[1:])} if len(words) > 1 else {(n, b.node, paths[b.node], 1, hash(words[0]))}
    want = {r.node: r.importance for r in site_style.node_importance(spark.createDataFrame([r[1:] for r in plain], "node long, path long, kind int, feature long")).collect()}
    got = {r.node: r.importance for r in site_style._judged(contents.sums(site_style._distinct(tree))).collect()}
    assert got.keys() == want.keys() and len({round(v, 6) for v in want.values()}) > 10
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_few_constant_pairs_do_not_decide(spark):
    """Eight pairs that stand on every page among 160 that do not: those eight have the smallest hashes, which a sketch kept alone."""
    constant = ["nikesa kimibe", "boleti netesa", "lunanu kumesi", "limole sotise", "betesa bediki", "kedile nubora", "toluna rasibe", "kunida limeme"]
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(40):
        lines = [f"{c} {' '.join(str(rng.randrange(10**6)) for _ in range(20))}" for c in constant]
        want[k] = " ".join(["Page", str(k), *lines])
        rows.append(page("pairs.example", k, f"<h2>Page {k}</h2><div class=z>" + "".join(f"<p>{line}</p>" for line in lines) + "</div>"))
    got = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(want[k].split(" ", 2)[2] in got[k] for k in want)


WRAPPED = {
    "form": "<form id=aspnetForm><div class=top><a>Home</a> <a>About us</a></div>{body}<div class=newsletter>Sign up now</div></form>",
    "comment": "<div class=top>Our site</div><div id=content><div class='post comment'>{body}</div></div><footer>All about us</footer>",
    "widget": "<div class='main has widget'>{body}</div><div class=sidebar>Latest offers here</div>",
}


@pytest.mark.parametrize("name", sorted(WRAPPED))
def test_names_do_not_overrule_the_tree(spark, name):
    """A form or a class that wraps the whole body does not take it away; what is named or dull inside still goes."""
    rng = random.Random(5)
    bodies = {k: " ".join(sentence("xx", rng, 30).split()) for k in range(30)}
    rows = [page("wrapped.example", k, WRAPPED[name].format(body=f"<p>{t}</p>")) for k, t in bodies.items()]
    got = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == bodies


def test_varying_bylines_are_dull(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(40):
        want[k] = sentence("yy", rng, 40)
        menu = " ".join(rng.sample(["Home", "News", "Sport", "Money", "Travel", "Food"], 4))
        byline = f"Published on {k % 28 + 1} {rng.choice(['May', 'June'])} by {sentence('xx', rng, 1)} in {rng.choice(['News', 'Sport'])}"
        rows.append(page("byline.example", k, f"<div class=b0>{menu}</div><div class=b1>{byline}</div><div class=b2><p>{want[k]}</p></div>"))
    got = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
