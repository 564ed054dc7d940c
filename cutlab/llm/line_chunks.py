"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash runs over the hashes of two neighbouring lines at a time. A
boundary falls between two lines where the rolling hash stands nowhere earlier
in the corpus; lines between two boundaries are a chunk. Boundaries depend on
the lines next to them alone, so that lines inserted elsewhere shift none, and a
chunk of several lines is by construction a repeated one, up to its last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlab.llm.common import WORD, drop_stored, stored

#: A line with more words is looked up on its own as well.
LONG_WORDS = 50
#: Repetitions that share one copy of their first text when bytes are compared.
SALT_ROWS = 512

_LETTER = r"[^\x20\x09-\x0D]"


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, even where functions over arrays use them once an element.

    A generator of one row keeps the optimiser from moving their expressions into those functions.
    """
    one = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_one")
    return df.select("*", one).select(*df.columns, *[F.col(f"_one.{name}").alias(name) for name in columns])


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, text): all other columns in one struct; rows of the same id and text share a key."""
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(others.alias("doc"), F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t")).alias("key"), text.alias("text"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _slice_text(lines: Column, at: Column, to: Column) -> Column:
    """Lines ``at`` to ``to``, joined."""
    return F.array_join(F.slice(lines, at + 1, to - at + 1), "\n")


def windows(rows: DataFrame, long_words: int = LONG_WORDS, hashed=_hash) -> DataFrame:
    """(key, hash, at, to) for rows (key, text): the rolling hash over each two neighbouring lines, and the hash of each long line.

    Blank lines count as space between neighbours.
    """
    full = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: (F.ascii(s["x"]) > 32) | s["x"].rlike(_LETTER))
    rows = _computed(rows.select("key", "text"), full=full).drop("text").filter(F.size("full") > 0)
    n = F.size("full") - 1
    rolling = F.zip_with(F.slice("full", F.lit(1), n), F.slice("full", F.lit(2), n), lambda a, b: F.struct(hashed(a["x"], b["x"], b["i"] - a["i"]).alias("hash"), a["i"].alias("at"), b["i"].alias("to")))
    is_long = lambda s: (F.length(s["x"]) > 2 * long_words) & (F.regexp_count(s["x"], F.lit(WORD)) > long_words)
    alone = F.transform(F.filter("full", is_long), lambda s: F.struct(hashed(s["x"]).alias("hash"), s["i"].alias("at"), s["i"].alias("to")))
    return rows.select("key", F.explode(F.concat(rolling, alone)).alias("w")).select("key", "w.hash", "w.at", "w.to")


def _again(found: DataFrame, *by: str) -> DataFrame:
    """Rows of ``found`` whose ``by`` stands earlier, with the key and place of its first row; a row may not overlap that."""
    first = stored(found.groupBy(*by).agg(F.min(F.struct("key", "at", "to")).alias("first")))  # so that the join below can split a window that very many documents share
    later = (F.col("key") != F.col("first.key")) | (F.col("at") > F.col("first.to"))
    return found.join(first, list(by)).filter(later).select("key", *by, "at", "to", F.col("first.key").alias("src"), F.col("first.at").alias("src_at"))


def _joined(rows: DataFrame, *by: str, touching: int = 0) -> DataFrame:
    """Ranges (at, to) of equal ``by`` that overlap, or with ``touching`` follow on one another, made one."""
    order = Window.partitionBy(*by).orderBy("at", "to")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("is_new", F.when(before >= F.col("at") - touching, 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("is_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "part").agg(F.min("at").alias("at"), F.max("to").alias("to")).drop("part")


def _ranges(rows: DataFrame) -> DataFrame:
    """(key, cuts): the ranges of each key, disjoint and in order."""
    return _joined(rows.select("key", "at", "to"), "key", touching=1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("cuts"))


def repeated(rows: DataFrame, long_words: int = LONG_WORDS, hashed=_hash) -> tuple[DataFrame, DataFrame]:
    """(again, chunks) of rows (key, text): windows that stand earlier, and chunks of them (key, src, at, to, src_at).

    A chunk's windows follow on one another both in its text and in the one text
    where they stood first. Both are stored tables.
    """
    found = stored(windows(rows, long_words, hashed))
    often = stored(found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    again = stored(_again(stored(found.join(often, "hash", "left_semi")), "hash"))
    drop_stored(found)
    shifted = again.withColumn("shift", F.col("at") - F.col("src_at"))
    chunks = _joined(shifted, "key", "src", "shift").select("key", "src", "at", "to", (F.col("at") - F.col("shift")).cast("int").alias("src_at"))
    return again, stored(chunks)


def _with_tasks(keyed: DataFrame, again: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds cuts (ranges to remove), asks (chunks to compare with their source) and gives (texts that chunks ask for)."""
    salts = F.ceil(F.count("*") / SALT_ROWS).cast("int")
    asked = chunks.withColumn("more", F.col("to") - F.col("at"))
    wanted = stored(asked.groupBy("src", "src_at", "more").agg(salts.alias("salts")))
    asks = asked.join(wanted, ["src", "src_at", "more"])
    asks = asks.select("key", F.struct("src", "src_at", "at", "to", "salts").alias("ask"), F.lit(None).cast("struct<at:int,to:int,salts:int>").alias("give"))
    gives = wanted.select(F.col("src").alias("key"), F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"), F.struct(F.col("src_at").alias("at"), (F.col("src_at") + F.col("more")).alias("to"), "salts").alias("give"))
    tasks = asks.unionByName(gives).groupBy("key").agg(F.collect_list("ask").alias("asks"), F.collect_list("give").alias("gives"))
    return keyed.join(tasks.join(_ranges(again), "key", "left"), "key", "left")


def _differing(tasked: DataFrame) -> DataFrame:
    """(key, at, to): chunks whose bytes are not those of their source."""
    rows = tasked.filter("asks is not null").select("key", "asks", "gives", _lines(F.col("text")).alias("lines"))
    rows = _computed(rows, asked=F.struct("asks", "gives", "lines"))
    text = lambda x: _slice_text(F.col("asked.lines"), x["at"], x["to"])
    own = rows.select("key", F.explode(F.transform("asked.asks", lambda a: F.struct(a["src"].alias("src"), a["src_at"].alias("src_at"), a["at"].alias("at"), a["to"].alias("to"), a["salts"].alias("salts"), text(a).alias("text")))).alias("a")).select("key", "a.*")
    own = own.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.col("salts")).cast("int")).withColumn("more", F.col("to") - F.col("at")).drop("salts")
    given = rows.select("key", F.explode(F.transform("asked.gives", lambda g: F.struct(g["at"].alias("at"), (g["to"] - g["at"]).alias("more"), g["salts"].alias("salts"), text(g).alias("text")))).alias("g"))
    given = given.select(F.col("key").alias("src"), F.col("g.at").alias("src_at"), "g.more", "g.salts", F.col("g.text").alias("src_text")).dropDuplicates(["src", "src_at", "more"])
    given = given.select("src", "src_at", "more", "src_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return own.join(given, ["src", "src_at", "more", "salt"]).filter("text <> src_text").select("key", "at", "to")


def _settled(keyed: DataFrame, again: DataFrame, differ: DataFrame, long_words: int, hashed) -> DataFrame:
    """The windows to remove where hashes clash: those of the clashing hashes are told apart by their bytes."""
    wrong = differ.select("key", F.col("at").alias("from"), F.col("to").alias("upto"))
    clashing = stored(again.join(wrong, "key").filter("at >= from and to <= upto").select("hash").distinct())
    places = windows(keyed, long_words, hashed).join(clashing, "hash", "left_semi").groupBy("key").agg(F.collect_set(F.struct("at", "to")).alias("places"))
    told = _computed(keyed.join(places, "key").select("key", "places", _lines(F.col("text")).alias("lines")), both=F.struct("places", "lines"))
    told = told.select("key", F.explode(F.transform("both.places", lambda p: F.struct(p["at"].alias("at"), p["to"].alias("to"), _slice_text(F.col("both.lines"), p["at"], p["to"]).alias("bytes")))).alias("p")).select("key", "p.*")
    return again.join(clashing, "hash", "left_anti").select("key", "at", "to").unionByName(_again(stored(told), "bytes").select("key", "at", "to"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS, hashed=_hash) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, plus n_lines and n_removed (replacing columns of these names).

    A line goes when it belongs to a run of two or more lines that are not blank,
    or has more than ``long_words`` words, and that run or line stands byte for
    byte earlier in the corpus: in a document with a smaller id, or further up
    in the same one without overlap. The first occurrence stays; blank lines
    inside a removed run, or between two that follow on one another, go with it.

    A null text stays null, an empty one empty; a text that loses every line
    becomes empty. n_lines counts the lines before, n_removed those that went;
    both are 0 for a null text. Rows of the same id and text are left for exact
    dedup: they count as one occurrence. Null ids are one id, before all others.
    Of different texts with the same id the one with the smaller hash comes
    first. Any other column may have any name.

    Keys, places and hashes alone are shuffled to find chunks. Texts are
    shuffled once, to their chunks, and those of repeated chunks once more, to
    be compared with the first occurrence, which is copied once per SALT_ROWS.
    """
    docs = docs.drop("n_lines", "n_removed")
    keyed = _keyed(docs, id_col, text_col)
    texts = keyed.filter("text is not null").select("key", "text")
    again, chunks = repeated(texts, long_words, hashed)
    tasked = stored(_with_tasks(keyed, again, chunks))
    differ = stored(_differing(tasked))
    if not differ.isEmpty():
        cuts = stored(_ranges(_settled(texts, again, differ, long_words, hashed)))
        tasked = tasked.drop("cuts").join(cuts, "key", "left")
    drop_stored(again, chunks, differ)

    rows = tasked.select("doc", "text", F.coalesce("cuts", F.array().cast("array<struct<at:int,to:int>>")).alias("cuts"))
    untouched = rows.withColumn("n_lines", F.coalesce(F.size(_lines(F.col("text"))), F.lit(0))).withColumn("n_removed", F.lit(0))
    split = _computed(rows.filter(F.size("cuts") > 0), lines=_lines(F.col("text")))
    # What lies before, between and after the removed ranges.
    begin = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["to"] + 1))
    end = F.concat(F.transform("cuts", lambda c: c["at"]), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(begin, end, lambda a, b: F.slice("lines", a + 1, b - a)))
    split = split.withColumn("kept", kept).select("doc", F.array_join("kept", "\n").alias("text"), "cuts", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_removed"))
    out = untouched.filter(F.size("cuts") == 0).unionByName(split)
    text = F.col("text").cast(docs.schema[text_col].dataType)
    return out.select(*[text.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns], "n_lines", "n_removed")
