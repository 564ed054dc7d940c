"""Hand labels: normalising, merging sources, editing, and filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlab.operators.series import by_clip

#: Events nearer than this to the one before them are the same event.
LEAST_GAP = 0.0005
# The names of the patterns with one, two, and three or more cuts; those of whole clips begin with "all".
PATTERNS = ("person->meme", "person->meme->person", "person->meme->person->meme")


def normalise_events(events: DataFrame, digits: int = 3) -> DataFrame:
    """(clip, k, sec, to) from rows (clip, sec): sorted, rounded, not negative, without repeats, with alternating labels.

    An event goes if its sorted predecessor, kept or not, is at most LEAST_GAP
    before it. Null and NaN times are dropped.
    """
    e = events.filter(F.col("sec").isNotNull() & ~F.isnan("sec")).select("clip", F.greatest(F.round("sec", digits), F.lit(0.0)).alias("sec"))
    order = by_clip().orderBy("sec")
    gap = F.col("sec") - F.lag("sec").over(order)
    kept = e.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") > LEAST_GAP))
    k = F.row_number().over(order) - 1
    return kept.withColumn("k", k).select("clip", "k", "sec", F.when(F.col("k") % 2 == 0, "meme").otherwise("person").alias("to"))


def predict_pattern(n: Column, current: Column) -> Column:
    """The pattern that a number of cuts suggests; without cuts a pattern for the whole clip stays, any other is cleared."""
    by_number = F.when(n == 1, PATTERNS[0]).when(n == 2, PATTERNS[1]).when(n >= 3, PATTERNS[2])
    return F.coalesce(by_number, F.when(current.startswith("all"), current), F.lit(""))


def with_cut_fields(clips: DataFrame, events: DataFrame) -> DataFrame:
    """Adds cuts, cut_sec (the first), has_transition and returns (two cuts or more) from normalised events."""
    c = events.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sec"))), lambda s: s["sec"]).alias("cuts"))
    r = clips.join(c, "clip", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    n = F.size("cuts")
    return r.withColumn("cut_sec", F.get("cuts", F.lit(0))).withColumn("has_transition", n > 0).withColumn("returns", n >= 2)


def last_by_key(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(pos)))).filter("rn = 1").drop("rn")


def merge_sources(base: DataFrame, local: DataFrame, second: DataFrame, third: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of each base row from the best source: the whole row of ``local`` or else ``second``; where that leaves a null, ``third``."""

    def as_struct(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key), F.struct(*fields).alias(name))

    r = base
    for df, name in ((local, "l"), (second, "s"), (third, "t")):
        r = r.join(as_struct(df, name), key, "left")
    row = F.coalesce("l", "s")
    source = F.when(F.col("l").isNotNull(), "local").when(F.col("s").isNotNull(), "second").when(F.col("t").isNotNull(), "third").otherwise("none")
    return r.select(*base.columns, *[F.coalesce(row.getField(f), F.col(f"t.{f}")).alias(f) for f in fields], source.alias("label_source"))


def blank_unedited(clips: DataFrame, blanks: dict[str, Column]) -> DataFrame:
    """Rows that nobody edited lose their labels, keeping all other columns; running it again changes nothing."""
    edited = F.coalesce("edited", F.lit(False))
    return clips.select(*[F.when(edited, F.col(c)).otherwise(blanks[c].cast(clips.schema[c].dataType)).alias(c) if c in blanks else F.col(c) for c in clips.columns])


def blanked_document(document: DataFrame) -> DataFrame:
    """A label document (one row, ``clips`` an array) whose unedited clips lose cuts, pattern and flags; notes and confidence stay.

    A null array stays null. A document is hand-made, and one row by its format.
    """

    def blank(c: Column) -> Column:
        kind = {f.name: f.dataType for f in document.schema["clips"].dataType.elementType.fields}
        values = {"cuts": F.array(), "cut_sec": F.lit(None), "has_transition": F.lit(False), "pattern": F.lit(""), "returns_to_creator": F.lit(False)}
        bare = F.struct(*[values[n].cast(t).alias(n) if n in values else c[n].alias(n) for n, t in kind.items()])
        return F.when(F.coalesce(c["edited"], F.lit(False)), c).otherwise(bare)

    return document.withColumn("clips", F.transform("clips", blank))


def blanking_counts(before: DataFrame) -> DataFrame:
    edited = F.coalesce("edited", F.lit(False))
    return before.agg(F.count_if(edited).alias("kept"), F.count_if(~edited).alias("cleared"), F.count("*").alias("total"))


def differs(edited: Column, has_transition: Column, cut: Column, reference: Column, tolerance: float = 0.05) -> Column:
    """An edited row whose effective cut is not the reference's: only one of them is null, or they lie apart."""
    own = F.when(F.coalesce(has_transition, F.lit(True)), cut)
    return F.coalesce(edited, F.lit(False)) & ((own.isNull() != reference.isNull()) | F.coalesce(F.abs(own - reference) > tolerance, F.lit(False)))


def filter_counts(clips: DataFrame) -> DataFrame:
    """How many rows each list filter shows, in one pass."""
    edited = F.coalesce("edited", F.lit(False))
    no_cut = F.coalesce(F.size("cuts"), F.lit(0)) == 0
    return clips.agg(F.count("*").alias("all"), F.count_if(~edited).alias("unedited"), F.count_if(edited).alias("edited"), F.count_if(no_cut).alias("no_cut"), F.count_if("differs").alias("differs"))


def latest_flags(toggles: DataFrame) -> DataFrame:
    """(clip, flag) after toggles (clip, pos, flag): the same value again clears a flag, another one replaces it."""
    order = by_clip().orderBy("pos")
    t = toggles.withColumn("run", F.sum(F.when(F.lag("flag").over(order).eqNullSafe(F.col("flag")), 0).otherwise(1)).over(order))
    last = t.groupBy("clip", "run", "flag").agg(F.count("*").alias("n"))
    top = last.groupBy("clip").agg(F.max(F.struct("run", "flag", "n")).alias("l"))
    return top.select("clip", F.when(F.col("l.n") % 2 == 1, F.col("l.flag")).alias("flag"))


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normal_cuts(cuts: Column) -> Column:
    """An array of times as ``normalise_events`` leaves it: sorted, rounded, not negative, without repeats; null times are dropped."""
    known = F.filter(cuts, lambda c: c.isNotNull() & ~F.isnan(c))
    tidy = F.array_sort(F.transform(known, lambda c: F.greatest(F.round(c, 3), F.lit(0.0))))
    return _once(tidy, lambda s: F.filter(s, lambda c, i: (i == 0) | (c - F.get(s, i - 1) > LEAST_GAP)))


def _edited(state: Column, edit: Column, reference: Column) -> Column:
    """The state (cuts, edited, pattern) after one edit."""
    cuts, at, value = state["cuts"], edit["index"], edit["value"]
    empty = F.array().cast("array<double>")
    op = F.when((edit["op"] == "set") & value.isNull(), "remove").otherwise(F.coalesce(edit["op"], F.lit("")))
    here = F.coalesce((at >= 0) & (at < F.size(cuts)), F.lit(False))
    whole = F.coalesce(edit["text"].startswith("all"), F.lit(False))
    idle = (op.isin("nudge", "set", "remove") & ~here) | (op.isin("add", "nudge") & value.isNull())
    with_one = lambda f: F.transform(cuts, lambda c, i: F.when(i == at, f(c)).otherwise(c))
    raw = (
        F.when(op == "add", F.concat(cuts, F.array(value)))
        .when(op == "nudge", with_one(lambda c: c + value))
        .when(op == "set", with_one(lambda c: value))
        .when(op == "remove", F.filter(cuts, lambda c, i: i != at))
        .when(op == "copy", F.when(reference.isNotNull(), F.array(reference)).otherwise(empty))
        .when((op == "clear") | ((op == "pattern") & whole), empty)
    )
    changed = F.coalesce(normal_cuts(raw), cuts)
    pattern = lambda c: F.when(op == "pattern", F.coalesce(edit["text"], F.lit(""))).when(op.isin("add", "remove", "clear", "copy"), predict_pattern(F.size(c), state["pattern"])).otherwise(state["pattern"])
    after = _once(changed, lambda c: F.struct(c.alias("cuts"), F.lit(True).alias("edited"), pattern(c).alias("pattern")))
    mark_off = F.struct(cuts.alias("cuts"), F.lit(False).alias("edited"), state["pattern"].alias("pattern"))
    return F.when(op == "reset", mark_off).when(idle, state).otherwise(after)


def apply_edits(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """(clip, cuts, edited, pattern) after the ordered edits (clip, pos, op, index, value, text) of each clip.

    clips: clip, cuts, edited, pattern, reference. ops: add (seconds), nudge
    (index, seconds), set (index, seconds; without a value it removes), remove
    (index), clear, pattern (text; one for the whole clip clears the cuts), copy
    (the reference's cut, or none), reset. All normalise, and mark the clip
    edited; add, remove, clear and copy guess the pattern anew. Any other op, a
    null one too, is an edit of another field: it marks the clip. An index out
    of range does nothing, nor does a null or NaN value to add or nudge by.
    Reset takes the mark off and leaves the cuts. Edits at the same place go by
    op, index, value and text. Null cuts are none, a null mark is off, a null
    pattern or text empty; a null clip has no edits, edits of unknown clips are left out.

    A clip's edits are a hand-made list: they are put in order in one array, and
    a fold over it, whose state is the clip's labels, makes every step.
    """
    value = F.col("value").cast("double")
    # Nulls in an ordered struct come first; a value that is not a number counts as none.
    rows = edits.select("clip", F.struct("pos", "op", F.col("index").cast("int").alias("index"), F.when(~F.isnan(value), value).alias("value"), "text").alias("edit"))
    lists = rows.groupBy("clip").agg(F.array_sort(F.collect_list("edit")).alias("steps"))
    reference = F.col("reference").cast("double")
    joined = clips.select(
        F.col("clip"), F.coalesce("cuts", F.array()).cast("array<double>").alias("cuts"), F.coalesce("edited", F.lit(False)).alias("edited"),
        F.coalesce("pattern", F.lit("")).alias("pattern"), F.when(~F.isnan(reference), reference).alias("reference"),
    ).join(lists, "clip", "left")
    begin = F.struct("cuts", "edited", "pattern")
    # Whoever has no edits stays as it is.
    end = F.when(F.col("steps").isNull(), begin).otherwise(F.aggregate("steps", begin, lambda state, edit: _edited(state, edit, F.col("reference"))))
    return joined.select("clip", end.alias("end")).select("clip", "end.cuts", "end.edited", "end.pattern")
