"""Names, labels and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(name: Column) -> Column:
    """The last 12 characters before ``.mp4``; a name without that suffix is unchanged."""
    return F.when(name.endswith(".mp4"), F.right(F.left(name, F.length(name) - 4), F.lit(12))).otherwise(name)


def short_id_always(name: Column) -> Column:
    """The same, with the last four characters cut from any name."""
    return F.right(F.left(name, F.greatest(F.length(name) - 4, F.lit(0))), F.lit(12))


def stem(name: Column) -> Column:
    """The name without ``.mp4`` in any case, else without its last extension."""
    return F.when(name.rlike(r"(?i)\.mp4$"), F.regexp_replace(name, r"(?i)\.mp4$", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def pattern(labels: Column) -> Column:
    """The first four characters of each label, joined by arrows."""
    return F.concat_ws("→", F.transform(labels, lambda x: F.left(x, F.lit(4))))


def pretty_pattern(p: Column, shown: dict[str, str] | None = None) -> Column:
    for old, new in (shown or {"pers": "creator"}).items():
        p = F.replace(p, F.lit(old), F.lit(new))
    return F.replace(p, F.lit("→"), F.lit(" → "))


def seconds(t: Column, missing: str = "none") -> Column:
    return F.when(t.isNotNull(), F.format_string("%.2fs", t)).otherwise(F.lit(missing))


def seconds_list(ts: Column, missing: str = "—") -> Column:
    return F.when(F.coalesce(F.size(ts), F.lit(0)) > 0, F.concat_ws(", ", F.transform(ts, lambda t: F.format_string("%.2f", t)))).otherwise(F.lit(missing))


def percent_of(x: Column, dur: Column) -> Column:
    """Position on a bar that is 100 wide; an unknown or short duration counts as 1."""
    return x / F.greatest(F.coalesce(dur, F.lit(1.0)), F.lit(1.0)) * 100


def frames_per_second(last_frame: Column, last_time: Column, default: float = 30.0) -> Column:
    frame, time = (F.when(c != 0, c.cast("double")) for c in (last_frame, last_time))
    return F.coalesce(frame / time, F.lit(default))


def frame_number(t: Column, fps: Column) -> Column:
    return F.round(t * fps).cast("long")


def nominal_frame(t: Column, fps: Column, total: Column) -> Column:
    """The frame at a time if all lasted equally long: int(t * fps), at most the last one; below 0 without frames."""
    return F.least((t * fps).cast("long"), total.cast("long") - 1)


def clamp(t: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(t, low), high)


def html_escape(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def url_path(s: Column) -> Column:
    """Percent-encoded, a blank as %20."""
    return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))


def head(s: Column, n: int = 45) -> Column:
    return F.left(F.coalesce(s, F.lit("")), F.lit(n))


def segment_file(index: Column, label: Column) -> Column:
    return F.format_string("%02d_%s.mp4", index, label)


def similarity_band(sim: Column, threshold: float) -> Column:
    return F.when(sim >= threshold, "green").when(sim >= threshold - 0.10, "yellow").otherwise("red")


def bar(sim: Column, width: int = 40) -> Column:
    return F.repeat(F.lit("#"), F.greatest((sim * width).cast("int"), F.lit(0)))


def verdict_colour(verdict: Column, colours: dict[str, str] | None = None) -> Column:
    table = colours or {"correct": "green", "correct_none": "green", "close": "amber", "partial": "amber"}
    out = F.when(F.lit(False), F.lit(""))
    for name, colour in table.items():
        out = out.when(verdict == name, colour)
    return out.otherwise("red")
