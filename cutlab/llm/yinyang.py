"""Vector codes: one codebook for each part of a vector, fitted by Lloyd's rounds with Yinyang's bounds.

Components are integers, so sums, means and distances are exact. Entries of a
codebook are clustered into groups once; a part of a vector keeps an upper bound
of its distance to its own entry and a lower bound for each group. After a round
the bounds move with the entries, and only groups whose bound no longer holds
are scanned. Bounds are rounded outwards, and what is scanned is compared by
integer distances, so ties go to the lower index as in a full scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlab.llm.common import drop_stored, few_rows, stored

#: Parts of a vector, entries of a codebook, rounds, and the factor that makes components integers.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Groups of the entries of a codebook.
GROUPS = 16
#: Integers beyond this are cut to it, which leaves squared distances exact in 64 bits.
LIMIT = 1 << 27
#: Up to this sum of squares, doubles hold products and distances of integers exactly.
_EXACT = 1 << 52


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of c."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < _EXACT:  # a matrix product in doubles, all of whose values are integers they can hold
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, entry in enumerate(c):
        d = x - entry
        out[:, j] = (d * d).sum(axis=1)
    return out


def _up(x: np.ndarray) -> np.ndarray:
    """Single precision, not below x."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf), dtype=np.float32)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf), dtype=np.float32)


def grouped(codebook: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """A group for each entry of a codebook, by a few rounds of Lloyd over the entries; any grouping gives the same codes."""
    c = codebook.astype(np.float64)
    centres = c[np.linspace(0, len(c) - 1, min(groups, len(c))).astype(int)]
    for _ in range(rounds):
        group = ((c[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(group):
            centres[g] = c[group == g].mean(axis=0)
    return group


@dataclass
class Codebook:
    """The entries of one part, their groups, and how far each moved in the last round."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    def members(self) -> list[tuple[int, np.ndarray]]:
        return [(g, np.flatnonzero(self.group == g)) for g in np.unique(self.group)]

    def group_drift(self) -> np.ndarray:
        out = np.zeros(GROUPS, np.float32)
        np.maximum.at(out, self.group, self.drift)
        return out


def first_codes(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, squared distance, upper bound, lower bounds a group) of parts x by a full scan."""
    d = squared(x, book.entries)
    code = d.argmin(axis=1)
    own = d[np.arange(len(x)), code]
    lower = np.full((len(x), GROUPS), np.inf, np.float32)
    d[np.arange(len(x)), code] = np.iinfo(np.int64).max
    for g, members in book.members():
        lower[:, g] = _lower(d[:, members].min(axis=1))
    return code, own, _up(np.sqrt(own)), lower


def _lower(least: np.ndarray) -> np.ndarray:
    """Bounds from squared distances, infinite where a group has no other entry."""
    none = least == np.iinfo(np.int64).max
    return np.where(none, np.float32(np.inf), _down(np.sqrt(np.where(none, 0, least))))


def next_codes(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries moved, and how many distances to other entries that took."""
    code, scanned = code.copy(), 0
    upper = _up(upper + book.drift[code])
    lower = _down(lower - book.group_drift())
    own = ((x - book.entries[code]) ** 2).sum(axis=1)
    unsure = upper >= lower.min(axis=1)
    exact = _up(np.sqrt(own))  # tightens the bound before anything is scanned
    upper = np.where(unsure, np.minimum(upper, exact), upper)
    rows = np.flatnonzero(unsure & (upper >= lower.min(axis=1)))
    if len(rows):
        old, best, best_d = code[rows], code[rows].copy(), own[rows].copy()
        opened = lower[rows] <= upper[rows, None]
        least: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g, members in book.members():
            hit = np.flatnonzero(opened[:, g])
            if not len(hit):
                continue
            d = squared(x[rows[hit]], book.entries[members])
            scanned += d.size
            least[g] = hit, d
            k = d.argmin(axis=1)
            near = d[np.arange(len(hit)), k]
            better = (near < best_d[hit]) | ((near == best_d[hit]) & (members[k] < best[hit]))
            best[hit] = np.where(better, members[k], best[hit])
            best_d[hit] = np.where(better, near, best_d[hit])
        for g, members in book.members():
            if g in least:
                hit, d = least[g]
                d[members[None, :] == best[hit][:, None]] = np.iinfo(np.int64).max
                lower[rows[hit], g] = _lower(d.min(axis=1))
        # An entry that was left counts for its group again; where the group was scanned, it did above.
        moved = np.flatnonzero(best != old)
        g = book.group[old[moved]]
        lower[rows[moved], g] = np.minimum(lower[rows[moved], g], _down(np.sqrt(own[rows[moved]])))
        code[rows], own[rows], upper[rows] = best, best_d, _up(np.sqrt(best_d))
    return code, own, upper, lower, scanned


def integers(vector: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(vector * float(scale)), -LIMIT, LIMIT).astype(np.int64)


def _padded(rows: np.ndarray, parts: int) -> np.ndarray:
    """Zeros behind the last component until the parts are equal."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % parts)))


def _one_round(rows: DataFrame, books: list[Codebook], state: bool, id_type: str, label_type: str) -> DataFrame:
    """Codes of all rows, and per task the count and sum of the parts of each entry, in one pass.

    Rows have id and label and either vector (in the first round) or x, code,
    upper and lower. The result has rows with ``part`` null (the rows, with
    their codes and bounds) and rows of sums (part, entry, n, total).
    """
    parts, width = len(books), books[0].entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, max(len(b.entries) for b in books)), np.int64)
        total = np.zeros((*count.shape, width), np.int64)
        schema = None
        for batch in batches:
            n, names = batch.num_rows, batch.schema.names
            if not n:
                continue
            flat = lambda c, kind: np.asarray(batch.column(c).flatten()).reshape(n, -1).astype(kind, copy=False)  # noqa: B023, E731
            x = flat("x", np.int64) if "x" in names else _padded(integers(flat("vector", np.float64)), parts)
            codes, errors = np.empty((n, parts), np.uint8 if count.shape[1] <= 256 else np.int32), np.zeros(n, np.int64)
            upper, lower = np.empty((n, parts), np.float32), np.empty((n, parts, GROUPS), np.float32)
            if "x" in names:
                old, old_upper, old_lower = flat("code", np.int64), flat("upper", np.float32), flat("lower", np.float32).reshape(n, parts, GROUPS)
            for p, book in enumerate(books):
                own = x[:, p * width : (p + 1) * width]
                if "x" in names:
                    code, d, upper[:, p], lower[:, p], _ = next_codes(own, old[:, p], old_upper[:, p], old_lower[:, p], book)
                else:
                    code, d, upper[:, p], lower[:, p] = first_codes(own, book)
                codes[:, p], errors = code, errors + d
                count[p] += np.bincount(code, minlength=count.shape[1])
                np.add.at(total[p], code, own)
            lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a[0].size), pa.array(a.reshape(-1), kind))
            columns = {"id": batch.column("id"), "label": batch.column("label"), "error": pa.array(errors)}
            columns |= {"x": lists(x.astype(np.int32), pa.int32()), "code": lists(codes.astype(np.int32), pa.int32()), "upper": lists(upper, pa.float32()), "lower": lists(lower, pa.float32())}
            columns |= {"part": pa.nulls(n, pa.int32()), "entry": pa.nulls(n, pa.int32()), "n": pa.nulls(n, pa.int64()), "total": pa.nulls(n, pa.list_(pa.int64()))}
            out = pa.RecordBatch.from_pydict(columns)
            schema = out.schema
            yield out
        if schema is not None:
            p, e = np.nonzero(count)
            sums = {"part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(count[p, e]), "total": pa.array(list(total[p, e]), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({f.name: sums.get(f.name, pa.nulls(len(p), f.type)) for f in schema}, schema=schema)

    kinds = f"id {id_type}, label {label_type}, error long, x array<int>, code array<int>, upper array<float>, lower array<float>, part int, entry int, n long, total array<long>"
    names = ["id", "label", *(["x", "code", "upper", "lower"] if state else ["vector"])]
    return stored(rows.select(names).mapInArrow(run, kinds))


def _moved(books: list[Codebook], done: DataFrame) -> list[Codebook]:
    """Entries at the floor of the mean of their parts; unused ones stay. Sums come as one row an entry."""
    width = books[0].entries.shape[1]
    sums = done.filter("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total")).collect()
    out = [Codebook(b.entries.copy(), b.group, b.drift) for b in books]
    for r in sums:
        out[r.part].entries[r.entry] = np.array(r.total, np.int64) // r.n
    for old, new in zip(books, out):
        new.drift = _up(np.sqrt(((new.entries - old.entries).astype(np.float64) ** 2).sum(axis=1)))
    return out


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(codes, codebooks): codes has id, label, code array<int>, error; codebooks an array (entries, width) a part.

    Rows are left out whose vector is null, empty, or holds nulls or non-finite
    components, and those whose vector is not as long as that of the first kept
    row. A length that the parts do not divide is filled with zeros. Components
    become floor(SCALE * x), cut to +-LIMIT. Codebooks start from the first
    ``entries`` rows by id (null ids last; of repeated ids the smaller vector
    first; fewer rows make smaller codebooks) and equal entries keep their
    places, where the lower one takes all. Repeated rows count each; other
    columns do not matter. An empty table gives no rows and no codebooks.

    A round is one pass over the rows, whose bounds and codes are written to the
    shared folder; a task sends at most one sum an entry, and one row an entry
    reaches the driver, which is parts * entries rows whatever the input.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vector")).filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return rows.select("id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error")).withColumnsRenamed({"id": id_col, "label": label_col}), []
    rows = rows.filter(F.size("vector") == len(first[0].vector))
    start = np.array([r.vector for r in rows.orderBy(*order).limit(entries).collect()])
    books = [Codebook(c, grouped(c), np.zeros(len(c), np.float32)) for c in np.split(_padded(integers(start), parts), parts, axis=1)]
    kinds = dict(rows.dtypes)
    done = _one_round(rows, books, False, kinds["id"], kinds["label"])
    for _ in range(rounds):
        books = _moved(books, done)
        before, done = done, _one_round(done.filter("part is null"), books, True, kinds["id"], kinds["label"])
        drop_stored(before)
    codes = done.filter("part is null").select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error")
    return codes, [b.entries for b in books]


def digest(codes: DataFrame, codebooks: list[np.ndarray], id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): codes as hexadecimal digits, errors summed over equal labels, nulls together.

    A sum beyond 64 bits is null.
    """
    text = ",".join(str(int(x)) for book in codebooks for entry in book for x in entry)
    by_label = few_rows(codes.groupBy(F.col(label_col).alias("of")).agg(F.try_sum("error").alias("label_error")))
    rows = codes.join(by_label, F.col(label_col).eqNullSafe(F.col("of")), "left")
    code = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return rows.select(id_col, code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
