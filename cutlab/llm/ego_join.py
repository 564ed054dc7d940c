"""Near-duplicate vectors by an epsilon grid order join.

Vectors are sorted by grid cells along their leading principal axes and cut into
blocks. Blocks in a row form intervals, those again longer ones. The join starts
with the longest intervals and opens only pairs of them whose bounding boxes are
not provably further apart than epsilon, level by level down to the blocks. The
task that gets a pair of blocks goes on likewise inside of it, down to leaves.

Vectors without any structure are close on all leading axes, so that most pairs
of blocks have to be opened. Blocks are therefore as large as memory allows: what
is shipped falls with their size, and leaves keep the boxes narrow.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlab.llm.common import arrow_batches, drop_stored, linked_heads, stored
from cutlab.llm.components import connected_components

#: Leading principal dimensions that order the grid and bound the blocks.
GRID_DIMS = 8
#: Vectors in a block, the shortest interval that is shipped, and their bytes; vectors in a leaf, the shortest one that is compared.
BLOCK, BLOCK_BYTES, LEAF = 4096, 1 << 21, 256
#: Pairs of blocks that a Python worker gets at once.
PAIRS_AT_ONCE = 4
#: Longer vectors have their axes along their first components, so that the driver gets a bounded number of sums.
AXES_DIMS = 512
#: An interval holds 2 ** FAN_BITS intervals of the level below.
FAN_BITS = 4


def _unit_vectors(rows: DataFrame) -> DataFrame:
    """(id, label, dim, key, unit) of the vectors that can link: none that is null, zero, or holds null or non-finite parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"id": [], "label": [], "dim": [], "key": [], "unit": []}
            for id_, label, vector in zip(*(batch.column(c) for c in ("id", "label", "vector"))):
                values = vector.values
                if values is None or values.null_count or not len(values):
                    continue
                v = np.asarray(values.to_numpy(zero_copy_only=False), np.float64)
                top = np.abs(v).max()
                if not np.isfinite(v).all() or top == 0:
                    continue
                u = v / top
                u /= math.sqrt(float(u @ u))
                for name, x in zip(out, (id_.as_py(), label.as_py(), len(v), hashlib.md5(v.tobytes()).digest(), u.tobytes())):
                    out[name].append(x)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()))})

    return rows.filter("label is not null and vector is not null").mapInArrow(run, "id long, label string, dim int, key binary, unit binary")


def _principal_axes(units: DataFrame, dim: int, k: int) -> np.ndarray:
    """The k leading principal axes of all vectors with ``dim`` parts, along the first AXES_DIMS ones; the driver gets a sum for each two of those."""
    whole, dim = dim, min(dim, AXES_DIMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim * dim + dim + 1)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(-1, whole)[:, :dim]
            total += np.concatenate(((x.T @ x).ravel(), x.sum(axis=0), [len(x)]))
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(total)})

    sums = units.filter(F.col("dim") == whole).select("unit").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toPandas()["v"].to_numpy()
    n = max(1.0, sums[-1])
    mean = sums[dim * dim : -1] / n
    axes = np.linalg.eigh(sums[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean))[1][:, ::-1][:, :k]
    return np.pad(axes, ((0, whole - dim), (0, 0)))


def _placed(classes: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """Adds place (coordinates on the leading axes) and cells; vectors of another length use their own first coordinates."""
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for unit in batch.column("unit"):
                u = np.frombuffer(unit.as_py(), np.float64)
                a = shared.value.get(len(u))
                p = u @ a if a is not None else u[:GRID_DIMS]
                places.append(np.pad(p, (0, GRID_DIMS - len(p))))
            cells = [np.floor(p / epsilon).astype(np.int32) for p in places]
            yield batch.append_column("place", pa.array(places, pa.list_(pa.float64()))).append_column("cells", pa.array(cells, pa.list_(pa.int32())))

    return classes.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", place array<double>, cells array<int>")


def _blocks(placed: DataFrame) -> DataFrame:
    """Cuts the epsilon grid order into blocks of at most BLOCK vectors and BLOCK_BYTES of one label and length, with their bounding boxes.

    (part, number) is the place of a block: the range of the sequence that a task held, and the block's number in it.
    """
    order = ["label", "dim", *[F.get("cells", F.lit(i)) for i in range(GRID_DIMS)], "cid"]
    rows = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key, held = 0, None, []

        def block() -> pa.RecordBatch:
            places = np.array([h[2] for h in held])
            columns = {
                "part": pa.array([held[0][4]], pa.int64()), "number": pa.array([number], pa.int64()), "label": pa.array([key[0]], pa.string()), "dim": pa.array([key[1]], pa.int32()),
                "lo": pa.array([places.min(axis=0)], pa.list_(pa.float64())), "hi": pa.array([places.max(axis=0)], pa.list_(pa.float64())),
                "ids": pa.array([np.array([h[0] for h in held], np.int64).tobytes()], pa.binary()), "counts": pa.array([np.array([h[1] for h in held], np.int64).tobytes()], pa.binary()), "units": pa.array([b"".join(h[3] for h in held)], pa.binary()), "places": pa.array([places.tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for cid, n, label, dim, place, unit, part in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "label", "dim", "place", "unit", "part"))):
                if held and ((label, dim) != key or len(held) >= max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))):
                    yield block()
                    number, held = number + 1, []
                key = (label, dim)
                held.append((cid, n, place, unit, part))
        if held:
            yield block()

    return rows.mapInArrow(run, "part long, number long, label string, dim int, lo array<double>, hi array<double>, ids binary, counts binary, units binary, places binary")


_LO, _HI = [f"lo{i}" for i in range(GRID_DIMS)], [f"hi{i}" for i in range(GRID_DIMS)]


def _near_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks of one label and length whose boxes are not provably further apart than epsilon.

    Level by level: pairs of intervals are opened into pairs of those they hold,
    and the distant ones among these fall at once with all that lies in them.
    """
    edges = [F.get("lo", F.lit(i)).alias(c) for i, c in enumerate(_LO)] + [F.get("hi", F.lit(i)).alias(c) for i, c in enumerate(_HI)]
    level = stored(blocks.select("label", "dim", F.col("block").alias("at"), *edges))
    levels = [level]
    bits = max(1, int(level.agg(F.max("at")).first()[0] or 0).bit_length())
    for _ in range((bits - 1) // FAN_BITS):
        wider = level.groupBy("label", "dim", F.shiftright("at", FAN_BITS).alias("at")).agg(*[F.min(c).alias(c) for c in _LO], *[F.max(c).alias(c) for c in _HI])
        level = stored(wider)
        levels.append(level)

    def side(of: DataFrame, s: str) -> DataFrame:
        return of.select("label", "dim", F.col("at").alias(s), F.shiftright("at", FAN_BITS).alias(f"up_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in (*_LO, *_HI)])

    gaps = [F.greatest(F.col(f"{lo}_a") - F.col(f"{hi}_b"), F.col(f"{lo}_b") - F.col(f"{hi}_a"), F.lit(0.0)) for lo, hi in zip(_LO, _HI)]
    near = (F.col("a") <= F.col("b")) & (sum((g * g for g in gaps), F.lit(0.0)) <= epsilon * epsilon)
    pairs = None
    for level in reversed(levels):
        if pairs is None:  # at most 2 ** FAN_BITS intervals a label
            found = side(level, "a").join(side(level, "b"), ["label", "dim"])
        else:
            found = pairs.join(side(level, "a"), ["label", "dim", "up_a"]).join(side(level, "b"), ["label", "dim", "up_b"])
        found = stored(found.filter(near).select("label", "dim", "a", "b"))
        pairs = found.select("label", "dim", F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    return found.select("a", "b")


def _boxes(places: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The corners of the boxes around each ``leaf`` places in a row."""
    at = np.arange(0, len(places), leaf)
    return np.minimum.reduceat(places, at), np.maximum.reduceat(places, at)


def _near_leaves(a: np.ndarray, b: np.ndarray, same: bool, epsilon: float, leaf: int) -> list[tuple[int, int]]:
    """Pairs of leaves of two blocks, by their places, that are not provably further apart than epsilon."""
    (lo_a, hi_a), (lo_b, hi_b) = _boxes(a, leaf), _boxes(b, leaf)
    gaps = np.maximum(np.maximum(lo_a[:, None] - hi_b[None], lo_b[None] - hi_a[:, None]), 0.0)
    near = (gaps * gaps).sum(axis=2) <= epsilon * epsilon
    return [(int(i), int(j)) for i, j in np.argwhere(np.triu(near) if same else near)]


def _links(pairs: DataFrame, blocks: DataFrame, cosine: float, epsilon: float) -> DataFrame:
    """(id, linked, root): for every class of a pair of leaves with a link in it, the vectors it links with there, and the head of its connected part."""

    leaf = LEAF

    def met(r: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        side = {}
        for s in "ab":
            ids = np.frombuffer(r[f"ids_{s}"], np.int64)
            side[s] = (ids, np.frombuffer(r[f"counts_{s}"], np.int64), np.frombuffer(r[f"units_{s}"], np.float64).reshape(len(ids), -1), np.frombuffer(r[f"places_{s}"], np.float64).reshape(len(ids), -1))
        same = r["a"] == r["b"]
        for i, j in _near_leaves(side["a"][3], side["b"][3], same, epsilon, leaf):
            ids_a, n_a, x, _ = (v[i * leaf : (i + 1) * leaf] for v in side["a"])
            ids_b, n_b, y, _ = (v[j * leaf : (j + 1) * leaf] for v in side["b"])
            near = x @ y.T >= cosine
            itself = same and i == j
            if itself:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            near = near[np.ix_(rows, columns)]
            head_a, head_b = linked_heads(near, ids_a[rows], ids_b[columns])
            yield ids_a[rows], near @ n_b[columns], head_a
            if not itself:
                yield ids_b[columns], near.T @ n_a[rows], head_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = list(met({c: batch.column(c)[row].as_py() for c in batch.schema.names}))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["id", "linked", "root"])

    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "counts", "units", "places")])
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "id long, linked long, root long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of the same label link when their cosine, in double precision, is at
    least ``cosine``. A null label, and a vector that is null, empty, zero or
    holds null or non-finite parts, links with nothing; vectors of different
    lengths never link. Rows that repeat an id are vectors each, with links and
    a component of their own; a null id is the smallest one. An empty table
    gives no rows, and other columns do not matter.

    Equal vectors form a class, with a key of its own, that is joined once and
    counts with its size. On unit vectors the limit is a distance epsilon. They
    are sorted by grid cells of side epsilon along leading principal axes and
    joined interval by interval (``_near_pairs``). A task handles one pair of
    blocks at a time, of BLOCK_BYTES each however long the vectors are, and
    returns counts and the heads of connected parts, never the links one by one.
    """
    epsilon = math.sqrt(2 - 2 * cosine) * (1 + 1e-9)
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    units = _unit_vectors(source)
    same = units.groupBy("label", "dim", "key").agg(F.min(F.struct("id")).getField("id").alias("id"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    classes = stored(same.withColumn("cid", F.monotonically_increasing_id()))
    dims = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return source.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    axes = {dims["dim"]: _principal_axes(classes, dims["dim"], min(GRID_DIMS, dims["dim"]))}
    blocks = stored(_blocks(_placed(classes.select("cid", "n", "label", "dim", "unit"), axes, epsilon)))
    bits = int(blocks.agg(F.max("number")).first()[0]).bit_length()
    blocks = blocks.withColumn("block", F.shiftleft("part", bits) + F.col("number"))
    with arrow_batches(rows.sparkSession, PAIRS_AT_ONCE):
        links = stored(_links(_near_pairs(blocks, epsilon), blocks, cosine, epsilon))
    component = connected_components(links, "id", "root").withColumnRenamed("id", "cid")
    counts = links.groupBy(F.col("id").alias("cid")).agg(F.sum("linked").alias("linked"))

    known = classes.select("label", "dim", "key", "cid", "id", "n").join(counts, "cid", "left").join(component, "cid", "left")
    known = stored(known.select("label", "dim", "key", "id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    least = stored(known.groupBy("component").agg(F.min(F.struct("id")).getField("id").alias("component_id")))
    reps = stored(known.join(least, "component").select("label", "dim", "key", "n_links", "component_id"))
    drop_stored(known, least)
    linked = units.select("id", "label", "dim", "key").join(reps, ["label", "dim", "key"]).select("id", "n_links", "component_id")
    out = linked.unionByName(_unlinkable(source))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _unlinkable(source: DataFrame) -> DataFrame:
    """The rows that ``_unit_vectors`` leaves out."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = source.filter(~F.coalesce(usable, F.lit(False)))
    return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
