"""Merkle manifest of a dataset: a tree a group, a tree over the groups' roots, and a proof for every row.

Rows are dealt out by ranges of (group, key). Counts of each group in each range
give every row its place in the group, so that a range can build all complete
aligned subtrees over its own rows. What is left at its ragged ends are a few
nodes a level; those are shuffled by coordinate, a number of levels at a time,
until each group has its root. Going back, a range builds its subtrees again and
ends its proofs with those of the ragged nodes above them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlab.llm.common import drop_stored, stored

#: Children of a node.
ARITY = 3
#: Levels that one shuffle of ragged nodes finishes; a task's group has some ARITY ** LEVELS nodes at most.
LEVELS = 8
#: Rows of a range, about: at least so many while there are fewer ranges than shuffle partitions, and at most.
LEAST_ROWS, MOST_ROWS = 5_000, 100_000
#: Rows of a batch that a task returns.
BATCH = 1000


def field(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    """The digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def joined(children: list[bytes]) -> bytes:
    """The digest of a node: that of its children's, written one after the other in hexadecimal."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def depth(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def step(run: list[bytes], slot: int) -> bytes:
    """One level of a proof: the slot in the run, how many siblings, and the siblings."""
    return bytes([slot, len(run) - 1]) + b"".join(run[:slot] + run[slot + 1 :])


def steps(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(proof):
        slot, n = proof[at], proof[at + 1]
        yield slot, [proof[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(n)]
        at += 2 + 32 * n


def folded(digest: bytes, proof: bytes) -> bytes:
    """The root that a digest and a proof lead to."""
    for slot, siblings in steps(proof):
        digest = joined(siblings[:slot] + [digest] + siblings[slot:])
    return digest


def siblings_digest(proof: bytes) -> str:
    """The digest of all siblings of a proof, level by level, left to right."""
    return hashlib.sha256("".join([s.hex() for _, siblings in steps(proof) for s in siblings]).encode()).hexdigest()


class Subtrees:
    """All complete aligned nodes over the leaves low, low + 1, ... of a tree with n leaves."""

    def __init__(self, low: int, leaves: list[bytes], n: int) -> None:
        self.levels = [(low, leaves)]
        while n > 1:
            up_n = -(-n // ARITY)
            first, end = -(-low // ARITY), up_n if low + len(leaves) == n else (low + len(leaves)) // ARITY
            if end <= first:
                break
            leaves = [joined(leaves[p * ARITY - low : (p + 1) * ARITY - low]) for p in range(first, end)]
            low, n = first, up_n
            self.levels.append((low, leaves))

    def inside(self, level: int, index: int) -> bool:
        """Whether the node is one of them."""
        return level < len(self.levels) and 0 <= index - self.levels[level][0] < len(self.levels[level][1])

    def ragged(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, index, digest) of the nodes whose parent is not one of them."""
        for level, (low, nodes) in enumerate(self.levels):
            up_low, up = self.levels[level + 1] if level + 1 < len(self.levels) else (0, [])
            covered = (up_low * ARITY - low, (up_low + len(up)) * ARITY - low) if up else (len(nodes), len(nodes))
            for k in (*range(min(covered[0], len(nodes))), *range(covered[1], len(nodes))):
                yield level, low + k, nodes[k]

    def proof(self, index: int) -> tuple[bytes, int, int]:
        """The proof of a leaf up to a ragged node, and that node's level and index."""
        out, level = b"", 0
        while self.inside(level + 1, index // ARITY):
            low, nodes = self.levels[level]
            first = index // ARITY * ARITY - low
            out += step(nodes[first : first + ARITY], index % ARITY)
            level, index = level + 1, index // ARITY
        return out, level, index


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(g, its rows as tuples) of batches whose first column is g, in order."""
    rows = (r for b in batches for at in range(0, b.num_rows, BATCH) for r in zip(*(c.to_pylist() for c in b.slice(at, BATCH).columns)))
    return itertools.groupby(rows, lambda r: r[0])


def _typed(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.DataType], Iterator[pa.RecordBatch]]:
    """The types of the columns, and the batches."""
    first = next(batches, None)
    return ([], iter(())) if first is None else (first.schema.types, itertools.chain([first], batches))


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)


_INT, _LONG, _BYTES = pa.int32(), pa.int64(), pa.binary()
_NODE = ["g", "part", "low", "n", "level", "index", "digest", "root"]
_NODE_SQL = "g {}, part int, low long, n long, level int, index long, digest binary, root binary"
_NODE_TYPES = [_INT, _LONG, _LONG, _INT, _LONG, _BYTES, _BYTES]


def _ragged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes at the ragged ends of each group of a range, from rows (g, part, low, n, digest) that begin with the group's run; a root says so."""
    types, batches = _typed(batches)

    def found() -> Iterator[tuple]:
        for g, rows in _groups(batches):
            _, part, low, n, _ = next(rows)
            for level, index, digest in Subtrees(low, [r[4] for r in rows], n).ragged():
                yield g, part, low, n, level, index, digest, digest if level == depth(n) else None

    yield from _batches(found(), _NODE, types[:1] + _NODE_TYPES)


def _finished(top: int):
    """Builds all nodes above ragged ones up to level ``top``: gives those with their proofs to there, and the new node at it."""

    def run(table: pa.Table) -> pa.Table:
        given = table.to_pylist()
        g, n, ancestor = (given[0][c] for c in ("g", "n", "top"))
        known = {(r["level"], r["index"]): r["digest"] for r in given}
        last = min(top, depth(n))
        for level in range(last):
            for index in sorted({i // ARITY for at, i in known if at == level}):
                if (level + 1, index) not in known:
                    known[level + 1, index] = joined([known[at] for at in _run(level, index, n)])
        root, rows = known[last, 0] if last == depth(n) else None, []
        for r in given:
            path, index = b"", r["index"]
            for level in range(r["level"], last):
                path += step([known[at] for at in _run(level, index // ARITY, n)], index % ARITY)
                index //= ARITY
            rows.append((g, r["part"], r["low"], n, r["level"], r["index"], r["digest"], root, path, ancestor, False))
        if root is None:
            rows.append((g, None, None, n, top, ancestor, known[top, ancestor], None, None, None, True))
        types = [table.schema.field("g").type, *_NODE_TYPES, _BYTES, _LONG, pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*_NODE, "path", "top", "above"])

    return run


def _run(level: int, parent: int, n: int) -> list[tuple[int, int]]:
    """The children of a node of the tree with n leaves."""
    wide = -(-n // ARITY**level)
    return [(level, i) for i in range(parent * ARITY, min(wide, (parent + 1) * ARITY))]


def _ended(more: int):
    """Proofs of leaves, from rows (g, leaf, k, digest, claimed, low, n, level, index, path, more columns) in which those with a path come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, batches = _typed(batches)

        def found() -> Iterator[tuple]:
            for _, rows in _groups(batches):
                above, leaves, first = {}, [], None
                for r in rows:
                    if r[1]:
                        leaves.append(r[2:5])
                    else:
                        above[r[7], r[8]], first = r[9], r
                low, extra = first[5], first[10:]
                own = Subtrees(low, [digest for _, digest, _ in leaves], first[6])
                for at, leaf in enumerate(leaves, low):
                    path, level, index = own.proof(at)
                    yield *leaf, path + above[level, index], *extra

        yield from _batches(found(), ["k", "leaf", "claimed", "proof", *(f"more{i}" for i in range(more))], types[2:5] + [_BYTES] * (1 + more))

    return run


class Forest:
    """Trees over rows (g, k, digest, claimed): one for each g, its leaves by k, then digest.

    ``paths`` has, for every ragged node of every range, its proof up to the
    root of its group: (g, part, low, n, level, index, path, root).
    """

    def __init__(self, rows: DataFrame) -> None:
        order = ["g", "k", "digest", "tie"]
        kinds, partitions = dict(rows.dtypes), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.g, self.k = kinds["g"], kinds["k"]
        rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()))
        n = rows.count()
        ranges = max(1, min(partitions, n // LEAST_ROWS), -(-n // MOST_ROWS))
        self.dealt = stored(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
        drop_stored(rows)
        counts = self.dealt.groupBy("g", "part").agg(F.count("*").alias("own"))  # a row a range and group
        group = Window.partitionBy("g")
        low = F.coalesce(F.sum("own").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.runs = stored(counts.select("g", "part", low.alias("low"), F.sum("own").over(group).alias("n")))
        self.parts = (self.runs.agg(F.max("part")).first()[0] or 0) + 1
        self.paths = self._paths()

    def _one_part_a_task(self, given: DataFrame) -> DataFrame:
        """The rows of each range in order, behind those of ``given`` for the same range and group."""
        both = self.dealt.withColumn("leaf", F.lit(True)).unionByName(given.withColumn("leaf", F.lit(False)), allowMissingColumns=True)
        return both.repartitionById(self.parts, F.col("part")).sortWithinPartitions("g", "leaf", "k", "digest", "tie")

    def _paths(self) -> DataFrame:
        source = self._one_part_a_task(self.runs).select("g", "part", "low", "n", "digest")
        nodes = stored(source.mapInArrow(_ragged, _NODE_SQL.format(self.g)))
        roots, nodes = nodes.filter("root is not null"), nodes.filter("root is null")
        power = F.element_at(F.array(*[F.lit(ARITY**k) for k in range(LEVELS + 1)]), F.col("reach") + 1)
        tops = range(LEVELS, depth(nodes.agg(F.max("n")).first()[0] or 1) + LEVELS, LEVELS)
        segments, known = [], nodes
        for top in tops:
            here = known.filter(F.col("level") < top).withColumn("reach", top - F.col("level")).withColumn("power", power)
            here = here.withColumn("top", F.expr("index div power")).drop("reach", "power")
            done = stored(here.groupBy("g", "top").applyInArrow(_finished(top), _NODE_SQL.format(self.g) + ", path binary, top long, above boolean"))
            segments.append((top, done.filter("not above")))
            # What comes out above and the nodes that begin there go on; finished groups have no node above.
            known = done.filter("above").select(_NODE).unionByName(nodes.filter(F.col("level") >= top))
        names = ["g", "part", "low", "n", "level", "index", "path", "root"]
        full = roots.withColumn("path", F.lit(b"")).select(names)
        for top, segment in reversed(segments):
            rest = full.filter(F.col("level") == top).select(F.col("g").alias("g_"), F.col("index").alias("index_"), F.col("path").alias("rest"), F.col("root").alias("root_"))
            own = segment.join(rest, F.col("g").eqNullSafe(F.col("g_")) & (F.col("index_") == F.col("top")), "left")
            own = own.withColumn("path", F.concat("path", F.coalesce("rest", F.lit(b"")))).withColumn("root", F.coalesce("root", "root_"))
            full = own.select(names).unionByName(full)
        return stored(full.filter("part is not null"))

    def proofs(self, paths: DataFrame, *more: str) -> DataFrame:
        """(k, leaf, claimed, proof, more ...) of every leaf; ``paths`` as those of the forest, with more binary columns of each group."""
        source = self._one_part_a_task(paths).select("g", "leaf", "k", "digest", "claimed", "low", "n", "level", "index", "path", *more)
        schema = f"k {self.k}, leaf binary, claimed binary, proof binary" + "".join(f", more{i} binary" for i in range(len(more)))
        return source.mapInArrow(_ended(len(more)), schema).withColumnsRenamed({f"more{i}": name for i, name in enumerate(more)})


def manifest(docs: DataFrame, values: list[str], id_col: str = "doc_id", group_col: str = "source", claimed: Column | None = None) -> DataFrame:
    """(id, leaf, claimed, proof, subroot, root), digests and proof binary: a row for every row of ``docs``.

    The digest of a row takes its ``values`` in order (see ``field``). Leaves of
    a group ascend by id, null ids first, and rows that repeat an id by digest;
    equal rows are leaves of their own. Groups ascend bytewise, a null group
    first. Each three neighbours, or what is left of them, make a node above,
    until one remains: the subroot, and of subroots the root. A lone leaf is its
    group's subroot. ``proof`` leads from the leaf to the root (see ``steps``).
    ``claimed`` is a digest to hold against the proof, by default the leaf.
    Empty and very long texts are texts as others; an empty table gives no rows;
    other columns do not matter.
    """
    digest = row_digest(*[F.col(f"`{v}`") for v in values])
    trees = Forest(docs.select(F.col(group_col).alias("g"), F.col(id_col).alias("k"), digest.alias("digest"), (digest if claimed is None else claimed).alias("claimed")))
    subroots = trees.paths.groupBy("g").agg(F.min("root").alias("digest"))
    over = Forest(subroots.select(F.lit("").alias("g"), F.col("g").alias("k"), "digest", F.col("digest").alias("claimed")))
    groups = stored(over.proofs(over.paths, "root").select(F.col("k").alias("g_"), F.col("proof").alias("rest"), F.col("root").alias("whole")))
    paths = trees.paths.join(groups, F.col("g").eqNullSafe(F.col("g_"))).drop("g_")
    paths = stored(paths.withColumn("path", F.concat("path", "rest")).withColumn("subroot", F.col("root")).withColumn("root", F.col("whole")).drop("rest", "whole"))
    return trees.proofs(paths, "subroot", "root").withColumnRenamed("k", id_col)


def check_proofs(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of what ``manifest`` gives; digests in hexadecimal.

    ``folded_root`` is where the claimed digest and the proof lead, and
    ``verified`` says whether that is the root.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs = batch.column("proof").to_pylist()
            ends = [folded(c, p) for c, p in zip(batch.column("claimed").to_pylist(), proofs)]
            columns = {"id": batch.column("id"), **{c: pa.array([x.hex() for x in batch.column(c).to_pylist()], pa.string()) for c in ("leaf", "subroot", "root")}}
            columns |= {"proof_sha256": pa.array([siblings_digest(p) for p in proofs], pa.string()), "folded_root": pa.array([e.hex() for e in ends], pa.string())}
            columns |= {"verified": pa.array([e == r for e, r in zip(ends, batch.column("root").to_pylist())], pa.bool_())}
            yield pa.RecordBatch.from_pydict(columns)

    named = rows.select(F.col(id_col).alias("id"), "leaf", "claimed", "subroot", "root", "proof")
    out = named.mapInArrow(run, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)
