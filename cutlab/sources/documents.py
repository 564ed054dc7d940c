"""JSON documents with explicit schemas, optional and required sources, versioned sinks."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHOTS = "shots array<struct<start_sec: double, end_sec: double, start_frame: int, end_frame: int, face_sim: double, label: string>>"
TRANSITIONS = f"clip string, transition_sec double, method string, num_shots int, {SHOTS}, qa_image string, error string, face_error boolean"
SEGMENTS = "clip string, short string, n_segments int, pattern string, segments array<struct<start: double, end: double, label: string, dur: double, face_sim: double>>"
TRUTH = "source string, editor string, n int, precision_note string, clips array<struct<clip: string, short: string, has_transition: boolean, cut_sec: double, cuts: array<struct<sec: double, to: string>>, pattern: string, returns_to_creator: boolean, confidence: string, notes: string, edited: boolean>>"
CURVE = "struct<clip: string, dur: double, sample_fps: double, times: array<double>, sims: array<double>, transnet_cuts: array<double>, luma_fps: double, times_l: array<double>, luma: array<double>, first_true: double, method: string>"
VERDICT = "struct<s: string, true_sec: double, verdict: string, confidence: string, notes: string, corrected: boolean>"


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array, a row an element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_map(spark: SparkSession, path: str, value: str, field: str | None = None) -> DataFrame:
    """(key, value.*) of a file that is one JSON object used as a map, or of its map ``field``.

    The schema is given: inference would make a field of every key.
    """
    text = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", f"{field} map<string, {value}>").getField(field) if field else F.from_json("value", f"map<string, {value}>")
    return text.select(F.explode(parsed).alias("key", "v")).select("key", "v.*")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """The clips of a label document, the last one of each short name."""
    rows = read_rows(spark, path, TRUTH).select(F.posexplode("clips").alias("pos", "c")).select("pos", "c.*")
    w = Window.partitionBy("short").orderBy(F.desc("pos"))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def optional(spark: SparkSession, read, schema: str | T.StructType) -> DataFrame:
    """What ``read()`` gives, or no rows if the path does not exist; any other error is raised."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def required(read, hint: str) -> DataFrame:
    """What ``read()`` gives; a missing path raises with a hint at what makes it."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(hint) from error


def list_files(spark: SparkSession, folder: str, pattern: str = "*.mp4", limit: int | None = None) -> DataFrame:
    """(path, name) of a folder's files by name; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy("name")
    return files.limit(limit) if limit else files


def usable(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records with shots, without an error, whose file exists."""
    good = records.filter((F.coalesce(F.size("shots"), F.lit(0)) > 0) & F.col("error").isNull())
    return good.join(files.select(F.col("name").alias("clip")), "clip", "left_semi")


def long_curves(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, luma, cuts) in long form from rows with parallel arrays."""
    samples = documents.select("clip", F.posexplode(F.arrays_zip("times", "sims")).alias("i", "x")).select("clip", "i", F.col("x.times").alias("t"), F.col("x.sims").alias("sim"))
    luma = documents.select("clip", F.posexplode(F.arrays_zip("times_l", "luma")).alias("i", "x")).select("clip", "i", F.col("x.times_l").alias("t"), F.col("x.luma").alias("luma"))
    cuts = documents.select("clip", F.explode("transnet_cuts").alias("t"))
    return samples, luma, cuts


def _listed(spark: SparkSession, root: str):
    """The file system of a dataset, and its names with their times of writing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, place, {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(place)} if fs.exists(place) else {}


def write_version(df: DataFrame, root: str) -> str:
    """Writes a new version of a dataset beside the old ones and makes it the current one; returns its path.

    A job may read the version that it replaces. What makes a version current is
    an empty file whose name holds a number and the version; it appears in one
    step, after the version is whole, and is never changed. Of two writers at
    once one is the last; none is lost.
    """
    name = uuid.uuid4().hex
    df.write.parquet(f"{root.rstrip('/')}/version={name}")
    fs, place, names = _listed(df.sparkSession, root)
    number = max((int(n.split("-")[1]) for n in names if n.startswith("current-")), default=0) + 1
    fs.create(df.sparkSession._jvm.org.apache.hadoop.fs.Path(place, f"current-{number:012d}-{name}"), False).close()
    return f"{root.rstrip('/')}/version={name}"


def current_version(spark: SparkSession, root: str) -> str:
    """The path of the current version; whoever reads it goes on reading that version, whatever is written meanwhile."""
    names = [n for n in _listed(spark, root)[2] if n.startswith("current-")]
    if not names:
        raise FileNotFoundError(f"no version of {root} has been written")
    return f"{root.rstrip('/')}/version={max(names).split('-')[2]}"


def expire_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes versions beyond the ``keep`` last written ones, never the current one; returns how many. Readers of a deleted version fail."""
    current = current_version(spark, root).rsplit("=", 1)[1]
    fs, place, names = _listed(spark, root)
    found = sorted((at, n.removeprefix("version=")) for n, at in names.items() if n.startswith("version="))
    gone = [n for _, n in found if n != current][: max(0, len(found) - keep)]
    for name in names:
        if any(name.endswith(old) for old in gone):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(place, name), True)
    return len(gone)


def only(rows: DataFrame, ids: list[str] | None = None, limit: int | None = None, key: str = "clip") -> DataFrame:
    """The rows of the named clips, or the first ones by name; all of them without either."""
    rows = rows.filter(F.col(key).isin(ids)) if ids else rows
    return rows.orderBy(key).limit(limit) if limit else rows


def write_documents(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, of any size."""
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str, key: str | None = None, optional: tuple[str, ...] = (), single: bool = False) -> str:
    """One JSON file that people and other tools read: an array of the rows, or with ``key`` a map from that column to the row.

    With ``single`` it is the one row of ``df`` itself; any other number of rows raises.

    Nulls stand in the file, since whether a key is there has a meaning; rows in
    which all ``optional`` columns are null leave those out. Tasks
    write the rows as parts, in the order of ``df``; the parts are then copied
    one after the other into a file aside, which is put in place in one step.
    So a document may have any size, and no process holds it.
    """
    spark, parts = df.sparkSession, f"{path.rsplit('/', 1)[0] if '/' in path else '.'}/.{uuid.uuid4().hex}"
    as_json = lambda columns: F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false", "pretty": "true"})
    row = as_json(df.columns)
    if optional:
        row = F.when(F.coalesce(*[F.col(c).cast("string") for c in optional]).isNull(), as_json([c for c in df.columns if c not in optional])).otherwise(row)
    if key:
        name = F.to_json(F.array(F.col(key).cast("string")))  # quoted, within brackets
        row = F.concat(F.substr(name, F.lit(2), F.length(name) - 2), F.lit(": "), row)
    df.select(F.concat(F.lit(","), row).alias("value")).write.text(parts)
    place = spark._jvm.org.apache.hadoop.fs.Path(parts)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(place) if f.getLen() and f.getPath().getName().startswith("part-"))
    begin, end = (b"", b"\n") if single else (b"{\n", b"}\n") if key else (b"[\n", b"]\n")
    try:
        if single and (n := spark.read.text(parts, wholetext=False, lineSep="\n,").count()) != 1:
            raise ValueError(f"{path} is a document of one row, not of {n}")
        _replace(spark, path, [begin, *(f"{parts}/{n}" for n in names), end])
    finally:
        fs.delete(place, True)
    return path


def _replace(spark: SparkSession, path: str, content: list[bytes | str]) -> None:
    """Writes a file beside ``path`` and renames it over it: bytes as they are, names as the files' content; of the first file without its first byte."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(place.getParent() or jvm.org.apache.hadoop.fs.Path("."), f".{uuid.uuid4().hex}")
    full = place.getFileSystem(conf)
    out, first = full.create(aside), True
    for piece in content:
        if isinstance(piece, bytes):
            out.write(bytearray(piece))
            continue
        part = full.open(jvm.org.apache.hadoop.fs.Path(piece))
        if first:
            part.read()
        first = False
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
        part.close()
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.getUri(), conf).rename(full.makeQualified(aside), full.makeQualified(place), overwrite)


def save_truth(df: DataFrame, folder: str, name: str, allowed: tuple[str, ...] = ("ground_truth.json",)) -> str:
    """Saves a label document, the one row of ``df``, under one of the allowed names; the first version of it stays as ``.bak``."""
    if not re.fullmatch(r"[\w.-]+", name) or name not in allowed:
        raise PermissionError(f"{name} is not one of {allowed}")
    spark, place = df.sparkSession, f"{folder}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(place)) and not fs.exists(path(f"{place}.bak")):
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(place), fs, path(f"{place}.bak"), False, spark._jsc.hadoopConfiguration())
    return write_document(df, place, single=True)
