"""Table scans, result sinks and lineage cuts."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactscope.functions.timeparts import parse_ts
from contactscope.sources.csv_splits import records

# Cell texts that a CSV scan reads as missing.
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def _typed(col: Column, kind: T.DataType, strict_time: bool) -> Column:
    """CSV text to the declared type; text of another kind gives NULL."""
    if isinstance(kind, T.StringType):
        return col
    if isinstance(kind, T.TimestampNTZType):
        return parse_ts(col, strict_time)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        # An integer column that has missing cells is often written as 1.0, 0.0.
        return F.coalesce(col.try_cast(kind), col.try_cast("double").try_cast(kind))
    return col.try_cast(kind)


def _csv(spark: SparkSession, multi_line: bool):
    return spark.read.option("quote", '"').option("escape", '"').option("multiLine", multi_line)


def _cells(spark: SparkSession, path: str, multi_line: bool, misfits: bool = False) -> tuple[list[str], DataFrame]:
    """The header's names, and one text column c0, c1, ... for each of them; _misfit marks other numbers of cells."""
    names = _csv(spark, multi_line).option("header", True).csv(path).columns
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    if misfits:
        fields.append(T.StructField("_misfit", T.StringType()))
    schema = T.StructType(fields)
    if not multi_line or not names:
        reader = _csv(spark, multi_line).option("header", True).option("enforceSchema", True)
        return names, reader.option("columnNameOfCorruptRecord", "_misfit").schema(schema).csv(path)
    options = {
        "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n", "columnNameOfCorruptRecord": "_misfit",
    }
    row = F.from_csv("value", ", ".join(f"{name} string" for name in schema.names), options)
    return names, records(spark, path).select(row.alias("r")).select("r.*")


def malformed_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row: rows of a CSV table, those with more or fewer cells than its header, empty cells."""
    names, rows = _cells(spark, path, multi_line, misfits=True)
    # All cells are asked for: the parser does not look at cells that nobody reads.
    empty = sum((F.col(f"c{i}").isNull().cast("bigint") for i in range(len(names))), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("_misfit").alias("malformed"),
        F.sum(empty).alias("empty_cells"),
    )


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    strict_time: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Scan a table with a declared schema, never an inferred one.

    CSV cells may be quoted, with quotes doubled inside. Line breaks inside quotes are read too
    while ``multi_line`` is on, by one more pass over the text that finds where records begin, see
    ``csv_splits``; either way a file is read in many tasks. Short rows end in NULL, see
    ``malformed_rows`` for a count.

    Column names are matched in any letter case and come out in lower case;
    columns that the file lacks are left out, extra columns are not read.
    NaN in a floating-point column is read as NULL.
    """
    if fmt == "csv":
        names, raw = _cells(spark, path, multi_line)
        raw = raw.toDF(*names)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
    present = {name.lower(): name for name in raw.columns}
    columns = []
    for field in schema.fields:
        if field.name not in present:
            continue
        col = raw[f"`{present[field.name]}`"]
        if fmt == "csv":
            col = F.when(~col.isin(MISSING_TEXT), col)
            col = _typed(col, field.dataType, strict_time)
        elif isinstance(field.dataType, T.TimestampNTZType):
            col = parse_ts(col, strict_time)
        elif isinstance(field.dataType, T.StringType):
            col = col.cast("string")
        else:
            col = col.try_cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            col = F.when(~F.isnan(col), col)
        columns.append(col.alias(field.name))
    return raw.select(columns)


def _write(df: DataFrame, target: str, fmt: str) -> None:
    writer = df.write
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(target)
    elif fmt == "parquet":
        writer.parquet(target)
    else:
        raise ValueError(f"unknown format: {fmt}")


def _files(spark: SparkSession, folder: str):
    """Hadoop's path type and the file system of a folder."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_result(df: DataFrame, name: str, path: str, fmt: str = "parquet") -> str:
    """Write one named result below ``path`` and return where it went.

    The result is written beside its place and moved there once it is whole, so a write that fails
    leaves the result of before as it was. See ``publish`` for readers that must never find none.
    """
    folder = path.rstrip("/")
    target, run = f"{folder}/{name}", uuid.uuid4().hex
    staged, old = f"{folder}/_staged-{run}", f"{folder}/_old-{run}"
    make, system = _files(df.sparkSession, folder)
    try:
        _write(df, f"{staged}/{name}", fmt)
        if system.exists(make(target)):
            system.mkdirs(make(old))
            if not system.rename(make(target), make(f"{old}/{name}")):
                raise OSError(f"could not move {target}")
        if not system.rename(make(f"{staged}/{name}"), make(target)):
            if system.exists(make(f"{old}/{name}")):
                system.rename(make(f"{old}/{name}"), make(target))
            raise OSError(f"could not move a result to {target}")
    finally:
        for leftover in (staged, old):
            system.delete(make(leftover), True)
    return target


def publish(df: DataFrame, name: str, path: str, fmt: str = "parquet", keep: int = 2) -> str:
    """Write a new version of a result and make it the current one in one step; gives the version's folder.

    Versions lie in folders of their own. A small manifest, replaced by a single rename, says which one counts,
    so a reader finds the version of before or the new one, whole either way. The latest ``keep`` versions stay
    for readers that are under way; older ones, and what failed writes left, are removed.
    """
    spark, folder = df.sparkSession, f"{path.rstrip('/')}/{name}"
    make, system = _files(spark, folder)
    before = manifest(spark, name, path)
    number = (before["versions"][-1]["number"] if before else 0) + 1
    version = f"v{number:08d}-{uuid.uuid4().hex}"
    _write(df, f"{folder}/{version}", fmt)
    entry = {"number": number, "folder": version, "format": fmt, "columns": df.dtypes}
    versions = [*(before["versions"] if before else []), entry][-max(1, keep) :]
    part = make(f"{folder}/_manifest-{uuid.uuid4().hex}")
    out = system.create(part, True)
    out.write(bytearray(json.dumps({"versions": versions}).encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.FileContext.getFileContext(system.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    overwrite = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    overwrite[0] = jvm.Options.Rename.OVERWRITE
    files.rename(part, make(f"{folder}/_manifest"), overwrite)
    kept = {v["folder"] for v in versions}
    for status in system.listStatus(make(folder)):
        if status.getPath().getName().startswith("v") and status.getPath().getName() not in kept:
            system.delete(status.getPath(), True)
    return f"{folder}/{version}"


def manifest(spark: SparkSession, name: str, path: str) -> dict | None:
    """The versions of a published result, the current one last; None where there is none."""
    folder = f"{path.rstrip('/')}/{name}"
    make, system = _files(spark, folder)
    if not system.exists(make(f"{folder}/_manifest")):
        return None
    source = system.open(make(f"{folder}/_manifest"))
    try:
        return json.loads(bytes(source.readAllBytes()))
    finally:
        source.close()


def read_published(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The current version of a published result."""
    found = manifest(spark, name, path)
    if not found:
        raise ValueError(f"nothing published as {name} in {path}")
    current = found["versions"][-1]
    target = f"{path.rstrip('/')}/{name}/{current['folder']}"
    if current["format"] == "csv":
        schema = ", ".join(f"`{c}` {t}" for c, t in current["columns"])
        return _csv(spark, True).option("header", True).schema(schema).csv(target)
    return spark.read.parquet(target)


def replace_periods(df: DataFrame, path: str, column: str) -> None:
    """Write rows by period: periods that ``df`` has are replaced, all others stay."""
    together = df.hint("rebalance", F.col(column))  # a period is one file, or several if it is large
    writer = together.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(column).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Without that setting only a single-machine session gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="contactscope-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where many jobs read the same linked or prepared table: the lineage is
    cut, a lost executor costs a re-read instead of the joins behind the table,
    and later scans still prune columns and push filters. The table is removed when
    the application ends.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark).rstrip('/')}/contactscope/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
