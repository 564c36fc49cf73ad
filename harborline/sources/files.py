"""Reading and writing of files and relational tables."""

from __future__ import annotations

import csv
import re
from datetime import datetime
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from harborline.functions.columns import lenient_timestamp
from harborline.operators.ordering import first_per_key, join_on
from harborline.sources.schemas import TableSpec, detect_dataset_type

# Holds the text of a line or record that does not fit its schema.
CORRUPT = "_corrupt_record"
UPLOAD = r"^(.*)/[^/]*$"


def headers(spark: SparkSession, path: str, pattern: str = "*") -> dict[tuple[str, ...], list[str]]:
    """The files below ``path`` by their header row, in the order of their paths. Empty files have none and are left out.

    Only the first line of each file leaves the executors.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    begun = lines.select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    first = begun.where(F.col("block") == 0).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").toLocalIterator():
        found.setdefault(tuple(next(csv.reader([row["header"]]))), []).append(row["file"])
    return found


def scan_csv(spark: SparkSession, path: str, schema: StructType, pattern: str = "*", skip_corrupt: bool = False) -> DataFrame:
    """CSV with a header row, typed by column name; a value that does not fit its type is NULL.

    Every file is read by its own header, so columns may come in any order, and differ from file to file; a column that
    a file lacks is NULL there. Columns that the schema does not know stay text. Folders may name more columns (key=value).
    """
    known = {f.name: f for f in schema.fields}
    parts = headers(spark, path, pattern)
    if not parts:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", skip_corrupt)
    if len(parts) == 1:
        (header,) = parts
        return reader.schema(_typed(header, known)).option("pathGlobFilter", pattern).csv(path)
    tables = [reader.schema(_typed(header, known)).csv(files) for header, files in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _typed(header: tuple[str, ...], known: dict[str, StructField]) -> StructType:
    return StructType([known.get(c, StructField(c, StringType())) for c in header])


def scan_csv_checked(spark: SparkSession, path: str, schema: StructType, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """The rows of ``scan_csv`` that fit, and a quarantine of those that do not: text, file, reason.

    A line is quarantined if it has more or fewer fields than its header, or a value that does not fit its type, so every
    line (blank ones and headers aside) is in exactly one of the two. Lines are parsed as text and in full, whatever columns
    are asked for later.
    """
    known = {f.name: f for f in schema.fields}
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    good, bad = None, None
    for header, paths in headers(spark, path, pattern).items():
        typed = _typed(header, known)
        lines = spark.read.text(paths).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
        titles = F.from_csv("text", ", ".join(f"_{n} STRING" for n in range(len(header))))
        is_header = F.array(*[titles[f"_{n}"] for n in range(len(header))]) == F.array(*[F.lit(c) for c in header])
        lines = lines.where((F.trim("text") != "") & ~F.coalesce(is_header, F.lit(False)))
        rows = lines.withColumn("row", F.from_csv("text", typed.add(CORRUPT, "string").toDDL(), options))
        fits = rows.where(F.col(f"row.{CORRUPT}").isNull()).select(*[F.col(f"row.`{c}`").alias(c) for c in header])
        torn = rows.where(F.col(f"row.{CORRUPT}").isNotNull()).select("text", "file", misfit(_typed(header, known)).alias("reason"))
        good = fits if good is None else good.unionByName(fits, allowMissingColumns=True)
        bad = torn if bad is None else bad.unionByName(torn)
    if good is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "text string, file string, reason string")
    return good, bad


def misfit(schema: StructType) -> Column:
    """Why the line ``text``, read as ``row``, is none of ``schema``: the count of its fields, or the fields that became NULL."""
    plain = StructType([*(StructField(f.name, StringType()) for f in schema.fields), StructField(CORRUPT, StringType())])
    fields = F.from_csv("text", plain.toDDL(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    wrong = [F.when(fields[f.name].isNotNull() & F.col("row")[f.name].isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")) for f in schema.fields]
    return F.when(fields[CORRUPT].isNotNull(), F.lit(f"not {len(schema)} fields")).otherwise(F.concat_ws(", ", *wrong))


def scan_csv_dates(spark: SparkSession, path: str, schema: StructType, date_cols: list[str]) -> DataFrame:
    """CSV whose date columns may hold anything: they are read as text and what is no date is NULL."""
    raw = StructType([StructField(f.name, StringType()) if f.name in date_cols else f for f in schema.fields])
    return scan_csv(spark, path, raw).withColumns({c: lenient_timestamp(c) for c in date_cols})


def scan_json(spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = False) -> DataFrame:
    """JSON records, one per line (or whole files with ``multi_line``, which Spark cannot split)."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def scan_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def scan_dir_union(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All CSV part files of a folder as one table; unreadable files are skipped."""
    return scan_csv(spark, folder, schema, "*.csv", skip_corrupt=True).select(*schema.fieldNames())


def scan_relational(
    spark: SparkSession, url: str, table: str, partition_col: str, lower: int, upper: int, parts: int, **options: str
) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric column at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(partitionColumn=partition_col, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts)).load()


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A table or view that the session knows."""
    return spark.table(name)


def sink_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(*partition_by).csv(path)


def sink_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sink_append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def sink_json_metrics(one_row: DataFrame, path: str) -> None:
    """The metrics of a run as a single JSON record."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def replace_all(df: DataFrame, path: str) -> None:
    """Drop what a table holds and write the new rows."""
    df.write.mode("overwrite").parquet(path)


def upsert_by_key(
    target: DataFrame, updates: DataFrame, key: str, defaults: dict[str, object], newest: str | None = None
) -> DataFrame:
    """Rows of ``target`` updated by key and rows with a new key added.

    A NULL key is a key like any other: an update without a key goes to the rows without a key, or is added.
    If updates may repeat a key, ``newest`` names the column by which the last of them counts; an update without that date is the oldest, and updates
    of the same date go by their other columns. Without ``newest`` a repeated key is an error.

    A missing or blank field of an update takes the column's default (0 is a value, not a blank). Columns
    that updates do not have keep the old value.
    """
    if newest:
        at = F.unix_micros(F.col(newest).cast("timestamp"))
        updates = first_per_key(updates, [key], [at.isNull(), -at, *[F.col(c) for c in updates.columns]])
    else:
        many = updates.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        alone = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"), F.lit("; name the newest")))).otherwise(True)
        updates = join_on(updates, many.where(alone.cast("boolean")).drop("_n"), [key])

    def filled(name: str) -> Column:
        value = F.col(f"n.{name}")
        if dict(updates.dtypes)[name] == "string":
            value = F.when(F.trim(value) != "", value)
        wanted = dict(target.dtypes)[name]
        value = value.try_cast(wanted)
        return F.coalesce(value, F.lit(defaults[name]).cast(wanted)) if name in defaults else value

    flagged = updates.withColumn("_update", F.lit(True))
    joined = target.alias("o").join(flagged.alias("n"), F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    is_new = F.col("n._update").isNotNull()
    out = []
    for name in target.columns:
        if name == key:
            out.append(F.coalesce(f"n.{key}", f"o.{key}").alias(key))
        elif name in updates.columns:
            out.append(F.when(is_new, filled(name)).otherwise(F.col(f"o.{name}")).alias(name))
        else:
            out.append(F.coalesce(F.col(f"o.{name}"), F.lit(defaults.get(name)).cast(dict(target.dtypes)[name])).alias(name))
    return joined.select(*out)


def load_registry(spark: SparkSession, root: str, registry: dict[str, TableSpec]) -> dict[str, DataFrame]:
    """All tables of a registry; every missing file or column is reported, in one error."""
    tables, errors = {}, []
    for name, spec in registry.items():
        path = f"{root}/{spec.folder}"
        try:
            found = headers(spark, path)
        except Exception as e:  # the reader's own message names the path
            errors.append(f"{name}: {str(e).splitlines()[0]}")
            continue
        missing = sorted({c for header in found for c in spec.required if c not in header}) if found else list(spec.required)
        if missing:
            errors.append(f"{name}: missing columns {missing}")
            continue
        tables[name] = scan_csv(spark, path, spec.schema)
    if errors:
        raise ValueError("; ".join(errors))
    return tables


def registry_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and mean percentage of missing values of each table."""
    out = None
    for name, df in tables.items():
        nulls = sum((F.avg(F.col(c).isNull().cast("int")) for c in df.columns), F.lit(0.0)) / len(df.columns) * 100
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("cols"), nulls.alias("null_pct"))
        out = row if out is None else out.unionByName(row)
    return out


def workspace_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Name, kind, rows and columns of the uploads below ``folder``, each a folder of CSV or JSON-lines files.

    One scan counts the rows of all CSV uploads and one those of all JSON uploads.
    """
    upload = F.regexp_extract("_metadata.file_path", UPLOAD, 1)
    known: list[tuple[str, str, int]] = []
    for header, paths in headers(spark, f"{folder}/*", "*.csv").items():
        known += [(name, detect_dataset_type(list(header)), len(header)) for name in {re.match(UPLOAD, p)[1] for p in paths}]
    counts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("header", True).schema("first string").csv(f"{folder}/*").groupBy(upload.alias("upload")).count()
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(f"{folder}/*").where(F.trim("value") != "")
    fields = lines.select(upload.alias("upload"), F.json_object_keys("value").alias("fields"))
    # A JSON upload has the fields that any of its rows has.
    of_json = fields.groupBy("upload").agg(F.count(F.lit(1)).alias("count"))
    named = fields.select("upload", F.explode("fields").alias("field")).distinct().orderBy("upload", "field").toLocalIterator()
    for name, rows in groupby(named, lambda r: r["upload"]):
        columns = [r["field"] for r in rows]
        known.append((name, detect_dataset_type(columns), len(columns)))
    kinds = spark.createDataFrame(known, "upload string, type string, cols int")
    return counts.unionByName(of_json).join(kinds, "upload").select(
        F.regexp_extract("upload", r"([^/]*)$", 1).alias("filename"), "type", F.col("count").alias("rows"), "cols"
    )


def newest_upload(spark: SparkSession, folder: str, kind: str | None = None) -> tuple[str, datetime] | None:
    """Path and time of the newest upload below ``folder``, of those whose header is of ``kind`` if given.

    Each upload is a folder of part files. Only paths and times are listed to choose (the later path of equal times).
    """
    of_kind = None
    if kind:
        found = headers(spark, f"{folder}/*", "*.csv").items()
        of_kind = [re.match(UPLOAD, p)[1] for header, paths in found if detect_dataset_type(list(header)) == kind for p in paths]
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{folder}/*")
    uploads = listed.select(F.regexp_extract("path", UPLOAD, 1).alias("upload"), "modificationTime")
    if of_kind is not None:
        names = spark.createDataFrame([(n,) for n in sorted({n.removeprefix("file:").lstrip("/") for n in of_kind})], "name string")
        uploads = uploads.join(names, F.ltrim(F.regexp_replace("upload", "^file:", ""), F.lit("/")) == F.col("name"), "left_semi")
    newest = uploads.agg(F.max(F.struct("modificationTime", "upload")).alias("newest")).first()["newest"]
    return (newest["upload"], newest["modificationTime"]) if newest else None


def sync_latest(spark: SparkSession, folder: str, schema: StructType, kind: str | None = None) -> DataFrame:
    """The rows of the newest upload below ``folder`` (see ``newest_upload``); only that one is read, and it may have no rows.

    ``versions.VersionedTable.sync_latest`` puts them in a table's place.
    """
    found = newest_upload(spark, folder, kind)
    return scan_csv(spark, found[0], schema) if found else spark.createDataFrame([], schema)
