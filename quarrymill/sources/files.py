"""Readers and writers of the file formats that corpora come in, and publishing without half-written states."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import snake


def read_csv_text(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """CSV with every column a string, quoted line breaks kept, blank fields null, names in snake case."""
    d = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, mode="PERMISSIVE" if lenient else "FAILFAST", enforceSchema=False)
    d = d.toDF(*map(snake, d.columns))
    return d.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in d.columns])


def read_csv_typed(spark: SparkSession, path: str, text_columns: list[str]) -> DataFrame:
    """CSV with inferred types, but codes in ``text_columns`` (snake case) as they are written."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=True)
    keep = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    names = [snake(c) for c in raw.columns]
    types = {n: raw.schema[c].dataType for n, c in zip(names, raw.columns)}
    d = keep.toDF(*names)
    return d.select(*[F.col(n) if n in text_columns else F.col(n).try_cast(types[n]).alias(n) for n in names])


def read_many(spark: SparkSession, paths: list[str], reader=read_csv_text, source_column: str = "source_file") -> DataFrame:
    """Files united by column names, absent columns null, with the name of each row's file."""
    out = None
    for p in paths:
        d = reader(spark, p).withColumn(source_column, F.lit(p.rsplit("/", 1)[-1]))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def read_paged_json(spark: SparkSession, path: str, item_schema: str, field: str = "data") -> DataFrame:
    """Items of paged answers (plain or gzip): each with its file, its index in the page and the verbatim JSON."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"{field} array<{item_schema}>").alias("p"), F.from_json("value", f"{field} array<string>").alias("raw"))
    items = pages.select("file", F.posexplode(f"p.{field}").alias("index", "item"), F.col("raw"))
    ref = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(f"#{field}["), "index", F.lit("]"))
    return items.select(ref.alias("record_ref"), "index", "item.*", F.element_at(f"raw.{field}", F.col("index") + 1).alias("raw_json"))


def read_links(spark: SparkSession, path: str, prefix: str = "broader") -> DataFrame:
    """Edges of a hierarchy from nested ``_links`` maps: every relation whose name starts with ``prefix``."""
    item = "array<struct<uri:string,_links:map<string,array<struct<uri:string,title:string>>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"_embedded struct<results:{item}>").alias("d"))
    rows = doc.select(F.explode("d._embedded.results").alias("r")).select(F.col("r.uri").alias("uri"), F.explode("r._links").alias("relation", "targets"))
    return rows.where(F.col("relation").startswith(prefix)).select("uri", "relation", F.explode("targets").alias("t")).select("uri", "relation", F.col("t.uri").alias("target_uri"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines log, and its lines that hold no such row."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    d = lines.select(F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return d.where("_corrupt is null").drop("_corrupt"), d.where("_corrupt is not null").select("_corrupt")


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """One CSV folder; with ``bom`` the header starts with a byte order mark, as spreadsheets want."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    (out.coalesce(1) if bom else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def publish(df: DataFrame, path: str) -> None:
    """Writes beside the target and swaps by rename: readers see the old table or the new one."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}"
    df.write.parquet(staging)
    target = fs_path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        old = fs_path(staging.replace(".staging-", ".old-"))
        fs.rename(target, old)
        fs.rename(fs_path(staging), target)
        fs.delete(old, True)
    else:
        fs.rename(fs_path(staging), target)


def replace_run(df: DataFrame, path: str, partition: str) -> None:
    """Writes the partitions of ``df`` in place of those with the same key; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def insert_checked(df: DataFrame, path: str, schema: str, key: list[str], required: list[str] = ()) -> None:
    """Writes rows of a fixed schema; fails if a key repeats or a required value is missing."""
    from pyspark.sql.types import StructType

    from quarrymill.operators.dedup import assert_keys

    fields = StructType.fromDDL(schema).fields
    assert_keys(df.select(*[F.col(f.name).cast(f.dataType) for f in fields]), key, list(required)).write.mode("overwrite").parquet(path)


def newest(df: DataFrame, snapshot: str, complete: str | None = None) -> DataFrame:
    """Rows of the newest (complete) snapshot of a partitioned table; the filter prunes the scan."""
    d = df.where(F.col(complete)) if complete else df
    last = d.agg(F.max(snapshot)).first()[0]
    return df.where(F.col(snapshot) == F.lit(last))


def newest_version(c: Column) -> Column:
    """Aggregate: the highest version of texts like ``29.10``, by its numbers."""
    return F.max_by(c, F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))))


def validate(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Checks of every file under a path: size, hash, whether it is a web page, and against a manifest's hash."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.lower(F.decode(F.substring("content", 1, 512), "UTF-8"))
    d = f.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"), head.rlike(r"^\s*(<!doctype html|<html)").alias("is_html"))
    if manifest is not None:
        d = d.join(manifest.select("file", F.col("sha256").alias("expected")), "file", "left")
    else:
        d = d.withColumn("expected", F.lit(None).cast("string"))
    status = F.when(F.col("length") == 0, "empty").when(F.col("is_html"), "web page").when(F.col("expected").isNotNull() & (F.col("expected") != F.col("sha256")), "changed").otherwise("ok")
    return d.select("file", "length", "sha256", status.alias("status"))


def folder_digest(spark: SparkSession, path: str) -> DataFrame:
    """One hash of all names and contents under a path, whatever order they are read in."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.struct(F.element_at(F.split("path", "/"), -1).alias("n"), F.sha2("content", 256).alias("h")).alias("s")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.concat(s["n"], s["h"])), ""), 256).alias("digest"))


SECRET = r"(?i)(?:api[_-]?key|secret|password|token)\s*[=:]\s*[\"'][A-Za-z0-9_\-]{16,}[\"']|\bsk-[A-Za-z0-9]{20,}\b|\bAKIA[0-9A-Z]{16}\b"


def secrets(spark: SparkSession, path: str) -> DataFrame:
    """Text files that hold what looks like a credential."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).where(F.col("value").rlike(SECRET)).select(F.input_file_name().alias("file"))


def tables(spark: SparkSession) -> DataFrame:
    """Tables of the session's catalog with their kind and columns."""
    rows = [(t.name, t.tableType, len(spark.table(t.name).columns)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, n_columns int")


def schema_inventory(frames: dict[str, DataFrame]) -> DataFrame:
    spark = next(iter(frames.values())).sparkSession
    rows = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n, d in frames.items() for i, f in enumerate(d.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, nullable boolean")


def cached_map(inputs: DataFrame, key: str, cache_path: str, compute) -> DataFrame:
    """Results of an expensive call by key: only keys that the cache lacks are computed, appended and read back.

    ``compute`` maps the DataFrame of missing inputs to rows with ``key``; an encoder or model runs there by
    ``mapInPandas``.
    """
    spark = inputs.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        missing = inputs.join(spark.read.parquet(cache_path).select(key), key, "left_anti").dropDuplicates([key])
    else:
        missing = inputs.dropDuplicates([key])
    compute(missing).write.mode("append").parquet(cache_path)
    return inputs.join(spark.read.parquet(cache_path), key, "left")
