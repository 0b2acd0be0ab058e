"""Scans of stored artifacts and decks, and sinks."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..model import schema


def lecture_of_path():
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.source)?\.[^./]+$", 1)


def scan_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON documents, one to a file, as rows with the lecture_id from the file's name; the schema is given, never inferred."""
    return spark.read.schema(schema(ddl)).option("multiLine", True).json(path).withColumn("lecture_id", lecture_of_path())


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


def scan_json_or(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """As ``scan_json``; missing files are no rows, and damaged ones rows without values, which are dropped."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema(ddl + ", lecture_id string"))
    names = schema(ddl).fieldNames()
    rows = spark.read.schema(schema(ddl + ", __bad string")).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    return rows.where("__bad is null").select(*names).withColumn("lecture_id", lecture_of_path())


def scan_url_map(spark: SparkSession, path: str) -> DataFrame:
    """(lecture_id, url) of a JSON object, by id."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("lecture_id", "url")).orderBy("lecture_id")


def scan_text(spark: SparkSession, path: str, name: str = "lecture_id") -> DataFrame:
    """(name, text) of whole text files, such as notes and sheets."""
    return spark.read.text(path, wholetext=True).select(lecture_of_path().alias(name), F.col("value").alias("text"))


def prefer(*sources: DataFrame, column: str = "text") -> DataFrame:
    """One row: the text of the first source that has any, or null. Each source is a course's one document."""
    parts = [s.agg(F.first(F.nullif(strip(column), F.lit("")), ignorenulls=True).alias("x")).select(F.lit(i).alias("i"), "x") for i, s in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.agg(F.min_by("x", F.when(F.col("x").isNotNull(), F.col("i"))).alias(column))


def known_lectures(stage_input: DataFrame) -> DataFrame:
    """What "all lectures" means to a stage: those its input has."""
    return stage_input.select("lecture_id").distinct().orderBy("lecture_id")


def verified_files(spark: SparkSession, path: str) -> DataFrame:
    """(lecture_id, path, size) of files that aren't empty; contents are not read."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    return rows.where("size > 0").withColumn("lecture_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))


def playable(files: DataFrame, durations: DataFrame) -> DataFrame:
    """Verified files whose probed duration (lecture_id, duration) is above zero."""
    return files.where("size > 0").join(durations.where("duration > 0").select("lecture_id", "duration"), "lecture_id")


def tagged_union(sources: dict[str, DataFrame], columns: list[str], tag: str = "source") -> DataFrame:
    """The rows of several files with their file's name, those of the first name first; no files are no rows, not an error.

    ``columns`` are SQL column definitions, which an empty set of files needs for its schema.
    """
    spark = SparkSession.active()
    rows = spark.createDataFrame([], schema(", ".join([*columns, f"{tag} string"])))
    for name in sorted(sources):
        rows = rows.unionByName(sources[name].withColumn(tag, F.lit(name)))
    return rows


def merge_pool(old: DataFrame, new: DataFrame, replace: bool, key: str = "name") -> DataFrame:
    """A pool after an upload: the new files alone, or the old ones too, a new one in the place of an old one of its name."""
    return new if replace else old.join(new.select(key), key, "left_anti").unionByName(new)


def write_lectures(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by lecture; lectures that are not in ``df`` stay as they are. Rewritten ones appear with the job's commit."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("lecture_id").parquet(path)


def pending(requested: DataFrame, spark: SparkSession, path: str, force: bool = False) -> DataFrame:
    """The requested lectures that have no rows at ``path`` yet, or all if forced."""
    if force or not path_exists(spark, f"{path}/lecture_id=*"):
        return requested
    return requested.join(spark.read.parquet(path).select("lecture_id").distinct(), "lecture_id", "left_anti")


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a table has rows; files that were not committed are not seen."""
    return path_exists(spark, path) and not spark.read.parquet(path).limit(1).isEmpty()


def merge_provenance(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows (lecture_id, url) with new ones in the place of those of the same lecture."""
    return old.join(new.select("lecture_id"), "lecture_id", "left_anti").unionByName(new)


def write_document(path: str, text: str) -> None:
    """One document to a local file, which never is half written."""
    where = os.path.dirname(os.path.abspath(path))
    os.makedirs(where, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=where, delete=False) as f:
        f.write(text)
    os.replace(f.name, path)


def write_json(path: str, value) -> None:
    write_document(path, json.dumps(value, ensure_ascii=False, indent=2))


def without_images(payloads: DataFrame, column: str = "content") -> DataFrame:
    """Payloads (content ARRAY<STRUCT<type, text, data>>) for a debug table, with image data left out."""
    kept = F.transform(column, lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.when(p["type"] == "image", "<image>").otherwise(p["data"]).alias("data")))
    return payloads.withColumn(column, kept)


def stale_documents(sources: DataFrame, rendered: DataFrame) -> DataFrame:
    """Sources (name, modified) that have no rendering, or one that is older."""
    made = rendered.select("name", F.col("modified").alias("__made"))
    return sources.join(made, "name", "left").where(F.col("__made").isNull() | (F.col("__made") < F.col("modified"))).drop("__made")


def with_extension(files: DataFrame, *extensions: str) -> DataFrame:
    """Files (path) of the kinds that are accepted, whatever their case."""
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
