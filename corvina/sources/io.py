"""Sources and sinks."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions.code_meta import parse_js


def _opened(content: bytes):
    """A reader of the Arrow file or stream in content."""
    try:
        return pa.ipc.open_file(pa.BufferReader(content))
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(pa.BufferReader(content))


def read_arrow(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S5. Arrow files or streams, one file or a folder of them: each file is read by a task (files below 2 GB), none on the driver.

    Without a schema that of the first file is taken; files of another schema are an error when they are read."""
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches):
        for b in batches:
            for c in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([_opened(c.as_py()).schema.serialize().to_pybytes()])], names=["schema"])

    if schema is None:
        first = files.limit(1).mapInArrow(heads, "schema binary").first()
        if first is None:
            raise ValueError(f"no Arrow file at {path}")
        schema = from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(first[0])))

    def rows(batches):
        for b in batches:
            for c in b.column(0):
                r = _opened(c.as_py())
                yield from (r.get_batch(i) for i in range(r.num_record_batches)) if hasattr(r, "num_record_batches") else r

    return files.mapInArrow(rows, schema)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S1, S5. Parquet, ORC, JSON lines, CSV with a header, or Arrow files, by the path's ending; a folder is read as parquet."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end in ("arrow", "feather"):
        return read_arrow(spark, path, schema)
    r = spark.read.schema(schema) if schema else spark.read
    if end in ("json", "jsonl", "ndjson"):
        return r.json(path)
    if end == "csv":
        return r.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return r.orc(path) if end == "orc" else r.parquet(path)


def prepare(df: DataFrame, path: str) -> None:
    """S4. Write once: a table that is there already stays as it is."""
    df.write.mode("ignore").parquet(path)


def inspect(df: DataFrame, n: int = 5) -> dict:
    """S5. Row count, schema and a few rows."""
    return {"rows": df.count(), "schema": df.schema.simpleString(), "sample": [r.asDict(True) for r in df.limit(n).collect()]}


def scan_sources(spark: SparkSession, root: str, pattern: str = "*.js") -> DataFrame:
    """S6. (path, text) of all files of a tree whose name matches; path is relative to root, on any file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(root)
    full = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath().rstrip("/")
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    decoded = F.url_decode(F.regexp_replace("_metadata.file_path", "\\+", "%2B"))
    path = F.regexp_replace(decoded, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    return df.select(F.substring(path, len(full) + 2, 1 << 20).alias("path"), F.col("value").alias("text"))


def function_corpus(files: DataFrame) -> DataFrame:
    """S7. (doc_id, path, start_line, end_line, short_name, text): each function of the files as a text, id path:line:name."""
    f = parse_js(files, "path", "text", keep=["path"]).join(files, "path")
    body = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return f.select(F.concat_ws(":", "path", F.col("start_line").cast("string"), "short_name").alias("doc_id"), "path", "start_line", "end_line", "short_name", body.alias("text"))


def first_available(spark: SparkSession, paths: list[str], fallback: list[tuple[str, str]], limit: int | None = None) -> DataFrame:
    """S8. (doc_id, text) from the first path that is there and has rows, else the given rows; blank texts are skipped.

    Only a path that does not exist, or holds no table, is passed over; a table that cannot be read is an error."""
    for p in paths:
        try:
            df = read_table(spark, p).select("doc_id", "text").filter(F.trim("text") != "")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        if df.limit(1).count():
            return df.limit(limit) if limit else df
    return spark.createDataFrame(fallback, "doc_id string, text string")


def write_report(report: dict, path: str) -> None:
    """S11. One JSON document, put in place by renaming."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".part", "w") as f:
        json.dump(report, f, indent=2, sort_keys=True, default=str)
    os.replace(path + ".part", path)


def write_triplets(df: DataFrame, path: str) -> None:
    """S12. JSON lines of (query, positive, negative)."""
    df.select("query", "positive", "negative").write.mode("overwrite").json(path)
