"""Files and databases as tables: Parquet, ORC, CSV, JSON, Arrow IPC, JDBC, and bulk JSON bodies."""

from __future__ import annotations

import functools
import glob
import re
import tempfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote, urlparse

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heddle.session import remove

BODY = "table string, rows array<struct<key: string, value: string>>"


def ingest_json(bodies: DataFrame) -> DataFrame:
    """(table, key, value) of JSON bodies (value) {table, rows: [{key, value}]}; a body that has no such form is an error, a null value is empty."""
    body = F.from_json("value", BODY, {"mode": "PERMISSIVE"}).alias("b")
    rows = bodies.select(body, F.col("value").alias("text"))
    bad = F.col("b").isNull() | F.col("b.table").isNull() | F.col("b.rows").isNull()
    checked = rows.select(F.when(bad, F.raise_error(F.concat(F.lit("not a body of rows: "), F.substring("text", 1, 80)))).otherwise(F.col("b")).alias("b"))
    out = checked.select("b.table", F.explode("b.rows").alias("r"))
    key = F.when(F.coalesce("r.key", F.lit("")) == "", F.raise_error(F.lit("empty key"))).otherwise(F.col("r.key"))
    return out.select("table", key.alias("key"), F.coalesce("r.value", F.lit("")).alias("value"))


def read_files(spark: SparkSession, kind: str, path: str, schema: StructType) -> DataFrame:
    """Parquet, ORC, CSV (with a header) or JSON lines of a known schema: nothing is read to infer it."""
    reader = spark.read.schema(schema).format(kind)
    return (reader.option("header", "true") if kind == "csv" else reader).load(path)


def write_arrow(df: DataFrame, path: str) -> DataFrame:
    """A file of Arrow IPC batches for each task, below `path`, a URI that pyarrow's file systems know; returns (file, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, n, writer, sink = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.arrow", 0, None, None
        for b in batches:
            if writer is None:
                sink = store.open_output_stream(f"{base}/{name}", compression=None)
                writer = pa.ipc.new_file(sink, b.schema)
            writer.write_batch(b)
            n += b.num_rows
        if writer is not None:
            writer.close()
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{path.rstrip('/')}/{name}"] if n else [], pa.string()), pa.array([n] if n else [], pa.int64())], names=["file", "rows"])

    return df.mapInArrow(run, "file string, rows long")


def read_arrow(files: DataFrame, schema: StructType) -> DataFrame:
    """The rows of Arrow IPC files (file: URI), a batch at a time."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for file in (x for b in batches for x in b.column(0).to_pylist()):
            store, at = fs.FileSystem.from_uri(file)
            with store.open_input_file(at) as f:
                reader = pa.ipc.open_file(f)
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i).select(names)

    return files.select("file").mapInArrow(run, schema)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 8, **options: str) -> DataFrame:
    """A database's table, read in `parts` ranges of a whole-number key; filters and columns are pushed to it."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


#: Rows of a database, at most, that an executor restores at once.
DATABASE_ROWS = 1_000_000


def _databases(df: DataFrame, path: str) -> list[str]:
    """`df` in embedded databases of some DATABASE_ROWS rows each: their URLs.

    An embedded database is of one process, so the driver loads each from files of a range of keys and
    leaves a copy below `path`, a folder that all machines have mounted; an executor's URL restores the
    copy to its own working folder when it first reads it. In the driver that name is an empty database,
    which is asked for the columns alone.
    """
    spark, key = df.sparkSession, df.columns[0]
    jvm, at = spark._jvm, unquote(urlparse(path).path)
    if urlparse(path).scheme not in ("", "file"):
        raise ValueError(f"an embedded database needs a folder that is mounted: {path}")
    if jvm.java.lang.System.getProperty("derby.system.home") is None:  # where relative names are
        jvm.java.lang.System.setProperty("derby.system.home", tempfile.mkdtemp(prefix="heddle-"))
    parts = -(-df.count() // DATABASE_ROWS) or 1
    times = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "dateFormat": "yyyy-MM-dd"}
    dealt = df.repartitionByRange(parts, key)
    dealt.write.options(escape='"', **times).csv(f"{path}/rows")
    types = ", ".join(f"{f.name} varchar(200)" for f in df.schema.fields if f.dataType.simpleString() == "string")
    base = at.rstrip("/").rsplit("/", 1)[-1]
    none = df.limit(0)

    def end(url: str) -> None:
        try:
            jvm.java.sql.DriverManager.getConnection(f"{url};shutdown=true").close()
        except Py4JJavaError as e:  # how a shutdown that succeeds is told
            if e.java_exception.getSQLState() != "08006":
                raise

    def load(i: int, file: str) -> str:
        name = f"rows-{base}-{i}"
        for url in (f"jdbc:derby:{name}", f"jdbc:derby:load-{name}"):
            none.write.option("createTableColumnTypes", types).jdbc(f"{url};create=true", "T", mode="overwrite")
        c = jvm.java.sql.DriverManager.getConnection(url)
        for call, value in (("SYSCS_UTIL.SYSCS_IMPORT_TABLE(null, 'T', ?, ',', '\"', 'UTF-8', 0)", file), ("SYSCS_UTIL.SYSCS_BACKUP_DATABASE(?)", f"{at}/copies/{i}")):
            s = c.prepareCall(f"CALL {call}")
            s.setString(1, value)
            s.execute()
            s.close()
        c.close()
        end(url)
        remove(spark, f"file://{jvm.java.lang.System.getProperty('derby.system.home')}/load-{name}")
        return f"jdbc:derby:{name};createFrom={at}/copies/{i}/load-{name}"

    files = sorted(glob.glob(f"{at}/rows/part-*"))
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(load, range(len(files)), files))


def round_trip(df: DataFrame, kind: str, path: str) -> DataFrame:
    """`df` written as `kind` below `path` and read back; JDBC: to an embedded database, in memory on a local master, else by `_databases`."""
    spark = df.sparkSession
    if kind == "arrow":
        uri = path if "://" in path or path.startswith("/") else f"/{path}"
        written = write_arrow(df, uri)
        written.write.parquet(f"{path}-files")
        return read_arrow(spark.read.parquet(f"{path}-files"), df.schema)
    if kind == "jdbc" and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return functools.reduce(DataFrame.union, [spark.read.jdbc(url, "T") for url in _databases(df, path)]).toDF(*df.columns)
    if kind == "jdbc":
        url, name = f"jdbc:derby:memory:{path.rstrip('/').rsplit('/', 1)[-1]};create=true", "T"
        low, high = df.agg(F.min(df.columns[0]), F.max(df.columns[0])).first()
        df.coalesce(1).write.option("createTableColumnTypes", ", ".join(f"{f.name} varchar(200)" for f in df.schema.fields if f.dataType.simpleString() == "string")).jdbc(url, name, mode="overwrite")
        return read_jdbc(spark, url, name, df.columns[0], low or 0, (high or 0) + 1, 4).toDF(*df.columns)
    writer = df.write.option("header", "true") if kind == "csv" else df.write
    writer.format(kind).save(path)
    return read_files(spark, kind, path, df.schema)
