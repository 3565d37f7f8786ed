"""COPY text and dumps: reading with their escapes and error rules, writing, validation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import copy_escape, copy_unescape

MAX_KEY, MAX_VALUE = 1024, 4 << 20


def read_copy(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""COPY text of declared columns: tab-separated, \N is null; a line with another number of fields is an error."""
    return parse_copy(spark.read.text(path), schema)


def parse_copy(lines: DataFrame, schema: str) -> DataFrame:
    """The same of a table of lines (value)."""
    fields = lines.sparkSession.createDataFrame([], schema).schema.fields
    parts = lines.where("value <> '\\\\.'").select("value", F.split("value", "\t", -1).alias("f"))
    checked = F.when(F.size("f") == len(fields), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.substring("value", 1, 80))))
    rows = parts.select(checked.alias("f"))
    return rows.select(*[copy_unescape(F.col("f")[i]).cast(x.dataType).alias(x.name) for i, x in enumerate(fields)])


def parse_copy_kv(lines: DataFrame) -> DataFrame:
    """COPY into a key/value table: two fields; an empty or null key is an error, a null value is empty."""
    rows = parse_copy(lines, "key string, value string")
    key = F.when(F.coalesce("key", F.lit("")) == "", F.raise_error(F.lit("empty key"))).otherwise(F.col("key"))
    return rows.select(key.alias("key"), F.coalesce("value", F.lit("")).alias("value"))


def to_copy(df: DataFrame) -> DataFrame:
    """One line (value) a row."""
    return df.select(F.concat_ws("\t", *[copy_escape(F.col(c)) for c in df.columns]).alias("value"))


def write_copy(df: DataFrame, path: str) -> None:
    to_copy(df).write.text(path)


def import_dump(lines: DataFrame) -> DataFrame:
    r"""A dump's COPY lines, leniently: (key, value, oversized). No tab: an empty value. Unknown escapes keep their backslash."""
    rows = lines.where("value <> '' and not startswith(value, '\\\\.')")
    at = F.instr("value", "\t")
    key = F.trim(F.when(at > 0, F.substring(F.col("value"), F.lit(1), at - 1)).otherwise(F.col("value")))
    value = F.when(at > 0, F.substring(F.col("value"), at + 1, F.length("value"))).otherwise(F.lit(""))
    out = rows.select(copy_unescape(key, True).alias("key"), copy_unescape(value, True).alias("v")).withColumnRenamed("v", "value")
    big = (F.octet_length("key") == 0) | (F.octet_length("key") > MAX_KEY) | (F.octet_length("value") > MAX_VALUE)
    return out.withColumn("oversized", big)


def report(rows: DataFrame) -> DataFrame:
    """(rows, bytes, oversized) of key/value rows; bytes are of the rows that fit."""
    big = (F.octet_length("key") == 0) | (F.octet_length("key") > MAX_KEY) | (F.octet_length("value") > MAX_VALUE)
    size = F.octet_length("key") + F.octet_length("value")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.when(~big, size)), F.lit(0)).alias("bytes"), F.count_if(big).alias("oversized"))


def parse_inserts(lines: DataFrame) -> DataFrame:
    """INSERT lines to (table, key, value): the first two quoted literals; other lines give none."""
    literal = r"'((?:[^']|'')*)'"
    table = F.regexp_extract("value", r"(?i)INSERT INTO\s+([\w\"]+)", 1)
    tail = F.regexp_extract("value", r"(?is)VALUES(.*)$", 1)
    found = F.regexp_extract_all(tail, F.lit(literal), F.lit(1))
    out = lines.select(F.replace(table, F.lit('"'), F.lit("")).alias("table"), found.alias("f")).where("table <> '' and size(f) >= 2")
    plain = lambda c: F.replace(c, F.lit("''"), F.lit("'"))
    return out.select("table", plain(F.col("f")[0]).alias("key"), plain(F.col("f")[1]).alias("value"))


def dump_objects(lines: DataFrame) -> DataFrame:
    """Tables and policies of a schema dump, one statement a line: (kind, name, table, expression)."""
    v = F.col("value")
    create = F.regexp_extract(v, r"(?i)CREATE TABLE\s+(?:IF NOT EXISTS\s+)?([\w.\"]+)", 1)
    policy = F.regexp_extract(v, r"(?i)CREATE POLICY\s+\"?([^\"]+?)\"?\s+ON\s", 1)
    on = F.regexp_extract(v, r"(?i)CREATE POLICY\s+.+?\s+ON\s+([\w.\"]+)", 1)
    using = F.regexp_extract(v, r"(?is)USING\s*\((.*)\)", 1)
    plain = lambda c: F.replace(c, F.lit('"'), F.lit(""))
    tables = lines.where(create != "").select(F.lit("table").alias("kind"), plain(create).alias("name"), plain(create).alias("table"), F.lit("").alias("expression"))
    return tables.unionByName(lines.where(policy != "").select(F.lit("policy").alias("kind"), policy.alias("name"), plain(on).alias("table"), using.alias("expression")))


def lsn(text):
    """A log position `hi/lo`, both hexadecimal, as one number."""
    part = F.split(text, "/")
    return F.conv(part[0], 16, 10).cast("long") * (1 << 32) + F.conv(part[1], 16, 10).cast("long")
