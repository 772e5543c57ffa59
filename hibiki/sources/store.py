"""Chunk stores: a where-language, upsert and delete over tables, lenient JSON logs, CSV of any common form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c.isNull() | (c != v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: c.isNull() | ~c.isin(list(v)),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
}


def where(clause: dict | None) -> Column:
    """A predicate from a nested clause of $and, $or and comparisons per column, pushed to the scan by Catalyst.

    {} and None are true.  A missing value equals nothing and differs from everything.
    """
    parts: list[Column] = []
    for name, value in (clause or {}).items():
        if name in ("$and", "$or"):
            if not value:
                raise ValueError(f"{name} needs clauses")
            parts.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), [where(v) for v in value]))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        elif isinstance(value, dict):
            for op, v in value.items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown operator {op}")
                parts.append(F.coalesce(_COMPARE[op](F.col(name), v), F.lit(False)))
        else:
            parts.append(F.coalesce(F.col(name) == value, F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tenant_is(tenant: str, column: str = "tenant_id") -> Column:
    """Rows of a tenant; null and blank belong to "default"."""
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("default")) == tenant


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of *new* in place of rows of equal keys; columns missing on one side are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(keys_df.select(*keys).distinct(), keys, "left_anti")


def problems(rows: DataFrame, key: str, vector: str | None = None) -> DataFrame:
    """(problem, n): null keys, repeated keys, and vectors that are empty, not finite or of another length than most."""
    found = [rows.filter(F.col(key).isNull()).agg(F.lit("null key").alias("problem"), F.count("*").alias("n")), rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").agg(F.lit("repeated key").alias("problem"), F.count("*").alias("n"))]
    if vector:
        size = F.size(vector)
        usual = rows.filter(size > 0).groupBy(size.alias("s")).agg(F.count("*").alias("c")).agg(F.max_by("s", F.struct("c", "s")).alias("s")).select("s").scalar()
        found.append(rows.filter(F.col(vector).isNull() | (size == 0)).agg(F.lit("empty vector").alias("problem"), F.count("*").alias("n")))
        found.append(rows.filter((size > 0) & (size != usual)).agg(F.lit("other length").alias("problem"), F.count("*").alias("n")))
        found.append(rows.filter(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).agg(F.lit("not finite").alias("problem"), F.count("*").alias("n")))
    return reduce(lambda a, b: a.unionByName(b), found)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with *malformed*: unreadable lines are kept as text in that column, blank lines are skipped."""
    if "malformed" in schema.names:
        raise ValueError("malformed is the column of unreadable lines")
    full = T.StructType([*schema.fields, T.StructField("malformed", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").json(path)


def write_days(lines: DataFrame, root: str, day: str, line: str) -> None:
    """Append-only day files: the text column *line* under root/dt=<day>."""
    lines.select(F.col(day).cast("string").alias("dt"), F.col(line).alias("value")).write.mode("append").partitionBy("dt").text(root)


def read_days(spark: SparkSession, root: str, schema: T.StructType, last: str, days: int) -> DataFrame:
    """The rows of the *days* days up to *last*, with dt and malformed: other days' files are not opened."""
    if days < 1:
        raise ValueError("at least one day")
    full = T.StructType([*schema.fields, T.StructField("malformed", T.StringType()), T.StructField("dt", T.DateType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").json(root)
    end = F.lit(last).cast("date")
    return rows.filter((F.col("dt") > F.date_sub(end, days)) & (F.col("dt") <= end))


def read_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON lines corpus: unreadable lines and rows without text are left out."""
    rows = read_log(spark, path, schema)
    return rows.filter(F.col("malformed").isNull() & F.col("text").isNotNull() & (F.trim("text") != "")).drop("malformed")


def sniff_csv(sample: bytes) -> tuple[str, str]:
    """(encoding, delimiter) of a CSV's first bytes: BOM, UTF-8, CP932 or EUC-JP; the delimiter that splits lines most evenly."""
    encoding = "utf-8"
    if sample.startswith(b"\xef\xbb\xbf"):
        sample = sample[3:]
    else:
        for encoding in ("utf-8", "cp932", "euc_jp"):
            try:
                sample[: sample.rfind(b"\n") + 1 or None].decode(encoding)
                break
            except UnicodeDecodeError:
                continue
    lines = [x for x in sample.decode(encoding, "replace").splitlines()[:20] if x.strip()]
    even = lambda d: (min((x.count(d) for x in lines), default=0) > 0, -len({x.count(d) for x in lines}), sum(x.count(d) for x in lines))
    return encoding, max(",\t;|", key=even)


def read_csv(spark: SparkSession, path: str, sample_bytes: int = 65_536) -> DataFrame:
    """A CSV with header, its encoding and delimiter sniffed from its first bytes only."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).open(fs_path)
    try:
        sample = bytes(stream.readNBytes(sample_bytes))
    finally:
        stream.close()
    encoding, delimiter = sniff_csv(sample)
    if encoding != "utf-8":  # Spark reads these only where legacy charsets are allowed
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    java = {"utf-8": "UTF-8", "cp932": "windows-31j", "euc_jp": "EUC-JP"}[encoding]
    return spark.read.option("header", True).option("sep", delimiter).option("encoding", java).option("multiLine", java != "UTF-8").csv(path)
