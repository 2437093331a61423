"""Sources and sinks: tables by suffix, header aliases, row ids, reports, and the adapter over the star schema."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import CANONICAL, HEADER_ALIASES, parse_date

TYPES = "InvoiceNo string, StockCode string, Description string, Quantity double, InvoiceDate timestamp_ntz, UnitPrice double, CustomerID bigint, Country string"

#: A dirty line-item table out of lineitem, orders, part and customer; valid in Spark and in DuckDB.
RETAIL_SQL = """
WITH c(k, nm) AS (VALUES (0,'United Kingdom'),(1,'EIRE'),(2,'USA'),(3,'France'),(4,'Germany'),(5,'Spain'),(6,'Italy'),(7,'Japan'),(8,'Norway'),(9,'Poland'),(10,'Portugal'),(11,'Sweden'),(12,'Greece'),(13,' iceland'),(14,'ISRAEL'),(15,'Cyprus'),(16,'Denmark'),(17,'Finland'),(18,'Belgium'),(19,'Austria'),(20,'Australia'),(21,'Bahrain'),(22,'Nigeria'),(23,'Atlantis'),(24,'UK')),
b AS (
 SELECT l.*, o.o_custkey, p.p_name, cu.c_nationkey,
        l.l_orderkey*31 + l.l_partkey*17 + l.l_suppkey*7 + l.l_linenumber AS h,
        row_number() OVER (ORDER BY l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_shipdate, l.l_extendedprice) - 1 AS rid
 FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN part p ON l.l_partkey=p.p_partkey JOIN customer cu ON o.o_custkey=cu.c_custkey),
r AS (
 SELECT CAST(rid AS BIGINT) AS row_id, h,
  CASE WHEN l_returnflag='R' AND h%3=0 THEN 'C' ELSE '' END || CAST(500000+l_orderkey AS STRING) AS InvoiceNo,
  CASE WHEN l_partkey%97=0 THEN 'POST' WHEN l_partkey%5=0 AND h%11=0 THEN CAST(20000+l_partkey AS STRING)||'a' WHEN l_partkey%5=0 THEN CAST(20000+l_partkey AS STRING)||'A' ELSE CAST(20000+l_partkey AS STRING) END AS StockCode,
  CASE WHEN h%211=0 THEN NULL WHEN h%7=0 THEN '  '||p_name||' ' WHEN h%13=0 THEN replace(upper(p_name),' ','   ') ELSE upper(p_name) END AS Description,
  CASE WHEN h%1999=0 THEN 0.0 WHEN h%503=0 THEN l_quantity*250 WHEN l_returnflag='R' AND h%3=0 AND h%41<>0 THEN -l_quantity WHEN h%229=0 THEN -l_quantity ELSE l_quantity END AS Quantity,
  l_shipdate AS InvoiceDate,
  CASE WHEN h%173=0 THEN 0.0 WHEN h%2503=0 THEN -1.0 ELSE round(l_extendedprice/l_quantity/100, 2) END AS UnitPrice,
  CASE WHEN o_custkey%3=0 THEN NULL ELSE 12000+o_custkey END AS CustomerID,
  c.nm AS Country
 FROM b JOIN c ON b.c_nationkey=c.k)
SELECT row_id, InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country FROM r
UNION ALL
SELECT row_id+100000000, InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country FROM r WHERE h%97=0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = RETAIL_SQL
    for name in ("lineitem", "orders", "part", "customer"):
        sql = sql.replace(f" {name} ", f" {{{name}}} ", 1)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "customer")})


def alias_headers(df: DataFrame) -> DataFrame:
    """Known headers by their canonical names, first and in canonical order; others stripped, behind them. A second
    column of one canonical name keeps its own."""
    names: dict[str, str] = {}
    for c in df.columns:
        new = HEADER_ALIASES.get(c.strip().lower(), c.strip())
        names[c] = new if new not in names.values() else c
    out = df.withColumnsRenamed(names)
    return out.select(*(f"`{c}`" for c in CANONICAL if c in out.columns), *(f"`{c}`" for c in out.columns if c not in CANONICAL))


def union_limit(frames: Iterable[DataFrame], order: list[str], n: int | None = 50_000) -> DataFrame:
    """At most n rows of each frame in a stated order (all for 0 or None), stacked, with the frame's number in _sheet."""
    out: DataFrame | None = None
    for i, df in enumerate(frames):
        part = (df.orderBy(*order).limit(n) if n else df).withColumn("_sheet", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frame")
    return out


def with_row_id(df: DataFrame) -> DataFrame:
    """row_id from 0 without gaps in file order, by counts of partitions (no task has all rows)."""
    numbered = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    counts, at, starts = dict(numbered.groupBy("_p").count().collect()), 0, []  # a row for each task of the scan
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    offsets = df.sparkSession.createDataFrame(starts, "_p int, _at long")
    inside = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(offsets), "_p").withColumn("row_id", (F.col("_at") + inside).cast("long")).drop("_p", "_i", "_at")


def load(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """A line-item table by suffix (parquet, csv, json, orc), headers aliased, in the contract's types."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix in (".xlsx", ".xls"):
        return workbook(spark, path, n)
    readers = {".parquet": lambda: spark.read.parquet(path), ".csv": lambda: spark.read.csv(path, header=True), ".json": lambda: spark.read.json(path), ".orc": lambda: spark.read.orc(path)}
    if suffix not in readers:
        raise ValueError(f"no source for {suffix or 'a path without suffix'}: {path}")
    df = alias_headers(readers[suffix]())
    if not df.columns or df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return typed(df.limit(n) if n else df)


def workbook(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """All sheets of a workbook, at most n rows of each, stacked. Sheets have a million rows at most; they are read on the
    driver by pandas, which needs a reader of its own for them (openpyxl, or xlrd for .xls)."""
    import pandas as pd

    reader = "openpyxl" if path.lower().rstrip("/").endswith("x") else "xlrd"
    if find_spec(reader) is None:  # said before the file is looked for
        raise ValueError(f"workbooks need {reader}, which isn't here; save {path} as CSV")
    sheets = pd.read_excel(path, sheet_name=None, dtype=str, nrows=n or None, engine=reader)
    frames = [alias_headers(spark.createDataFrame(x.astype(object).where(x.notna(), None), ", ".join(f"`{c}` string" for c in x.columns))) for x in sheets.values()]
    return typed(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))


def typed(df: DataFrame) -> DataFrame:
    """The contract's types, and row ids."""
    kinds = dict(x.split(" ", 1) for x in TYPES.split(", "))
    cast = [F.col(f"`{c}`") if c not in kinds else parse_date(c).alias(c) if c == "InvoiceDate" else F.expr(f"try_cast(`{c}` as {kinds[c]})").alias(c) for c in df.columns]
    return with_row_id(df.select(*cast))


def save_csv(df: DataFrame, path: str, order: str = "row_id") -> None:
    """One CSV in a stated order, for handing over; tables at scale go to Parquet."""
    df.orderBy(order).coalesce(1).write.mode("overwrite").csv(path, header=True, lineSep="\n", timestampNTZFormat="yyyy-MM-dd HH:mm:ss")


def _storage(spark: SparkSession, path: str):
    """The file system of a path, whatever its scheme, and the path in its terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _storage(spark, path)
    return fs.exists(at)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    fs, at = _storage(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def save_json(report: dict, path: str, spark: SparkSession | None = None) -> None:
    """A report, to a local path or, with a session, to any that Spark can write to."""
    text = json.dumps(report, indent=2, ensure_ascii=False, default=str)
    if spark is not None:
        save_text(spark, text, path)
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def load_json(path: str, required: tuple[str, ...] = (), columns_of: str = "") -> dict:
    """A report. Keys that must be there, and a list of rows by column that must cover the report's columns, are checked."""
    report = json.loads(Path(path).read_text(encoding="utf-8"))
    if absent := [k for k in required if k not in report]:
        raise ValueError(f"{path} has no {', '.join(absent)}")
    if columns_of:
        known = {r["column"] for r in report.get("columns", [])}
        if absent := sorted(known - {r["column"] for r in report.get(columns_of, [])}):
            raise ValueError(f"{path}: {columns_of} lacks {', '.join(absent)}")
    return report
