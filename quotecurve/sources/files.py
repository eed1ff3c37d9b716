"""Read sales and product files from a folder, write results and report records."""

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import lenient_date
from ..functions.money import MONEY
from ..functions.numeric import nonneg
from ..session import discard, materialise

# File name patterns of the two inputs, unless others are given.
SALES_GLOB = "*sales*"
PRODUCT_GLOB = "*product*"

MAX_HEADERS = 100  # different headers that one folder may hold
BAD_SCHEMA = "source_file string, line string, reason string"

SALES_COLUMNS = ["item_id", "order_date", "price", "shipped_units", "event_name", "deal_discount_percent"]
PRODUCT_COLUMNS = ["item_id", "tag", "variation", "current_price"]


def clean_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case all column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def _read(spark: SparkSession, folder: str, glob: str, file_format: str) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", glob)
    if file_format == "csv":
        # every column as text; types are coerced leniently below
        return clean_columns(reader.option("header", True).csv(folder))
    return clean_columns(reader.format(file_format).load(folder))


def coerce_sales(df: DataFrame) -> DataFrame:
    """Typed sales: unreadable prices and units count as 0, unreadable dates as missing."""
    df = require_columns(clean_columns(df), SALES_COLUMNS, "sales")
    return df.select(
        F.col("item_id").cast("string").alias("item_id"),
        lenient_date(F.col("order_date")).alias("order_date"),
        nonneg(F.col("price")).cast(MONEY).alias("price"),
        F.round(nonneg(F.col("shipped_units"))).cast("bigint").alias("shipped_units"),
        F.col("event_name").cast("string").alias("event_name"),
        F.col("deal_discount_percent").try_cast("double").alias("deal_discount_percent"),
    )


def coerce_products(df: DataFrame) -> DataFrame:
    df = require_columns(clean_columns(df), ["item_id"], "products")
    text = [
        (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c)
        for c in ("tag", "variation")
    ]
    price = F.col("current_price").try_cast(MONEY) if "current_price" in df.columns else F.lit(None).cast(MONEY)
    return df.select(F.col("item_id").cast("string").alias("item_id"), *text, price.alias("current_price"))


def read_sales(spark: SparkSession, folder: str, file_format: str = "csv", pattern: str = SALES_GLOB) -> DataFrame:
    return coerce_sales(_read(spark, folder, pattern, file_format))


def read_products(spark: SparkSession, folder: str, file_format: str = "csv", pattern: str = PRODUCT_GLOB) -> DataFrame:
    return coerce_products(_read(spark, folder, pattern, file_format))


def write_sales(
    df: DataFrame, path: str, file_format: str = "parquet", mode: str = "overwrite", window: tuple[str, str] | None = None
) -> None:
    """Result sink, one folder for each order month so a look-back window prunes files.

    Overwriting replaces the sales of a run's `window` (first and last day; those of `df` if not given) and
    nothing else: months outside stay as they are, and rows of the outer months that lie outside the window
    are carried over. Rows without a date are replaced as a month of their own. A run can be repeated. Rows
    are rebalanced by month: adaptive execution joins small months and splits large ones.
    """
    spark = df.sparkSession
    out = df.withColumn("order_month", F.date_format("order_date", "yyyy-MM"))
    kept = None
    if mode == "overwrite" and _exists(spark, path):
        if window is None:
            ends = out.agg(F.min("order_date").cast("string").alias("a"), F.max("order_date").cast("string").alias("b")).first()
            window = (ends["a"], ends["b"])
        if window[0] is not None:
            first, last = (F.lit(d).cast("date") for d in window)
            outer = F.col("order_month").isin(*{d[:7] for d in window})
            reader = spark.read.schema(out.schema)
            reader = reader.option("header", True) if file_format == "csv" else reader
            before = reader.format(file_format).load(path).where(outer & ~F.col("order_date").between(first, last))
            kept = materialise(before.select(*out.columns), "kept")  # written apart: its files are about to be replaced
            gone = spark.sql(f"SELECT explode(sequence(date_trunc('month', DATE '{window[0]}'), DATE '{window[1]}', INTERVAL 1 MONTH)) AS m")
            months = [r["m"].strftime("%Y-%m") for r in gone.collect()]  # months of one run's window
            present = out.unionByName(kept).select("order_month").distinct()
            for month in set(months) - {r["order_month"] for r in present.where(F.col("order_month").isin(*months)).collect()}:
                discard(spark, f"{path}/order_month={month}")  # sold then in an earlier run, no longer
    both = out.unionByName(kept) if kept is not None else out
    writer = both.hint("rebalance", "order_month").write.mode(mode).partitionBy("order_month")
    writer = writer.option("partitionOverwriteMode", "dynamic")
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _named_lines(spark: SparkSession, folder: str, pattern: str) -> tuple[DataFrame, list[list[str]]]:
    """Lines (file, line, kind) of all files but their headers; `kind` numbers the header the file has."""
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .text(folder)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
        .withColumn("at", F.monotonically_increasing_id())
    )
    # a file's first line is the first one read of its first block
    heads = lines.where("start = 0 and trim(line) <> ''").groupBy("file").agg(F.min_by("line", "at").alias("head"))
    kinds = sorted(r["head"] for r in heads.select("head").distinct().limit(MAX_HEADERS + 1).collect())
    if len(kinds) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers in {folder}")
    # the byte order mark some writers put first is no part of a name
    names = [[c.strip().lower() for c in next(csv.reader([k.lstrip("\ufeff")]))] for k in kinds]
    for header in names:
        if len(set(header)) < len(header):
            raise ValueError(f"a column name occurs twice: {header}")
    kind = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("head")).cast("int") - 1 if kinds else F.lit(None).cast("int")
    placed = lines.join(heads, "file").where("line <> head and trim(line) <> ''").select("file", "line", kind.alias("kind"))
    return placed, names


def read_loose(spark: SparkSession, folder: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of all CSV files that match: each file is read by its own header.

    Files are grouped by header and united by column name (trimmed, lower case; a column that a file lacks
    is null there), every column a text, with `source_file`. Lines with too few or too many fields go to
    the second frame (source_file, line, reason). A record is one line; a line equal to its file's header
    and blank lines are left out. No files give a frame without rows.
    """
    lines, headers = _named_lines(spark, folder, pattern)
    columns = list(dict.fromkeys(c for h in headers for c in h))
    schema = ", ".join(f"`{c}` string" for c in [*columns, "source_file"])
    rows, bad = None, spark.createDataFrame([], BAD_SCHEMA)
    for k, header in enumerate(headers):
        fields = ", ".join(f"`{c}` string" for c in header) + ", `_corrupt` string"
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        parsed = lines.where(F.col("kind") == k).select("file", "line", F.from_csv("line", fields, options).alias("v"))
        broken = F.col("v._corrupt").isNotNull()
        shown = [(F.col(f"v.`{c}`") if c in header else F.lit(None).cast("string")).alias(c) for c in columns]
        good = parsed.where(~broken).select(*shown, F.col("file").alias("source_file"))
        rows = good if rows is None else rows.unionByName(good)
        bad = bad.unionByName(parsed.where(broken).select(F.col("file").alias("source_file"), "line", F.lit("fields").alias("reason")))
    return rows if rows is not None else spark.createDataFrame([], schema), bad


def read_sales_files(spark: SparkSession, folder: str, pattern: str = SALES_GLOB) -> tuple[DataFrame, DataFrame]:
    """(sales, bad lines): sales with readable dates, prices and units; the rest kept aside with a reason."""
    rows, bad = read_loose(spark, folder, pattern)
    rows = require_columns(rows, SALES_COLUMNS, "sales")
    amount = lambda c: F.col(c).try_cast("double")
    unread = lambda value, c: value.isNull() & F.col(c).isNotNull()
    reason = (
        F.when(unread(lenient_date(F.col("order_date")), "order_date"), "order_date")
        .when(unread(amount("price"), "price") | (amount("price") < 0), "price")
        .when(unread(amount("shipped_units"), "shipped_units") | (amount("shipped_units") < 0), "shipped_units")
        .when(unread(amount("deal_discount_percent"), "deal_discount_percent"), "deal_discount_percent")
    )
    judged = rows.withColumn("reason", reason)
    line = F.to_csv(F.struct(*SALES_COLUMNS))
    aside = judged.where("reason is not null").select("source_file", line.alias("line"), "reason")
    return coerce_sales(judged.where("reason is null")), bad.unionByName(aside)


def read_product_files(spark: SparkSession, folder: str, pattern: str = PRODUCT_GLOB) -> tuple[DataFrame, DataFrame]:
    """(products, bad lines) of all product files, united by column name."""
    rows, bad = read_loose(spark, folder, pattern)
    return coerce_products(rows), bad


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report rows as JSON records."""
    df.write.mode(mode).json(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Name an intermediate frame for SQL users; nothing is materialised."""
    df.createOrReplaceTempView(name)
    return df
