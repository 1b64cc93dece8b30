"""File scans and sinks. Vendor fetches are out of scope: inputs are landed files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions import scalars as S

NEWS_COLUMNS = ["headline", "ticker", "date", "source"]


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names only. Spark reads the first line, not the data."""
    return spark.read.option("header", True).csv(path).columns


def as_news(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename user columns to the standard names, add missing ones, fill nulls, add row_id."""
    df = df.withColumnsRenamed({theirs: ours for ours, theirs in mapping.items() if theirs})
    df = df.withColumns({c: F.lit("") for c in NEWS_COLUMNS if c not in df.columns}).na.fill("")
    return df.withColumn("row_id", S.row_id(F.col("ticker"), F.col("date"), F.col("headline")))


def read_news(spark: SparkSession, path: str, mapping: Mapping[str, str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, every column text. ``multiLine`` because headlines hold line breaks;
    such files are read whole, so land them as many files of a few hundred MB."""
    schema = schema or T.StructType([T.StructField(c, T.StringType()) for c in csv_columns(spark, path)])
    raw = (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return as_news(numbered(raw), mapping)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of files with a dense ``line_no`` from 1: files by name, lines in file order.

    Rows of a file get rising ids as they are read; the first id and the number of lines of
    each file, one row a file, turn them into line numbers.
    """
    rows = lines.withColumns({"_file": F.col("_metadata.file_path"), "_id": F.monotonically_increasing_id()})
    starts = rows.groupBy("_file").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(starts.withColumn("_before", before), "_file")
    return rows.withColumn("line_no", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_file", "_id", "_first", "_n", "_before")


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    (
        df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"')
        .option("quoteAll", True).option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_dated(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet by suffix, else CSV with a header; ``date`` becomes a date. A missing path raises."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.withColumn("date", F.to_date("date")) if "date" in df.columns else df


def clean_keys(df: DataFrame) -> DataFrame:
    """Constituent and fundamental files: real dates, upper-case trimmed tickers."""
    return df.withColumns({"date": F.to_date("date"), "ticker": F.upper(F.trim("ticker"))})


def typed_fundamentals(df: DataFrame) -> DataFrame:
    """Numbers where they parse, null where not; sector stays text."""
    cols = [c for c in df.columns if c not in ("date", "ticker", "sector")]
    return clean_keys(df).withColumns({c: S.safe_double(F.col(c)) for c in cols})


def long_prices(wide: DataFrame) -> DataFrame:
    """One column per ticker to one row per ticker and date; null means not listed."""
    tickers = [c for c in wide.columns if c != "date"]
    return (
        wide.unpivot("date", tickers, "ticker", "close")
        .withColumns({"ticker": F.upper(F.trim("ticker")), "date": F.to_date("date")})
        .where(F.col("close").isNotNull())
    )


def factor_returns(df: DataFrame) -> DataFrame:
    """``Date`` plus factors; cells that are not numbers become null, empty rows go."""
    factors = [c for c in df.columns if c != "Date"]
    return df.select(F.to_date("Date").alias("date"), *[S.safe_double(F.col(c)).alias(c) for c in factors]).dropna(
        "all", subset=factors
    )


def daily_bars(bars: DataFrame, end, years: int = 5, tickers: Sequence[str] | None = None) -> DataFrame:
    """Bars of the last years*365+30 days up to ``end``; the date range reaches the scan."""
    end = F.lit(end).cast("date")
    out = bars.where(F.col("date").between(F.date_sub(end, years * 365 + 30), end))
    return out.where(F.col("ticker").isin(list(tickers))) if tickers else out


def valid_symbols(df: DataFrame, column: str) -> DataFrame:
    """Index-member list: preamble lines and numeric rows fail the pattern."""
    return df.where(F.col(column).rlike("^[A-Z]{1,5}$")).select(F.col(column).alias("ticker"))


def enough(df: DataFrame, least: int, what: str) -> DataFrame:
    """Fail the job, inside Spark, where a list has fewer rows than expected."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    guard = n.where(F.col("_n") < least).select(
        F.raise_error(F.concat(F.lit(f"{what}: only "), F.col("_n").cast("string"), F.lit(" valid rows")))
        .cast("string").alias("ticker")
    )
    return df.unionByName(guard)


def union_universe(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("ticker")
    for other in lists[1:]:
        out = out.unionByName(other.select("ticker"))
    return out.select(S.normalize_ticker(F.col("ticker")).alias("ticker")).distinct()


def with_json(df: DataFrame, columns: Sequence[str], out: str = "data") -> DataFrame:
    """Typed columns to one JSON text column, at the sink only."""
    return df.withColumn(out, F.to_json(F.struct(*columns))).drop(*columns)


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Latest-state record: given sections over the defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), d) if c in df.columns else d for c, d in defaults.items()})
