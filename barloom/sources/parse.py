"""Readers and parsers for vendor files: locale price CSV, unit-suffixed volume, macro series, nested statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import locale_number, null_if_nan, slash_date, symbol_norm, unit_number

# Candidate names of the price column, first match wins.
PRICE_COLUMNS = ["Close", "Price", "Adj Close"]
# Vendor column -> panel column.
VENDOR_COLUMNS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}

STATEMENT_JSON = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("filing_date", T.StringType()),
            T.StructField("totalAssets", T.StringType()),
            T.StructField("totalRevenue", T.StringType()),
        ]
    ),
)


def read_text_csv(spark: SparkSession, path: str, null_value: str | None = None) -> DataFrame:
    """CSV with a header, every column kept as text; the byte-order mark is dropped by the reader."""
    opts = {"header": "true", "inferSchema": "false"}
    if null_value is not None:
        opts["nullValue"] = null_value
    return spark.read.options(**opts).csv(path)


def with_file_key(df: DataFrame, out: str = "code") -> DataFrame:
    """Instrument key taken from the file name of a file-per-instrument layout."""
    return df.withColumn(out, F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))


def read_file_per_key(spark: SparkSession, folder: str, fmt: str = "parquet", out: str = "code") -> DataFrame:
    """One multi-file scan of a folder; names starting with an underscore are skipped by the reader."""
    return with_file_key(spark.read.format(fmt).load(folder), out)


def day_first_flags(df: DataFrame, key: str, date: str) -> DataFrame:
    """Per file: does any first token exceed 12?"""
    first = F.split(F.trim(F.col(date)), "[/-]")[0].try_cast("int")
    return df.groupBy(key).agg(F.coalesce(F.max(first) > 12, F.lit(False)).alias("day_first"))


def price_column(columns: list[str]) -> str:
    for name in PRICE_COLUMNS:
        if name in columns:
            return name
    raise ValueError(f"no price column among {columns}")


def parse_locale_prices(raw: DataFrame, key: str = "code", date: str = "Date", order: str = "row_id", extra: dict[str, str] | None = None) -> DataFrame:
    """Text rows -> (key, date, close): bad rows dropped, last duplicate kept, prices must be positive."""
    flags = day_first_flags(raw, key, date)
    price = price_column(raw.columns)
    cols = [slash_date(date, F.col("day_first")).alias("date"), locale_number(f"`{price}`").alias("close")]
    cols += [locale_number(f"`{src}`").alias(dst) for dst, src in (extra or {}).items()]
    out = raw.join(flags, key).select(key, *cols, F.col(order)).where("date IS NOT NULL AND close IS NOT NULL")
    rest = [c for c in out.columns if c not in (key, "date", order)]
    out = out.groupBy(key, "date").agg(*[F.max_by(c, order).alias(c) for c in rest])
    checked = F.when(F.col("close") > 0, F.col("close")).otherwise(F.raise_error(F.lit("non-positive price")).cast("double"))
    return out.withColumn("close", checked)


def parse_ohlcv(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """OHLC text columns and a unit-suffixed volume; rows need all four prices."""
    out = raw.select(
        *[c for c in raw.columns if c not in names.values()],
        *[(unit_number(f"`{src}`") if dst == "volume" else locale_number(f"`{src}`")).alias(dst) for dst, src in names.items()],
    )
    return out.dropna(subset=["open", "high", "low", "close"])


def parse_macro(raw: DataFrame, date: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """First column a date, second numeric; ``.`` and other text become NULL and are dropped."""
    return raw.select(
        *(keys or []),
        F.try_to_date(F.col(date)).alias("date"),
        null_if_nan(F.col(value).try_cast("double")).alias("value"),
    ).dropna(subset=["date", "value"])


def parse_statements(raw: DataFrame, key: str, balance: str, income: str, lag_days: int = 120) -> DataFrame:
    """Two JSON maps keyed by fiscal date -> point-in-time rows; unknown filing dates get fiscal + lag."""
    b = raw.select(key, F.explode(F.map_entries(F.from_json(balance, STATEMENT_JSON))).alias("e")).select(
        key, F.to_date("e.key").alias("fiscal_date"), F.col("e.value.filing_date").alias("__f"),
        F.col("e.value.totalAssets").try_cast("double").alias("assets"),
    )
    i = raw.select(key, F.explode(F.map_entries(F.from_json(income, STATEMENT_JSON))).alias("e")).select(
        key, F.to_date("e.key").alias("fiscal_date"), F.col("e.value.totalRevenue").try_cast("double").alias("sales")
    )
    avail = F.coalesce(F.try_to_date(F.col("__f")), F.date_add("fiscal_date", lag_days))
    return b.join(i, [key, "fiscal_date"], "left").withColumn("avail_date", avail).drop("__f")


def normalise_vendor(raw: DataFrame, key: str) -> DataFrame:
    """Drop rows without any price field, rename known columns, keep only those."""
    known = {src: dst for src, dst in VENDOR_COLUMNS.items() if src in raw.columns}
    out = raw.dropna(how="all", subset=list(known))
    return out.select(symbol_norm(key).alias("code"), "date", *[F.col(f"`{s}`").alias(d) for s, d in known.items()])


def first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of symbol lists; the first list holding a code wins."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("__prio", F.lit(i))
        out = f if out is None else out.unionByName(f)
    rest = [c for c in out.columns if c not in (key, "__prio")]
    return out.groupBy(key).agg(F.min_by(F.struct(*rest), "__prio").alias("r")).select(key, "r.*")


def read_parsed_folder(spark: SparkSession, folder: str, **kw) -> DataFrame:
    """Locale price CSVs, one file per instrument, parsed to the long price table."""
    raw = with_file_key(read_text_csv(spark, folder)).withColumn("row_id", F.monotonically_increasing_id())
    return parse_locale_prices(raw, **kw)
