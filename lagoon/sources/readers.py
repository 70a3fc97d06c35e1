"""CSV sources. Columns are parsed by expressions, so pruning and pushdown reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = "yyyy-MM-dd HH:mm:ss"
TRIP_FORMAT = "M/d/yyyy H:mm:ss"


def _cells(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """line cells, trimmed; trailing empty cells stay."""
    lines = spark.read.text(path)
    return lines.select(F.transform(F.split("value", _quoted(sep), -1), lambda x: F.trim(x)).alias("c"))


def _quoted(sep: str) -> str:
    return "".join("\\" + x if x in r"\.[]{}()*+-?^$|" else x for x in sep)


def _number(x: Column) -> Column:
    return x.try_cast("double")


def read_temporal_csv(spark: SparkSession, path: str | list[str], index_col: int = 0, fmt: str = FORMAT, sep: str = ",", replace_na: float = 0.0) -> tuple[DataFrame, int]:
    """(ts, v) and the number of values in v. Lines without a parsable time go (so does a header), other cells that are no numbers become replace_na, lines of another width than the first one go."""
    cells = _cells(spark, path, sep)
    first = spark.read.text(path).limit(1).select(F.size(F.split("value", _quoted(sep), -1))).first()
    dims = (first[0] if first else 1) - 1
    rest = F.filter(F.transform("c", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["i"] != index_col)
    values = F.transform(rest, lambda s: F.coalesce(_number(s["x"]), F.lit(float(replace_na))))
    out = cells.select(F.try_to_timestamp(F.get("c", F.lit(index_col)), F.lit(fmt)).alias("ts"), values.alias("v"))
    return out.where(F.col("ts").isNotNull() & (F.size("v") == dims)), dims


def read_geo_csv(spark: SparkSession, path: str | list[str], time_col: int = 0, lon_col: int = 1, lat_col: int = 2, fmt: str = FORMAT, sep: str = ",") -> tuple[DataFrame, int]:
    """(ts, lon, lat, v) and the number of values in v. Strict: a line with a cell that doesn't parse goes. The width is that of the first line."""
    cells = _cells(spark, path, sep)
    first = spark.read.text(path).limit(1).select(F.size(F.split("value", _quoted(sep), -1))).first()
    dims = max(0, (first[0] if first else 3) - 3)
    used = F.array(*[F.lit(x) for x in (time_col, lon_col, lat_col)])
    rest = F.filter(F.transform("c", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(used, s["i"]))
    out = cells.select(
        F.try_to_timestamp(F.get("c", F.lit(time_col)), F.lit(fmt)).alias("ts"),
        _number(F.get("c", F.lit(lon_col))).alias("lon"),
        _number(F.get("c", F.lit(lat_col))).alias("lat"),
        F.transform(rest, lambda s: _number(s["x"])).alias("v"),
    )
    return out.where("ts is not null and lon is not null and lat is not null and not exists(v, x -> x is null)").where(F.size("v") == dims), dims


def read_csv(spark: SparkSession, path: str | list[str], header: bool = True, schema=None, sep: str = ",") -> DataFrame:
    """A generic table; all strings unless a schema is given."""
    reader = spark.read.option("header", header).option("sep", sep)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_trips(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ts, lat, lon, base of monthly trip files with one layout, bound by rows."""
    raw = read_csv(spark, paths, True, "Timestamp string, Lat double, Lon double, Base string")
    return raw.select(F.try_to_timestamp("Timestamp", F.lit(TRIP_FORMAT)).alias("ts"), F.col("Lat").alias("lat"), F.col("Lon").alias("lon"), F.col("Base").alias("base"))


def read_detectors(spark: SparkSession, path: str | list[str], lanes: int = 8) -> DataFrame:
    """ts, station, flow_1.., occ_1.. of loop-detector files."""
    fields = [T.StructField("ts", T.TimestampType()), T.StructField("station", T.StringType())]
    fields += [T.StructField(f"{x}_{i}", T.DoubleType()) for x in ("flow", "occ") for i in range(1, lanes + 1)]
    return spark.read.option("header", True).option("timestampFormat", TRIP_FORMAT).schema(T.StructType(fields)).csv(path)


def described(df: DataFrame) -> DataFrame:
    """count, mean, stddev, min, quartiles and max of the numeric columns."""
    return df.summary()
