"""Column expressions shared by the operators. All are JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> Column:
    """A column by its exact name; series names hold dots and colons."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(q(name)), q(name))
    return q(name)


def filled(df: DataFrame, number: object, text: str) -> DataFrame:
    """Missing numbers and strings replaced; names may hold any character."""

    def cell(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.NumericType):
            return F.coalesce(present(df, field.name), F.lit(number).cast(field.dataType))
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(q(field.name), F.lit(text))
        return q(field.name)

    return df.select(*[cell(f).alias(f.name) for f in df.schema.fields])


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ("time",)) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def epoch_seconds(ts: Column) -> Column:
    """Unix seconds with microseconds kept, as a double."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def time_bucket(seconds: Column, width: int, offset: int = 0) -> Column:
    """Start of the bucket of ``width`` seconds that holds a numeric time."""
    return (F.floor((seconds - F.lit(offset)) / F.lit(width)) * F.lit(width) + F.lit(offset)).cast(
        "long"
    )


def human_time(epoch: Column) -> Column:
    """Readable time of an epoch number: milliseconds, or seconds if those give 1970."""
    as_millis = F.timestamp_millis(epoch.cast("long"))
    as_seconds = F.timestamp_seconds(epoch.cast("long"))
    chosen = F.when(F.year(as_millis) == 1970, as_seconds).otherwise(as_millis)
    return F.date_format(chosen, "yyyy-MM-dd HH:mm:ss")


def duration_seconds(text: Column) -> Column:
    """``10s``, ``5m``, ``1h`` in seconds; anything else is 0."""
    number = F.regexp_extract(text, r"^([+-]?\d+)[smh]$", 1)
    unit = F.right(text, F.lit(1))
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600)
    return F.coalesce(
        F.when(number != "", number).try_cast("long") * factor, F.lit(0)
    ).cast("long")


def seconds_of(text: str) -> int:
    """``duration_seconds`` for a driver-side option."""
    factor = {"s": 1, "m": 60, "h": 3600}.get(text[-1:])
    return int(text[:-1]) * factor if factor else 0


def parse_thresholds(text: Column) -> Column:
    """``metric:bound:value;…`` as an array of rules; blank or ``default`` gives null."""
    parts = F.transform(F.split(text, ";"), lambda rule: F.split(rule, ":"))
    rules = F.transform(
        parts,
        lambda p: F.struct(
            p[0].alias("metric"),
            p[1].alias("bound"),
            p[2].try_cast("double").alias("threshold"),
        ),
    )
    blank = text.isNull() | text.isin("default", "", " ")
    return F.when(~blank, rules)


def decode_one_hot(flags: Column) -> Column:
    """Index of the first 1.0 in an array, 0 where there is none."""
    found = F.coalesce(F.array_position(flags, F.lit(1.0)), F.lit(0))
    return F.greatest(found - 1, F.lit(0)).cast("long")


def series_name(metric: Column, device: Column, instance: Column) -> Column:
    """``metric_device_instance``, without the device where there is none."""
    return F.concat_ws("_", metric, device, instance)


def nominal_text(text: Column) -> Column:
    """Runs of other than letters and digits become ``_``; missing becomes ``?``."""
    return F.coalesce(
        F.when(text == "?", text).otherwise(F.regexp_replace(text, "[^A-Za-z0-9]+", "_")),
        F.lit("?"),
    )


def row_mean(columns: list[Column]) -> Column:
    given = _given(columns)
    return F.when(F.size(given) > 0, _total(given) / F.size(given))


def row_std(columns: list[Column]) -> Column:
    """Sample standard deviation over one row; null for fewer than two values."""
    given = _given(columns)
    count = F.size(given)
    mean = _total(given) / count
    squares = F.aggregate(
        F.transform(given, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x
    )
    return F.when(count > 1, F.sqrt(squares / (count - 1)))


def row_median(columns: list[Column]) -> Column:
    ordered = F.array_sort(_given(columns))
    count = F.size(ordered)
    low = F.element_at(ordered, ((count + 1) / 2).cast("int"))
    high = F.element_at(ordered, (count / 2).cast("int") + 1)
    return F.when(count > 0, (low + high) / 2)


def _given(columns: list[Column]) -> Column:
    return F.filter(
        F.array(*[c.cast("double") for c in columns]), lambda x: x.isNotNull() & ~F.isnan(x)
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
