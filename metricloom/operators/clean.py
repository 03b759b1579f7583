"""Projection, filtering, cleaning and encoding of wide metric frames."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.scalars import filled, numeric_columns, present, q, string_columns
from metricloom.operators.ranking import ordinal_codes, running



def column_list(spec: str | Iterable[str]) -> list[str]:
    """A column list, also as one ``a;b;c`` string."""
    return spec.split(";") if isinstance(spec, str) else list(spec)


def row_bounds(spec: str | Mapping[str, float]) -> dict[str, float]:
    """Row bounds ``ld`` and ``gd``, also as one ``ld:..;gd:..`` string."""
    if isinstance(spec, str):
        return {k: float(v) for k, v in (part.split(":") for part in spec.split(";"))}
    return dict(spec)


def filter_columns(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    """Keep the listed columns in the listed order."""
    known = [c for c in column_list(columns) if c in df.columns]
    if not known:
        raise ValueError("none of the listed columns exists")
    return df.select(*[q(c) for c in known])


def filter_rows(df: DataFrame, ld: float = 0, gd: float = 0, time: str = "time") -> DataFrame:
    """Rows strictly between ``gd`` and ``ld``; a bound of 0 is no bound."""
    if ld:
        df = df.where(q(time) < ld)
    if gd:
        df = df.where(q(time) > gd)
    return df


def drop_columns(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    unwanted = set(column_list(columns))
    return df.select(*[q(c) for c in df.columns if c not in unwanted])


def filter_wildcard(df: DataFrame, pattern: str, keep: bool = False) -> DataFrame:
    """Drop, or keep, the columns whose name contains a match of ``pattern``."""
    hit = re.compile(pattern).search
    return df.select(*[q(c) for c in df.columns if bool(hit(c)) == keep])


def drop_low_variance(df: DataFrame) -> DataFrame:
    """Drop columns with exactly one distinct value; all-null columns stay."""
    if not df.columns:
        return df
    cells = [present(df, c) for c in df.columns]
    row = df.agg(
        *[(F.min(c) == F.max(c)).alias(f"single{i}") for i, c in enumerate(cells)]
    ).first()
    return df.select(*[q(c) for i, c in enumerate(df.columns) if not row[f"single{i}"]])


def fill_missing(df: DataFrame) -> DataFrame:
    """Nulls and NaN become 0 in every numeric or string column."""
    return filled(df, 0, "0")


def drop_missing_columns(df: DataFrame, how: str = "all") -> DataFrame:
    """Drop columns that are entirely (``all``) or partly (``any``) missing."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    ).first()
    least = {"all": 1, "any": row["rows"]}[how]
    return df.select(*[q(c) for i, c in enumerate(df.columns) if row[f"n{i}"] >= least])


def drop_null_rows(df: DataFrame) -> DataFrame:
    for name in df.columns:
        df = df.where(present(df, name).isNotNull())
    return df


def variance_threshold(
    df: DataFrame, t: float = 0.8, keep: Iterable[str] = ("time",)
) -> DataFrame:
    """Keep numeric columns whose population variance exceeds ``t * (1 - t)``."""
    kept = list(keep)
    names = numeric_columns(df, exclude=tuple(kept))
    row = df.agg(*[F.var_pop(q(c)).alias(f"v{i}") for i, c in enumerate(names)]).first()
    wide = {c for i, c in enumerate(names) if (row[f"v{i}"] or 0.0) > t * (1 - t)}
    return df.select(*[q(c) for c in df.columns if c in wide or c in kept])


def split_target(df: DataFrame, target: str | None = None) -> tuple[list[str], str]:
    """Feature names and target name; the last column is the target by default."""
    target = target or df.columns[-1]
    return [c for c in df.columns if c != target], target


def one_hot(
    df: DataFrame, columns: Iterable[str] | None = None, replace: bool = True
) -> DataFrame:
    """0/1 columns ``column=value`` for every value of the string columns."""
    columns = list(columns) if columns is not None else string_columns(df)
    made: dict[str, Column] = {}
    # Every value becomes a column, so the values are as many as the plan is to have columns.
    found = distinct_values(df, {name: q(name) for name in columns}).collect() if columns else []
    for name, value in sorted(tuple(r) for r in found):
        made[f"{name}={value}"] = (q(name).cast("string") == F.lit(value)).eqNullSafe(F.lit(True)).cast("double")
    kept = [c for c in df.columns if not (replace and c in columns)]
    return df.select(*[q(c) for c in kept], *[made[m].alias(m) for m in sorted(made)])


def distinct_values(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, value): the distinct non-null values of all columns, as text, in one pass."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), c.cast("string").alias("value")) for n, c in columns.items()
    ]))
    return df.select(cells.alias("cell")).select("cell.*").where("value IS NOT NULL").distinct()


def ordinal_encode(df: DataFrame, column: str, code: str | None = None) -> DataFrame:
    """Replace values by their 0-based rank among the sorted distinct values."""
    return _attach_codes(df, ordinal_codes(df, column, "_code"), column, code)


def factorize(
    df: DataFrame, column: str, order: str, code: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Codes by first appearance along the unique ``order``; frame and definitions."""
    firsts = df.where(q(column).isNotNull()).groupBy(q(column)).agg(
        F.min(q(order)).alias("_first")
    )
    codes = running(firsts, ["_first"], {"_code": F.lit(1).cast("long")})
    codes = codes.select(q(column), (F.col("_code") - 1).alias("_code"))
    return (
        _attach_codes(df, codes, column, code),
        codes.select(F.col("_code").alias("code"), q(column).alias("value")),
    )


def _attach_codes(df: DataFrame, codes: DataFrame, column: str, code: str | None) -> DataFrame:
    lookup = codes.select(q(column).alias("_value"), F.col("_code"))
    joined = df.join(lookup, q(column) == F.col("_value"), "left")
    name = code or column
    kept = [c for c in df.columns if c != name]
    return joined.select(*[q(c) for c in kept], F.col("_code").alias(name))


def binarize_target(
    df: DataFrame, column: str, normal: str = "None", target: str = "target"
) -> DataFrame:
    """1 for the normal class, -1 for every other."""
    return df.withColumn(target, F.when(q(column) == normal, 1).otherwise(-1))


def remap_classes(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    value = q(column)
    new = F.coalesce(
        *[F.when(value == old, F.lit(to)) for old, to in mapping.items()], value
    )
    return df.withColumn(column, new)


def drop_classes(df: DataFrame, column: str, classes: Iterable[str]) -> DataFrame:
    """Rows whose class is not listed; rows without a class stay."""
    return df.where(~F.coalesce(q(column).isin(list(classes)), F.lit(False)))


def distinct_terms(df: DataFrame, host: str, term: str) -> DataFrame:
    """One row per host and term."""
    return df.select(q(host), q(term)).distinct()


def stored_range(
    df: DataFrame, ts: str, gte: float | None = None, lte: float | None = None, date: str | None = None
) -> DataFrame:
    """Rows of an inclusive range of epoch seconds, as bounds on the column as it is stored.

    Bounds on a computed time are checked row by row; these reach the files, whose statistics rule
    out what lies outside. ``date`` names a partition column of UTC days (dates or their ISO
    text), whose other folders are then not even listed. ``ts`` may be a timestamp with or without
    zone (then in UTC), a date, or a number of seconds. Rows without a time are left out by a bound.
    """
    kind = df.schema[ts].dataType
    for seconds, side in ((gte, 1), (lte, -1)):
        if seconds is None:
            continue
        # The bound in whole microseconds that lies inside the range.
        micros = -math.floor(-seconds * 1e6) if side > 0 else math.floor(seconds * 1e6)
        at = datetime(1970, 1, 1) + timedelta(microseconds=micros)
        if isinstance(kind, T.TimestampNTZType):
            bound = F.lit(at.isoformat(" ")).cast("timestamp_ntz")
        elif isinstance(kind, T.TimestampType):
            bound = F.timestamp_micros(F.lit(micros))
        elif isinstance(kind, T.DateType):
            # A day counts as its first instant.
            bound = F.lit((at if side < 0 or at == datetime(at.year, at.month, at.day) else at + timedelta(days=1)).date())
        elif isinstance(kind, T.IntegralType):
            bound = F.lit(math.ceil(seconds) if side > 0 else math.floor(seconds))
        else:
            bound = F.lit(seconds)
        df = df.where(q(ts) >= bound if side > 0 else q(ts) <= bound)
        if date is not None:
            day = F.lit(at.date() if isinstance(df.schema[date].dataType, T.DateType) else at.date().isoformat())
            df = df.where(q(date) >= day if side > 0 else q(date) <= day)
    return df


def term_query(
    df: DataFrame,
    terms: Mapping[str, object],
    time: str | None = None,
    gte: object = None,
    lte: object = None,
) -> DataFrame:
    """All terms must match; the time range is inclusive."""
    for name, value in terms.items():
        df = df.where(q(name) == F.lit(value))
    if time is not None:
        if gte is not None:
            df = df.where(q(time) >= F.lit(gte))
        if lte is not None:
            df = df.where(q(time) <= F.lit(lte))
    return df


def augment(df: DataFrame, method: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user-defined augmentation."""
    return df.transform(method)


def add_columns(
    columns: tuple[str | None, str | None] = (None, None), column_name: str | None = None
) -> Callable[[DataFrame], DataFrame]:
    """Augmentation that adds two columns; without columns it changes nothing."""

    def method(df: DataFrame) -> DataFrame:
        if columns[0] is None:
            return df
        return df.withColumn(column_name, q(columns[0]) + q(columns[1]))

    return method
