"""Type maps, typed casts and schema alignment between landing and gold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source type -> (landing type, gold type). NUMBER follows its precision and scale.
TYPE_MAP = {
    "VARCHAR2": ("string", "string"),
    "NVARCHAR2": ("string", "string"),
    "CHAR": ("string", "string"),
    "ROWID": ("string", "string"),
    "BINARY_FLOAT": ("float", "float"),
    "BINARY_DOUBLE": ("double", "double"),
    "DATE": ("string", "timestamp_ntz"),
    "TIMESTAMP": ("string", "timestamp_ntz"),
}


def _mapped(base: Column, which: int) -> Column:
    """The mapped type of ``base`` as a lookup in a literal map; unknown types become text."""
    pairs = [F.lit(x) for k, v in TYPE_MAP.items() for x in (k, v[which])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), base), F.lit("string"))


def type_map(columns: DataFrame) -> DataFrame:
    """Landing and gold type of every column.

    ``columns`` holds COLUMN_NAME, DATA_TYPE, DATA_PRECISION and DATA_SCALE.
    Types are cut at the first character that is neither letter nor digit,
    save the underscore of the two binary types; unknown types become text.
    """
    base = F.regexp_extract("DATA_TYPE", "^(BINARY_FLOAT|BINARY_DOUBLE|[A-Za-z0-9]*)", 0)
    scale = F.coalesce("DATA_SCALE", F.lit(0))
    precision = F.coalesce("DATA_PRECISION", F.lit(38))
    number = (
        F.when(scale > 0, F.concat(F.lit("decimal("), precision, F.lit(","), scale, F.lit(")")))
        .when(precision < 10, F.lit("int"))
        .when(precision <= 18, F.lit("bigint"))
        .otherwise(F.concat(F.lit("decimal("), precision, F.lit(",0)")))
    )
    return columns.select(
        "*",
        F.when(base == "NUMBER", number).otherwise(_mapped(base, 0)).alias("landing_type"),
        F.when(base == "NUMBER", number).otherwise(_mapped(base, 1)).alias("gold_type"),
    )


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Every named column as its type, in the order of ``types``; unreadable values become NULL."""
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def cast_for_append(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """As ``cast_columns``, but columns that already have their gold type pass as they are."""
    have = {f.name.upper(): f.dataType.simpleString() for f in df.schema}
    return df.select(
        *[
            F.col(c).alias(c) if have[c.upper()] == t else F.col(c).try_cast(t).alias(c)
            for c, t in types.items()
        ]
    )


def cast_failures(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Per column, how many non-NULL values the cast cannot read; one pass."""
    counts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias("failed"),
        )
        for c, t in types.items()
    ]
    return df.agg(F.array(*counts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


class SchemaMismatch(ValueError):
    """Gold has columns that landing lacks, and filling them is not allowed."""


def align(
    landing: DataFrame, gold: T.StructType, fill_null: bool = False, allowed_fraction: float = 0.5
) -> DataFrame:
    """Landing rows with gold's columns, types and order.

    Extra landing columns are dropped. Columns landing lacks are an error,
    unless ``fill_null`` and the columns not shared are few against those shared.
    """
    have = {c.upper(): c for c in landing.columns}
    want = {f.name.upper() for f in gold}
    missing = want - set(have)
    if missing:
        shared = len(want & set(have))
        apart = len(want ^ set(have))
        if not fill_null or shared == 0 or apart / shared >= allowed_fraction:
            raise SchemaMismatch(f"landing lacks {sorted(missing)}")
    out: list[Column] = []
    for f in gold:
        found = have.get(f.name.upper())
        value = F.col(found).try_cast(f.dataType) if found else F.lit(None).cast(f.dataType)
        out.append(value.alias(f.name))
    return landing.select(*out)
