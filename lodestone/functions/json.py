"""Flattening of JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def infer_schema(df: DataFrame, column: str) -> T.StructType:
    """The schema that all non-null texts show; one distributed pass, without Python workers."""
    spark = df.sparkSession
    texts = df.select(F.col(column).cast("string").alias("value")).filter("value is not null")
    found = spark._jsparkSession.read().json(getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())).schema()
    schema = T._parse_datatype_json_string(found.json())
    return T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])


def flatten(df: DataFrame, column: str, schema: T.StructType | str | None = None, prefix: str | None = None, deep: bool = True, explode_arrays: bool = False, keep: bool = False) -> DataFrame:
    """df with a column for each field of a JSON column, nested ones too, and ``{column}_corrupt`` for text that is no JSON.

    Malformed and null text gives nulls. Arrays become rows with ``explode_arrays``; empty ones keep their row.
    """
    given = T._parse_datatype_string(schema) if isinstance(schema, str) else schema or infer_schema(df, column)
    prefix = f"{column}_" if prefix is None else prefix
    text = F.col(column).cast("string")
    parsed = F.from_json(text, given) if len(given.fields) else None
    out = df.withColumn("__j", parsed if parsed is not None else F.lit(None))
    leaves: list[tuple[str, Column, T.DataType]] = []

    def walk(at: Column, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType) and deep:
            for f in kind.fields:
                walk(at[f.name], f"{name}{'_' if name else ''}{f.name}", f.dataType)
        else:
            leaves.append((prefix + name, at, kind))

    for f in given.fields:
        walk(F.col("__j")[f.name], f.name, f.dataType)
    clash = {n for n, _, _ in leaves} & set(df.columns)
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    corrupt = text.isNotNull() & F.try_parse_json(text).isNull()
    out = out.select(*(c for c in df.columns if keep or c != column), *(c.alias(n) for n, c, _ in leaves), corrupt.alias(f"{column}_corrupt"))
    if explode_arrays:
        for n, _, kind in leaves:
            if isinstance(kind, T.ArrayType):
                out = out.withColumn(n, F.explode_outer(n))
    return out


def for_export(df: DataFrame) -> DataFrame:
    """All columns as text: binary in base64, structs, arrays and maps as JSON, null and NaN as the empty string."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            t = F.base64(c)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            t = F.to_json(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            t = F.when(~F.isnan(c), c.cast("string"))
        else:
            t = c.cast("string")
        out.append(F.coalesce(t, F.lit("")).alias(f.name))
    return df.select(*out)
