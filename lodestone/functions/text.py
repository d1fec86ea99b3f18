"""Strings, names, addresses, and deterministic identifiers."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unquote(c: Column | str) -> Column:
    """Trimmed, and without one pair of equal quotes around it; null gives the empty string."""
    t = F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), r"^\s+|\s+$", "")
    quoted = (F.length(t) >= 2) & (F.substring(t, 1, 1) == F.substring(t, -1, 1)) & F.substring(t, 1, 1).isin("'", '"')
    return F.when(quoted, F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"^\s+|\s+$", "")).otherwise(t)


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends; null gives the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), r"\s+", " "))


def clean(c: Column | str) -> Column:
    return squeeze(unquote(c))


def snake_case(c: Column | str) -> Column:
    """Blanks and hyphens as underscores, words parted where a capital follows a small letter or digit, in lower case."""
    t = F.regexp_replace(F.regexp_replace(_c(c), r"[\s-]+", "_"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.lower(t), "_+", "_")


def alphanumeric(c: Column | str, keep: str = "") -> Column:
    """Only ASCII letters, digits, and the characters of ``keep``."""
    extra = "".join("\\" + x if not x.isalnum() else x for x in keep)
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"[^A-Za-z0-9{extra}]", "")


@F.pandas_udf(T.StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    """Decomposed, without marks and punctuation, case-folded and squeezed. Spark has no decomposition, hence Arrow batches."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
        return " ".join("".join(c if c.isalnum() or c.isspace() else "" if unicodedata.category(c)[0] == "P" else c for c in t).split())

    return names.map(one)


def sanitised(df: DataFrame) -> DataFrame:
    """Column names in lower case, trimmed, with blanks and slashes as underscores; two that become one raise."""
    names = [c.strip().lower().replace("/", "_").replace(" ", "_") for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names become equal: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def to_front(df: DataFrame, column: str) -> DataFrame:
    return df.select(column, *(F.col(f"`{c}`") for c in df.columns if c != column))


def address(*parts: Column | str) -> Column:
    """The parts that aren't empty, with commas."""
    return F.concat_ws(", ", *(F.nullif(F.trim(_c(p)), F.lit("")) for p in parts))


def address_hash(c: Column | str) -> Column:
    return F.sha2(F.lower(squeeze(c)), 256)


def _hex_to_uuid(h: Column) -> Column:
    """The first 32 digits of a SHA-1 as a UUID of version 5."""
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def uuid5(namespace: str | uuid.UUID, seed: Column | str) -> Column:
    """UUIDv5 of a namespace and a seed; null for a blank seed."""
    s = _c(seed).cast("string")
    space = F.unhex(F.lit(uuid.UUID(str(namespace)).hex))
    return F.when(F.trim(s) != "", _hex_to_uuid(F.sha1(F.concat(space, F.encode(s, "UTF-8")))))


def attestation(namespace: str | uuid.UUID, *parts: Column | str) -> Column:
    """UUIDv5 of parts joined by the record separator; null if one is blank or null."""
    given = [_c(p).cast("string") for p in parts]
    ok = F.lit(True)
    for g in given:
        ok = ok & g.isNotNull() & (F.trim(g) != "")
    return F.when(ok, uuid5(namespace, F.concat_ws("\x1e", *given)))


def root_namespace(seed: str) -> uuid.UUID:
    """A namespace of its own for a seed, on the driver."""
    if not seed.strip():
        raise ValueError("a namespace needs a seed")
    return uuid.uuid5(uuid.NAMESPACE_DNS, seed)


def sub_namespace(root: uuid.UUID | str, name: str) -> uuid.UUID:
    if not name.strip():
        raise ValueError("a namespace needs a name")
    return uuid.uuid5(uuid.UUID(str(root)), name)


def token_score(a: Column | str, b: Column | str) -> Column:
    """Common words over the larger number of distinct words, in lower case, to three places."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(_c(c)), r"\s+"), lambda x: x != ""))
    x, y = words(a), words(b)
    return F.coalesce(F.round(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(x), F.size(y)).cast("double")), 3), F.lit(0.0))


def fuzzy_match(df: DataFrame, text: str, candidates: DataFrame, title: str, threshold: float = 0.3) -> DataFrame:
    """Pairs of texts and titles with a score of at least the threshold.

    A score above 0 takes a common word, so the two sides meet on words; no pair without one is looked at.
    """
    def words(d: DataFrame, c: str) -> DataFrame:
        return d.select("*", F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))).alias("__w"))

    met = words(df, text).join(words(candidates, title), "__w").drop("__w").distinct()
    return met.withColumn("score", token_score(text, title)).filter(F.col("score") >= threshold)


def file_digests(spark, path: str, algorithm: str = "sha256") -> DataFrame:
    """path, size, modification time and digest of files."""
    h = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "sha1": F.sha1, "md5": F.md5}[algorithm]
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), "modificationTime", h(F.col("content")).alias("digest"))


def joined_codes(parts: Sequence[tuple[Column | str, int]]) -> Column:
    """Parts padded with zeros to their lengths, in one code; null if one is null."""
    return F.concat(*(pad(p, n) for p, n in parts))


def pad(c: Column | str, n: int) -> Column:
    """Zeros before a shorter value; longer ones stay whole."""
    t = F.trim(_c(c).cast("string"))
    return F.when(F.length(t) < n, F.lpad(t, n, "0")).otherwise(t)


def named(code: Column | str, names: dict[str, str]) -> Column:
    """The name of a code, in any case, by a table given; a code without one stays."""
    m = F.create_map(*(F.lit(x) for kv in ((k.lower(), v) for k, v in names.items()) for x in kv))
    return F.coalesce(F.try_element_at(m, F.lower(_c(code))), _c(code))


def coded(name: Column | str, names: dict[str, str]) -> Column:
    """The code of a name, in any case; null if there is none."""
    m = F.create_map(*(F.lit(x) for kv in ((v.lower(), k) for k, v in names.items()) for x in kv))
    return F.try_element_at(m, F.lower(_c(name)))
