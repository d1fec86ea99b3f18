"""Statements and settings for catalogues and databases of others; nothing here touches a network."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Sequence

from ..compat import identifier

PRESETS = {
    "local": {"executors": 4, "cores": 2, "memory": "2g"},
    "cluster": {"executors": 8, "cores": 4, "memory": "4g"},
    "yarn": {"executors": 10, "cores": 4, "memory": "8g", "spark.driver.memory": "4g"},
    "geocoding": {"executors": 4, "cores": 2, "memory": "4g"},
    "census": {"executors": 6, "cores": 4, "memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "50m"},
}
FORMATS = ("DELTA", "PARQUET", "CSV", "JSON", "AVRO", "ORC", "TEXT")


def partitions(executors: int, cores: int) -> int:
    return executors * cores * 3


def preset(name: str, **changes) -> dict[str, str]:
    """Spark settings of a kind of deployment."""
    p = PRESETS[name] | changes
    out = {"spark.executor.instances": p["executors"], "spark.executor.cores": p["cores"], "spark.executor.memory": p["memory"], "spark.sql.shuffle.partitions": partitions(p["executors"], p["cores"]), "spark.sql.adaptive.enabled": "true"}
    return {k: str(v) for k, v in (out | {k: v for k, v in p.items() if k.startswith("spark.")}).items()}


def jdbc_url(host: str, database: str, port: int = 5432, kind: str = "postgresql") -> str:
    return f"jdbc:{identifier(kind)}://{host}:{int(port)}/{database}"


def foreign_table(catalog: str, schema: str, table: str, connection: str, source_schema: str, source_table: str) -> str:
    names = [identifier(n) for n in (catalog, schema, table, connection, source_schema, source_table)]
    return "CREATE FOREIGN TABLE IF NOT EXISTS {0}.{1}.{2} USING CONNECTION {3} OPTIONS (schema '{4}', table '{5}')".format(*names)


def foreign_tables(catalog: str, schema: str, connection: str, source_schema: str, tables: Sequence[str]) -> list[str]:
    return [f"CREATE SCHEMA IF NOT EXISTS {identifier(catalog)}.{identifier(schema)}", *(foreign_table(catalog, schema, t, connection, source_schema, t) for t in dict.fromkeys(tables))]


def federated_view(catalog: str, schema: str, view: str, source_catalog: str, source_schema: str, source_table: str) -> str:
    a, b = ".".join(map(identifier, (catalog, schema, view))), ".".join(map(identifier, (source_catalog, source_schema, source_table)))
    return f"CREATE OR REPLACE VIEW {a} AS SELECT * FROM {b}"


def external_table(catalog: str, schema: str, name: str, location: str, fmt: str, columns: Sequence[tuple[str, str]], comment: str | None = None) -> dict:
    """What a catalogue's service takes to register a table that lies somewhere."""
    if fmt.upper() not in FORMATS:
        raise ValueError(f"format is none of {FORMATS}: {fmt!r}")
    cols = [{"name": identifier(n), "type_text": t, "type_name": t.upper(), "position": i, "nullable": True} for i, (n, t) in enumerate(columns)]
    out = {"catalog_name": identifier(catalog), "schema_name": identifier(schema), "name": identifier(name), "table_type": "EXTERNAL", "data_source_format": fmt.upper(), "storage_location": location, "columns": cols}
    return out | ({"comment": comment} if comment else {})


def census_table(year: int, level: str, prefix: str = "census") -> str:
    return identifier(f"{prefix}_{level}_{int(year)}".lower())


def census_targets(year: int, levels: Sequence[str], prefix: str = "census") -> list[str]:
    return list(dict.fromkeys(census_table(year, l.strip().lower(), prefix) for l in levels))


#: Ways to load shapes, best first.
LOADERS = ("native", "ogr2ogr", "sedona", "python")


def loaders(native: bool = False, converter: bool = False, sedona: bool = False) -> list[str]:
    """The best way to load shapes that there is, and those to fall back on; plain Python is always there."""
    there = dict(zip(LOADERS, (native, converter, sedona, True), strict=True))
    return list(LOADERS[next(k for k, n in enumerate(LOADERS) if there[n]) :])


def runtime(version: str | None = None, native: bool | None = None, sedona: bool | None = None, since: tuple[int, int] = (17, 1)) -> list[str]:
    """The same for computing with shapes, where converters don't count.

    What isn't stated is told from the version of the runtime, which has functions of its own ``since`` one, and from
    whether the library can be imported.
    """
    if native is None:
        parts = re.match(r"\s*(\d+)\.(\d+)", version or "")
        native = parts is not None and tuple(map(int, parts.groups())) >= since
    if sedona is None:
        sedona = importlib.util.find_spec("sedona") is not None
    return [n for n in loaders(native, False, sedona) if n != "ogr2ogr"]
