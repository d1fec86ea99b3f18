"""Queries where executors are processes of their own: what only the driver's process holds isn't there."""

from __future__ import annotations

import importlib.util
import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import oracle_sql

DIR = "/root/testdata/sf0.001"
REPO = str(Path(__file__).resolve().parent.parent)
RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
conf = {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "600m", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC"}
conf |= {"spark.checkpoint.dir": "file://" + sys.argv[3], "spark.sql.warehouse.dir": sys.argv[3] + "/warehouse"}
s = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
df = __spark_entry__.queries()[sys.argv[1]](s, sys.argv[2])
print("ROWS", json.dumps([df.columns, [list(r) for r in df.collect()]]))
s.stop()
"""


@pytest.mark.parametrize("name", ["jdbc_round_trip", "jdbc_in_parts", "jdbc_shapes"])
def test_apart(tmp_path, name):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # the executors' logs
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    gone = ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS")
    env = {k: v for k, v in os.environ.items() if k not in gone} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": REPO, "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", RUN, name, DIR, str(tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = [x for x in run.stdout.splitlines() if x.startswith("ROWS ")]
    assert said, run.stderr[-3000:]
    columns, got = json.loads(said[0][5:])
    duck = duckdb.connect()
    for t in ("nation", "customer", "orders"):
        duck.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = duck.sql(f"select {', '.join(columns)} from ({oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
