from __future__ import annotations

import random

import pytest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents, with nulls, empty and repeated rows."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    return [*docs, (90_000, None), (90_001, ""), (None, None), (None, docs[3][1]), (90_002, docs[5][1]), (90_002, docs[5][1]), (90_003, " \n\t ")]


@pytest.fixture
def frame(spark):
    return lambda rows, schema="doc_id long, text string": spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture
def rows():
    return lambda data, n=99: sorted((tuple(r)[:n] for r in data), key=repr)


@pytest.fixture
def dice():
    return random.Random(7)
