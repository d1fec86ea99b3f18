"""Verdicts on quality and the pipeline's rows against plain Python that shares no code with them."""

from __future__ import annotations

import base64
import hashlib
import re

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken

from lodestone.llm import quality

from . import brute, outliers

DIR = "/root/testdata/{}/documents.parquet"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_verdicts(spark, sf):
    table = spark.read.parquet(DIR.format(sf))
    docs = [tuple(r) for r in table.select("doc_id", "text", "lang", "source").collect()]
    assert {r.doc_id: r.kept for r in quality.verdicts(table).collect()} == outliers.verdicts(docs)


def test_small_sources_are_judged_by_their_language(spark):
    docs = [(i, f"{'word ' * (60 + i % 7)}" + " ".join(f"w{i}x{k}" for k in range(100 + i % 13)), "en" if i < 300 else "xx", "large" if i < 200 else f"s{i % 4}") for i in range(330)]
    docs += [(1000, "#" * 500 + " a" * 3 + " " + " ".join(f"#|{k}" for k in range(90)), "en", "s1"), (1001, " ".join(f"#|{k}" for k in range(90)), "xx", "s2")]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert got == outliers.verdicts(docs) and not got[1000] and not got[1001]


def test_pipeline_rows(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [tuple(r) for r in table.select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    kept = outliers.verdicts(docs)
    left = [(i, t) for i, t, *_ in docs if kept[i]]
    left = [(i, t) for (i, t), (_, _, c) in zip(left, brute.jaccard(left, 5, 80), strict=True) if c == i]
    texts = {i: t for (i, t), (*_, bad) in zip(left, brute.leaks(left, items), strict=True) if not bad}
    assert sorted(out) == sorted(texts)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    same = 0
    for i, t in texts.items():
        new = theirs.decode(list(out[i].token_ids))
        assert theirs.encode_ordinary(new) == list(out[i].token_ids) and out[i].n_tokens == len(out[i].token_ids)
        assert out[i].decoded_sha256 == hashlib.sha256(new.encode()).hexdigest()
        # base spans are gone, whatever the method adds; where it adds nothing the text is as plain Python makes it
        parts, at = [], 0
        for kind, s, e in ((k, int(s), int(e)) for k, s, e in (x.split(":") for x in brute.pii(t).split(",") if x)):
            if s >= at:
                parts += [t[at:s], f"<{kind.upper()}>"]
            at = max(at, e)
        plain = "".join([*parts, t[at:]])
        for more in re.split("(<SECRET>|<PHONE>|<CARD>|<EMAIL>|<IP>)", new)[::2]:
            assert more in t
        same += new == plain
    assert same >= 0.95 * len(texts)
