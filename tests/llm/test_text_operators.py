from __future__ import annotations

import hashlib

import pytest

from lodestone.llm import decontaminate, licenses, pii, quality, warc

from . import brute

DIR = "/root/testdata/sf0.001"


def test_archive(spark, rows, tmp_path):
    pages = [(1, "u", "a\r\n\r\nb"), (2, "u2", "a\r\n\r\nb"), (3, None, None), (4, "x", ""), (5, "é", "é" * 50), (7, "z", "a\r\n\r\nb")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    a = warc.write(df, str(tmp_path / "a"))
    got = a.parsed().join(a.verified(), "sha256").select("record_id", "n", "sha1", "record_type", "refers_to")
    assert rows(got.collect()) == rows(brute.warc([(i, h) for i, _, h in pages]))
    assert a.payloads().count() == 3
    assert {r.record_id: bytes(r.payload).decode() for r in a.originals().collect()} == {i: h or "" for i, _, h in pages}
    a.export(str(tmp_path / "w"), 2)
    files = [p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*"))]
    assert sorted(b"".join(files).split(b"WARC/1.1\r\n")[1:]) == sorted(bytes(r.record)[10:] for r in a.serialized().collect())


def test_archive_of_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "u", "x"), (None, "u", "y"), (3, "u", "x"), (3, "u", "x")], "page_id long, url string, html string")
    a = warc.write(df, str(tmp_path / "a"))
    assert sorted((str(r.record_id), r.record_type) for r in a.parsed().collect()) == [("3", "response"), ("3", "response"), ("None", "response"), ("None", "revisit")]
    assert warc.write(df.limit(0), str(tmp_path / "b")).parsed().collect() == []


def test_archive_notices_damage(spark, tmp_path):
    a = warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "a"))
    bad = a.payloads().selectExpr("sha256", "cast('y' as binary) as payload").collect()
    spark.createDataFrame(bad, a.payloads().schema).write.mode("overwrite").parquet(f"{a.path}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        a.verified().collect()


def test_archive_query(spark, rows):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()]
    assert rows(warc.query(spark, DIR).collect(), 5) == rows(brute.warc(pages))


def test_base_spans(dice):
    for _ in range(8000):
        t = "".join(dice.choice("a1.@ +-0(9") for _ in range(dice.randint(0, 40)))
        assert pii.written(pii.base_spans(t)) == brute.pii(t)
        pii.occurrences(t, pii.base_spans(t))


def test_spans_of_long_runs_are_linear():
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 100_000 + "@") == [] and pii.base_spans("+1" + " " * 100_000) == []


def test_extraction(spark, frame, corpus):
    docs = [*corpus, *((91_000 + k, f'word{k} here token = "{hashlib.sha1(str(k).encode()).hexdigest()}" end') for k in range(12)), (92_000, 'new token = "Zq7kP2mX9vB4nL8sT1wY" end'), (92_001, "plain Zq7kP2mX9vB4nL8sT1wY stands alone")]
    got = {(r.doc_id, r.text_hash): r for r in pii.extract(frame(docs)).collect()}
    assert len(got) == len({(i, t) for i, t in docs})
    by_id = {k[0]: v for k, v in got.items()}
    for i, t in docs:
        if i is not None:
            assert by_id[i].base_sha256 == hashlib.sha256(brute.pii(t).encode()).hexdigest()
            assert set(filter(None, brute.pii(t).split(","))) <= set(by_id[i].spans.split(","))
    assert "secret:13:33" in by_id[92_000].spans and "secret" not in by_id[92_001].spans
    assert pii.extract(frame(docs).limit(0)).collect() == []


def test_redaction(frame):
    docs = frame([(1, None, 5), (None, "call +1 (222) 333-4444 now", 26), (2, "a@b.cc", 6)], "doc_id long, text string, n_chars long")
    assert sorted((r.text or "", r.n_chars) for r in pii.redact(docs).collect()) == [("", None), ("<EMAIL>", 7), ("call <PHONE> now", 16)]


def test_licenses(frame, corpus):
    docs = [*corpus, (93_000, "The MIT  license, and GNU General-Public License. Apache License"), (93_001, "SPDX-License-Identifier: MPL-2.0"), (93_002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software")]
    got = {r.doc_id: r for r in licenses.scan(frame(docs)).collect()}
    for i, t in docs:
        if i is not None:
            r = got[i]
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(t)
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[93_001].labels == "mpl" and got[93_002].labels == "mit" and licenses.scan(frame(docs).limit(0)).collect() == []


def test_license_suppression():
    found = [d[3] for d in licenses.detect("licensed under the gnu lesser general public license v2.1")]
    assert found == ["lgpl"]
    assert len(licenses.rules()[0]) > 300


def test_quality_counts(frame, corpus):
    docs = [*corpus, (94_000, "a b c a b c"), (94_001, "x\nx\ny\n\n x")]
    got = quality.counts(frame(docs)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(r.text)[:5]


def test_quality_verdicts(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = quality.query(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(texts) and all(r.base_failed == brute.quality(texts[r.doc_id])[5] for r in got)
    clean = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    poor = [r for r in got if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert all(r.kept for r in clean) and sum(r.kept for r in poor) <= 0.1 * len(poor)


def test_quality_of_odd_rows(frame):
    docs = frame([(1, None, None, None), (1, "", "en", None), (None, "a b", None, "s")], "doc_id long, text string, lang string, source string")
    assert [(r.base_failed, r.kept) for r in quality.verdicts(docs).collect()] == [(True, False)] * 3
    assert quality.verdicts(docs.limit(0)).collect() == []


def test_quality_runs_no_python(spark):
    plan = quality.query(spark, DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontamination(spark, frame, corpus, rows, most):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    docs = [*corpus, (95_000, "x. Tiny one! " + items[0][1] + " tiny ONE"), (95_001, "tiny one é z"), (95_002, " ".join(items[3][1].split()[2:12]))]
    items += [(900, "tiny one"), (901, ""), (902, None), (901, "é z"), (900, "tiny one")]
    got = decontaminate.decontaminate(frame(docs), frame(items, "item_id long, text string"), broadcast_bytes=most)
    assert rows(got.collect(), 6) == rows(brute.leaks(docs, items))
    assert decontaminate.decontaminate(frame(docs).limit(0), frame(items, "item_id long, text string"), broadcast_bytes=most).collect() == []


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_clean_judges_rows_by_themselves(frame, rows, most):
    """A contaminated row takes none with it that shares its id, or also has none; both ways give the same rows."""
    passage = " ".join(f"item{k}" for k in range(20))
    docs = [(None, f"so {passage} on"), (None, "clean words without id"), (None, None), (7, passage), (7, "clean words with the same id"), (8, passage), (9, "")]
    got = decontaminate.clean(frame(docs), frame([(1, passage)], "item_id long, text string"), broadcast_bytes=most)
    assert rows(got.collect()) == rows([docs[1], docs[2], docs[4], docs[6]])


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, empty texts, and columns whose names might clash."""
    from lodestone.llm import bpe, set_join

    good = " ".join(f"word{k} of" for k in range(60))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, None, None, None, None), (None, good + " end", "en", "s", 1), (None, "", "en", None, 0), (None, "$$ " * 80, "en", "s", 1), (3, good.replace("word7 ", "other "), "en", "s", 7)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["id", "hash", "spans", "bad_id", "row", "key", "n_words", "kept", "token_ids", "_words", "contaminated"]
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], names + "".join(f", {c} int" for c in extra))
    spark.createDataFrame([(1, "word1 of word2 of word3 of word4 of word5 of word6 of")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage in (quality.stage, set_join.stage, decontaminate.stage, pii.stage):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema == docs.schema
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert sorted(str(r.doc_id) for r in quality.stage(spark, docs, str(tmp_path)).collect()) == ["1", "1", "3", "None"]
    assert sorted(str(r.doc_id) for r in decontaminate.stage(spark, docs, str(tmp_path)).collect()) == ["2", "None", "None"]
    assert "token_ids" in bpe.stage(spark, docs, str(tmp_path)).columns and bpe.stage(spark, docs, str(tmp_path)).count() == 7


def test_queries_ignore_further_columns(spark, frame, rows):
    """Operators take what they need by name; columns with clashing names don't matter."""
    from lodestone.llm import set_join, substring_dedup, suffix_dedup

    plain = frame([(1, "a b c d " * 200), (2, "a b c d " * 200), (3, None)])
    wide = plain.selectExpr("*", "1 as key", "2 as set_id", "3 as root", "4 as names", "5 as earlier", "6 as tag", "7 as bucket", "8 as row")
    for f in (set_join.join, substring_dedup.dedup, suffix_dedup.dedup, licenses.scan, pii.extract):
        assert rows(f(wide).collect()) == rows(f(plain).collect())


@pytest.mark.parametrize("name", ["op1_warc", "op4_set_join", "op5_window_dedup", "op9_decontaminate"])
def test_sql(spark, rows, name):
    import duckdb

    from lodestone.llm import registry

    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DIR), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())
