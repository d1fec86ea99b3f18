from __future__ import annotations

import importlib

import pytest

from lodestone.llm import set_join, substring_dedup, suffix_dedup
from lodestone.llm.components import components

from . import brute


def test_factor_arrays(dice):
    def longest(t, i, others):
        best = 0
        for j in others:
            h = 0
            while i + h < len(t) and j + h < len(t) and t[i + h] == t[j + h]:
                h += 1
            best = max(best, h)
        return best

    for _ in range(150):
        t = bytes(dice.choice(b"ab") for _ in range(dice.randint(0, 40)))
        assert list(suffix_dedup.suffix_array(t)) == sorted(range(len(t)), key=lambda i: t[i:])
        assert suffix_dedup.previous_factors(t) == [longest(t, i, range(i)) for i in range(len(t))]
        assert suffix_dedup.previous_factors(t, True) == [longest(t, i, range(i + 1, len(t))) for i in range(len(t))]


@pytest.fixture(scope="module")
def strings():
    import random

    d = random.Random(2)
    text = lambda n: "".join(d.choice("abcdé ") for _ in range(n))
    base, out = text(3000), []
    for i in range(80):
        a = d.randint(0, 2000)
        b = a + d.randint(200, 1000)
        out.append((1000 + i, text(d.randint(0, 300)) + base[a:b] + text(d.randint(0, 300)) + (base[a + 50 : b - 50] if i % 5 == 0 else "")))
    out += [(1, None), (2, ""), (4, "a" * 399), (5, "a" * 400), (6, "b" * 401), (7, "ab" * 1000), (8, "c" * 5000 + text(100)), (9, "xyz" * 200 + text(500) + "xyz" * 150), (10, text(401) * 2)]
    near = text(4000)
    for i in range(25):
        x = list(near)
        for _ in range(d.randint(0, 12)):
            x[d.randrange(len(x))] = d.choice("abcd")
        out.append((2000 + i, "".join(x)))
    return out, base


def test_repeated_strings(frame, rows, strings, corpus):
    docs = [*strings[0], (3, strings[1]), (3, strings[1]), (None, strings[1][:700]), (None, None)]
    want = rows(brute.repeats(docs))
    assert rows(suffix_dedup.dedup(frame(docs)).collect()) == want
    assert rows(suffix_dedup.dedup(frame(docs), heavy=2).collect()) == want
    assert rows(suffix_dedup.dedup(frame(corpus)).collect()) == rows(brute.repeats(corpus))
    assert suffix_dedup.dedup(frame(docs).limit(0)).collect() == []


def test_first_copies_stay(frame, rows, strings):
    want = rows(brute.repeats(strings[0], first=True))
    for heavy in (suffix_dedup.HEAVY, 2):
        assert rows(suffix_dedup.dedup(frame(strings[0]), keep_first=True, heavy=heavy).collect()) == want


def test_later_copies_are_counted(frame, rows, strings, spark):
    """The query tells rows that hold a first copy from those with later ones; what it removes stays as it was."""
    docs = strings[0]
    want = rows((*r, first[2]) for r, first in zip(brute.repeats(docs), brute.repeats(docs, first=True), strict=True))
    assert any(r[2] and not r[5] for r in want) and any(r[5] for r in want)
    for heavy in (suffix_dedup.HEAVY, 2):
        assert rows(suffix_dedup.dedup(frame(docs), heavy=heavy, count_later=True).collect()) == want
    assert suffix_dedup.query(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_later"]


def test_repeated_windows(frame, rows, corpus, dice):
    words = ["a", "b", "é", "dd", "x"]
    base = " ".join(dice.choice(words) for _ in range(400))
    docs = [(i, " ".join(dice.choice(words[:2]) for _ in range(dice.randint(0, 60)))) for i in range(120)]
    docs += [(300 + i, base[dice.randint(0, 100) : dice.randint(200, 700)]) for i in range(40)]
    docs += [(400, None), (401, ""), (None, base), (None, None), (402, "a " * 500), (403, "a " * 300 + "b " * 40), (404, "b " * 300 + "a " * 14), (405, base), (405, base), (406, "q " + "a " * 12)]
    assert rows(substring_dedup.dedup(frame(docs)).collect()) == rows(brute.windows(docs))
    assert rows(substring_dedup.dedup(frame(corpus)).collect()) == rows(brute.windows(corpus))
    assert substring_dedup.dedup(frame(docs).limit(0)).collect() == []


@pytest.fixture(scope="module")
def near_copies():
    import random

    d, out = random.Random(5), []
    for _ in range(30):
        base = [f"w{d.randint(0, 5000)}" for _ in range(d.choice([3, 8, 10, 11, 12, 13, 14, 20, 21, 22, 30, 50, 120, 300]))]
        for _ in range(d.choice([2, 5, 40, 120])):
            w = list(base)
            for _ in range(d.choice([0, 1, 1, 2, len(w) // 40, len(w) // 25])):
                w[d.randrange(len(w))] = f"w{d.randint(0, 5000)}"
            if d.random() < 0.3:
                w = w[:-1] or w
            out.append((len(out), " ".join(w + ["tail"] * (d.random() < 0.2))))
    return [*out, (90_000, None), (90_001, ""), (90_002, "one"), (90_003, "ONE "), (None, out[5][1]), (None, "only null"), (90_004, "two words"), (90_005, out[9][1]), (90_005, out[9][1])]


@pytest.mark.parametrize("block", [set_join.BLOCK, 16])
def test_set_join(frame, rows, near_copies, block):
    assert rows(set_join.join(frame(near_copies), block=block).collect()) == rows(brute.jaccard(near_copies))


def test_set_join_of_corpus(frame, rows, corpus):
    assert rows(set_join.join(frame(corpus)).collect()) == rows(brute.jaccard(corpus))
    assert set_join.join(frame(corpus).limit(0)).collect() == []


def test_set_join_of_the_stage(spark, frame, rows, near_copies, dice):
    """Five words and 80 of 100: copies between the stage's rule and the query's go."""
    got = set_join.join(frame(near_copies), set_join.STAGE_SHINGLE, set_join.STAGE_PERCENT, block=16)
    assert rows(got.collect()) == rows(brute.jaccard(near_copies, 5, 80))
    docs = []
    for i in range(0, 40, 2):
        base = [f"w{dice.randrange(10**6)}" for _ in range(200)]
        copy = list(base)
        for at in (20, 70, 120, 170):  # 176 of 216 shingles of five words, 186 of 210 of three
            copy[at] = f"x{i}"
        docs += [(i, " ".join(base)), (i + 1, " ".join(copy))]
    assert all(c == i for i, _, c in brute.jaccard(docs, 3, 90))
    assert sorted(r.doc_id for r in set_join.stage(spark, frame(docs), "").collect()) == list(range(0, 40, 2))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 1 for i in range(2, 61)) and got[101] == 100


def test_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "personal data", "byte-level BPE"]
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [tuple(r) for r in table.collect()]
    out = {r.doc_id: r for r in pipeline.run(spark, sf).collect()}
    # plain Python: what each stage may let through
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    from lodestone.llm import quality

    kept = {r.doc_id for r in quality.verdicts(table).collect() if r.kept}
    left = [(i, t) for i, t, *_ in docs if i in kept]
    left = [(i, t) for (i, t), (_, _, c) in zip(left, brute.jaccard(left), strict=True) if c == i]
    left = [i for (i, *_, bad) in brute.leaks(left, items) if not bad]
    assert sorted(out) == sorted(left)
    import hashlib

    texts = {i: t for i, t, *_ in docs}
    untouched = [i for i in out if not brute.pii(texts[i]) and "token" not in texts[i]]
    assert untouched and all(out[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i in untouched)


@pytest.mark.parametrize("repeats", [True, False])
def test_names_of_several_tasks(dice, repeats):
    """What tasks know by themselves and what buckets find out is what all entries together say."""
    from collections import Counter, defaultdict

    import numpy as np
    import pyarrow as pa

    from lodestone.llm import names
    from lodestone.llm.words import mix

    entries = [(dice.randrange(40), dice.randrange(25)) for _ in range(200)]
    value = mix(np.arange(40, dtype=np.uint64) + np.uint64(1))
    buckets = defaultdict(list)
    for k in range(0, 200, 30):  # seven tasks
        gather = names.Gather(8, repeats)
        part = entries[k : k + 30]
        gather.add(value[[n for n, _ in part]], np.array([r for _, r in part], np.int64))
        got = gather.take()
        for b, raw in zip(got.column("bucket").to_pylist(), got.column("data").to_pylist(), strict=True):
            buckets[b].append(raw)
    assert names.Gather(8).take() is None
    found, earlier, heavy, total = set(), set(), {}, 0
    for raw in buckets.values():
        for key, of, before in (tuple(r.values()) for r in names.shared(pa.table({"data": pa.array(raw, pa.binary())}), least=9).to_pylist()):
            if key is None:
                counts = np.frombuffer(before, np.int64)
                total += 0 if of else int(counts.sum())
                heavy |= dict(zip(np.frombuffer(of, np.uint64).tolist(), counts.tolist(), strict=False)) if of else {}
                continue
            some = np.frombuffer(of, np.uint64).tolist()
            found |= {(key, n) for n in some}
            earlier |= {(key, n) for n, e in zip(some, before, strict=True) if e}
    rows_of, count = defaultdict(set), Counter(n for n, _ in entries)
    for n, r in entries:
        rows_of[n].add(r)
    shared = {n for n in rows_of if (count[n] > 1 if repeats else len(rows_of[n]) > 1)}
    assert found == {(r, int(value[n])) for n in shared for r in rows_of[n]}
    assert earlier == {(r, int(value[n])) for n in rows_of for r in rows_of[n] if r > min(rows_of[n])}
    assert total == 200 and heavy == {int(value[n]): c for n, c in count.items() if c >= 9}
