"""What hashes may not confuse, and what comes through the methods themselves."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestone.llm import decontaminate, licenses, set_join, substring_dedup, suffix_dedup, token_counts, words

from . import brute

#: Any polynomial hash modulo a power of two takes this word of two symbols and its complement for equal.
ALTERNATING = [bin(i).count("1") % 2 for i in range(2048)]


def test_spans_of_two_symbols_differ():
    a = np.array(ALTERNATING, np.uint64)
    start, end = np.zeros(1, np.int64), np.full(1, len(a))
    for seed in (0, 1):
        assert words.spans(words.mix(a), start, end, seed) != words.spans(words.mix(1 - a), start, end, seed)
    x, y = (np.array(v, np.uint8) for v in (ALTERNATING, [1 - v for v in ALTERNATING]))
    assert words.fixed(x, 2048) != words.fixed(y, 2048)


def test_hashes_of_spans(dice):
    text = bytes(dice.choice(b"ab") for _ in range(300))
    raw = np.frombuffer(text, np.uint8)
    for n in (1, 2, 5, 8, 9, 16, 100, 300, 301):
        h = words.fixed(raw, n)
        assert len(h) == max(0, 301 - n)
        known = {}
        for i in range(len(h)):
            assert known.setdefault(text[i : i + n], h[i]) == h[i]
        assert len(set(known.values())) == len(known)
    w = words.Words([" ".join(["x" * n for n in range(1, 600, 7)] + ["x" * 8, "x" * 8]), None, ""], words.SPACED)
    assert w.end[1] - w.start[1] == 8 and w.hash[-1] == w.hash[-2] == w.hash[1]
    assert len(set(w.hash.tolist())) == len(set(w.check.tolist())) == len(w.hash) - 2


def test_words_that_polynomials_confuse(frame, rows):
    one, two = ("".join("ab"[x ^ flip] for x in ALTERNATING) for flip in (0, 1))
    docs = [(1, f"{one} q r"), (2, f"{two} q r"), (3, f"{one} q r")]
    assert rows(set_join.join(frame(docs)).collect()) == rows(brute.jaccard(docs)) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    pairs = [" ".join(f"{('foo', 'bar')[x ^ flip]} u{i}" for i, x in enumerate(ALTERNATING[:1024])) for flip in (0, 1)]
    docs = list(enumerate(pairs, 1))
    got = rows(substring_dedup.dedup(frame(docs)).collect())
    assert got == rows(brute.windows(docs)) and all(r[2] == 0 for r in got)
    leaks = decontaminate.decontaminate(frame([(1, f"say {two} q r")]), frame([("i", f"{one} q r")], "item_id string, text string")).collect()
    assert not leaks[0].contaminated


def test_parts_of_the_suffix_order(dice):
    """Ranges of factors within parts are those of whole factor arrays; parts hold several anchors and rows."""
    for length in (5, 12):
        for _ in range(60):
            texts = ["".join(dice.choice("ab") for _ in range(dice.randint(0, 40))) for _ in range(dice.randint(1, 5))]
            a = suffix_dedup.Anchors(texts, length, length // 2)
            if not len(a.at):
                continue
            of, half = np.arange(len(a.at)), len(a.at) // 2
            part = pa.table({"data": pa.array([suffix_dedup.pack_windows(a, x, a.doc[x]) for x in (of[:half], of[half:])], pa.binary())})
            # separators that stand once keep factors of one string from crossing texts
            joined, begin = b"", []
            for k, t in enumerate(texts):
                begin.append(len(joined))
                joined += t.encode() + bytes([128 + k])
            for later in (False, True):
                got = [bytearray(len(t)) for t in texts]
                for key, s, e in zip(*(c.to_pylist() for c in suffix_dedup.factors(part, length, later).columns), strict=True):
                    for i, j in zip(np.frombuffer(s, np.int64), np.frombuffer(e, np.int64), strict=True):
                        got[key][i:j] = b"\1" * (j - i)
                size = suffix_dedup.previous_factors(joined)
                after = suffix_dedup.previous_factors(joined, True) if later else [0] * len(joined)
                want = [bytearray(len(t)) for t in texts]
                for k, t in enumerate(texts):
                    for i in range(len(t) - length + 1):
                        if max(size[begin[k] + i], after[begin[k] + i]) >= length:
                            want[k][i : i + length] = b"\1" * length
                assert got == want


@pytest.mark.parametrize("block", [False, True])
def test_answers_are_derived(block):
    """In clusters of every size overlaps come from lists, and from those of a similar set where there is one."""
    d, seen = random.Random(9), Counter()
    for m in (2, 3, 6, 7, 40):
        base = [d.randrange(1 << 40) for _ in range(200)]
        sets = [np.array(sorted({*d.sample(base, 196), *(d.randrange(1 << 40) for _ in range(d.choice([0, 4, 30])))}), np.uint64) for _ in range(m)]
        sides = np.array([d.randrange(2) for _ in sets]) if block else None
        got, up = set_join.links(sets, 90, sides, seen), list(range(m))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(m):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if (sides is None or sides[i] != sides[j]) and 100 * o >= 90 * (len(sets[i]) + len(sets[j]) - o):
                    up[root(i)] = root(j)
        forest = set_join.Forest(m)
        assert all(forest.link(i, j) for i, j in got)
        assert all((root(i) == root(j)) == (forest.root(i) == forest.root(j)) for i in range(m) for j in range(i))
    assert seen["read"] and seen["derived"]


def test_components_that_do_not_settle(spark):
    from lodestone.llm.components import components

    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), 1)


def test_long_pretokens():
    own, theirs = token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = lambda t: len(theirs.encode(t, add_special_tokens=False).ids)
    n, fit = own.measure("xqzj" * 25_000, 512)
    assert n > 512 and count("xqzj" * 25_000) == n and count(("xqzj" * 25_000)[:fit]) <= 512 < count(("xqzj" * 25_000)[: fit + 1])
    for text in ("xqzj" * 200 + " the" + "!" * 90, "Donau" * 60 + "é日" * 40, "a" + " " * 300 + "b"):
        index, every = own.index(text), [count(text[:k]) for k in range(len(text) + 1)]
        assert [index.count(k) for k in range(len(text) + 1)] == every
        for budget in (0, 1, 20, 100):
            k = index.fitting(budget)
            assert every[k] <= budget and own.measure(text, budget) == (every[-1], k)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("this work is licensed under a creative commons attribution-noncommercial 4.0 license", "cc,cc-by-nc"),
        ("copyright 2020 foo, mozilla public license 2.0, all rights reserved", "all-rights-reserved,mpl"),
        ("licensed under gpl-3.0-only", "gpl"),
        ("license: apache-2.0", "apache"),
        ('license = "bsd-3-clause"', "bsd-3-clause"),
        ("spdx-license-identifier: (mit and bsd-3-clause)", "bsd-3-clause,mit"),
        ("spdx-license-identifier: mit or apache-2.0", "apache,mit"),
        ("spdx-license-identifier: gpl-2.0-or-later with classpath-exception-2.0 and (isc or zlib)", "gpl,isc,zlib"),
        ("the nasa open source agreement version 1.3 applies", "nasa"),
        ("gnu lesser general public license v2.1", "lgpl"),
        ("see the license: it is long", ""),
        ("", ""),
    ],
)
def test_license_labels(text, labels):
    assert ",".join(sorted({d[3] for d in licenses.detect(text)})) == labels


def test_kept_detections():
    """Against a plain reading: a detection goes if one of better priority, or of the same and longer, contains it."""
    d = random.Random(5)
    parts = ["licensed under the mit license", "spdx-license-identifier: mit", "all rights reserved", "copyright", "gpl-2.0", "the gnu lesser general public license", " and ", "license: isc", "x" * 30]
    for _ in range(200):
        text = " ".join(d.choice(parts) for _ in range(d.randint(0, 8)))
        ordered, _ = licenses.rules()
        every = []
        for p, label, w, x in ordered:
            for m in x.finditer(text):
                every += [(m.start(), m.end(), p, label, w)] if label else [(s, e, p, name, w) for s, e, name in licenses.expression(text, m.start(), m.end())]
        every.sort(key=lambda r: (r[2], r[0] - r[1], r[0], r[3]))
        want = [r for k, r in enumerate(every) if not any(q[0] <= r[0] and q[1] >= r[1] for q in every[:k])]
        assert licenses.detect(text) == sorted(want, key=lambda r: r[:4])
