from __future__ import annotations

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import bpe, token_counts
from lodestone.llm.pretokens import splitter

ODD = ["", "  a  b ", "<|endoftext|>", "x<|endoftext|> y", "'re don't it's 'RE", "\x1c\x1d a\x85b\xa0 c", "日本語 テスト ²³½ ٣٤", "a" * 900, "ab" * 700, " " * 70 + "x", "\n\n \n\t x", "😀😀 é́"]


@pytest.fixture(scope="module")
def texts():
    import random

    d = random.Random(3)
    return ODD + ["".join(d.choice("abcde 'rstelvm\n\t1²é<|>") for _ in range(d.randint(0, 60))) for _ in range(400)] + ["".join(d.choice("abcdehinort") for _ in range(d.randint(20, 90))) for _ in range(80)]


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return Tokenizer.from_file(P.path("byte_bpe_50k.json")), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_librarys(texts, theirs):
    own = token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert [own.count(t) for t in texts] == [len(e.ids) for e in theirs[0].encode_batch(texts, add_special_tokens=False)]


def test_counts_of_every_prefix(texts, theirs):
    own = token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    for t in [x for x in texts if len(x) < 100][:120]:
        index = own.index(t)
        cuts = [t[:k] for k in range(len(t) + 1)]
        assert [index.count(k) for k in range(len(t) + 1)] == [len(e.ids) for e in theirs[0].encode_batch(cuts, add_special_tokens=False)]


def test_fitting(texts, theirs):
    own = token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    for t in texts[:200]:
        n, fit = own.measure(t, 7)
        assert own.index(t).fitting(7) == fit and len(theirs[0].encode(t[:fit], add_special_tokens=False).ids) <= 7
        assert fit == len(t) or n > 7


def test_ids_are_the_librarys(texts, theirs):
    own = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in texts:
        ids = own.encode(t)
        assert ids == theirs[1].encode_ordinary(t) and own.decode(ids) == t.encode()


def test_rank_queue_order():
    q, pushed = bpe.RankQueue(), [(50_000, 3), (7, 9), (7, 2), (4_096, 1), (7, 5)]
    for x in pushed:
        q.push(*x)
    assert [q.pop() for _ in range(6)] == [*sorted(pushed), None]


def test_splitters_agree(texts):
    import regex

    split, plain = splitter(P.PATTERN), regex.compile(P.PATTERN).findall
    assert all(split(t) == plain(t) for t in texts)


def test_queries_rows(frame, corpus, theirs):
    docs = frame(corpus)
    n = {r.doc_id: r for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN, 512).collect()}
    e = {r.doc_id: r for r in bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in corpus:
        if i is None:
            continue
        t = t or ""
        ids = theirs[1].encode_ordinary(t)
        assert (n[i].n_bytes, n[i].n_tokens, n[i].over_limit) == (len(t.encode()), len(ids), len(ids) > 512)
        assert (e[i].n_tokens, e[i].ids_sha256, e[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    empty = docs.limit(0)
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json"), P.PATTERN, 5).collect() == bpe.round_trip(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_encode_then_decode(frame):
    path = P.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(frame([(1, "héllo wörld"), (2, None)]), path, P.PATTERN), path, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in out.collect()} == {1: "héllo wörld".encode(), 2: b""}
