"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's tokens form a linked list. Each pair that may merge stands in the bucket of its merge rank,
as the position of its left token; a bitmap of three levels marks the buckets that hold something, and
find-first-set walks it to the lowest rank. An entry whose pair has changed since is stale and skipped.
Each merge is constant work but for the bucket's heap, so a pre-token of a megabyte takes seconds.

Ranks follow the rank file: a pair merges if its bytes are in the file, lowest rank first, leftmost first
among equals. Null text counts as empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import Generations, splitter
from .words import small_batches, texts_of

ENCODED = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Positions by merge rank; the lowest rank is found through a bitmap of 64-bit words in three levels."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.top, self.mid, self.low = 0, {}, {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        m, h = rank >> 6, rank >> 12
        self.low[m] = self.low.get(m, 0) | 1 << (rank & 63)
        self.mid[h] = self.mid.get(h, 0) | 1 << (m & 63)
        self.top |= 1 << h

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank and the leftmost position in its bucket."""
        if not self.top:
            return None
        h = (self.top & -self.top).bit_length() - 1
        w = self.mid[h]
        m = h << 6 | (w & -w).bit_length() - 1
        x = self.low[m]
        rank = m << 6 | (x & -x).bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            self.low[m] = x & x - 1
            if not self.low[m]:
                self.mid[h] = w & w - 1
                if not self.mid[h]:
                    self.top &= self.top - 1
        return rank, at


class Encoder:
    """Encodes and decodes by the ranks of one file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.text = {i: str(i) for i in self.bytes}
        self.split = splitter(pattern)
        self.known = Generations(lambda piece: self.merge(piece.encode("utf-8", "surrogatepass")))

    def merge(self, raw: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return (whole,)
        n = len(raw)
        end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # of the token that starts at a position
        queue = RankQueue()
        for i in range(n - 1):
            if (r := ranks.get(raw[i : i + 2])) is not None:
                queue.push(r, i)
        while (got := queue.pop()) is not None:
            rank, i = got
            j = end[i]
            if not j or j >= n or ranks.get(raw[i : end[j]]) != rank:
                continue  # stale: this token is gone or has another neighbour
            k = end[i] = end[j]
            end[j] = 0
            if k < n:
                before[k] = i
                if (r := ranks.get(raw[i : end[k]])) is not None:
                    queue.push(r, i)
            if (h := before[i]) >= 0 and (r := ranks.get(raw[h:k])) is not None:
                queue.push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return [*chain.from_iterable(map(self.known.__getitem__, self.split(text)))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of each whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            ids = [own.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            raw = [own.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them, in one pass over the texts.

    Nulls count as empty; repeated rows give repeated rows; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        written = own.text.__getitem__
        for b in batches:
            n, a, d = [], [], []
            for t in b.column("text").to_pylist():
                ids = own.encode(t or "")
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(written, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the columns of documents but for the text, with the token ids."""
    import public_tokenizers

    return encode_with(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def encode_with(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with ids, n_tokens and the digest of the decoded bytes in place of the text; one pass, no shuffle.

    Columns that docs has under these names already are replaced.
    """
    small_batches(docs.sparkSession)
    made = ("token_ids", "n_tokens", "decoded_sha256")
    kept = [f for f in docs.schema.fields if f.name not in ("text", *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            ids = [own.encode(t or "") for t in b.column("text").to_pylist()]
            digests = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
            rest = [b.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(digests, pa.string())], names=[*(f.name for f in kept), *made])

    schema = docs.select([F.col(f.name) for f in kept] + [F.lit(None).cast("array<int>").alias("token_ids"), F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("decoded_sha256")]).schema
    return docs.mapInArrow(run, schema)
