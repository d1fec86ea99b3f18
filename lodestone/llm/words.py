"""Vectorised words, fingerprints and packed shuffles shared by the corpus operators.

Texts of a batch are laid into one byte buffer and handled by numpy as a whole: a word costs a few dozen
nanoseconds, not a Python object. What has to be shuffled travels as packed arrays, a binary value for
each (batch, bucket), so that Spark moves a few large rows and not one row a word. The number of buckets
follows the size of the input; a bucket is a hash range, so its content is bounded however the data grow.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Text bytes handled at once in a Python worker.
CHUNK_BYTES = 1 << 20
#: Input bytes a bucket of a packed shuffle stands for.
BUCKET_BYTES = 4 << 20


def splitmix(n: int, seed: int = 7) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values; returns a new array."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One value for the pair (a, b); for a given a, or a given b, different others give different values."""
    x = a >> U(32)
    x ^= a
    x *= U(0xD6E8FEB86659FD93)
    x += b
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


#: Of bytes, of spans' lengths, and of the steps of each seed.
BYTES = splitmix(256)
STEPS = splitmix(128, 13)
LENGTHS = U(0xA0761D6478BD642F)
#: Bytes of a word from which on it is digested by itself.
LONG_WORD = 256
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def doubled(values: np.ndarray, seed: int = 0, n: int = 1):
    """(n, hashes of spans of n) for n, 2 n, 4 n, ... from those of the first: each is made of two of the one before.

    Hashes of pairs are mixed at each step and never added up, so no arrangement of few symbols makes different spans equal.
    """
    h = values
    for step in STEPS[64 * seed :]:
        yield n, h
        if len(h) <= n:
            return
        h = joined(h[:-n] + step, h[n:])
        n *= 2


def fixed(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of values[i:i + length] for each i; values are bytes, or hashes."""
    if len(values) < length:
        return np.zeros(0, U)
    if values.dtype != np.uint8:
        steps = doubled(values)
    elif length < 8:
        steps = doubled(BYTES[values])
    else:
        steps = doubled(mix(np.ndarray((len(values) - 7,), "<u8", values.tobytes(), strides=(1,))), n=8)
    for n, h in steps:
        if 2 * n > length:
            break
    return mix(joined(h[: len(values) - length + 1], h[length - n :]) + U(length * int(LENGTHS) % (1 << 64)))


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of values[start:end], none empty: two overlapping powers of two cover each span, and its length is mixed in."""
    out, size = np.zeros(len(start), U), end - start
    most = int(size.max(initial=0))
    for n, h in doubled(values, seed):
        if n > most:
            break
        some = np.flatnonzero((size >= n) & (size < 2 * n))
        if len(some):
            out[some] = joined(h[start[some]], h[end[some] - n])
    return mix(out + size.astype(U) * LENGTHS)


def word_hashes(buffer: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of buffer[start:end], eight bytes at a time."""
    size = end - start
    eight = np.ndarray((len(buffer) + 1,), "<u8", buffer + bytes(8), strides=(1,))
    out = joined(mix(size.astype(U) + STEPS[64 * seed]), eight[start] & MASKS[np.minimum(size, 8)])
    some = np.flatnonzero(size > 8)
    for at in range(8, LONG_WORD, 8):
        if not len(some):
            break
        out[some] = joined(out[some], eight[start[some] + at] & MASKS[np.minimum(size[some] - at, 8)])
        some = some[size[some] > at + 8]
    for k in some.tolist():  # long ones
        out[k] = U(int.from_bytes(hashlib.blake2b(buffer[start[k] : end[k]], digest_size=8, salt=bytes([seed])).digest(), "little"))
    return mix(out)


def strong(raw: bytes) -> tuple[int, int]:
    """A strong digest of 128 bits as two numbers."""
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _table(word: bytes | None, lower: bool) -> bytes:
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        if b in (9, 10, 11, 12, 13, 32) or (word is not None and not c.isalnum()):
            out[b] = 32
        elif lower and "A" <= c <= "Z":
            out[b] = b + 32
    return bytes(out)


#: Bytes to bytes: all that parts words becomes a space.
SPACED = _table(None, False)
SPACED_LOWER = _table(None, True)
ALNUM_LOWER = _table(b"", True)


class Words:
    """The words of a batch of texts: byte spans, 64-bit hashes, and where each text's words begin."""

    def __init__(self, texts: list[str | bytes | None], table: bytes, hashes: bool = True) -> None:
        raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b" ".join([*raw, b""]) or b" "
        self.buffer = joined.translate(table)
        a = np.frombuffer(self.buffer, np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.byte_at = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(raw)]
        word = (a != 32).view(np.int8)
        edge = np.diff(word, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.append(np.searchsorted(self.start, self.byte_at), len(self.start))
        self.counts = np.diff(self.first)
        if hashes:
            self.hash = word_hashes(self.buffer, self.start, self.end)

    @cached_property
    def check(self) -> np.ndarray:
        """Further 64 bits of each word, from other steps than those of ``hash``."""
        return word_hashes(self.buffer, self.start, self.end, 1)

    def of(self, text: int) -> list[bytes]:
        """The words of a text."""
        a, b = self.first[text], self.first[text + 1]
        return self.buffer[self.start[a] : self.end[b - 1]].split() if b > a else []

    def doc_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all runs of k words inside one text, and their hashes."""
        start = runs(self.first, self.counts, k)
        return start, spans(self.hash, start, start + k)


def runs(first: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Indices from which k items lie inside the same text."""
    n = int(first[-1]) if len(first) else 0
    ok = np.ones(n, bool)
    ends = first[1:]
    for j in range(1, k):
        at = ends - j
        ok[at[at >= first[:-1]]] = False
    return np.flatnonzero(ok)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + skip


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the n items that lie in any [start, end)."""
    d = np.bincount(start, minlength=n + 1).astype(np.int64) - np.bincount(end, minlength=n + 1)
    return np.cumsum(d)[:n] > 0


def pieces(ids: list, texts: list[str | bytes | None], most: int = CHUNK_BYTES):
    """Slices of a batch that hold about ``most`` bytes each; one text is never parted."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += 2 * len(t or "") + 1
        if size >= most:
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(ids):
        yield ids[at:], texts[at:]


def scan_bytes(df: DataFrame) -> int:
    """The bytes that df reads: no more than its sources hold, as estimates over joins are products; counted where a source tells none."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sources = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    found = min(sources, int(str(plan.stats().sizeInBytes())))
    if found < 1 << 60:
        return found
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    return int(df.agg(F.sum(sum(long, F.lit(8)).cast("long"))).first()[0] or 0)


def buckets(df: DataFrame, each: int = BUCKET_BYTES) -> int:
    """How many buckets a packed shuffle over df takes: in proportion to its bytes, and enough for the cores of small runs.

    Names are dealt by 24 bits of their hashes, so beyond 64 terabytes buckets grow with the data.
    """
    return int(min(max(128, scan_bytes(df) // each), 1 << 24))


def by_buckets(dealt: DataFrame, source: DataFrame):
    """dealt grouped by bucket, in tasks of which each stands for as many bytes of the source as a bucket does, whatever their packed size.

    At least as many tasks as the session's shuffles have, and at most 2**17: beyond half a terabyte a task takes several buckets, one by one.
    """
    least = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(max(least, min(scan_bytes(source) // BUCKET_BYTES, 1 << 17)), "bucket").groupBy("bucket")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def by_bucket(names: np.ndarray, n: int):
    """(bucket, indices) for names, in order of names; a bucket is a range of hashes."""
    order = np.argsort(names)
    b = (names[order] >> U(40)).astype(np.int64) * n >> 24
    cut = np.flatnonzero(np.diff(b)) + 1
    at = np.concatenate([[0], cut, [len(b)]])
    for i, j in zip(at[:-1], at[1:], strict=True):
        if i < j:
            yield int(b[i]), order[i:j]


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
