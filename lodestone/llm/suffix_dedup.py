"""Removal of repeated byte strings by longest-previous-factor arrays.

In suffix order, the nearest suffixes before and after one that start at a smaller position give its longest previous
factor: the longest string that starts there and somewhere earlier. A byte goes if a string of ``length`` bytes over it has
a previous factor of that length (later copies go, the first stays) or also if it has a next factor (all copies go).
Where all copies go, the bytes of later ones alone can be counted beside that, in the same passes.
``previous_factors`` computes whole arrays for one byte string.

Over a corpus only factors of ``length`` count, so the suffix order is needed only as far as that depth, and is built in
parts. Each window of ``length`` bytes picks as anchor the k-gram of least hash in it, the last among equals; equal windows
pick equal anchors at equal places, so the windows of one anchor are one part of the suffix order. First round: anchors are
named by hash, which only finds candidates, and anchors with all that their windows may cover by a strong digest of 128
bits; Spark finds the names that stand more than once. A repeated surrounding settles all windows around its anchor. Second
round: for anchors that are repeated while their surroundings aren't, and for one of each group of equal surroundings, the
bytes of their windows go to the anchor's part. There ``Part`` sorts the suffixes that start at anchors by their bytes, with
their common prefixes, and extends that order byte by byte to the left, so that it has the suffix order of all windows at
each distance from their anchors. Where neighbours share ``length`` bytes, the nearest places before and after with a
smaller position in the corpus give the previous factor, those with a greater one the next. Equality there is equality of
bytes. Anchors with more than one in ``SHARE`` of all entries, at most so many, are told to all tasks; their windows are
parts of their own, named by 128 bits, which tasks aggregate before they deal them out, so no part is held by very many rows.
Texts aren't compared in pairs, and a string that a third of all rows share costs a few entries a row.

Null text is empty; matches never cross rows; repeated rows are copies of each other. A text is held whole by a task, with
some 50 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import BLOB, FOUND, Gather, by_key, heavy_names, shared
from .shared import shared_path, stored
from .words import U, buckets, by_bucket, by_buckets, cover, expand, fixed, mix, pieces, small_batches, splitmix, strong, table, texts_of

LENGTH, GRAM = 400, 128
SALT = splitmix(4, 31)
#: Entries from which, and share of all entries above which, an anchor's windows travel one by one.
HEAVY, SHARE = 2_000, 100_000


def suffix_array(text: bytes) -> np.ndarray:
    """Suffixes in lexicographic order, by doubling: eight bytes first, then twice as many in each round."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.frombuffer(text + bytes(8), np.uint8).astype(U)
    key = np.zeros(n, U)
    for j in range(7):
        key = key << U(9) | (padded[j : j + n] + U(1)) * (np.arange(n) + j < n)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    h = 7
    while h < n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(text: bytes, order: np.ndarray) -> list[int]:
    """For each place in suffix order the bytes shared with the suffix before it."""
    n, rank, out, h = len(text), np.empty(len(order), np.int64), [0] * len(order), 0
    rank[order] = np.arange(n)
    for i in range(n):
        r = int(rank[i])
        if not r:
            h = 0
            continue
        j = int(order[r - 1])
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        out[r] = h
        h = max(h - 1, 0)
    return out


def previous_factors(text: bytes, later: bool = False) -> list[int]:
    """Length of the longest string from each position that also starts earlier (or later).

    A stack over the suffix order holds increasing positions; what is popped has its previous and next smaller
    positions beneath it and before it, and the least common prefix on the way is the match.
    """
    order = suffix_array(text)
    lcp = [*common_prefixes(text, order), 0]
    n, out = len(text), [0] * len(text)
    sign = -1 if later else 1
    stack: list[tuple[int, int]] = []  # position and the common prefix with the one beneath
    for r in range(n + 1):
        at, shared = (int(order[r]), lcp[r]) if r < n else (None, 0)
        while stack and (at is None or sign * at < sign * stack[-1][0]):
            top, beneath = stack.pop()
            out[top] = max(beneath, shared)
            shared = min(shared, beneath)
        if at is not None:
            stack.append((at, shared))
    return out


def _sliding(a: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over a[i:i + w] for each i, by running values within blocks of w from both sides."""
    n = len(a)
    size = -(-(n + w) // w) * w
    padded = np.full(size, U(fill), U)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


class Anchors:
    """Anchors of a batch of texts with the range of windows that picked each."""

    def __init__(self, texts: list[str | None], length: int, gram: int) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.length, self.gram = length, gram
        self.raw = raw
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        n, w = len(self.bytes), length - gram + 1
        empty = np.zeros(0, np.int64)
        self.at = self.low = self.high = self.doc = empty
        self.name = self.around = self.around_check = np.zeros(0, U)
        self.whole = np.zeros(0, bool)
        sizes = np.diff(self.first)
        if n < length or not (sizes >= length).any():
            return
        h = fixed(self.bytes, gram) >> U(1) | U(1)  # odd, so never 0, and never the largest
        ends = self.first[1:]
        valid = np.ones(n, bool)  # a window may start here
        for d in np.flatnonzero(sizes > 0):
            valid[max(self.first[d], ends[d] - length + 1) : ends[d]] = False
        least = _sliding(h, w, np.minimum, (1 << 64) - 1)
        m = np.zeros(len(h), U)
        ok = valid[: len(h)]
        m[ok] = least[ok]
        at = self._least_of_some(h, m, w)
        run = np.flatnonzero(np.diff(m, prepend=~m[:1]) != 0)
        run_end = np.append(run[1:], len(m))
        value, code = np.unique(m[run], return_inverse=True)
        key = code * (n + 1) + run
        by = np.argsort(key)
        own = np.searchsorted(value, h[at])
        pos = np.searchsorted(key[by], own * (n + 1) + at, "right") - 1
        r = by[np.maximum(pos, 0)]
        doc = np.searchsorted(self.first, at, "right") - 1
        order = np.lexsort((at, own))
        following = np.full(len(at), 4 * n + 4 * w)
        same = (own[order][1:] == own[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        following[order[:-1][same]] = at[order[1:][same]]
        low = np.maximum(np.maximum(run[r], at - w + 1), self.first[doc])
        high = np.minimum(np.minimum(run_end[r] - 1, at), following - w)
        keep = (low <= high) & (m[run[r]] == h[at])
        self.at, self.low, self.high, self.doc = at[keep], low[keep], high[keep], doc[keep]
        self.name = mix(h[self.at] ^ SALT[0])  # anchors have small hashes, names any
        a, b = self.at - w + 1, self.at + gram + w - 1
        self.whole = (a >= self.first[self.doc]) & (b <= ends[self.doc])
        self.around, self.around_check = np.zeros(len(self.at), U), np.zeros(len(self.at), U)
        self.around[self.whole], self.around_check[self.whole] = self.digests(a[self.whole], b[self.whole])
        self.around[self.whole] ^= SALT[1]

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Both halves of the strong digests of spans."""
        raw = self.bytes.tobytes()
        return np.array([strong(raw[i:j]) for i, j in zip(start.tolist(), end.tolist(), strict=True)], U).reshape(-1, 2).T

    @staticmethod
    def _least_of_some(h: np.ndarray, m: np.ndarray, w: int) -> np.ndarray:
        """Positions p with m[s] == h[p] for some s in p - w + 1 to p; m is 0 where no window starts."""
        most = _sliding(np.concatenate([np.zeros(w - 1, U), m]), w, np.maximum, 0)[: len(h)]
        return np.flatnonzero(most == h)


def pack_windows(a: Anchors, of: np.ndarray, key: np.ndarray) -> bytes:
    """The windows of anchors ``of`` as bytes, with the row and the place that each stands at."""
    order = of[np.argsort(key, kind="stable")]
    at, low, high = a.at[order], a.low[order], a.high[order]
    text = a.bytes[expand(low, high + a.length - low)].tobytes()
    head = np.diff(np.sort(key), prepend=0).tobytes() + (at - a.first[a.doc[order]]).astype(np.int64).tobytes() + np.stack([at - high, at - low]).astype(np.int32).tobytes()
    return np.array([len(of)], np.int64).tobytes() + zstandard.compress(head + text, 1)


def unpack_windows(raw: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    rest = zstandard.decompress(raw[8:])
    near, far = np.frombuffer(rest, np.int32, 2 * n, 16 * n).reshape(2, n).astype(np.int64)
    return np.cumsum(np.frombuffer(rest, np.int64, n)), np.frombuffer(rest, np.int64, n, 8 * n), near, far, np.frombuffer(rest, np.uint8, -1, 24 * n)


class Part:
    """Windows around anchors in suffix order.

    Occurrence i has the bytes ``text[start[i]:]``, of its windows and no further; ``far[i]`` bytes of them come before
    its anchor, and its windows begin ``near[i]`` to ``far[i]`` bytes before it.
    """

    def __init__(self, text: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> None:
        self.text, self.near, self.far, self.length = text, near, far, length
        self.size = far - near + length
        self.start = np.cumsum(self.size) - self.size
        raw, anchor, end = text.tobytes(), (self.start + far).tolist(), (self.start + self.size).tolist()
        right = [raw[i:j] for i, j in zip(anchor, end, strict=True)]
        self.order = np.array(sorted(range(len(near)), key=right.__getitem__), np.int64)
        self.common = self._common_prefixes()

    def _common_prefixes(self) -> np.ndarray:
        """For each place in the order of the suffixes at anchors the bytes shared with the one before it."""
        out = np.zeros(len(self.order), np.int64)
        anchor, most = self.start + self.far, self.size - self.far
        columns = np.arange(self.length)
        for lo in range(1, len(self.order), 1024):
            a, b = self.order[lo - 1 : lo + 1023], self.order[lo : lo + 1024]
            a = a[: len(b)]
            within = np.minimum(most[a], most[b])
            x, y = (self.text[np.minimum(anchor[i][:, None] + columns, len(self.text) - 1)] for i in (a, b))
            differ = (x != y) | (columns >= within[:, None])
            out[lo : lo + len(b)] = np.where(differ.any(1), differ.argmax(1), self.length)
        return out

    def factors(self, place: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences with windows that have a previous factor of full length, or with ``later`` a next one too.

        With each the least and the greatest distance of these windows from its anchor. ``place`` orders the occurrences
        by their positions in the corpus.
        """
        return self.factors_of(place, (later,))[0]

    def factors_of(self, place: np.ndarray, kinds: tuple[bool, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``factors`` for each of several ``later``, of one suffix order."""
        m = len(self.order)
        least, greatest = np.full((len(kinds), m), self.length), np.full((len(kinds), m), -1)
        rank = np.empty(m, np.int64)
        rank[self.order] = np.arange(m)
        order, left = self.order, np.zeros(m, np.int64)  # in suffix order, and numbers of equal bytes before the anchor
        anchor = self.start + self.far
        for j in range(int(self.far.max(initial=-1)) + 1):
            if j:
                has = self.far[order] >= j
                order, left = order[has], left[has]
                byte = self.text[anchor[order] - j]
                by = np.argsort(byte, kind="stable")
                order, left, byte = order[by], left[by], byte[by]
                left = np.cumsum(np.append(True, (byte[1:] != byte[:-1]) | (left[1:] != left[:-1]))) if len(by) else left
            own = self.near[order] <= j
            if np.count_nonzero(own) < 2:
                continue
            some = order[own]
            alike = np.cumsum(self.common < self.length - j)[rank[some]]  # equal for suffixes at anchors with so long a common prefix
            run = np.cumsum(np.append(True, (alike[1:] != alike[:-1]) | (left[own][1:] != left[own][:-1])))
            before = smaller_in_run(run, place[some])
            after = smaller_in_run(run, m - 1 - place[some]) if any(kinds) else before
            for k, later in enumerate(kinds):
                found = some[before | after] if later else some[before]
                least[k, found] = np.minimum(least[k, found], j)
                greatest[k, found] = j
        which = [np.flatnonzero(g >= 0) for g in greatest]
        return [(x, least[k, x], greatest[k, x]) for k, x in enumerate(which)]


def smaller_in_run(run: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a smaller place comes before, or after, in the same run of the suffix order: the previous and next smaller positions."""
    if not len(run):
        return np.zeros(0, bool)
    span = int(place.max()) + 1
    before, after = place - run * span, (place + run * span)[::-1]  # runs are apart, so that what is least so far is of one run
    out = np.minimum.accumulate(before) < before
    return out | (np.minimum.accumulate(after) < after)[::-1]


def factors(t: pa.Table, length: int, later: bool = True) -> pa.Table:
    """Per row key the ranges of bytes that windows with factors of full length cover.

    The windows of one occurrence of an anchor overlap, so those that have factors cover one range.
    """
    return factors_of(t, length, (later,))[0]


def factors_of(t: pa.Table, length: int, kinds: tuple[bool, ...]) -> list[pa.Table]:
    """``factors`` for each of several ``later``."""
    key, at, near, far, text = (np.concatenate(x) for x in zip(*map(unpack_windows, t.column("data").to_pylist()), strict=True))
    place = np.empty(len(key), np.int64)
    place[np.lexsort((at, key))] = np.arange(len(key))
    found = Part(text, near, far, length).factors_of(place, kinds)
    return [by_key(key[which], ("starts", "ends"), at[which] - greatest, at[which] - least + length) for which, least, greatest in found]


def dealt(gather: Gather) -> list[tuple]:
    got = gather.take()
    return [(3, w, x, None, None, None, None, None, None) for w, x in zip(*(got.column(c).to_pylist() for c in ("bucket", "data")), strict=True)] if got is not None else []


def pass_two(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    cols = zip(*rows, strict=True) if rows else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["tag", "bucket", "data", "key", "doc_id", "text", "n_bytes", "digest", "later"])


PASS_TWO = "tag int, bucket int, data binary, key long, doc_id long, text string, n_bytes long, digest string, later binary"


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, heavy: int = HEAVY, count_later: bool = False) -> DataFrame:
    """Per row its bytes, those removed, the runs they form, and the digest of the rest.

    With ``count_later`` also n_later, the bytes that ``keep_first`` removes: of the copies after the first, by row key and
    position, rows without a doc_id first. Rows of one doc_id share a row key, so that what is counted for one is for each.
    """
    kinds = (keep_first, True) if count_later else (keep_first,)  # whether first copies stay
    spark = docs.sparkSession
    small_batches(spark)
    docs = texts_of(docs).withColumn("key", F.coalesce("doc_id", -F.shiftrightunsigned(F.xxhash64("text"), 2) - 1))
    n = buckets(docs)
    w = length - gram + 1

    def batch(b: pa.RecordBatch, texts: str = "text") -> Iterator[tuple[list[int], list[str | None], int]]:
        at = 0
        for keys, some in pieces(b.column("key").to_pylist(), b.column(texts).to_pylist()):
            yield keys, some, at
            at += len(keys)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(n, repeats=True)
        for b in batches:
            for keys, texts, _ in batch(b):
                a = Anchors(texts, length, gram)
                k = np.array(keys, np.int64)
                gather.add(a.name, k[a.doc])
                gather.add(a.around[a.whole], k[a.doc[a.whole]], a.around_check[a.whole])
                if gather.full():
                    yield gather.take()
        if (last := gather.take()) is not None:
            yield last

    repeated = stored(by_buckets(docs.select("key", "text").mapInArrow(name, BLOB), docs).applyInArrow(lambda t: shared(t, least=heavy), FOUND), "anchors")
    heaviest = spark.sparkContext.broadcast(heavy_names(repeated, heavy, SHARE))
    told = repeated.filter("key is not null").groupBy("key").agg(F.collect_list("names").alias("names"), F.collect_list("earlier").alias("earlier"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(n, repeats=True)
        for b in batches:
            ids, names, earlier = (b.column(c).to_pylist() for c in ("doc_id", "names", "earlier"))
            out: list[tuple] = []
            for keys, texts, at in batch(b):
                hit = [k for k in range(len(keys)) if names[at + k]]
                for k in range(len(keys)):
                    if not names[at + k]:
                        raw = (texts[k] or "").encode("utf-8", "surrogatepass")
                        out.append((0, None, None, None, ids[at + k], None, len(raw), hashlib.sha256(raw).hexdigest(), None))
                if not hit:
                    continue
                a = Anchors([texts[k] for k in hit], length, gram)
                own = mix(np.arange(len(hit), dtype=U) + U(1))
                got = [np.frombuffer(b"".join(names[at + k]), U) for k in hit]
                known = mix(np.concatenate(got) + np.repeat(own, [len(g) for g in got]))
                before = np.frombuffer(b"".join(x for k in hit for x in earlier[at + k]), np.uint8).astype(bool)
                order = np.argsort(known)
                known, before = known[order], before[order]

                def lookup(asked: np.ndarray, of: np.ndarray, known: np.ndarray = known, own: np.ndarray = own) -> tuple[np.ndarray, np.ndarray]:
                    keyed = mix(asked + own[of])
                    j = np.minimum(np.searchsorted(known, keyed), len(known) - 1)
                    return known[j] == keyed, j

                some, _ = lookup(a.name, a.doc)
                around, j = lookup(a.around, a.doc)
                around &= a.whole
                gone = [around & before[j] if first else around for first in kinds]
                # of equal surroundings only those of the least row key are looked into, once a text
                chosen = np.zeros(len(a.at), bool)
                chosen[np.unique(mix(a.around + own[a.doc]), return_index=True)[1]] = True
                of = np.flatnonzero(some & (~around | ~before[j] & (chosen | any(kinds))))
                numbers = np.array([keys[k] for k in hit], np.int64)
                single = np.isin(a.name[of], heaviest.value)
                at_once, of = of[single], of[~single]
                start = expand(a.low[at_once], a.high[at_once] - a.low[at_once] + 1)
                if len(start):
                    gather.add(fixed(a.bytes, length)[start] ^ SALT[3], numbers[np.repeat(a.doc[at_once], a.high[at_once] - a.low[at_once] + 1)], a.digests(start, start + length)[0])
                for bucket, x in by_bucket(a.name[of], n):
                    out.append((1, bucket, pack_windows(a, of[x], numbers[a.doc[of[x]]]), None, None, None, None, None, None))
                settled = [cover(len(a.bytes), a.at[g] - w + 1, a.at[g] + gram + w - 1) for g in gone]
                for d, k in enumerate(hit):
                    edges = [np.diff(s[a.first[d] : a.first[d + 1]].astype(np.int8), prepend=0, append=0) for s in settled]
                    ranges = [np.stack([np.flatnonzero(e == 1), np.flatnonzero(e == -1)]).astype(np.int32).tobytes() for e in edges]
                    out.append((2, None, ranges[0], keys[k], ids[at + k], texts[k], len(a.raw[d]), None, ranges[1] if count_later else None))
            yield pass_two(out)
            if gather.full():
                yield pass_two(dealt(gather))
        yield pass_two(dealt(gather))

    path = shared_path(spark, "factors")
    docs.join(told, "key", "left").select("key", "doc_id", "text", "names", "earlier").mapInArrow(settle, PASS_TWO).write.partitionBy("tag").option("compression", "zstd").parquet(path)
    part = spark.read.schema(PASS_TWO).parquet(path)
    none = F.lit(0).cast("long")
    counts = ["n_removed", "n_spans", "n_later"] if count_later else ["n_removed", "n_spans"]
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *counts[2:]]
    plain = part.filter("tag = 0").select("doc_id", "n_bytes", *(none.alias(c) for c in counts), F.col("digest").alias("kept_sha256")).select(columns)

    def look(t: pa.Table) -> pa.Table:
        found = factors_of(t, length, tuple(not first for first in kinds))
        return pa.concat_tables([f.append_column("kind", pa.array([k] * len(f), pa.int32())) for k, f in enumerate(found)])

    found = by_buckets(part.filter("tag = 1").select("bucket", "data"), docs).applyInArrow(look, "key long, starts binary, ends binary, kind int")
    lists = [F.collect_list(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}") for k in range(len(kinds)) for c in ("starts", "ends")]
    told_again = found.groupBy("key").agg(*lists)

    singly = by_buckets(part.filter("tag = 3").select("bucket", "data"), docs).applyInArrow(lambda t: shared(t), FOUND).groupBy("key").agg(F.collect_list("names").alias("names"), F.collect_list("earlier").alias("earlier"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, runs, digests, later = [], [], [], []
            for text, names, earlier, *rest in zip(*(b.column(c).to_pylist() for c in ("text", "names", "earlier", *parts)), strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                ones = [np.zeros(0, np.int64)] * len(kinds)
                if names:
                    start = np.arange(len(raw) - length + 1)
                    own = fixed(raw, length) ^ SALT[3]
                    known, before = np.frombuffer(b"".join(names), U), np.frombuffer(b"".join(earlier), np.uint8) > 0
                    same = np.isin(own, known)
                    stays = np.zeros(len(own), bool)  # the first of a name that no earlier row has
                    first = np.unique(own, return_index=True)[1]
                    stays[first[~np.isin(own[first], known[before])]] = True
                    ones = [start[same & ~stays] if k else start[same] for k in kinds]
                gone = []
                for k, one in enumerate(ones):
                    ranges, begin, end = rest[3 * k : 3 * k + 3]
                    starts, ends = np.frombuffer(ranges, np.int32).reshape(2, -1).astype(np.int64)
                    starts, ends = (np.concatenate([x, np.frombuffer(b"".join(y or []), np.int64)]) for x, y in ((starts, begin), (ends, end)))
                    gone.append(cover(len(raw), np.concatenate([starts, one]), np.concatenate([ends, one + length])))
                removed.append(int(gone[0].sum()))
                runs.append(int((np.diff(gone[0].astype(np.int8), prepend=0) == 1).sum()))
                digests.append(hashlib.sha256(raw[~gone[0]].tobytes()).hexdigest())
                later.append(int(gone[-1].sum()))
            out = [b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(later, pa.int64())]
            yield pa.RecordBatch.from_arrays(out[: len(columns)], names=columns)

    parts = ["data", "starts_0", "ends_0", "later", "starts_1", "ends_1"][: 3 * len(kinds)]
    rest = part.filter("tag = 2").select("key", "doc_id", "text", "n_bytes", "data", "later").join(told_again, "key", "left").join(singly, "key", "left")
    return plain.unionByName(rest.select("doc_id", "text", "n_bytes", "names", "earlier", *parts).mapInArrow(remove, ", ".join(f"{c} {'string' if c == 'kept_sha256' else 'long'}" for c in columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), count_later=True)
