"""Removal of repeated word windows by recompression.

A text's words are symbols. In each round the alphabet is split in two by a bit of each symbol's name, and each
left symbol with a right one behind it becomes a new symbol; from the third round on, runs of one symbol become
one first. A name is a hash of what it stands for, 64 bits and 64 to check, so all executors give equal content the same name without
asking each other, and Spark's rounds only have to find which names are shared, and by which first document.
Whether two symbols join depends on these two alone. Equal word sequences therefore get equal symbols inside, but
for a margin of three words at each end after two rounds.

Round one: each window of words takes as its anchor the symbol of the second round, with its margins, that has the
least hash among those the window holds; equal windows have equal anchors. Anchors and the longer symbols of high
rounds are named, and Spark finds the names that several documents share. A long symbol that an earlier document
has settles all windows within it. Round two: windows that are not settled but whose anchor is shared are named
themselves. What is left has no equal anywhere. A long symbol, a window and a whole text remove words only if all 128 bits
of their names are equal.

Names travel packed and are aggregated first: see ``names``. Null text has no words; rows without doc_id neither remove nor lose words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import BLOB, FOUND, Gather, shared
from .shared import shared_path
from .words import SPACED, U, Words, buckets, by_buckets, cover, joined, mix, pieces, runs, small_batches, spans, splitmix, strong, table, texts_of

WINDOW, MARGIN = 13, 3
#: Rounds whose symbols are looked up as long repeats.
LONG = (11, 15, 19)
SALTS = splitmix(64, 11)


class Parse:
    """Symbols of a batch of texts: name, first word, word after the last, and the text they are in.

    The name alone decides what is joined; ``check`` names the same content by further 64 bits.
    """

    def __init__(self, words: Words) -> None:
        self.name, self.check = words.hash, words.check
        self.start = np.arange(len(words.hash))
        self.end = self.start + 1
        self.doc = words.doc_of()
        self.round = 0

    def advance(self) -> None:
        """One round of run and pair naming."""
        r = self.round = self.round + 1
        if r > 2 and len(self.name):
            head = np.ones(len(self.name), bool)
            head[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
            at = np.flatnonzero(head)
            n = np.diff(np.append(at, len(self.name)))
            many = n > 1
            name, check = (np.where(many, mix(x[at] * U(0x9FB21C651E98DF25) + n.astype(U)), x[at]) for x in (self.name, self.check))
            self._take(at, name, check, self.end[at + n - 1])
        right = (mix(self.name ^ SALTS[r]) & U(1)).astype(bool)
        join = np.zeros(len(self.name), bool)
        join[:-1] = ~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1])
        head = np.ones(len(self.name), bool)
        head[1:] = ~join[:-1]
        at = np.flatnonzero(head)
        pair = join[at]
        name, check, end = self.name[at], self.check[at], self.end[at]
        two = at[pair]
        name[pair] = joined(self.name[two] + SALTS[r], self.name[two + 1])
        check[pair] = joined(self.check[two] + SALTS[32 + r], self.check[two + 1])
        end[pair] = self.end[two + 1]
        self._take(at, name, check, end)

    def _take(self, at: np.ndarray, name: np.ndarray, check: np.ndarray, end: np.ndarray) -> None:
        self.name, self.check, self.start, self.end, self.doc = name, check, self.start[at], end, self.doc[at]


class Plan:
    """Windows, their anchors, and long symbols of a batch."""

    def __init__(self, texts: list[str | None], window: int) -> None:
        self.words = w = Words(texts, SPACED)
        self.window = window
        self.at = runs(w.first, w.counts, window)
        p = Parse(w)
        p.advance()
        p.advance()
        self._anchors(p)
        long = []
        while p.round < LONG[-1] and len(self.at):
            p.advance()
            if p.round in LONG:
                keep = p.end - p.start >= window
                long.append((p.name[keep] ^ SALTS[30], p.start[keep], p.end[keep], p.doc[keep], p.check[keep]))
        whole = np.flatnonzero(w.counts >= window)  # what further rounds would end in: one symbol for each text
        a, b = w.first[whole], w.first[whole + 1]
        name = np.array([strong(b" ".join(w.of(d))) for d in whole], U).reshape(-1, 2)
        long.append((name[:, 0] ^ SALTS[31], a, b, whole, name[:, 1]))
        self.long = [np.concatenate(x) for x in zip(*long, strict=True)]

    def _anchors(self, p: Parse) -> None:
        w, n = self.words, len(self.words.hash)
        inside = (p.start - MARGIN >= w.first[p.doc]) & (p.end + MARGIN <= w.first[p.doc + 1])
        start, end = p.start[inside], p.end[inside]
        self.named = spans(w.hash, start - MARGIN, end + MARGIN)
        after = np.searchsorted(start, np.arange(n + 1))  # the first symbol that starts at a word or later
        best = np.full(len(self.at), ~U(0), U)
        which = np.full(len(self.at), -1)
        first, last = after[np.minimum(self.at + MARGIN, n)], self.at + self.window - MARGIN
        for c in range(self.window - 2 * MARGIN):
            j = first + c
            ok = j < len(start)
            j = np.minimum(j, max(len(start) - 1, 0))
            if not len(start):
                break
            ok &= end[j] <= last
            ok &= self.named[j] <= best
            best = np.where(ok, self.named[j], best)
            which[ok] = j[ok]
        self.anchor = which
        self.used = np.unique(which)
        self.anchor_doc = np.searchsorted(w.first, start, "right") - 1

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names to look up, the text of each, and what checks those of long symbols; anchors only point to candidates."""
        named = self.named[self.used]
        return np.concatenate([named, self.long[0]]), np.concatenate([self.anchor_doc[self.used], self.long[3]]), np.concatenate([np.zeros(len(named), U), self.long[4]])

    def windows(self, shared: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flags of words in settled windows, and the windows left to look up; the flags are of names()."""
        n, a = len(self.words.hash), len(self.used)
        long = earlier[a:]
        settled = cover(n, self.long[1][long], self.long[2][long])
        known = np.zeros(len(self.named), bool)
        known[self.used] = shared[:a]
        reach = np.zeros(n + 1, np.int64)  # how far the settled symbols that start at a word or before reach
        np.maximum.at(reach, self.long[1][long], self.long[2][long])
        reach = np.maximum.accumulate(reach)
        left = known[self.anchor] & (reach[self.at] < self.at + self.window)
        return settled, self.at[left]


def _texts(texts: list[str | bytes | None], ids: list[int | None]) -> Iterator[tuple[list[int | None], list[str | bytes | None], int]]:
    at = 0
    for part, some in pieces(ids, texts):
        yield part, some, at
        at += len(part)


def kept_digest(words: list[bytes], gone: np.ndarray) -> str:
    return hashlib.sha256(b" ".join(compress(words, (~gone).tolist()))).hexdigest()


def dealt(gather: Gather) -> list[tuple]:
    got = gather.take()
    return [(1, w, x, None, None, None, None, None) for w, x in zip(*(got.column(c).to_pylist() for c in ("bucket", "data")), strict=True)] if got is not None else []


def pass_two(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
    cols = zip(*rows, strict=True) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["tag", "bucket", "data", "doc_id", "text", "n_words", "n_removed", "digest"])


PASS_TWO = "tag int, bucket int, data binary, doc_id long, text binary, n_words long, n_removed long, digest string"


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row the words removed because an earlier document has their window, and the digest of the rest.

    A window takes 13 words at least: a symbol of the second round has up to four, starts within any four words, and needs
    three on either side.
    """
    if window < 2 * MARGIN + 7:
        raise ValueError(f"windows have {2 * MARGIN + 7} words at least: {window}")
    spark = docs.sparkSession
    small_batches(spark)
    docs = texts_of(docs)
    n = buckets(docs)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(n)
        for b in batches:
            for ids, texts, _ in _texts(b.column("text").to_pylist(), b.column("doc_id").to_pylist()):
                some = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None]
                plan = Plan([t for _, t in some], window)
                names, of, checks = plan.names()
                gather.add(names, np.array([i for i, _ in some], np.int64)[of], checks)
                if gather.full():
                    yield gather.take()
        if (last := gather.take()) is not None:
            yield last

    met = by_buckets(docs.mapInArrow(name, BLOB), docs).applyInArrow(lambda t: shared(t), FOUND)
    told = met.groupBy(F.col("key").alias("doc_id")).agg(F.collect_list("names").alias("names"), F.collect_list("earlier").alias("earlier"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [zstandard.compress((t or "").encode("utf-8", "surrogatepass").translate(SPACED), 3) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(n)
        for b in batches:
            names, earlier, raw = (b.column(c).to_pylist() for c in ("names", "earlier", "text"))
            out: list[tuple] = []
            for ids, texts, at in _texts([zstandard.decompress(x) for x in raw], b.column("doc_id").to_pylist()):
                mine = range(at, at + len(ids))
                hit = [k for k in mine if names[k]]
                for k in mine:
                    if not names[k]:
                        words = texts[k - at].split()
                        out.append((0, None, None, ids[k - at], None, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()))
                if not hit:
                    continue
                plan = Plan([texts[k - at] for k in hit], window)
                asked, of, _ = plan.names()
                keys = mix(asked + mix(of.astype(U) + U(1)))
                got = [np.frombuffer(b"".join(names[k]), U) for k in hit]
                known = mix(np.concatenate(got) + np.repeat(mix(np.arange(len(hit), dtype=U) + U(1)), [len(g) for g in got]))
                before = np.frombuffer(b"".join(x for k in hit for x in earlier[k]), np.uint8).astype(bool)
                order = np.argsort(known)
                known, before = known[order], before[order]
                j = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                found = known[j] == keys
                settled, left = plan.windows(found, found & before[j])
                doc = np.searchsorted(plan.words.first, left, "right") - 1
                numbers = np.array([ids[k - at] for k in hit], np.int64)
                asked, checks = spans(plan.words.hash, left, left + window), spans(plan.words.check, left, left + window, 1)
                once = np.unique(mix(asked + mix(doc.astype(U) + U(1))), return_index=True)[1]  # a text that repeats itself asks once
                gather.add(asked[once], numbers[doc[once]], checks[once])
                open_ones = np.bincount(doc, minlength=len(hit))
                for d, k in enumerate(hit):
                    flags = settled[plan.words.first[d] : plan.words.first[d + 1]]
                    if open_ones[d]:
                        edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
                        ranges = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)]).astype(np.int32)
                        out.append((2, None, ranges.tobytes(), ids[k - at], raw[k], len(flags), None, None))
                    else:
                        out.append((0, None, None, ids[k - at], None, len(flags), int(flags.sum()), kept_digest(texts[k - at].split(), flags)))
            yield pass_two(out)
            if gather.full():
                yield pass_two(dealt(gather))
        yield pass_two(dealt(gather))

    path = shared_path(spark, "windows")
    packed = docs.mapInArrow(pack, "doc_id long, text binary")  # texts travel compressed
    told_docs = packed.join(told, "doc_id", "left").select("doc_id", "text", "names", "earlier")
    told_docs.mapInArrow(settle, PASS_TWO).write.partitionBy("tag").option("compression", "zstd").parquet(path)
    part = spark.read.schema(PASS_TWO).parquet(path)
    plain = part.filter("tag = 0").select("doc_id", "n_words", "n_removed", F.col("digest").alias("kept_sha256"))
    found = by_buckets(part.filter("tag = 1").select("bucket", "data"), docs).applyInArrow(lambda t: shared(t, True), FOUND).groupBy(F.col("key").alias("doc_id")).agg(F.collect_list("names").alias("names"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = [zstandard.decompress(x) for x in b.column("text").to_pylist()], 0
            ranges, known, removed, digests = b.column("data").to_pylist(), b.column("names").to_pylist(), [], []
            for _, some in pieces(raw, raw):
                w = Words(some, SPACED)
                start = runs(w.first, w.counts, window)
                name = spans(w.hash, start, start + window)
                edge = np.searchsorted(start, w.first)
                for d, text in enumerate(some):
                    starts, ends = np.frombuffer(ranges[at], np.int32).reshape(2, -1).astype(np.int64)
                    mine = slice(edge[d], edge[d + 1])
                    one = start[mine][np.isin(name[mine], np.frombuffer(b"".join(known[at] or []), U))] - w.first[d]
                    gone = cover(int(w.counts[d]), np.concatenate([starts, one]), np.concatenate([ends, one + window]))
                    removed.append(int(gone.sum()))
                    digests.append(kept_digest(text.split(), gone))
                    at += 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rest = part.filter("tag = 2").select("doc_id", "text", "n_words", "data").join(found, "doc_id", "left")
    return plain.unionByName(rest.select("doc_id", "text", "n_words", "data", "names").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
