"""Benchmark decontamination by winnowing.

Of each run of ``window - gram + 1`` word k-grams the one with the least hash is kept, the last among equals.
A span of ``window`` words that a document shares with an item holds the same run in both, hence the same
kept k-gram: the fingerprints of documents and items meet on every shared span. Each hit is extended word
by word to the left and right; a common run of ``window`` words or more is contamination. Items of fewer
words are one window each, looked up by the hash of the whole.

The benchmark goes to the executors if its text is within ``broadcast_bytes``; beyond that, document and
item fingerprints are joined, and only documents and items that share one are compared. Both give the same rows.

Nulls have no words. Repeated item rows count once by item_id; items without item_id mark words but are not listed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import ALNUM_LOWER, U, Words, cover, fixed, pieces, runs, small_batches, spans, table, texts_of

GRAM, WINDOW = 5, 10
BROADCAST_BYTES = 16 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_starts array<int>, hit_ends array<int>"


def winnow(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the kept k-grams, and their hashes."""
    start = runs(words.first, words.counts, window)
    if not len(start):
        return start, np.zeros(0, U)
    n = len(words.hash)
    h = np.full(n, ~U(0), U)
    h[: n - gram + 1] = fixed(words.hash, gram)
    best, where = h[start], start.copy()
    for j in range(1, window - gram + 1):
        other = h[start + j]
        take = other <= best
        best = np.where(take, other, best)
        where[take] = start[take] + j
    kept = np.unique(where)
    return kept, h[kept]


class Items:
    """The benchmark's words and fingerprints, ready to be looked up."""

    def __init__(self, ids: list[str | None], texts: list[str | None], gram: int, window: int) -> None:
        self.ids, self.gram, self.window = ids, gram, window
        w = Words(texts, ALNUM_LOWER)
        self.first, self.counts, self.hash = w.first, w.counts, w.hash
        at, prints = winnow(w, gram, window)
        order = np.argsort(prints, kind="stable")
        self.prints, self.at = prints[order], at[order]
        self.item_of = np.searchsorted(w.first, self.at, "right") - 1
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i in np.flatnonzero((w.counts > 0) & (w.counts < window)):
            a = w.first[i : i + 1]
            self.short[int(w.counts[i])][int(spans(w.hash, a, a + w.counts[i])[0])].append(int(i))

    def hits(self, w: Words) -> dict[int, list[tuple[int, int, int]]]:
        """For each text of w that has some: (item, start, end) of common runs, in words of the batch."""
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        at, prints = winnow(w, self.gram, self.window)
        if len(self.prints) and len(prints):
            lo = np.searchsorted(self.prints, prints)
            found = np.flatnonzero(self.prints[np.minimum(lo, len(self.prints) - 1)] == prints)
            hi = np.searchsorted(self.prints, prints[found], "right")
            done: dict[tuple[int, int], int] = {}
            for p, a, b in zip(at[found].tolist(), lo[found].tolist(), hi.tolist(), strict=True):
                d = int(np.searchsorted(w.first, p, "right")) - 1
                for k in range(a, b):
                    i, q = int(self.item_of[k]), int(self.at[k])
                    if done.get((i, p - q, d), -1) > p:
                        continue
                    s, e = common(w.hash, int(w.first[d]), int(w.first[d + 1]), p, self.hash, int(self.first[i]), int(self.first[i + 1]), q)
                    done[i, p - q, d] = e
                    if e - s >= self.window:
                        out[d].append((i, s, e))
        for m, known in self.short.items():
            start, h = w.grams(m)
            for x in np.flatnonzero(np.isin(h, np.fromiter(known, U, len(known)))):
                s = int(start[x])
                d = int(np.searchsorted(w.first, s, "right")) - 1
                out[d] += [(i, s, s + m) for i in known[int(h[x])] if (w.hash[s : s + m] == self.hash[self.first[i] : self.first[i] + m]).all()]
        return out


def common(a: np.ndarray, a0: int, a1: int, p: int, b: np.ndarray, b0: int, b1: int, q: int) -> tuple[int, int]:
    """The longest run through a[p] and b[q] that is equal in both, as positions in a."""
    back = min(p - a0, q - b0)
    on = min(a1 - p, b1 - q)
    left = np.flatnonzero(a[p - back : p][::-1] != b[q - back : q][::-1])
    right = np.flatnonzero(a[p : p + on] != b[q : q + on])
    return p - (int(left[0]) if len(left) else back), p + (int(right[0]) if len(right) else on)


def rows(ids: list[int], w: Words, hits: dict[int, list[tuple[int, int, int]]], names: list[str | None]) -> pa.RecordBatch:
    n_hit, n_items, digests, items, starts, ends = [0] * len(ids), [0] * len(ids), [hashlib.sha256(b"").hexdigest()] * len(ids), [[] for _ in ids], [[] for _ in ids], [[] for _ in ids]
    for d, found in hits.items():
        f = int(w.first[d])
        s, e = np.array([x[1] - f for x in found]), np.array([x[2] - f for x in found])
        flags = cover(int(w.counts[d]), s, e)
        edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
        starts[d], ends[d] = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
        items[d] = sorted({names[x[0]] for x in found if names[x[0]] is not None})
        n_hit[d], n_items[d], digests[d] = int(flags.sum()), len(items[d]), hashlib.sha256(",".join(items[d]).encode()).hexdigest()
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(w.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(items, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_starts", "hit_ends"],
    )


def _items(benchmark: DataFrame, most: int):
    """The benchmark's items, and these as a broadcast if their text is within ``most`` bytes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most:
        return items, None
    known = items.distinct().collect()
    return items, benchmark.sparkSession.sparkContext.broadcast(([r[0] for r in known], [r[1] for r in known]))


def clean(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs, all columns, without a contaminated word; rows are judged one by one, whatever their ids."""
    small_batches(docs.sparkSession)
    _, held = _items(benchmark, broadcast_bytes)
    if held is None:
        # the text alone decides, so its hash stands for the row: ids may be null or repeated
        own = F.xxhash64(docs["text"].cast("string"))
        bad = decontaminate(docs.select(own.alias("doc_id"), "text"), benchmark, gram, window, broadcast_bytes).filter("contaminated").select(F.col("doc_id").alias("__contaminated")).distinct()
        return docs.join(bad, own == bad["__contaminated"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(*held.value, gram, window)
        for b in batches:
            at = 0
            for ids, texts in pieces([None] * b.num_rows, b.column("text").to_pylist()):
                hit = index.hits(Words(texts, ALNUM_LOWER))
                yield b.slice(at, len(ids)).filter(pa.array([not hit.get(d) for d in range(len(ids))], pa.bool_()))
                at += len(ids)

    return docs.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each document the words that lie in any window of the benchmark, and the items they come from."""
    small_batches(docs.sparkSession)
    items, held = _items(benchmark, broadcast_bytes)
    if held is None:
        return _joined(texts_of(docs), items, gram, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(*held.value, gram, window)
        for b in batches:
            for ids, texts in pieces(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = Words(texts, ALNUM_LOWER)
                yield rows(ids, w, index.hits(w), index.ids)

    return texts_of(docs).mapInArrow(run, SCHEMA)


def _joined(docs: DataFrame, items: DataFrame, gram: int, window: int) -> DataFrame:
    """The way for a benchmark of any size: fingerprints meet in a join, then pairs of texts are compared.

    Documents get a row number, so that repeated doc_ids stay apart.
    """
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    items = items.distinct().withColumn("row", F.xxhash64("item_id", "text"))
    lengths = sorted(r[0] for r in items.select(F.size(F.array_compact(F.split(F.regexp_replace(F.lower("text"), "[^0-9a-z\\x{80}-\\x{10FFFF}]+", " "), " "))).alias("n")).filter(F.col("n") < window + 2).distinct().collect())
    lengths = [m for m in range(1, window) if any(m <= n <= m + 2 for n in lengths)]  # outer blanks may add up to two

    def prints(frame: DataFrame, whole: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, texts in pieces(b.column("row").to_pylist(), b.column("text").to_pylist()):
                    w = Words(texts, ALNUM_LOWER)
                    at, h = winnow(w, gram, window)
                    found = [(at, h)]
                    for m in lengths:
                        s, g = w.grams(m)
                        own = w.counts[np.searchsorted(w.first, s, "right") - 1] == m if whole else np.ones(len(s), bool)
                        found.append((s[own], mix_length(g[own], m)))
                    at, h = (np.concatenate(x) for x in zip(*found, strict=True))
                    got = np.unique(np.stack([np.array(ids, np.int64)[np.searchsorted(w.first, at, "right") - 1], h.view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["row", "print"])

        return frame.select("row", "text").mapInArrow(run, "row long, print long")

    pairs = prints(docs, False).withColumnRenamed("row", "doc_row").join(prints(items, True).withColumnRenamed("row", "item_row"), "print").select("doc_row", "item_row").distinct()
    sides = pairs.join(items.select(F.col("row").alias("item_row"), "item_id", F.col("text").alias("item_text")), "item_row").join(docs.select(F.col("row").alias("doc_row"), "text").dropDuplicates(["doc_row"]), "doc_row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r, i, t, x in zip(*(b.column(c).to_pylist() for c in ("doc_row", "item_id", "item_text", "text")), strict=True):
                for found in Items([i], [t], gram, window).hits(Words([x], ALNUM_LOWER)).values():
                    out += [(r, i, s, e) for _, s, e in found]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_row", "item_id", "s", "e"), o, strict=True)) for o in out], schema=pa.schema([("doc_row", pa.int64()), ("item_id", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))

    found = sides.select("doc_row", "item_id", "item_text", "text").mapInArrow(compare, "doc_row long, item_id string, s int, e int").groupBy("doc_row").agg(F.collect_set(F.struct("item_id", "s", "e")).alias("found"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, found = (b.column(c).to_pylist() for c in ("doc_id", "text", "found"))
            at = 0
            for part, some in pieces(ids, texts):
                w = Words(some, ALNUM_LOWER, hashes=False)
                names = sorted({x["item_id"] for f in found[at : at + len(part)] for x in f or [] if x["item_id"] is not None})
                where = {n: k for k, n in enumerate(names)} | {None: len(names)}
                hits = {d: [(where[x["item_id"]], int(w.first[d]) + x["s"], int(w.first[d]) + x["e"]) for x in f] for d, f in enumerate(found[at : at + len(part)]) if f}
                at += len(part)
                yield rows(part, w, hits, [*names, None])

    return docs.join(found, docs.row == found.doc_row, "left").select("doc_id", "text", "found").mapInArrow(mark, SCHEMA)


def mix_length(h: np.ndarray, m: int) -> np.ndarray:
    """Fingerprints of whole short items, apart from those of k-grams."""
    return h ^ U(m * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents without any contaminated word stay."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
