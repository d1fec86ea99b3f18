"""Exact similarity join of word-shingle sets, with set-relation skipping.

Equal sets are one set under a digest of 128 bits; its first half names candidates. Two different sets whose Jaccard similarity reaches the threshold differ in at
most (a + b) * (1 - t) / (1 + t) shingles. Shingles are dealt by hash into one part more than that, so at least two
parts are equal in both: sets that share the hash of a part may link, all others can't. A set deals out only its fullest
parts, as many as may differ and one more, and those as full as the last of these. Sizes fall into classes, and a
set near the upper end of its class is dealt for the next class too, so that both sets of a pair are dealt alike. Sets
that share parts, directly or through others, form a cluster; a set's shingles go to its cluster once.

Within a cluster, sets are numbered by size, and inverted lists hold a token's sets by number, so that whole blocks of
sets too small or too large are skipped by position. Rare tokens come first in each set, and only prefixes are probed.
A set's overlaps with all others are derived from those of the most similar set that is already answered: only the
lists of the tokens in which the two differ are read. Every cluster of two sets or more is answered that way. Sets that
are one component already aren't compared.

A task joins its own sets that share a part before it deals parts out, so a part that very many sets have costs its bucket
one entry a task. Clusters above ``block`` sets are dealt to pairs of blocks, so no task holds more than two blocks. Links come out as a
spanning forest, never as all pairs. Null and wordless texts have empty sets and link with nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .names import FLUSH
from .shared import stored
from .words import SPACED_LOWER, U, Words, buckets, by_bucket, by_buckets, expand, mix, pieces, runs, small_batches, spans, splitmix, table, texts_of

SHINGLE, PERCENT, BLOCK = 3, 90, 4096
#: Of the pipeline's stage; SHINGLE and PERCENT are the contract of the query alone.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80
#: Clusters above a block up to which their sizes are broadcast, 16 bytes each.
LARGE = 200_000
#: Answered sets that others are derived from, a cluster; what is like none of them is read from whole lists.
ANSWERED = 32
SALTS = splitmix(256, 23)


class Sets:
    """Distinct shingles of each text of a batch, sorted, one text after another."""

    def __init__(self, texts: list[str | None], k: int) -> None:
        w = Words(texts, SPACED_LOWER)
        start = runs(w.first, w.counts, k)
        doc = np.searchsorted(w.first, start, "right") - 1
        few = np.flatnonzero((w.counts > 0) & (w.counts < k))
        begin, end = np.concatenate([start, w.first[few]]), np.concatenate([start + k, w.first[few + 1]])
        value = spans(w.hash, begin, end)
        doc = np.concatenate([doc, few])
        order = np.lexsort((value, doc))
        value, doc, second = value[order], doc[order], spans(w.check, begin, end, 1)[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        self.value, doc = value[new], doc[new]
        self.n = np.bincount(doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        # value by value, the digest of a set: its members' sum and count, mixed
        total = np.concatenate([[U(0)], np.cumsum(mix(self.value ^ SALTS[0]))])
        self.digest = mix(total[self.first[1:]] - total[self.first[:-1]] + self.n.astype(U) * SALTS[1]).view(np.int64)
        # 64 bits more, of other hashes of words and shingles: both together name a set
        total = np.concatenate([[U(0)], np.cumsum(mix(second[new] ^ SALTS[200]))])
        self.check = mix(total[self.first[1:]] - total[self.first[:-1]])

    def names(self) -> list[bytes]:
        """The sets' names, of 128 bits."""
        raw = np.stack([self.digest.view(U), self.check], axis=1).tobytes()
        return [raw[16 * i : 16 * i + 16] for i in range(len(self.n))]


def classes(percent: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper sizes of the classes in which different sets can link, and the parts of each."""
    a, b = 100 - percent, 100 + percent  # a pair differs in at most (size + size) * a / b shingles
    lows, highs, parts = [], [], []
    low = 1
    while low < most:
        high = max(low, low * 7 // 5)
        lows.append(low)
        highs.append(high)
        k = 2 * high * a // b + 2
        k += int(3 * k * np.exp(-high / k) * (1 + high / k))  # in place of those with no shingle or one
        parts.append(k if 2 * high * a // b else 0)
        low = high + 1
    return np.array(lows), np.array(highs), np.array(parts)


def signatures(s: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parts of each set, and the index of the set."""
    lows, highs, parts = classes(percent)
    own = np.searchsorted(lows, s.n, "right") - 1
    upper = own + 1
    near = 100 * s.n >= percent * lows[np.minimum(upper, len(lows) - 1)]
    sets = np.concatenate([np.flatnonzero(s.n > 0), np.flatnonzero((s.n > 0) & near)])
    kind = np.concatenate([own[s.n > 0], upper[(s.n > 0) & near]])
    ok = parts[kind] > 0
    sets, kind = sets[ok], kind[ok]
    if not len(sets):
        return np.zeros(0, U), sets
    k = parts[kind]
    at = expand(s.first[sets], s.n[sets])
    which = np.repeat(np.arange(len(sets)), s.n[sets])
    value = s.value[at]
    base = np.concatenate([[0], np.cumsum(k)])
    part = ((mix(value ^ SALTS[2 + kind[which]]) >> U(32)) * k[which].astype(U) >> U(32)).astype(np.int64)
    slot = base[which] + part
    order = np.argsort(slot, kind="stable")
    sums = np.concatenate([[U(0)], np.cumsum(mix(value[order] + SALTS[1]))])
    count = np.bincount(slot, minlength=base[-1])
    end = np.cumsum(count)
    total = sums[end] - sums[end - count]
    owner = np.repeat(np.arange(len(sets)), k)
    number = np.arange(base[-1]) - base[owner]
    name = mix(total + mix(number.astype(U) + (kind[owner].astype(U) << U(40)) + (count.astype(U) << U(48))))
    size = s.n[sets]
    differ = (size + np.minimum(highs[kind], 100 * size // percent)) * (100 - percent) // (100 + percent)
    # of the fullest parts, one more than may differ, one is equal; the other set deals it too, or has such a fuller one
    least = count[np.lexsort((-count, owner))][base[:-1] + differ]
    keep = count >= least[owner]
    return name[keep], sets[owner[keep]]


def stars(name: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least set of each part hash, and edges from the other sets that have it to that one, once each."""
    order = np.lexsort((of, name))
    name, of = name[order], of[order]
    head = np.flatnonzero(np.diff(name, prepend=~name[:1]))
    low = np.repeat(of[head], np.diff(np.append(head, len(name))))
    keep = low != of
    pair = np.unique(np.stack([of[keep], low[keep]]), axis=1)
    return name[head], of[head], pair[0], pair[1]


def shared_parts(t: pa.Table) -> pa.Table:
    """Edges of a bucket: those that tasks found among their own sets, and those between the least sets of tasks."""
    raw = [(x[0], np.frombuffer(x, U, -1, 1).reshape(2, -1)) for x in t.column("data").to_pylist()]
    none = [np.zeros((2, 0), U)]
    name, of = np.concatenate([x for k, x in raw if k == 0] or none, axis=1)
    a, b = np.concatenate([x for k, x in raw if k == 1] or none, axis=1).view(np.int64)
    _, _, c, d = stars(name, of.view(np.int64))
    return pa.table({"a": np.concatenate([a, c]), "b": np.concatenate([b, d])})


class Forest:
    """Union-find."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None, seen: Counter | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct sets; with sides, only of links between the two.

    ``seen`` counts the sets whose overlaps were read from whole lists and those that were derived from another set's.
    """
    m = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    side = None if sides is None else sides[order]
    first = np.concatenate([[0], np.cumsum(size)])
    tokens, token, df = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(tokens))
    token = rank[token]
    owner = np.repeat(np.arange(m), size)
    by = np.lexsort((token, owner))
    token = token[by]  # each set's tokens, rare ones first
    position = np.arange(len(token)) - first[owner]
    need = lambda a, b: -(-percent * (a + b) // (100 + percent))  # noqa: E731  the least overlap of a link
    prefix = size - -(-percent * size // 100) + 1
    key = np.sort(token * m + owner)  # inverted lists, by token and set number
    probe = position < prefix[owner]
    index_key, index_at = token[probe] * m + owner[probe], position[probe]
    by = np.argsort(index_key)
    index_key, index_at = index_key[by], index_at[by]

    def slices(keys: np.ndarray, t: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries of tokens t for sets lo to hi: the rest of each list is skipped as blocks."""
        a, b = np.searchsorted(keys, t * m + lo), np.searchsorted(keys, t * m + hi)
        return expand(a, b - a), np.repeat(np.arange(len(t)), b - a)

    forest, out = Forest(m), []
    answered: list[tuple[int, np.ndarray]] = []  # sets whose overlaps with all others are known
    for x in range(1, m):
        mine = token[first[x] : first[x + 1]]
        lo = int(np.searchsorted(size, -(-percent * size[x] // 100)))
        at, of = slices(index_key, mine[: prefix[x]], lo, x)
        y = index_key[at] % m
        room = 1 + np.minimum(size[x] - 1 - of, size[y] - 1 - index_at[at])
        y = np.unique(y[room >= need(size[x], size[y])])
        if side is not None:
            y = y[side[y] != side[x]]
        here = forest.root(x)
        if not len(y) or len(y) < 64 and all(forest.root(int(j)) == here for j in y):
            continue
        best = min(answered, key=lambda r: size[r[0]] - 2 * r[1][x], default=None)
        differ = size[x] + size[best[0]] - 2 * best[1][x] if best is not None else size[x]
        derived = best is not None and differ < size[x]
        if derived:
            other = token[first[best[0]] : first[best[0] + 1]]
            known = best[1].copy()
            for t, sign in ((np.setdiff1d(mine, other, assume_unique=True), 1), (np.setdiff1d(other, mine, assume_unique=True), -1)):
                e, _ = slices(key, t, 0, m)
                known += sign * np.bincount(key[e] % m, minlength=m)
        else:
            e, _ = slices(key, mine, 0, m)
            known = np.bincount(key[e] % m, minlength=m)
        if seen is not None:
            seen["derived" if derived else "read"] += 1
        if best is None or differ > 0.1 * size[x] and len(answered) < ANSWERED:
            answered.append((x, known))
        overlap = known[y]
        for j in y[100 * overlap >= percent * (size[x] + size[y] - overlap)]:
            if forest.link(x, int(j)):
                out.append((int(order[x]), int(order[j])))
    return out


def cluster_links(t: pa.Table, percent: int) -> pa.Table:
    """Links within each cluster, or pair of blocks, of a task."""
    group, block = (t.column(c).to_numpy() for c in ("part", "block"))
    ids, data = t.column("full").to_pylist(), t.column("data")
    out: list[tuple[bytes, bytes]] = []
    order = np.argsort(group, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(some) > 1:
            sides = block[some]
            mixed = len(np.unique(sides)) > 1
            found = links([np.frombuffer(data[int(i)].as_buffer(), U) for i in some], percent, sides if mixed else None)
            out += [(ids[some[i]], ids[some[j]]) for i, j in found]
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row the size of its set and the least doc_id that it reaches by links; rows without doc_id have that of the others, or none."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = texts_of(docs)
    n = buckets(docs)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in pieces(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                s = Sets(texts, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s.digest), pa.array(s.names(), pa.binary()), pa.array(s.n, pa.int64())], names=["doc_id", "set_id", "full", "n"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            name, of, a, b = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            where, blobs = [], []
            for kind, x, y, by in ((0, name, of, name), (1, a, b, mix(a.view(U)))):
                both = np.stack([x.view(U), y.view(U)])
                for k, at in by_bucket(by, n):
                    where.append(k)
                    blobs.append(bytes([kind]) + np.ascontiguousarray(both[:, at]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for _, texts in pieces(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                s = Sets(texts, shingle)
                name, of = signatures(s, percent)
                held.append((name, s.digest[of]))
                if sum(len(x) for x, _ in held) >= FLUSH:
                    yield dealt()
        if held:
            yield dealt()

    members = stored(docs.mapInArrow(digests, "doc_id long, set_id long, full binary, n long"), "sets")
    near = by_buckets(docs.mapInArrow(parts, "bucket int, data binary"), docs).applyInArrow(shared_parts, "a long, b long")
    clusters = components(near)
    clusters = stored(clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()), "clusters")
    # sizes matter for clusters of several blocks alone; these few are told to all tasks, so that no cluster's sets meet in one
    sizes = stored(clusters.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") > block), "sizes")
    told = F.broadcast(sizes) if sizes.count() <= LARGE else sizes
    none = F.lit((1 << 63) - 1)
    chosen = members.filter("n > 0").groupBy("set_id", "full").agg(F.min(F.coalesce("doc_id", none)).alias("key")).join(clusters.withColumnRenamed("node", "set_id"), "set_id").join(told, "root", "left").fillna(1, subset=["size"])
    with_text = docs.withColumn("key", F.coalesce("doc_id", none)).join(chosen, "key").select("text", "full", "root", "size")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for wanted, texts in pieces(b.column("full").to_pylist(), b.column("text").to_pylist()):
                s = Sets(texts, shingle)
                raw, rest = [s.value[i:j].tobytes() for i, j in zip(s.first[:-1], s.first[1:], strict=True)], b.slice(at, len(wanted))
                at += len(wanted)
                same = pa.array([x == y for x, y in zip(wanted, s.names(), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([rest.column("full"), rest.column("root"), rest.column("size"), pa.array(raw, pa.binary())], names=["full", "root", "size", "data"])
                yield out.filter(same)

    sets = with_text.mapInArrow(contents, "full binary, root long, size long, data binary")
    if members.filter("doc_id is null").limit(1).count():  # several rows share the key then
        sets = sets.dropDuplicates(["full"])
    blocks = F.ceil(F.col("size") / block)
    mine = F.pmod(F.xxhash64("full"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.struct(F.xxhash64("root", F.least(mine, other), F.greatest(mine, other)).alias("part")))
    dealt = sets.select("full", "data", mine.alias("block"), F.explode(pairs).alias("p")).select("full", "data", "block", F.col("p.part").alias("part")).withColumn("bucket", F.pmod("part", F.lit(4 * n)))
    found = by_buckets(dealt, docs).applyInArrow(lambda t: cluster_links(t, percent), "a binary, b binary")
    roots = components(stored(found, "links"))
    labelled = members.join(roots.withColumnRenamed("node", "full"), "full", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "full")))
    least = stored(labelled.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return labelled.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each group of linked documents that with the least doc_id stays; rows without doc_id stay."""
    worse = join(docs, STAGE_SHINGLE, STAGE_PERCENT).filter("component_id < doc_id").select(F.col("doc_id").alias("__worse")).distinct()
    return docs.join(worse, docs["doc_id"].cast("long") == worse["__worse"], "left_anti")
