"""Which names several rows have: a packed shuffle with aggregation before it.

A task that holds names with the rows they come from knows much by itself: if two of its rows have a name, that name is
shared, and all of them but the one of the least row key have it from an earlier row. Only this least row's entry has to
meet the entries of other tasks, in the bucket of the name. What is known already goes straight to the bucket of its row
key. A name that a third of all rows have thus costs its bucket one entry a task, however many rows there are.

What a name decides by itself rests on 128 bits: 64 of its own, which deal it to a bucket, and 64 to check, without which
names only point to candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, by_bucket, mix

#: Entries that a task gathers before it deals them out.
FLUSH = 1_000_000
BLOB = "bucket int, data binary"
FOUND = "key long, names binary, earlier binary"


def _pack(kind: int, names: np.ndarray, keys: np.ndarray, many: np.ndarray | None, checks: np.ndarray | None = None) -> bytes:
    rest = np.diff(keys, prepend=0).tobytes() + (many.tobytes() + checks.tobytes() if many is not None else b"")
    return np.array([kind, len(names)], np.int64).tobytes() + names.tobytes() + zstandard.compress(rest, 1)


def _unpack(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    rest = zstandard.decompress(raw[16 + 8 * n :])
    more = n if len(rest) > 8 * n else 0
    return kind, np.frombuffer(raw, U, n, 16), np.cumsum(np.frombuffer(rest, np.int64, n)), np.frombuffer(rest, np.uint32, more, 8 * n), np.frombuffer(rest, U, more, len(rest) - 8 * more)


def _heads(names: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where the next name begins."""
    if not len(names):
        return np.zeros(0, np.int64)
    return np.append(0, 1 + np.flatnonzero((names[1:] != names[:-1]) | (checks[1:] != checks[:-1])))


def deal(names: np.ndarray, keys: np.ndarray, checks: np.ndarray, n: int, repeats: bool = False) -> pa.RecordBatch:
    """Blobs of a task's entries: the least row's of each name by name; others by row.

    With ``repeats`` a name that one row has twice is shared, too.
    """
    order = np.lexsort((keys, checks, names))
    names, keys, checks = names[order], keys[order], checks[order]
    head = _heads(names, checks)
    count = np.diff(np.append(head, len(names)))
    first = np.repeat(keys[head], count)
    other = keys != first
    many = (count > 1 if repeats else np.add.reduceat(other, head) > 0) if len(head) else np.zeros(0, bool)
    many = many.astype(np.uint32) | np.minimum(count, (1 << 31) - 1).astype(np.uint32) << np.uint32(1)  # the number of entries above the flag
    where, blobs = [], []
    for b, of in by_bucket(names[head], n):
        of = of[np.argsort(keys[head][of], kind="stable")]
        where.append(b)
        blobs.append(_pack(0, names[head][of], keys[head][of], many[of], checks[head][of]))
    rest_names, rest_keys = names[other], keys[other]
    for b, of in by_bucket(mix(rest_keys.view(U)), n):
        of = of[np.argsort(rest_keys[of], kind="stable")]
        where.append(b)
        blobs.append(_pack(1, rest_names[of], rest_keys[of], None))
    return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])


def by_key(keys: np.ndarray, names: tuple[str, ...], *cols: np.ndarray) -> pa.Table:
    """A row for each key with its entries of each column as bytes."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    out = {"key": pa.array(keys[head], pa.int64())}
    for name, c in zip(names, cols, strict=True):
        c = np.ascontiguousarray(c[order])
        offsets = np.append(head, len(keys)).astype(np.int64) * c.itemsize
        out[name] = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(c.tobytes())]).cast(pa.binary())
    return pa.table(out)


def shared(table: pa.Table, only_earlier: bool = False, least: int = 0) -> pa.Table:
    """Per row key the shared names of a bucket, and whether an earlier row has each; or those alone that one has.

    With ``least`` two more rows without a key: names of at least so many entries, with these numbers, and the sum of all entries.
    """
    parts = [_unpack(x) for x in table.column("data").to_pylist()]
    empty = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, U))]
    names, keys, many, checks = (np.concatenate(x) for x in zip(*([p[1:] for p in parts if p[0] == 0] or empty), strict=True))
    known_names, known_keys, _, _ = (np.concatenate(x) for x in zip(*([p[1:] for p in parts if p[0] == 1] or empty), strict=True))
    order = np.lexsort((checks, names))
    names, keys, many, checks = names[order], keys[order], many[order], checks[order]
    if len(names):
        head = _heads(names, checks)
        n = np.diff(np.append(head, len(names)))
        low = np.repeat(np.minimum.reduceat(keys, head), n)
        entries = np.add.reduceat((many >> np.uint32(1)).astype(np.int64), head)
        heavy = [(names[head][entries >= least], entries[entries >= least]), (names[:0], entries.sum(keepdims=True))]
        keep = keys > low if only_earlier else (np.repeat(n, n) > 1) | (np.repeat(np.maximum.reduceat(many & np.uint32(1), head), n) > 0)
        names, keys, earlier = names[keep], keys[keep], (keys > low)[keep]
    else:
        earlier, heavy = np.zeros(0, bool), []
    found = by_key(np.concatenate([keys, known_keys]), ("names", "earlier"), np.concatenate([names, known_names]), np.concatenate([earlier, np.ones(len(known_keys), bool)]).astype(np.uint8))
    if not least or not heavy:
        return found
    return pa.concat_tables([found, pa.table({"key": pa.array([None] * 2, pa.int64()), "names": pa.array([a.tobytes() for a, _ in heavy], pa.binary()), "earlier": pa.array([b.tobytes() for _, b in heavy], pa.binary())})])


def heavy_names(found: DataFrame, least: int, share: int) -> np.ndarray:
    """Names with more than one in ``share`` of all entries, of those with ``least`` or more; at most ``share``, so they can go to all executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, counts = [], []
            for a, c in zip(b.column("names").to_pylist(), b.column("earlier").to_pylist(), strict=True):
                counts += np.frombuffer(c, np.int64).tolist()
                names += np.frombuffer(a, np.int64).tolist() or [None] * (len(counts) - len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(counts, pa.int64())], names=["name", "n"])

    each = found.filter("key is null").select("names", "earlier").mapInArrow(run, "name long, n long")
    total = each.filter("name is null").agg(F.sum("n")).first()[0] or 0
    chosen = each.filter(F.col("name").isNotNull() & (F.col("n") > max(least, total // share))).select("name").collect()
    return np.sort(np.array([r[0] for r in chosen], np.int64).view(U))


class Gather:
    """Entries of a task, dealt out whenever there are many."""

    def __init__(self, n: int, repeats: bool = False) -> None:
        self.n, self.repeats, self.held, self.size = n, repeats, [], 0

    def add(self, names: np.ndarray, keys: np.ndarray, checks: np.ndarray | None = None) -> None:
        self.held.append((names, keys, np.zeros(len(names), U) if checks is None else checks))
        self.size += len(names)

    def full(self) -> bool:
        return self.size >= FLUSH

    def take(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        names, keys, checks = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        return deal(names, keys, checks, self.n, self.repeats)
