"""Cells of the S2 grid: a cube's faces, each with a Hilbert curve, 31 levels, 64-bit ids.

Ids are unsigned; as longs those of the upper faces are negative, and tokens, their hexadecimal digits without trailing
zeros, order them. Finding a point's cell is numpy on Arrow batches; parents, children, ranges and tokens are bit
operations on columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

#: Place of a quadrant on the curve, for each of the four orientations, and how the orientation changes with the place.
IJ_TO_POS = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])
TURN = np.array([1, 0, 0, 3])


def cell_ids(lat: np.ndarray, lon: np.ndarray, level: int = 30) -> np.ndarray:
    """Ids, as signed numbers, of the cells of a level that hold positions in degrees."""
    la, lo = np.radians(lat.astype(float)), np.radians(lon.astype(float))
    p = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
    axis = np.argmax(np.abs(p), axis=0)
    largest = np.take_along_axis(p, axis[None], 0)[0]
    face = axis + 3 * (largest < 0)
    x, y, z = p
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    st = lambda w: np.where(w >= 0, 0.5 * np.sqrt(1 + 3 * np.maximum(w, 0)), 1 - 0.5 * np.sqrt(1 - 3 * np.minimum(w, 0)))
    to_int = lambda s: np.clip(np.floor(s * (1 << 30)), 0, (1 << 30) - 1).astype(np.int64)
    i, j = to_int(st(u)), to_int(st(v))
    turn = face & 1
    out = face.astype(np.uint64)
    for k in range(29, -1, -1):
        quadrant = ((i >> k) & 1) << 1 | ((j >> k) & 1)
        place = IJ_TO_POS[turn, quadrant]
        out = out << np.uint64(2) | place.astype(np.uint64)
        turn = turn ^ TURN[place]
    ids = out << np.uint64(1) | np.uint64(1)
    low = np.uint64(1) << np.uint64(2 * (30 - level))
    return ((ids & ~(low - np.uint64(1)) & ~low) | low if level < 30 else ids).view(np.int64)


def point_cell(lat: Column | str, lon: Column | str, level: int = 12) -> Column:
    """The cell of a level; null for a missing or impossible position."""
    if not 0 <= level <= 30:
        raise ValueError(f"levels are 0 to 30: {level}")

    @F.pandas_udf("long")
    def cells(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = a.between(-90, 90) & b.between(-180, 180)
        out = pd.array(cell_ids(a.where(ok, 0.0).to_numpy(), b.where(ok, 0.0).to_numpy(), level), dtype="Int64")
        out[~ok.to_numpy()] = pd.NA
        return pd.Series(out)

    return cells(_c(lat).cast("double"), _c(lon).cast("double"))


def lowest_bit(cell: Column | str) -> Column:
    return _c(cell).bitwiseAND(-_c(cell))


def cell_level(cell: Column | str) -> Column:
    """30 less half the place of the lowest bit."""
    return (F.lit(30) - F.floor(F.log2(lowest_bit(cell).cast("double")) / 2)).cast("int")


def parent(cell: Column | str, level: int) -> Column:
    low = 1 << (2 * (30 - level))
    return _c(cell).bitwiseAND(F.lit(-low)).bitwiseOR(F.lit(low))


def children(cell: Column | str) -> Column:
    """The four cells of the next level."""
    c, low = _c(cell), F.shiftright(lowest_bit(cell), 2)
    return F.array(*(c + low * k for k in (-3, -1, 1, 3)))


def leaf_range(cell: Column | str) -> Column:
    """Struct of the least and the greatest leaf of a cell; compare after adding 2^63, as ids are unsigned."""
    c, low = _c(cell), lowest_bit(cell)
    return F.struct((c - (low - 1)).alias("lo"), (c + (low - 1)).alias("hi"))


def token(cell: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.lpad(F.hex(_c(cell)), 16, "0"), "0+$", ""))


def from_token(t: Column | str) -> Column:
    """The id of a token; halves are read apart, as the whole may pass a signed number."""
    full = F.rpad(_c(t), 16, "0")
    half = lambda a: F.conv(F.substring(full, a, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


#: Average areas, in square kilometres, of administrative levels, and other names for them (fixed values).
AREAS = {"state": 196_600.0, "county": 3_000.0, "zcta": 110.0, "tract": 5.0, "block_group": 1.0, "block": 0.04}
NAMES = {
    "states": "state", "us_state": "state", "counties": "county", "us_county": "county", "zip": "zcta", "zip_code": "zcta",
    "zipcode": "zcta", "zctas": "zcta", "tracts": "tract", "census_tract": "tract", "bg": "block_group",
    "block_groups": "block_group", "blockgroup": "block_group", "blocks": "block", "census_block": "block",
}
#: The earth's surface in square kilometres; a level has 6 * 4 ** level cells.
SURFACE = 510_072_000.0


def level_for_area(km2: float) -> int:
    """The level whose cells are nearest to an area, by logarithms."""
    if km2 <= 0:
        raise ValueError(f"areas are above 0: {km2}")
    return min(range(31), key=lambda k: abs(np.log10(SURFACE / (6 * 4.0**k)) - np.log10(km2)))


def level_for(name: str) -> int:
    n = name.strip().lower()
    n = NAMES.get(n, n)
    if n not in AREAS:
        raise ValueError(f"no such level: {name!r}")
    return level_for_area(AREAS[n])


def _unpack(cell: int) -> tuple[int, int, int, int]:
    """Face, i, j of a cell's first leaf corner, and its level."""
    u = cell & (1 << 64) - 1
    level = 30 - ((u & -u).bit_length() - 1) // 2
    turn = face = u >> 61
    turn &= 1
    i = j = 0
    for k in range(level):
        place = u >> (59 - 2 * k) & 3
        q = int(np.flatnonzero(IJ_TO_POS[turn] == place)[0])
        i, j = i << 1 | q >> 1, j << 1 | q & 1
        turn ^= int(TURN[place])
    return face, i << (30 - level), j << (30 - level), level


def _position(face: int, i: float, j: float) -> tuple[float, float]:
    """Latitude and longitude of a place on a face; beyond its edge, of the place next to it."""
    uv = lambda s: (4 * s * s - 1) / 3 if s >= 0.5 else (1 - 4 * (1 - s) ** 2) / 3
    u, v = uv(i / (1 << 30)), uv(j / (1 << 30))
    x, y, z = [(1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1)][face]
    return float(np.degrees(np.arctan2(z, np.hypot(x, y)))), float(np.degrees(np.arctan2(y, x)))


def corners(cell: int) -> list[tuple[float, float]]:
    """The four corners of a cell, in degrees."""
    face, i, j, level = _unpack(cell)
    n = 1 << (30 - level)
    return [_position(face, a, b) for a, b in ((i, j), (i + n, j), (i + n, j + n), (i, j + n))]


def neighbours(cell: int) -> list[int]:
    """The cells of the same level across the four edges."""
    face, i, j, level = _unpack(cell)
    n = 1 << (30 - level)
    at = np.array([_position(face, a, b) for a, b in ((i + n / 2, j - n / 2), (i + 1.5 * n, j + n / 2), (i + n / 2, j + 1.5 * n), (i - n / 2, j + n / 2))])
    return [int(c) for c in cell_ids(at[:, 0], at[:, 1], level)]


def ring(cell: int, k: int) -> set[int]:
    """Cells within k steps across edges."""
    seen = edge = {cell}
    for _ in range(k):
        edge = {n for c in edge for n in neighbours(c)} - seen
        seen = seen | edge
    return seen


def steps(a: int, b: int, most: int = 200) -> int | None:
    """Least steps across edges from one cell to another of its level; null beyond ``most``."""
    seen, edge = {a}, {a}
    for k in range(most + 1):
        if b in edge:
            return k
        edge = {n for c in edge for n in neighbours(c)} - seen
        seen |= edge
    return None


def cover_box(lat0: float, lon0: float, lat1: float, lon1: float, level: int) -> list[int]:
    """Cells of a level that meet a box, found by spreading from its middle over edges."""
    start = int(cell_ids(np.array([(lat0 + lat1) / 2]), np.array([(lon0 + lon1) / 2]), level)[0])

    def meets(c: int) -> bool:
        p = np.array(corners(c))
        pad_lat, pad_lon = np.ptp(p[:, 0]) / 4, np.ptp(p[:, 1]) / 4
        return bool(p[:, 0].min() - pad_lat <= lat1 and p[:, 0].max() + pad_lat >= lat0 and p[:, 1].min() - pad_lon <= lon1 and p[:, 1].max() + pad_lon >= lon0)

    seen, edge = {start}, [start]
    while edge:
        edge = [n for c in edge for n in neighbours(c) if n not in seen and (seen.add(n) or meets(n))]
    return sorted(c for c in seen if c == start or meets(c))


def region_cover(lat0: float, lon0: float, lat1: float, lon1: float, min_level: int = 0, max_level: int = 20, max_cells: int = 8) -> list[int]:
    """Cells of mixed levels over a box, at most ``max_cells`` unless even the coarsest level has more."""
    best = cover_box(lat0, lon0, lat1, lon1, min_level)
    for level in range(min_level + 1, max_level + 1):
        if len(best) > max_cells:
            break
        finer = cover_box(lat0, lon0, lat1, lon1, level)
        by_parent: dict[int, list[int]] = {}
        low = 1 << (2 * (31 - level))
        for c in finer:
            by_parent.setdefault((c & -low) | low, []).append(c)
        merged = [x for p, cs in by_parent.items() for x in ([p] if len(cs) == 4 else cs)]
        if len(merged) > max_cells:
            break
        best = merged
    return sorted(best)


def polygon_cover(geometry: Column | str, level: int, refine: bool = True) -> Column:
    """Cells of a level over a polygon's box; refined, those whose middle the polygon covers, or one at least.

    For covers that a join may lean on take ``refine=False``: they leave nothing out.
    """
    from .geometry import _edges, parse

    @F.pandas_udf("array<long>")
    def cells(shapes: pd.Series) -> pd.Series:
        out = []
        for w in shapes:
            rs = parse(w)
            points = [p for r in rs for p in r]
            if not points:
                out.append([])
                continue
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            found = cover_box(min(ys), min(xs), max(ys), max(xs), level)
            if refine:
                edges = _edges(rs)
                keep = []
                for c in found:
                    y, x = np.mean(corners(c), axis=0)
                    if sum((b > y) != (d > y) and x < a + (y - b) * (e - a) / (d - b) for a, b, e, d in edges) % 2:
                        keep.append(c)
                found = keep or [int(cell_ids(np.array([np.mean(ys)]), np.array([np.mean(xs)]), level)[0])]
            out.append(found)
        return pd.Series(out)

    return cells(_c(geometry))


def infer(grid: str | None = None, resolution: int | None = None, level: int | None = None) -> str:
    """Which grid is meant: resolutions are H3's, levels S2's; h3 if nothing says so."""
    hints = {g for g, given in (("h3", resolution), ("s2", level)) if given is not None} | ({grid} if grid else set())
    if len(hints) > 1 or hints - {"h3", "s2"}:
        raise ValueError(f"one of h3 and s2 is needed: {sorted(hints)}")
    return hints.pop() if hints else "h3"


def h3_cell(lat: Column | str, lon: Column | str, resolution: int) -> Column:
    """H3 cells, where that library is installed."""
    import h3  # raises ImportError elsewhere

    @F.pandas_udf("string")
    def cells(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([h3.latlng_to_cell(x, y, resolution) if pd.notna(x) and pd.notna(y) and abs(x) <= 90 and abs(y) <= 180 else None for x, y in zip(a, b, strict=True)], dtype="object")

    return cells(_c(lat).cast("double"), _c(lon).cast("double"))
