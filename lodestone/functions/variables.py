"""Codes of the census's variables by subject, and the margins that go with estimates."""

from __future__ import annotations

from collections.abc import Sequence


def _codes(table: str, kind: str, *numbers: int) -> list[str]:
    return [f"{table}_{n:03d}{kind}" for n in numbers]


# fixed values: subjects and the published codes of their variables
GROUPS = {
    "total_population": _codes("B01001", "E", 1),
    "demographics_basic": _codes("B01001", "E", 1, 2, 26) + _codes("B01002", "E", 1),
    "race_ethnicity": _codes("B02001", "E", *range(1, 9)) + _codes("B03001", "E", 3),
    "income": ["B19013_001E", "B19301_001E", "B19025_001E"],
    "education": _codes("B15003", "E", 1, 17, 18, 21, 22, 23, 24, 25),
    "poverty": _codes("B17001", "E", 1, 2),
    "housing": ["B25001_001E", "B25002_002E", "B25002_003E", "B25003_002E", "B25003_003E", "B25077_001E", "B25064_001E"],
    "decennial_population": _codes("P1", "N", 1, *range(3, 9)),
    "pl_p1_race": _codes("P1", "N", *range(1, 12)),
    "pl_p2_hispanic": _codes("P2", "N", *range(1, 12)),
    "pl_p3_race_18plus": _codes("P3", "N", *range(1, 10)),
    "pl_p4_hispanic_18plus": _codes("P4", "N", *range(1, 12)),
    "pl_p5_group_quarters": _codes("P5", "N", *range(1, 11)),
    "pl_h1_housing": _codes("H1", "N", 1, 2, 3),
    "pl_redistricting_core": _codes("P1", "N", 1) + _codes("P2", "N", 2, 3, *range(5, 12)) + _codes("P3", "N", 1) + _codes("P4", "N", 2, 3, 5, 6) + _codes("H1", "N", 1, 2, 3),
    "pl_voting_age": _codes("P3", "N", 1) + _codes("P4", "N", 2, 3, *range(5, 12)),
}


def resolve(wanted: str | Sequence[str], groups: dict[str, list[str]] | None = None) -> list[str]:
    """The codes of a subject; what is no subject is a code itself, and a list of codes stays."""
    if isinstance(wanted, str):
        return list((GROUPS if groups is None else groups).get(wanted, [wanted]))
    return list(wanted)


def with_margins(codes: Sequence[str]) -> list[str]:
    """Each code, after an estimate (E) that of its margin (M)."""
    return [c for code in codes for c in ([code, f"{code[:-1]}M"] if code.endswith("E") else [code])]
