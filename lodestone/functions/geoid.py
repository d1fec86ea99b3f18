"""Geographic codes: levels, states, validity, parts, parents, and readable slugs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c, pad

#: Length of each level's code (fixed values).
LENGTHS = {
    "nation": 1, "region": 1, "division": 1, "state": 2, "county": 5, "cousub": 10, "place": 7, "cd": 4, "sldu": 5, "sldl": 5,
    "tract": 11, "block_group": 12, "block": 15, "tabblock20": 15, "tabblock10": 15, "zcta": 5, "cbsa": 5, "puma": 7, "vtd": 6, "vtd20": 6,
}
#: Other names of the levels (fixed values).
ALIASES = {
    "us": "nation", "national": "nation", "county_subdivision": "cousub", "congressional_district": "cd",
    "state_legislative_upper": "sldu", "state_legislative_district_upper": "sldu", "state_legislative_district": "sldu",
    "state_legislative_lower": "sldl", "state_legislative_district_lower": "sldl", "bg": "block_group", "blockgroup": "block_group",
    "tabblock": "block", "zip_code": "zcta", "zcta5": "zcta", "zipcode": "zcta", "voting_district": "vtd",
}
#: Abbreviation, code and name of states and territories (fixed values).
STATES = [
    ("AL", "01", "Alabama"), ("AK", "02", "Alaska"), ("AZ", "04", "Arizona"), ("AR", "05", "Arkansas"), ("CA", "06", "California"),
    ("CO", "08", "Colorado"), ("CT", "09", "Connecticut"), ("DE", "10", "Delaware"), ("DC", "11", "District of Columbia"),
    ("FL", "12", "Florida"), ("GA", "13", "Georgia"), ("HI", "15", "Hawaii"), ("ID", "16", "Idaho"), ("IL", "17", "Illinois"),
    ("IN", "18", "Indiana"), ("IA", "19", "Iowa"), ("KS", "20", "Kansas"), ("KY", "21", "Kentucky"), ("LA", "22", "Louisiana"),
    ("ME", "23", "Maine"), ("MD", "24", "Maryland"), ("MA", "25", "Massachusetts"), ("MI", "26", "Michigan"), ("MN", "27", "Minnesota"),
    ("MS", "28", "Mississippi"), ("MO", "29", "Missouri"), ("MT", "30", "Montana"), ("NE", "31", "Nebraska"), ("NV", "32", "Nevada"),
    ("NH", "33", "New Hampshire"), ("NJ", "34", "New Jersey"), ("NM", "35", "New Mexico"), ("NY", "36", "New York"),
    ("NC", "37", "North Carolina"), ("ND", "38", "North Dakota"), ("OH", "39", "Ohio"), ("OK", "40", "Oklahoma"), ("OR", "41", "Oregon"),
    ("PA", "42", "Pennsylvania"), ("RI", "44", "Rhode Island"), ("SC", "45", "South Carolina"), ("SD", "46", "South Dakota"),
    ("TN", "47", "Tennessee"), ("TX", "48", "Texas"), ("UT", "49", "Utah"), ("VT", "50", "Vermont"), ("VA", "51", "Virginia"),
    ("WA", "53", "Washington"), ("WV", "54", "West Virginia"), ("WI", "55", "Wisconsin"), ("WY", "56", "Wyoming"),
    ("AS", "60", "American Samoa"), ("GU", "66", "Guam"), ("MP", "69", "Northern Mariana Islands"), ("PR", "72", "Puerto Rico"),
    ("UM", "74", "United States Minor Outlying Islands"), ("VI", "78", "Virgin Islands"),
]
#: Parts of the codes that have some, with their lengths.
PARTS = {
    "state": [("state", 2)], "county": [("state", 2), ("county", 3)], "tract": [("state", 2), ("county", 3), ("tract", 6)],
    "block_group": [("state", 2), ("county", 3), ("tract", 6), ("block_group", 1)], "block": [("state", 2), ("county", 3), ("tract", 6), ("block", 4)],
    "place": [("state", 2), ("place", 5)], "cd": [("state", 2), ("cd", 2)], "sldu": [("state", 2), ("sldu", 3)], "sldl": [("state", 2), ("sldl", 3)],
    "cousub": [("state", 2), ("county", 3), ("cousub", 5)], "puma": [("state", 2), ("puma", 5)], "zcta": [("zcta", 5)], "cbsa": [("cbsa", 5)],
}
#: How a level is called in a slug where not by its own name (fixed values).
SLUG = {"block_group": "bg"}
GEOID_NAMES = ["GEOID", "geoid", "GEOID20", "GEOID10", "GEOID00", "geoid20", "geoid10", "geoid00", "GEO_ID", "geo_id", "GEOCODE", "geocode", "FIPS", "fips", "FIPSCODE", "fipscode"]


def level(name: str) -> str:
    """A level's own name, in any case and by any alias."""
    n = name.strip().lower()
    n = ALIASES.get(n, n)
    if n not in LENGTHS:
        raise ValueError(f"unknown level: {name!r}")
    return n


def _map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs)))


def state_fips(c: Column | str) -> Column:
    """The code of a state given by code, abbreviation or name in any case; null if there is none."""
    t = F.upper(F.trim(_c(c)))
    known = [(f, f) for _, f, _ in STATES] + [(a, f) for a, f, _ in STATES] + [(n.upper(), f) for _, f, n in STATES]
    return F.try_element_at(_map(known), t)


def state_abbreviation(fips: Column | str) -> Column:
    return F.try_element_at(_map([(f, a) for a, f, _ in STATES]), _c(fips))


def state_name(fips: Column | str) -> Column:
    return F.try_element_at(_map([(f, n) for _, f, n in STATES]), _c(fips))


def normalize(c: Column | str, at: str) -> Column:
    """Zeros before a code that is too short; longer ones stay; null stays null."""
    return pad(c, LENGTHS[level(at)])


def validate(c: Column | str, at: str, strict: bool = True) -> Column:
    """Digits of the level's length, or at most that if not strict; false for null."""
    n = LENGTHS[level(at)]
    return F.coalesce(_c(c).cast("string").rlike(rf"^\d{{{n if strict else '1,' + str(n)}}}$"), F.lit(False))


def known_state(c: Column | str, digits: int) -> Column:
    """So many digits that begin with a known state's code; false for null."""
    return F.coalesce(_c(c).rlike(rf"^\d{{{digits}}}$") & F.substring(_c(c), 1, 2).isin([f for _, f, _ in STATES]), F.lit(False))


def construct(at: str, **parts: Column | str) -> Column:
    """A level's code of its parts, each padded."""
    return F.concat(*(pad(parts[n], k) for n, k in PARTS[level(at)]))


def parse(c: Column | str, at: str) -> Column:
    """A struct of the parts of a code."""
    g, at0, out = normalize(c, at), 1, []
    for n, k in PARTS[level(at)]:
        out.append(F.substring(g, at0, k).alias(n))
        at0 += k
    return F.struct(*out)


def parent(c: Column | str, child: str, of: str) -> Column:
    """The code of an enclosing level."""
    a, b = level(child), level(of)
    if [n for n, _ in PARTS[b]] != [n for n, _ in PARTS[a]][: len(PARTS[b])]:
        raise ValueError(f"{child} doesn't lie within {of}")
    return F.substring(normalize(c, a), 1, LENGTHS[b])


def slug(c: Column | str, at: str) -> Column:
    """state abbreviation, parts and level with hyphens, as ca-037-tract-101100."""
    a = level(at)
    g = normalize(c, a)
    if a == "zcta":
        return F.concat(F.lit("zcta-"), g)
    st = F.lower(F.coalesce(state_abbreviation(F.substring(g, 1, 2)), F.substring(g, 1, 2)))
    if a == "state":
        return st
    name = SLUG.get(a, a)
    if a in ("tract", "vtd"):
        return F.concat_ws("-", st, F.substring(g, 3, 3), F.lit(name), F.substring(g, 6, 99))
    if a in ("block_group", "block"):
        return F.concat_ws("-", st, F.substring(g, 3, 3), F.substring(g, 6, 6), F.lit(name), F.substring(g, 12, 99))
    return F.concat_ws("-", st, F.lit(name), F.substring(g, 3, 99))


def from_slug(c: Column | str) -> Column:
    """The code of a slug; null where the state or the level is unknown."""
    p = F.split(F.lower(_c(c)), "-")
    st = F.try_element_at(_map([(a.lower(), f) for a, f, _ in STATES]), F.get(p, F.lit(0)))
    labels = [F.lit(SLUG.get(n, n)) for n in LENGTHS]
    digits = F.array_join(F.filter(p, lambda x: ~x.isin(*labels)), "")
    return F.when(F.get(p, F.lit(0)) == "zcta", F.array_join(F.slice(p, 2, 9), "")).when(st.isNull(), None).when(F.size(p) == 1, st).when(F.exists(p, lambda x: x.isin(*labels)), F.concat(st, F.substring(digits, 3, 99)))


def find_column(df: DataFrame) -> str | None:
    return next((n for n in GEOID_NAMES if n in df.columns), None)


def for_join(df: DataFrame, column: str, at: str, output: str = "geoid_join") -> DataFrame:
    """df with the padded code and whether it is valid."""
    return df.withColumn(output, normalize(column, at)).withColumn(f"{output}_valid", validate(F.col(output), at))
