"""Industry, occupation and locale codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

#: Titles of the industry sectors (fixed values).
NAICS = {
    "11": "Agriculture, Forestry, Fishing and Hunting",
    "21": "Mining, Quarrying, and Oil and Gas Extraction",
    "22": "Utilities",
    "23": "Construction",
    "31": "Manufacturing",
    "32": "Manufacturing",
    "33": "Manufacturing",
    "42": "Wholesale Trade",
    "44": "Retail Trade",
    "45": "Retail Trade",
    "48": "Transportation and Warehousing",
    "49": "Transportation and Warehousing",
    "51": "Information",
    "52": "Finance and Insurance",
    "53": "Real Estate and Rental and Leasing",
    "54": "Professional, Scientific, and Technical Services",
    "55": "Management of Companies and Enterprises",
    "56": "Administrative and Support and Waste Management",
    "61": "Educational Services",
    "62": "Health Care and Social Assistance",
    "71": "Arts, Entertainment, and Recreation",
    "72": "Accommodation and Food Services",
    "81": "Other Services (except Public Administration)",
    "92": "Public Administration",
}
#: Codes that changed between revisions (fixed values).
NAICS_CHANGES = {
    (2012, 2017): {"517110": ["517311"]},
    (2017, 2022): {"454110": ["455110"], "519130": ["519290"], "517311": ["517111"], "517312": ["517111"]},
}
#: Titles of the major occupation groups (fixed values).
SOC = {
    "11": "Management",
    "13": "Business and Financial Operations",
    "15": "Computer and Mathematical",
    "17": "Architecture and Engineering",
    "19": "Life, Physical, and Social Science",
    "21": "Community and Social Service",
    "23": "Legal",
    "25": "Educational Instruction and Library",
    "27": "Arts, Design, Entertainment, Sports, and Media",
    "29": "Healthcare Practitioners and Technical",
    "31": "Healthcare Support",
    "33": "Protective Service",
    "35": "Food Preparation and Serving Related",
    "37": "Building and Grounds Cleaning and Maintenance",
    "39": "Personal Care and Service",
    "41": "Sales and Related",
    "43": "Office and Administrative Support",
    "45": "Farming, Fishing, and Forestry",
    "47": "Construction and Extraction",
    "49": "Installation, Maintenance, and Repair",
    "51": "Production",
    "53": "Transportation and Material Moving",
    "55": "Military Specific",
}
#: Numbers of the locales; the tens give the category (fixed values).
LOCALES = {
    "city_large": 11, "city_midsize": 12, "city_small": 13, "suburb_large": 21, "suburb_midsize": 22, "suburb_small": 23,
    "town_fringe": 31, "town_distant": 32, "town_remote": 33, "rural_fringe": 41, "rural_distant": 42, "rural_remote": 43,
}
CATEGORIES = {1: "city", 2: "suburban", 3: "town", 4: "rural"}
#: Least populations, and greatest distances in miles (fixed values).
LARGE, MIDSIZE, SMALL, TOWN, FRINGE, DISTANT = 250_000, 100_000, 25_000, 2_500, 5, 25


def _lookup(table: dict, key: Column, default: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def naics(c: Column | str) -> Column:
    """Struct of code, sector title, level and parent; null if it isn't two to six digits."""
    t = F.trim(_c(c))
    n = F.length(t)
    s = F.struct(t.alias("code"), _lookup(NAICS, F.substring(t, 1, 2), "Unknown Sector").alias("title"), n.alias("level"), F.when(n > 2, F.substring(t, F.lit(1), n - 1)).alias("parent_code"))
    return F.when(t.rlike(r"^\d{2,6}$"), s)


def naics_ancestors(c: Column | str) -> Column:
    """Prefixes of a code from two digits to its own length."""
    t = F.trim(_c(c))
    return F.when(F.length(t) >= 2, F.transform(F.sequence(F.lit(2), F.length(t)), lambda n: F.substring(t, F.lit(1), n)))


def naics_sector(c: Column | str) -> Column:
    p = F.substring(F.trim(_c(c)), 1, 2)
    return F.struct(p.alias("sector"), _lookup(NAICS, p, "Unknown Sector").alias("title"))


def _renamed(changes: Column):
    return lambda x: F.coalesce(F.try_element_at(changes, x), F.array(x))


def crosswalk_naics(c: Column | str, start: int = 2017, end: int = 2022) -> Column:
    """The codes of a later revision; a code without a change stays."""
    steps = {(2012, 2022): [(2012, 2017), (2017, 2022)]}.get((start, end), [(start, end)])
    if any(s not in NAICS_CHANGES for s in steps):
        raise ValueError(f"no crosswalk from {start} to {end}")
    out = F.array(F.trim(_c(c)))
    for s in steps:
        m = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in NAICS_CHANGES[s].items()))
        out = F.flatten(F.transform(out, _renamed(m)))
    return out


def soc(c: Column | str) -> Column:
    """Struct of code, major title and level; null if it is neither two digits nor two and four."""
    t = F.trim(_c(c))
    kind = F.when(F.length(t) == 2, "major").when(t.endswith("0000"), "major").when(t.endswith("0"), "broad").otherwise("detailed")
    return F.when(t.rlike(r"^\d{2}(-\d{4})?$"), F.struct(t.alias("code"), _lookup(SOC, F.substring(t, 1, 2), "Unknown").alias("title"), kind.alias("level")))


def soc_major(c: Column | str) -> Column:
    p = F.substring(F.split(F.trim(_c(c)), "-")[0], 1, 2)
    return F.struct(p.alias("major"), _lookup(SOC, p, "Unknown").alias("title"))


def urbanicity(population: Column | str, miles: Column | str) -> Column:
    """One of twelve locales, by population and distance to an urban area."""
    p, d = _c(population), _c(miles)
    near = d <= FRINGE
    out = None
    for least, size in ((LARGE, "large"), (MIDSIZE, "midsize"), (SMALL, "small")):
        value = F.when(near, f"city_{size}").otherwise(f"suburb_{size}")
        out = F.when(p >= least, value) if out is None else out.when(p >= least, value)
    far = lambda kind: F.when(near, f"{kind}_fringe").when(d <= DISTANT, f"{kind}_distant").otherwise(f"{kind}_remote")
    return F.when(p.isNotNull() & d.isNotNull(), out.when(p >= TOWN, far("town")).otherwise(far("rural")))


def locale_number(name: Column | str) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(LOCALES.items()))), _c(name))


def locale_info(code: Column | str) -> Column:
    """Struct of number, category, subcategory and description; null for an unknown number."""
    c = _c(code).cast("int")
    sub = F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable((v, k) for k, v in LOCALES.items()))), c)
    cat = F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(CATEGORIES.items()))), F.floor(c / 10).cast("int"))
    return F.when(sub.isNotNull(), F.struct(c.alias("numeric_code"), cat.alias("category"), sub.alias("subcategory"), F.initcap(F.replace(sub, F.lit("_"), F.lit(" "))).alias("description")))


def walkability(distance: Column | str) -> Column:
    """Map of grade and label by distance; null gives null. Bands are open above."""
    d = _c(distance)
    out = F.when(d.isNull(), None)
    for most, grade, label in ((100, "Trivial", "Trivial (<100m)"), (250, "Tolerable", "Tolerable (100-250m)"), (400, "Moderate", "Moderate (250-400m)"), (500, "Borderline", "Borderline (400-500m)")):
        out = out.when(d < most, F.create_map(F.lit("grade"), F.lit(grade), F.lit("label"), F.lit(label)))
    return out.otherwise(F.create_map(F.lit("grade"), F.lit("Outside"), F.lit("label"), F.lit("Outside (>500m)")))
