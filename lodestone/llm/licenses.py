"""License scans by ordered signature rules.

A rule is a regular expression with a keyword, a label, a priority and a weight. An automaton of all
keywords is run over a text first; only rules whose keyword occurs are tried. Detections are taken by priority, then by
length, and one that lies inside another of the same or a better priority is suppressed: a full title keeps the names
within it quiet, while a broad sentence doesn't hide the licence that it names. Identifiers are read out of whole
expressions with ``and``, ``or``, ``with`` and parentheses.

Base phrases are counted by words and are never suppressed. Null text counts as empty; a long text is searched whole. Among
detections of equal place and priority the lesser label stays; repeated rows give repeated rows, further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .words import ALNUM_LOWER, Words, pieces, small_batches, table, texts_of

#: The phrases every scan counts, by their words (fixed values of the contract).
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: label; how the licence is named in running text; its SPDX identifiers; its address. Versions are optional groups.
NAMED = [
    ("mit", r"(?:mit|expat)(?: \(?(?:expat|x11)\)?)?(?: style)? licen[sc]e", r"mit|x11|mit-0|mit-advertising|mit-feh|mit-cmu|mit-open-group", r"opensource\.org/licenses?/mit"),
    ("apache", r"apache(?: software)? licen[sc]e,?(?: version)?(?: v?\d(?:\.\d)?)?", r"apache-[\d.]+", r"apache\.org/licenses/license-\d\.\d"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e,?(?: version| v)?(?: ?\d(?:\.\d)?)?", r"lgpl-[\d.]+(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e,?(?: version| v)?(?: ?\d(?:\.\d)?)?", r"agpl-[\d.]+(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("gpl", r"(?:gnu )?general public licen[sc]e,?(?: version| v)?(?: ?\d(?:\.\d)?)?", r"gpl-[\d.]+(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gfdl", r"gnu free documentation licen[sc]e,?(?: version| v)?(?: ?\d(?:\.\d)?)?", r"gfdl-[\d.]+(?:-only|-or-later)?", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("cc-by-nc-nd", r"(?:cc by-nc-nd|creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?)(?: \d\.\d)?", r"cc-by-nc-nd-[\d.]+", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", r"(?:cc by-nc-sa|creative commons attribution[- ]non-?commercial[- ]share-?alike)(?: \d\.\d)?", r"cc-by-nc-sa-[\d.]+", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", r"(?:cc by-nc|creative commons attribution[- ]non-?commercial)(?!-)(?: \d\.\d)?", r"cc-by-nc-[\d.]+", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", r"(?:cc by-nd|creative commons attribution[- ]no-?deriv(?:ative)?s?)(?: \d\.\d)?", r"cc-by-nd-[\d.]+", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", r"(?:cc by-sa|creative commons attribution[- ]share-?alike)(?: \d\.\d)?", r"cc-by-sa-[\d.]+", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?!-)(?: \d\.\d)?(?: licen[sc]e)?", r"cc-by-[\d.]+", r"creativecommons\.org/licenses/by/"),
    ("cc0", r"(?:cc0|creative commons zero)(?: 1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("bsd-2-clause", r"(?:(?:simplified|freebsd|2-clause|two-clause) bsd|bsd 2-clause) licen[sc]e", r"bsd-2-clause(?:-[a-z]+)?", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", r"(?:(?:new|modified|revised|3-clause|three-clause) bsd|bsd 3-clause) licen[sc]e", r"bsd-3-clause(?:-[a-z]+)?", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", r"(?:(?:original|4-clause) bsd|bsd 4-clause) licen[sc]e", r"bsd-4-clause(?:-[a-z]+)?", r"directory\.fsf\.org/wiki/license:bsd-4clause"),
    ("0bsd", r"(?:zero-clause bsd|bsd zero clause) licen[sc]e", r"0bsd", r"opensource\.org/licenses?/0bsd"),
    ("bsd", r"bsd(?:-style)? licen[sc]e", r"bsd-[a-z0-9-]+", r"opensource\.org/licenses?/bsd-license"),
    ("mpl", r"mozilla public licen[sc]e,?(?: version| v\.?)?(?: ?\d\.\d)?", r"mpl-[\d.]+(?:-no-copyleft-exception)?", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", r"eclipse public licen[sc]e(?: -)?,?(?: version| v)?(?: ?\d\.\d)?", r"epl-[\d.]+", r"eclipse\.org/legal/epl"),
    ("edl", r"eclipse distribution licen[sc]e(?: -)?,?(?: version| v)?(?: ?\d\.\d)?", r"edl-[\d.]+", r"eclipse\.org/org/documents/edl"),
    ("cddl", r"common development and distribution licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"cddl-[\d.]+", r"opensource\.org/licenses?/cddl"),
    ("cpl", r"common public licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"cpl-[\d.]+", r"opensource\.org/licenses?/cpl"),
    ("cpal", r"common public attribution licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"cpal-[\d.]+", r"opensource\.org/licenses?/cpal"),
    ("ibm-pl", r"ibm public licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"ipl-[\d.]+", r"opensource\.org/licenses?/ipl"),
    ("isc", r"\bisc licen[sc]e", r"isc", r"opensource\.org/licenses?/isc"),
    ("artistic", r"artistic licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"artistic-[\d.]+", r"perlfoundation\.org/artistic"),
    ("boost", r"boost software licen[sc]e(?: -)?,?(?: version)?(?: ?\d\.\d)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("busl", r"business source licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"busl-1\.1", r"mariadb\.com/bsl"),
    ("sspl", r"server side public licen[sc]e,?(?: version| v)?(?: ?\d)?", r"sspl-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic", r"elastic licen[sc]e,?(?: version| v)?(?: ?\d\.\d)?", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib(?:-acknowledgement)?", r"opensource\.org/licenses?/zlib"),
    ("libpng", r"libpng licen[sc]e(?: version \d)?", r"libpng(?:-2\.0)?", r"libpng\.org/pub/png/src/libpng-license"),
    ("unlicense", r"(?:the )?unlicense(?: licen[sc]e)?\b", r"unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the f\w* you want to public licen[sc]e", r"wtfpl", r"wtfpl\.net"),
    ("ofl", r"(?:sil )?open font licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"ofl-[\d.]+(?:-rfn|-no-rfn)?", r"scripts\.sil\.org/ofl"),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", r"odbl-[\d.]+", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"open data commons attribution licen[sc]e", r"odc-by-[\d.]+", r"opendatacommons\.org/licenses/by"),
    ("pddl", r"(?:open data commons )?public domain dedication (?:and|&) licen[sc]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("eupl", r"european union public licen[sc]e,?(?: version| v\.?)?(?: ?\d\.\d)?", r"eupl-[\d.]+", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("cecill", r"cecill(?:-[bc])?(?: free software)? licen[sc]e", r"cecill-[\w.]+", r"cecill\.info"),
    ("python", r"python software foundation licen[sc]e,?(?: version)?(?: ?\d)?", r"(?:psf|python)-2\.0", r"docs\.python\.org/\d?/?license"),
    ("php", r"\bphp licen[sc]e,?(?: version)?(?: ?\d\.\d+)?", r"php-3\.0\d?", r"php\.net/license"),
    ("ruby", r"\bruby licen[sc]e", r"ruby", r"ruby-lang\.org/en/about/license"),
    ("perl", r"same terms as perl(?: itself)?", r"artistic-1\.0-perl", r"dev\.perl\.org/licenses"),
    ("ms-pl", r"microsoft public licen[sc]e", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", r"ms-rl", r"opensource\.org/licenses?/ms-rl"),
    ("osl", r"open software licen[sc]e,?(?: version| v)?(?: ?\d\.\d)?", r"osl-[\d.]+", r"opensource\.org/licenses?/osl"),
    ("afl", r"academic free licen[sc]e,?(?: version| v)?(?: ?\d\.\d)?", r"afl-[\d.]+", r"opensource\.org/licenses?/afl"),
    ("ecl", r"educational community licen[sc]e,?(?: version| v)?(?: ?\d\.\d)?", r"ecl-[\d.]+", r"opensource\.org/licenses?/ecl"),
    ("upl", r"universal permissive licen[sc]e,?(?: version| v)?(?: ?\d\.\d)?", r"upl-1\.0", r"oss\.oracle\.com/licenses/upl"),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[sc]e", r"ncsa", r"opensource\.org/licenses?/ncsa"),
    ("w3c", r"w3c software (?:notice and )?licen[sc]e", r"w3c(?:-\d+)?", r"w3\.org/consortium/legal/.{0,30}copyright-software"),
    ("vim", r"\bvim licen[sc]e", r"vim", r"vimdoc\.sourceforge\.net/.{0,30}license"),
    ("openssl", r"openssl licen[sc]e", r"openssl", r"openssl\.org/source/license"),
    ("openldap", r"openldap public licen[sc]e(?: version \d\.\d)?", r"oldap-[\d.]+", r"openldap\.org/.{0,20}license"),
    ("postgresql", r"postgresql licen[sc]e", r"postgresql", r"postgresql\.org/about/licen[sc]e"),
    ("sleepycat", r"sleepycat(?: public)? licen[sc]e", r"sleepycat", r"opensource\.org/licenses?/sleepycat"),
    ("sunpl", r"sun public licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"spl-1\.0", r"opensource\.org/licenses?/spl"),
    ("qpl", r"q public licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"qpl-1\.0", r"opensource\.org/licenses?/qpl"),
    ("lppl", r"latex project public licen[sc]e,?(?: version)?(?: ?\d\.\d\w?)?", r"lppl-[\w.]+", r"latex-project\.org/lppl"),
    ("mulan", r"mulan (?:permissive|public) (?:software )?licen[sc]e,?(?: version| v)?(?: ?\d)?", r"mulanp[su]l-[\d.]+", r"license\.coscl\.org\.cn"),
    ("blueoak", r"blue oak model licen[sc]e,?(?: version)?(?: ?\d\.\d\.\d)?", r"blueoak-1\.0\.0", r"blueoakcouncil\.org/license"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|internal use|free trial) licen[sc]e(?: \d\.\d\.\d)?", r"polyform-[\w.-]+", r"polyformproject\.org/licenses"),
    ("parity", r"parity public licen[sc]e(?: \d\.\d\.\d)?", r"parity-[\d.]+", r"paritylicense\.com"),
    ("hippocratic", r"hippocratic licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"hippocratic-2\.1", r"firstdonoharm\.dev"),
    ("openrail", r"(?:creativeml )?open ?rail(?:-[ms]+|\+\+-m)?(?: licen[sc]e)?", r"openrail(?:-[a-z]+)?", r"huggingface\.co/spaces/.{0,40}license"),
    ("llama", r"llama \d(?:\.\d)? community licen[sc]e", r"llama-?\d?", r"ai\.meta\.com/.{0,20}license"),
    ("fal", r"free art licen[sc]e(?: \d\.\d)?", r"lal-[\d.]+", r"artlibre\.org"),
    ("ogl", r"open government licen[sc]e(?: version| v)?(?: ?\d\.\d)?", r"ogl-uk-[\d.]+", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("etalab", r"licence ouverte(?: /? ?open licen[sc]e)?", r"etalab-2\.0", r"etalab\.gouv\.fr/licence-ouverte"),
    ("beerware", r"beer-?ware licen[sc]e", r"beerware", r"people\.freebsd\.org/~phk"),
    ("nasa", r"nasa open source agreement,?(?: version)?(?: ?\d\.\d)?", r"nasa-1\.3", r"opensource\.org/licenses?/nasa"),
    ("rpl", r"reciprocal public licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"rpl-[\d.]+", r"opensource\.org/licenses?/rpl"),
    ("apsl", r"apple public source licen[sc]e,?(?: version)?(?: ?\d\.\d)?", r"apsl-[\d.]+", r"opensource\.apple\.com/apsl"),
]

#: label, keyword, expression, weight: sentences of the licences themselves and of notices.
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software", 0.95),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all", 0.8),
    ("isc", "permission to use, copy, modify", r"permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee", 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without\s+modification", 0.9),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,120} may be used to\s+endorse or promote products", 0.9),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("apache", "limitations under the license", r"see the license for the specific language governing permissions and\s+limitations under the license", 0.9),
    ("apache", "you may not use this file", r"you may not use this file except in compliance with the license", 0.85),
    ("gpl", "free software foundation", r"redistribute it and/or modify\s+it under the terms of the gnu general public license as published by\s+the free software foundation", 0.95),
    ("gpl", "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim copies of this license document", 0.9),
    ("gpl", "merchantability or fitness", r"without even the implied warranty of\s+merchantability or fitness for a particular purpose", 0.6),
    ("mpl", "source code form is subject", r"this source code form is subject to the terms of the mozilla public license", 0.95),
    ("epl", "accompanying materials are made available", r"accompanying materials are made available under the terms of the eclipse public license", 0.95),
    ("boost", "obtaining a copy of the software and accompanying", r"obtaining a copy of the software and accompanying documentation covered by this license", 0.9),
    ("zlib", "freely, subject to the following", r"alter it and redistribute it\s+freely, subject to the following restrictions", 0.9),
    ("unlicense", "released into the public domain", r"this is free and unencumbered software released into the public domain", 0.95),
    ("public-domain", "public domain", r"(?:placed in|dedicated to|released (?:in)?to|is in) the public domain", 0.7),
    ("ofl", "reserved font name", r"with reserved font name", 0.8),
    ("cc", "creative commons", r"licensed under (?:a|the) creative commons[\w ./-]{0,60}", 0.8),
    ("all-rights-reserved", "all rights reserved", r"(?:copyright|©|\(c\))[^\n]{0,80}all rights reserved", 0.5),
    ("cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights", 0.9),
    ("wtfpl", "you just do what the", r"you just do what the f\w* you want to", 0.9),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 0.9),
    ("artistic", "the artistic license", r"you can redistribute it and/or modify it under the terms of the artistic license", 0.9),
    ("perl", "same terms as perl", r"redistribute it and/or modify it under the same terms as perl(?: itself)?", 0.95),
    ("lgpl", "lesser general public", r"under the terms of the gnu lesser general public license as published by\s+the free software foundation", 0.95),
    ("agpl", "affero general public", r"under the terms of the gnu affero general public license as published by\s+the free software foundation", 0.95),
    ("cddl", "common development and distribution", r"the contents of this file are subject to the terms of the\s+common development and distribution license", 0.95),
    ("mpl", "copy of the mpl was not distributed", r"if a copy of the mpl was not distributed with this\s+file", 0.95),
    ("bsd-2-clause", "expressed or implied, of the freebsd", r"either expressed or implied, of the freebsd project", 0.9),
    ("0bsd", "with or without fee is hereby granted", r"use, copy, modify, and/or distribute this software for any\s+purpose with or without fee is hereby granted\.", 0.7),
    ("unlicense", "means, commercial or non-commercial", r"for any purpose, commercial or non-commercial, and by any\s+means", 0.85),
    ("openssl", "for use in the openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", 0.95),
    ("ms-pl", "microsoft public", r"this license governs use of the accompanying software\. if you use the software, you accept this license", 0.8),
    ("boost", "license_1_0.txt", r"see accompanying file license_1_0\.txt", 0.9),
    ("proprietary", "trade secret", r"(?:confidential|proprietary)[^\n]{0,60}trade secrets?", 0.7),
    ("no-derivatives", "may not be modified", r"may not be modified(?:,| or) (?:sold|distributed|reproduced)", 0.6),
    ("non-commercial", "non-commercial use only", r"for (?:personal,? )?non-commercial use only", 0.7),
    ("research-only", "research purposes only", r"for (?:academic )?research purposes only", 0.7),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 0.7),
]

#: What identifiers follow: expression, priority, weight, keywords.
LEADS = [
    (r"spdx-license-identifier:\s*", 0, 1.0, ["spdx-license-identifier"]),
    (r"(?<![\w-])licen[sc]e[\"']?\s*[:=]\s*[\"']?", 1, 0.9, ["license", "licence"]),
    (r"(?<![a-z])(?:licensed|released|distributed|available)\s+under\s+(?:the\s+)?", 1, 0.9, ["licensed", "released", "distributed", "available"]),
]
OPERAND = re.compile(r"[\s(]*([a-z0-9][\w+-]*(?:\.[\w+-]+)*)")
CONNECTIVE = re.compile(r"\s*\)*\s*(and|or|with|/)(?=[\s(])\s*")

#: Ways in which a notice names a licence: expression around the name, better priority first, weight.
FRAMES = [
    (r"(?:dual[- ])?(?:licensed|released|distributed|published|available|provided)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+|a\s+)?{}", 1, 0.9),
    (r"(?:covered|governed)\s+by\s+(?:the\s+)?{}|subject\s+to\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{}", 2, 0.8),
    (r"{}", 4, 0.6),
]


@lru_cache(1)
def rules() -> tuple[list[tuple[int, str, float, re.Pattern[str]]], ahocorasick.Automaton]:
    """(priority, label, weight, expression) in order, and the automaton that gives the rules of a keyword.

    A rule without label leads to an expression of identifiers.
    """
    found: list[tuple[int, str, float, str, list[str]]] = [(p, "", w, x, gates) for x, p, w, gates in LEADS]
    for label, name, tag, address in NAMED:
        gates = keywords(name)
        found.append((1, label, 0.9, rf"(?<![\w.-])(?:https?://)?(?:www\.)?{address}", [address.split("/")[0].replace("\\", "")]))
        found += [(p, label, w, frame.replace("{}", rf"(?:{name})(?![a-z])"), gates) for frame, p, w in FRAMES]
    found += [(0 if w > 0.8 else 5, label, w, x, [key]) for label, key, x, w in SENTENCES]  # broad ones hide nothing
    found.sort(key=lambda r: (r[0], r[1]))
    automaton, number = ahocorasick.Automaton(), count()
    gated: dict[str, list[int]] = {}
    for k, r in zip(number, found, strict=False):
        for gate in r[4]:
            gated.setdefault(gate, []).append(k)
    for gate, ks in gated.items():
        automaton.add_word(gate, tuple(ks))
    automaton.make_automaton()
    return [(p, label, w, re.compile(rf"(?<![a-z]){x}" if x[:1].isalpha() or x[:3] == "(?:" else x)) for p, label, w, x, _ in found], automaton


def keywords(name: str) -> list[str]:
    """Literal text without which a name's expression can't match: its longest plain run, in each spelling."""
    plain = re.sub(r"\(\?[:!][^()]*\)\??|\(\?:[^()]*\([^()]*\)[^()]*\)\??", "|", name)
    plain = re.sub(r"\[[^]]*\][?*+]?|\\.[?*+]?|\(.*|.[?*+]|\.", "|", plain)  # a character that may be missing is none of it
    best = max(plain.split("|"), key=len).strip()
    return [best] if len(best) >= 5 else ["licens", "licenc", "cc by", "cc0", "creative commons", "cecill", "openrail", "open rail", "unlicense"]


@lru_cache(100_000)
def identified(identifier: str) -> str | None:
    """The label of an identifier."""
    return next((label for label, _, tag, _ in NAMED if re.fullmatch(rf"(?:{tag})\+?", identifier)), None)


def expression(lower: str, start: int, at: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, label) of the identifiers of an expression that begins at ``at``, the first with what leads to it."""
    exception = False
    while (m := OPERAND.match(lower, at)) is not None:
        label = None if exception else identified(m[1])
        if label is not None:
            yield start, m.end(), label
        elif not exception:
            return
        following = CONNECTIVE.match(lower, m.end())
        if following is None:
            return
        exception, at = following[1] == "with", following.end()
        start = at


def detect(lower: str) -> list[tuple[int, int, int, str, float]]:
    """Detections (start, end, priority, label, weight) that no other one of as good a priority contains."""
    ordered, automaton = rules()
    on = sorted({k for _, ks in automaton.iter(lower) for k in ks})
    found = []
    for k in on:
        p, label, w, x = ordered[k]
        if label:
            found += [(m.start(), m.end(), p, label, w) for m in x.finditer(lower)]
        else:
            found += [(s, e, p, named, w) for m in x.finditer(lower) for s, e, named in expression(lower, m.start(), m.end())]
    found.sort(key=lambda d: (d[2], d[0] - d[1], d[0], d[3]))
    kept: list[tuple[int, int, int, str, float]] = []
    starts: list[int] = []  # of what is kept, with the ends beside them
    ends: list[int] = []
    longest = 0
    for d in found:  # whatever is kept has as good a priority as what follows, and if the same, is no shorter
        near = slice(bisect_left(starts, d[1] - longest), bisect_right(starts, d[0]))
        if not any(end >= d[1] for end in ends[near]):
            kept.append(d)
            at = bisect_right(starts, d[0])
            starts.insert(at, d[0])
            ends.insert(at, d[1])
            longest = max(longest, d[1] - d[0])
    return sorted(kept, key=lambda d: (d[0], d[1], d[2], d[3]))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"
_lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def scan(docs: DataFrame) -> DataFrame:
    """Base phrases, labels of all detections left, the best weight as score, and the detections by code points."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = rules()[1]
        for b in batches:
            for ids, texts in pieces(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = Words(texts, ALNUM_LOWER, hashes=False)
                n = len(ids)
                cols = [ids, w.counts.tolist(), [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n, [""] * n]
                for d, text in enumerate(texts):
                    if not text:
                        continue
                    lower = text.translate(_lower) if not text.isascii() else text.lower()
                    base: list[tuple[int, str]] = []
                    if "license" in lower:
                        a = int(w.byte_at[d])
                        words = w.buffer[a : a + len(text.encode("utf-8", "surrogatepass"))].split(b" ")
                        words = [x for x in words if x]
                        for k, x in enumerate(words):
                            if x == b"license":
                                for phrase, label in PHRASES.items():
                                    s = k - len(phrase) + 1
                                    if s >= 0 and all(words[s + j] == p.encode() for j, p in enumerate(phrase)):
                                        base.append((s, label))
                    kept = detect(lower) if next(automaton.iter(lower), None) else []
                    if base:
                        at = [s for s, _ in base]
                        cols[2][d], cols[3][d], cols[4][d] = len(at), min(at), max(at)
                        cols[5][d] = ",".join(sorted({x for _, x in base}))
                    if base or kept:
                        cols[6][d] = ",".join(sorted({x for _, x in base} | {x[3] for x in kept}))
                        cols[7][d] = max([0.5 * bool(base), *(x[4] for x in kept)])
                        cols[8][d] = ",".join(f"{x[3]}:{x[0]}:{x[1]}" for x in kept)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return texts_of(docs).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
