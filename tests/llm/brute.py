"""Plain Python forms of the corpus operators' contracts."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def warc(pages):
    groups = defaultdict(list)
    for i, html in pages:
        groups[(html or "").encode()].append(i)
    for i, html in pages:
        p = (html or "").encode()
        first = max(groups[p])
        yield i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first else "revisit", None if i == first else first


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in sorted(out))


def repeats(docs, n=400, first=False):
    raw = [(i, (t or "").encode()) for i, t in docs]
    count, seen = Counter(), {}
    for k in sorted(range(len(raw)), key=lambda k: (raw[k][0] is None, raw[k][0] or 0)):
        for a in range(len(raw[k][1]) - n + 1):
            g = raw[k][1][a : a + n]
            count[g] += 1
            seen.setdefault(g, (k, a))
    for k, (i, r) in enumerate(raw):
        gone, end = bytearray(len(r)), 0
        for a in range(len(r) - n + 1):
            g = r[a : a + n]
            if seen[g] != (k, a) if first else count[g] > 1:
                for x in range(max(a, end), a + n):
                    gone[x] = 1
                end = a + n
        yield i, len(r), sum(gone), sum(1 for x in range(len(r)) if gone[x] and (not x or not gone[x - 1])), sha(bytes(b for b, g in zip(r, gone, strict=True) if not g))


def jaccard(docs, k=3, percent=90):
    sets = []
    for _, t in docs:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = defaultdict(list)
    for x, s in enumerate(sets):
        for y, o in Counter(y for t in s for y in lists[t]).items():
            if 100 * o >= percent * (len(s) + len(sets[y]) - o):
                up[root(x)] = root(y)
        for t in s:
            lists[t].append(x)
    least = {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return [(i, len(sets[x]), least.get(root(x)) if sets[x] else i) for x, (i, _) in enumerate(docs)]


def windows(docs, n=13):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - n + 1):
                g = tuple(w[a : a + n])
                first[g] = min(first.get(g, i), i)
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            if i is not None and first[tuple(w[a : a + n])] < i:
                gone[a : a + n] = [True] * n
        yield i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def licenses(t):
    w = ALNUM.findall(lower(t))
    at = [(k, label) for k in range(len(w)) for p, label in PHRASES.items() if tuple(w[k : k + len(p)]) == p]
    return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def quality(t):
    t = t or ""
    w = WORD.findall(t)
    g = list(zip(w, w[1:], w[2:], strict=False))
    c, rep = Counter(g), set()
    for k, x in enumerate(g):
        if c[x] > 1:
            rep |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def leaks(docs, items, n=10):
    index = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        m = min(n, len(w))
        for k in range(len(w) - m + 1) if m else []:
            index[tuple(w[k : k + m])].add(str(i))
    for i, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for m in {len(g) for g in index}:
            for k in range(len(w) - m + 1):
                if got := index.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= got
        yield i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)
