"""Robust outliers in numpy, row by row, for the verdicts on quality."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from . import brute

FLOORS = np.array([0.12, 0.3, 0.1, 0.1])


def features(text):
    n, chars, symbols, dup, rep, failed = brute.quality(text)
    lines = sum(1 for x in (text or "").split("\n") if brute.WORD.search(x))
    return failed, [np.log(max(chars, 1) / max(n, 1)), np.log1p(100 * symbols / max(chars, 1)), rep / max(n, 1), dup / max(lines, 1)]


def binned_median(v):
    bins = np.sort(np.floor(v * 128))
    return (bins[int(np.ceil(0.5 * len(bins))) - 1] + 0.5) / 128


def distances(x, mean, cov):
    d = x - mean
    return np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T)


def step(x, mean, cov):
    bins = np.floor(np.log(distances(x, mean, cov) + 1e-9) * 32)
    order = np.sort(bins)
    last = order[int(np.ceil(0.75 * len(x))) - 1]  # the bin in which the share is reached
    near = x[bins <= last]
    return near.mean(0), np.cov(near.T, bias=True) + np.diag(FLOORS**2)


def estimate(x):
    middle = np.array([binned_median(v) for v in x.T])
    spread = np.array([binned_median(np.abs(v - m)) * 1.4826 for v, m in zip(x.T, middle, strict=True)])
    best = None
    for mean, cov in ((middle, np.diag(spread**2 + FLOORS**2)), (middle, np.diag(FLOORS**2)), (x.mean(0), np.cov(x.T, bias=True) + np.diag(FLOORS**2))):
        mean, cov = step(x, mean, cov)
        while True:
            further = step(x, mean, cov)
            if not np.linalg.slogdet(further[1])[1] < np.linalg.slogdet(cov)[1] - 1e-6:
                break
            mean, cov = further
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    return best[1:]


def verdicts(docs):
    """{doc_id: kept} for (doc_id, text, lang, source) rows."""
    own = {i: (*features(t), lang, source) for i, t, lang, source in docs}
    by = defaultdict(list)
    for failed, x, lang, source in own.values():
        if not failed:
            by[lang, source].append(x)
            by[lang].append(x)
            by[None].append(x)
    known, kept = {}, {}
    for i, (failed, x, lang, source) in own.items():
        key = next((k for k in ((lang, source), lang, None) if len(by[k]) >= 100), None)
        if not failed and len(by[key]) >= 100:
            if key not in known:
                rows = np.array(by[key])
                mean, cov = estimate(rows)
                bins = np.sort(np.floor(np.log(distances(rows, mean, cov) + 1e-9) * 32))
                scale = max(1.0, np.exp((bins[int(np.ceil(0.5 * len(bins))) - 1] + 0.5) / 32) / 3.3567)
                known[key] = mean, cov, scale
            mean, cov, scale = known[key]
            kept[i] = bool(distances(np.array([x]), mean, cov)[0] / scale <= 28.4733)
        else:
            kept[i] = not failed
    return kept
