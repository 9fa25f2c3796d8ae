"""Plain definitions that the operators are held against."""

import hashlib
import re

WORD = r"[^\x20\x09-\x0D]+"


def repeats(texts: dict[int, str | None], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen, out = set(), {}
    for doc_id, text in sorted(texts.items()):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                mark[k : k + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[doc_id] = len(raw), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(raw, mark, strict=True) if not m)).hexdigest()
    return out


def near(texts: dict[int, str | None], k: int = 4, percent: int = 80) -> dict[int, tuple[int, int]]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(WORD, (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    least = {i: i for i in texts}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def base_rules(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = re.findall(WORD, text)
    grams: dict[tuple, list[int]] = {}
    for j in range(len(w) - 2):
        grams.setdefault(tuple(w[j : j + 3]), []).append(j)
    covered = {j + d for places in grams.values() if len(places) > 1 for j in places for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def fill(weights, sizes, most=3):
    """Targets by sharing again and again."""
    total, target, capped = float(sum(sizes)), [0.0] * len(sizes), [s == 0 for s in sizes]
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        over = [k for k in range(len(sizes)) if not capped[k] and left * weights[k] / weight > most * sizes[k]]
        if not over:
            return [most * s if c else left * w / weight for w, s, c in zip(weights, sizes, capped, strict=True)]
        for k in over:
            capped[k] = True


def balanced(rows, targets, most=3, ridge=0.3):
    """Rates by bisection: of the slope, and for each slope of every source's multiplier."""
    import math

    whole = sum(n for _, _, n in rows)
    mean = sum(n * math.log(n) for _, _, n in rows if n) / whole if whole else 0.0
    by = {}
    for i, s, n in rows:
        if n:
            by.setdefault(s, []).append((i, n, math.log(n) - mean))

    def rate(z):
        return most / (1 + (most - 1) * math.exp(-min(60.0, max(-60.0, z))))

    def solved(slope):
        rates = {}
        for s, own in by.items():
            if targets[s] >= most * sum(n for _, n, _ in own) * (1 - 1e-9):
                rates |= {i: float(most) for i, _, _ in own}
                continue
            lo, hi = -60.0, 60.0
            for _ in range(200):
                m = (lo + hi) / 2
                lo, hi = (m, hi) if sum(n * rate(m + slope * x) for _, n, x in own) < targets[s] else (lo, m)
            rates |= {i: rate(hi + slope * x) for i, _, x in own}
        return rates

    lo, hi = -20.0, 20.0
    for _ in range(100):
        m = (lo + hi) / 2
        rates = solved(m)
        slack = sum(n * rates[i] * x for own in by.values() for i, n, x in own) + ridge * whole * m
        lo, hi = (m, hi) if slack < 0 else (lo, m)
    return {i: 0.0 for i, _, n in rows if not n} | solved((lo + hi) / 2)


def robust_distances(groups, x, floors, prior=20, half=1.9122, most_of=1.0556, inner=12.8325, plain=0.1):
    """Squared distances by minimum covariance determinants on whole arrays; medians are lower ones, groups small or large alike."""
    import numpy as np

    floors, out, p = np.array(floors, float), np.empty(len(x)), x.shape[1]
    low = lambda a: np.sort(a, axis=0)[(len(a) - 1) // 2]
    own = lambda y: (low(y), 1.4826 * low(np.abs(y - low(y))))
    share = lambda n: n / (n + prior)
    languages = np.array([str(g[0]) for g in groups])
    for g in sorted(set(groups), key=str):
        at = np.array([k for k, h in enumerate(groups) if h == g])
        y, spoken = x[at], x[languages == str(g[0])]
        t, c = own(x)
        for rows in (spoken, y):
            s, (mid, dev) = share(len(rows)), own(rows)
            t, c = s * mid + (1 - s) * t, s * dev + (1 - s) * c
        c, rho = np.maximum(c, floors), share(len(y))

        def fit(chosen, factor):
            mean = rho * chosen.mean(axis=0) + (1 - rho) * t
            cov = rho * factor * np.cov(chosen.T, bias=True).reshape(p, p) + (1 - rho) * np.diag(c**2)
            return mean, cov + np.diag(np.maximum(0, floors**2 - np.diag(cov)))

        def away(mean, cov):
            return np.einsum("ij,jk,ik->i", y - mean, np.linalg.inv(cov), y - mean)

        z = (y - t) / c
        r = np.linalg.norm(z, axis=1, keepdims=True)
        found = []
        for w in (None, np.tanh(z), np.divide(z, r, out=np.zeros_like(z), where=r > 0)):
            corr = np.eye(p)
            if w is not None:
                m = w.T @ w
                d = np.sqrt(np.diag(m))
                scale = np.outer(d, d)
                corr = np.where(np.eye(p) > 0, 1.0, (1 - plain) * np.divide(m, scale, out=np.zeros_like(m), where=scale > 0))
            now, last = (t, corr * np.outer(c, c)), np.inf
            while True:
                d2 = away(*now)
                new = fit(y[d2 <= np.sort(d2)[(len(y) - 1) // 2] * 1.02], half)
                det = np.linalg.slogdet(new[1])[1]
                if not det < last - 1e-3:
                    break
                now, last = new, det
            found.append((last, len(found), now))
        best = min(found, key=lambda f: f[:2])[2]
        out[at] = away(*fit(y[away(*best) <= inner], most_of))
    return out
