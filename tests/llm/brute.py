"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# quality rules

def quality_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:]))
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))


def quality(rows):
    """Verdicts of (text, lang, source) rows."""
    from tally.llm import quality_outliers as m

    floors = np.array(list(m.STATS.values()))
    d = len(floors)
    counts = [quality_counts(t) for t, _, _ in rows]
    failed = [n < 50 or 100 * r > 50 * n for n, _, _, _, r, _ in counts]
    stat = np.array([((c + 500) / (n + 100), s / max(n, 1), dl / max(ln, 1), r / max(n, 1)) for n, c, s, dl, r, ln in counts]).reshape(-1, d)
    pair = [(la or "", s or "") for _, la, s in rows]
    sizes = Counter(p for p, f in zip(pair, failed) if not f)
    rest = Counter()
    for (la, s), n in sizes.items():
        if n < m.MIN_GROUP:
            rest[la] += n
    key = [p if sizes[p] >= m.MIN_GROUP else p[0] if rest[p[0]] >= m.MIN_GROUP else "" for p in pair]

    def factor(c):
        return np.linalg.cholesky(c + np.diag(floors ** 2))

    def distance(x, mean, low):
        return (np.linalg.solve(low, (x - mean).T) ** 2).sum(axis=0)

    far = np.zeros(len(rows))
    for k in set(key):
        mine = np.array([i for i, x in enumerate(key) if x == k])
        x = stat[[i for i in mine if not failed[i]]]
        if not len(x):
            continue
        best = None
        for low in (factor(np.cov(x.T, bias=True).reshape(d, d)), np.diag(10 * floors)):
            mean = x.mean(axis=0)
            for _ in range(m.STEPS):
                bins = np.floor(16 * np.log2(distance(x, mean, low) + 1e-4)).astype(int)
                before = np.array([(bins < b).sum() for b in bins])
                core = x[before < m.CORE * len(x)]
                mean, low = core.mean(axis=0), factor(np.cov(core.T, bias=True).reshape(d, d) * m.CONSISTENCY)
            det = np.diag(low).prod()
            if best is None or det < best[0] - 1e-12:
                best = (det, mean, low)
        far[mine] = distance(stat[mine], best[1], best[2])
    return counts, failed, [not f and x <= m.CUTOFF for f, x in zip(failed, far)]


# near duplicates

def fingerprint(text, shingle=3):
    w = words(re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(values, linked):
    """Index of the smallest linked index, for each value."""
    head = list(range(len(values)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return [find(i) for i in range(len(values))]


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and max(map(int, m.group().split("."))) > 255
                    or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def listing(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def redact(text, found):
    out, at, runs = "", 0, []
    for a, _, b, kind in found:
        if runs and runs[-1][1] > a:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b, kind])
    for a, b, kind in runs:
        out += text[at:a] + f"[{kind.upper()}]"
        at = b
    return out + text[at:]


# mixing

def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        share = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] >= 3 * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            rest -= 3 * sizes[s]
            open_.discard(s)
    return out


def mix(rows):
    """(size, source_size, target, taken) of (doc_id, text, source) rows."""
    size = [len(words(t)) for _, t, _ in rows]
    per = defaultdict(int)
    for n, (_, _, s) in zip(size, rows):
        per[s] += n
    goal = targets(per)
    taken = [0] * len(rows)
    for s in per:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        mine.sort(key=lambda i: md5(f"mix|{'' if rows[i][0] is None else rows[i][0]}|{md5(rows[i][1] or '')}"))
        left = min(math.floor(goal[s] + 0.5), 3 * per[s])
        for i in mine * 3:
            n = min(left, size[i])
            taken[i] += n
            left -= n
    return [(n, per[s], goal[s], t) for n, (_, _, s), t in zip(size, rows, taken)]
