import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tally.llm import periodic_runs as pr
from tally.llm.common import pick
from tally.llm.queries import op12_periodic_runs
from tally.llm.suffixes import Names, Wavelet

WHITE = b" \t\n\x0b\x0c\r"


def plain_runs(words, shortest=12):
    """(start, period, length) of all runs, period by period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(shortest, 2 * q):
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, q, e - s) for (s, e), q in out.items())


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, q, l in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else None
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{l},{q}\n" for s, q, l in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4), *sha)


def test_suffix_order_and_successors():
    rng = np.random.default_rng(5)
    code = rng.integers(0, 3, 300)
    names = Names(code, np.full(300, 300))
    place = names.suffix_array()
    assert place.tolist() == sorted(range(300), key=lambda i: code[i:].tolist())
    tree = Wavelet(place)
    lo, size = rng.integers(0, 290, 500), rng.integers(0, 11, 500)
    least = rng.integers(0, 320, 500)
    got = tree.successor(lo, lo + size, least, -1).tolist()
    assert got == [min((v for v in place[a:a + b].tolist() if v >= c), default=-1) for a, b, c in zip(lo.tolist(), size.tolist(), least.tolist())]


def test_runs_of_random_sequences():
    rng = random.Random(1)
    for _ in range(250):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5, 40])
            d = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 20)
                d = d[:a] + [d[a + (i - a) % p] for i in range(a, n)]
            docs.append(d + d if rng.random() < 0.2 else d)
        code = np.array([x for d in docs for x in d], np.int64)
        row, start, length, period = (x.tolist() for x in pr.runs_of(code, np.append(0, np.cumsum([len(d) for d in docs]))))
        got = [[(s, q, l) for r, s, l, q in zip(row, start, length, period) if r == i] for i in range(len(docs))]
        assert got == [plain_runs(d) for d in docs]


def test_runs_at_every_length_of_period():
    for q in range(1, 60):
        for length in {max(12, 2 * q), max(12, 2 * q) + 1, max(12, 2 * q) - 1, 5 * q}:
            body = [1000 + i % q for i in range(length)]
            words = [*range(37), *body, *range(2000, 2011)]
            row, start, size, period = pr.runs_of(np.array(words), np.array([0, len(words)]))
            want = [(37, q, length)] if length >= max(12, 2 * q) else []
            assert list(zip(start.tolist(), period.tolist(), size.tolist())) == want


@pytest.mark.parametrize("make", [lambda n: np.zeros(n, np.int64), lambda n: np.random.default_rng(0).integers(0, 2, n)])
def test_time_grows_with_the_text(make):
    def took(n):
        best = 9e9
        for _ in range(3):
            t = time.perf_counter()
            pr.runs_of(make(n), np.array([0, n]))
            best = min(best, time.perf_counter() - t)
        return best

    assert took(80_000) < 4 * took(40_000)


def test_query_equals_plain_version(spark, sf_dir, documents):
    got = {tuple(r) for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert got == {plain_row(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()}
    assert sum(r[1] > 0 for r in got) > 10


def test_awkward_rows(spark, awkward):
    short = pick(awkward, doc_id="doc_id", text="text").where("length(text) < 40000 or text is null")
    got = [tuple(r) for r in pr.run_digests(pr.find_runs(short, repeat=pr.planted)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(r[0], r[1]) for r in short.collect()), key=str)
    full = pr.find_runs(awkward).collect()
    assert len(full) == awkward.count()
    (long,) = [r for r in full if r["n_words"] == 40_000]
    assert [tuple(x) for x in long["runs"]] == [(0, 40_000, 2)] and long["collapsed"] == "long word"
    assert pr.find_runs(awkward.limit(0)).count() == 0
