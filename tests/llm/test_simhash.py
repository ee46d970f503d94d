import random

import pytest

from tally.llm import queries as q
from tally.llm.components import connected
from tally.llm.simhash import fingerprint, keep_first, links, near_duplicates
from tests.llm import brute


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def near(a, b, most=2):
    return bin((a ^ b) & (1 << 64) - 1).count("1") <= most


@pytest.mark.parametrize("text", ["", "a", "a b", "A b C", "x y z x y z x y z", "é É  ß\x0b\x1cq r s t", "one two\tthree\nfour five"])
def test_fingerprint(text):
    assert fingerprint(text.encode(), 3) == brute.fingerprint(text)


@pytest.mark.parametrize("most", [2, 1, 0])
def test_links_connect_what_brute_force_connects(spark, most):
    rnd, fps = random.Random(3), set()
    for c in range(6):
        base = rnd.getrandbits(64)
        for _ in range(100 if c < 3 else 10):  # entries with more and with fewer members than BUCKET
            x = base
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64 if c else 32)
            fps.add(signed(x))
    base = rnd.getrandbits(64)
    fps |= {signed(base & 0xFFFFFFFF | rnd.getrandbits(5) << 40 ^ rnd.getrandbits(4) << 60) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = links(df, most).collect()
    assert all(near(r["u"], r["v"], most) for r in found)
    root = {r["u"]: r["v"] for r in connected(links(df, most)).collect()}
    want = brute.groups(fps, lambda a, b: near(a, b, most))
    assert [root.get(f, f) for f in fps] == [fps[i] for i in want]


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (2000, 2001)]
    got = {r["u"]: r["v"] for r in connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 200)} | {2001: 2000}


def test_query(spark, sf_dir, documents):
    rows = sorted(documents.collect(), key=lambda r: r["doc_id"])
    fps = [brute.fingerprint(r["text"]) for r in rows]
    head = brute.groups(fps, near)
    want = [(r["doc_id"], f"{f:016x}", rows[h]["doc_id"]) for r, f, h in zip(rows, fps, head)]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in q.op3_simhash_multi_index(spark, sf_dir).collect())
    assert got == want
    kept = keep_first(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["doc_id"] for r, h, i in zip(rows, head, range(len(rows))) if h == i})


def test_awkward(awkward):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {0, 1, 2} and {r["component_id"] for r in zero} == {0}
    kept = keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, None, 5} <= set(ids) and not {1, 2, 6} & set(ids)
    assert near_duplicates(awkward.limit(0)).collect() == [] and keep_first(awkward.limit(0)).collect() == []
