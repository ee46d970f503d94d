from collections import Counter, defaultdict

import pytest

from tally.llm import mixing
from tally.llm import queries as q
from tests.llm import brute


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, None: 50, "c": 3}, {"x": 5}, {"a": 0, "b": 0}, {"a": 100, "b": 100, "c": 100, "d": 100}, {None: 7, "": 3, "é": 1, "z": 900}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute.targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_schedule_spreads_sources(spark):
    goal = mixing.plan(spark.createDataFrame([("a", 100_000), ("b", 30_000), ("c", 200_000)], "source string, source_size long")).cache()
    slots = [(r["slot"], r["place"], r["rank"], r["epoch"], r["block"]) for r in mixing.schedule(goal).orderBy("slot").collect()]
    want = {r["place"]: r for r in goal.collect()}
    ranks = defaultdict(list)
    for _, place, rank, epoch, block in slots:
        ranks[place].append(rank)
        assert (epoch, block) == divmod(rank, want[place]["n_blocks"])
    assert all(ranks[p] == list(range(r["slots"])) for p, r in want.items())
    share = {p: r["hi"] - r["lo"] for p, r in want.items()}
    for n in (50, 200, 700):  # every beginning of the schedule has the shares, to within a few slots
        seen = Counter(place for _, place, _, _, _ in slots[:n])
        assert all(abs(seen[p] - n * share[p]) <= 4 for p in share)


def test_points_are_evenly_spread(spark):
    got = sorted(r["p"] for r in spark.range(5000).select(mixing.points(mixing.F.col("id")).alias("p")).collect())
    assert 0 <= got[0] and got[-1] < 1
    assert max(abs(p - (i + 0.5) / 5000) for i, p in enumerate(got)) < 0.002
    exact = [r["p"] for r in spark.range(10**12, 10**12 + 5).select(mixing.points(mixing.F.col("id")).alias("p")).collect()]
    from fractions import Fraction
    from math import isqrt
    golden = Fraction(isqrt(5 * 10**80) - 10**40, 2 * 10**40)
    assert exact == pytest.approx([float((10**12 + i) * golden % 1) for i in range(5)], abs=1e-4)


def test_query(spark, sf_dir, documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    want = {r[0]: x for r, x in zip(rows, brute.mix(rows))}
    first = q.op7_golden_mix(spark, sf_dir).collect()
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in first}
    assert len(first) == len(rows)
    assert {k: v[:2] + v[3:] for k, v in got.items()} == {k: v[:2] + v[3:] for k, v in want.items()}
    assert [got[k][2] for k in want] == pytest.approx([want[k][2] for k in want])
    assert all(t <= 3 * n for n, _, _, t in got.values())
    assert sorted(map(tuple, q.op7_golden_mix(spark, sf_dir).collect())) == sorted(map(tuple, first))


def test_query_matches_its_sql(spark, sf_dir, duck):
    from tally.llm.registry import ORACLE_SQL
    want = sorted(duck.execute(ORACLE_SQL["op7_golden_mix"]).fetchall())
    got = sorted(map(tuple, q.op7_golden_mix(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert got == want


def test_mix_documents(spark, documents):
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(documents).collect()}
    out = mixing.mix_documents(documents)
    assert out.columns == documents.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    assert copies == {i: round(t / max(n, 1) + 1e-9) for i, (t, n) in taken.items() if int(t / max(n, 1) + 0.5)}


def test_awkward(awkward):
    rows = mixing.mix(awkward).collect()
    want = brute.mix([(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()])
    assert sorted((r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows) == \
        sorted((a, b, round(c, 6), d) for a, b, c, d in want)
    assert mixing.mix(awkward.limit(0)).collect() == []
    out = mixing.mix_documents(awkward)
    assert out.columns == awkward.columns and out.count() > 0
    assert mixing.mix_documents(awkward.limit(0)).collect() == []
