import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tally.llm import language_id as m
from tally.llm import queries as q


def kneser_ney(texts, order=m.ORDER):
    """Interpolated Kneser-Ney over characters, from its definition."""
    counts = Counter()
    for t in texts:
        flat = " ".join(re.findall(r"[^\W\d_]+", t.lower()))
        padded = " " * (order - 1) + flat + " "
        counts.update(padded[i - order + 1:i + 1] for i in range(order - 1, len(padded)) if flat)
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discount, total, types = {}, {}, {}
    for k, table in tables.items():
        once, twice = (sum(v == x for v in table.values()) for x in (1, 2))
        discount[k] = max(0.05, min(0.95, once / (once + 2 * twice) if once + 2 * twice else 0.5))
        total[k], types[k] = Counter(), Counter()
        for g, v in table.items():
            total[k][g[:-1]] += v
            types[k][g[:-1]] += 1

    def p(gram, alphabet):
        k = len(gram)
        if k == 0:
            return 1 / alphabet
        lower, context = p(gram[1:], alphabet), gram[:-1]
        if not total[k][context]:
            return lower
        return (max(tables[k][gram] - discount[k], 0) + discount[k] * types[k][context] * lower) / total[k][context]

    return p, set(tables[1])


def test_entropies_follow_the_definition(spark):
    rnd = random.Random(0)
    rows = [(i, "".join(rnd.choice("abc d" if i % 2 else "abxy é") for _ in range(60)), "ab"[i % 2 == 0]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    aside = {r["doc_id"] for r in df.where(F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(m.CALIBRATION_SHARE)) == 0).collect()}
    model = m.fit(df)
    exact = {x: kneser_ney([t for i, t, y in rows if y == x and i not in aside]) for x in "ab"}
    alphabet = len(exact["a"][1] | exact["b"][1]) + 1
    tests = ["abc dxy é zz", "a", "cab bac   d"]
    bits, n = model.entropies(pa.array(tests))
    for t, row in zip(tests, bits):
        padded = "   " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
        for x, got in zip("ab", row):
            want = -sum(math.log2(exact[x][0](padded[i - 3:i + 1], alphabet)) for i in range(3, len(padded))) / (len(padded) - 3)
            assert got == pytest.approx(want, rel=1e-4)


def test_values_follow_the_definition_in_one_pass_of_all_orders(spark):
    """All orders share two aggregates: a plan that names each order anew fills the driver."""
    texts = {"aa": ["abc é", "cab"], "bb": ["日本 a", "\U0001F600 xyz a", "xy"]}
    rows = [(t, x) for x, every in texts.items() for t in every]
    grams = m._grams(spark.createDataFrame(rows, "text string, lang string")).checkpoint()
    values = m._values(grams)
    assert values._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 10
    got = {(r["part"], r["k"], r["lang"], r["gram"]): r["value"] for r in values.collect()}
    n, known = Counter(), {m.ORDER: {(r["lang"], r["gram"]): r["n"] for r in grams.collect()}}
    for k in range(m.ORDER - 1, 0, -1):
        known[k] = Counter((x, g[1:]) for x, g in known[k + 1])
    for k, table in known.items():
        for x in texts:
            mine = {g: v for (y, g), v in table.items() if y == x}
            once, twice = (sum(v == i for v in mine.values()) for i in (1, 2))
            d = max(0.05, min(0.95, once / (once + 2 * twice) if once + 2 * twice else 0.5))
            for c in {g[:-1] for g in mine}:
                own = {g: v for g, v in mine.items() if g[:-1] == c}
                total = sum(own.values())
                assert got["context", k, x, c] == pytest.approx(d * len(own) / total)
                for g, v in own.items():
                    assert got["run", k, x, g] == pytest.approx(max(v - d, 0) / total)
                n.update(["run"] * len(own) + ["context"])
    assert sum(n.values()) == len(got)


def test_held_out_accuracy(spark, sf_dir):
    wide = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{wide}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in q.op10_kneser_ney_language(spark, wide).collect()]
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert 0.25 < len(held) / len(rows) < 0.42
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_awkward(spark, awkward):
    rows = m.identify(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1
    empty = [r for r in rows if r["doc_id"] in (0, 1, 2, 10)]
    assert empty and all((r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False) for r in empty)
    assert m.identify(awkward.limit(0)).collect() == []
    unlabelled = awkward.drop("lang").withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in m.identify(unlabelled).collect()} == {"und"}


def test_marks_alone_are_no_letters():
    texts = pa.array(["\u0301", "1 \u0301\u0300 !", "e\u0301", "", None, "x"])
    assert (m.runs(texts).counts > 0).tolist() == [False, False, True, False, False, True]


def test_labels_are_no_inputs_of_a_prediction(spark, documents):
    """Held-out rows get the same predictions whatever their labels, source and id say."""
    a = {r["text"]: r["lang_pred"] for r in _held(m.identify(documents), documents)}
    other = documents.withColumn("lang", F.when(m.remainder(F.col("doc_id")) == 1, F.lit("xx")).otherwise(F.col("lang")))
    b = {r["text"]: r["lang_pred"] for r in _held(m.identify(other), documents)}
    assert a == b


def _held(found, documents):
    return found.where("held_out").join(documents.select("doc_id", "text"), "doc_id").collect()


def test_a_model_that_stays_a_table_keeps_every_run(spark, documents, awkward, monkeypatch):
    """Past the bound, rows get what the arrays give."""
    def answers(df):
        rows = m.identify(df).collect()
        return sorted(((r["doc_id"] or -1, r["held_out"], r["lang_pred"], r["accepted"]), r["score"], r["bits"]) for r in rows)

    for df in (documents, awkward):
        monkeypatch.undo()
        want = answers(df)
        monkeypatch.setattr(m, "MAX_ROWS", 10)
        got = answers(df)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [x for g in got for x in g[1:]] == pytest.approx([x for w in want for x in w[1:]], abs=1e-4)


def test_rows_set_aside_are_learned_too(spark):
    """A language whose only labelled rows are set aside for calibration is predicted."""
    ids = spark.range(3000).where(m.remainder(F.col("id")) != 1)
    mine = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("id")), F.lit(m.CALIBRATION_SHARE)) == 0
    rnd = random.Random(1)

    def text(letters):
        return "".join(rnd.choice(letters) for _ in range(80))

    rows = [(r["id"], text("abcde "), "aa") for r in ids.where(~mine).limit(60).collect()]
    rows += [(r["id"], text("fghij "), "bb") for r in ids.where(~mine).orderBy(F.desc("id")).limit(60).collect()]
    rare = [r["id"] for r in ids.where(mine).limit(3).collect()]
    rows += [(i, text("xyzwv "), "cc") for i in rare] + [(None, text("xyzwv "), "cc"), (None, text("abcde "), "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == t[2] for r, t in zip(m.identify(df.coalesce(1)).collect(), rows))
    labelled = df.where("doc_id IS NOT NULL")
    model, exact = m.learn(labelled), kneser_ney([t for i, t, y in rows if y == "cc" and i in rare])
    assert model.langs == ["aa", "bb", "cc"]
    bits, _ = model.entropies(pa.array(["xyz"]))
    padded = "   xyz "
    want = -sum(math.log2(exact[0](padded[i - 3:i + 1], model.alphabet)) for i in range(3, len(padded))) / (len(padded) - 3)
    assert bits[0][2] == pytest.approx(want, rel=1e-4)
