import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tally.llm import toxicity as tx
from tally.llm.grammar import Transducer
from tally.llm.queries import op13_clause_grammar_toxicity

LEXICON = tx.build_lexicon([], 10, 100)
WEIGHT = LEXICON.weight("idiot")


def plain_scores(text, lexicon):
    """Clause scores by rules read off the grammar's description."""
    out = []
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        events, n = [], 0
        for m in re.finditer(r'["«»“”„‟]|[a-zÀ-῿₀-\U0010ffff]+', clause):
            if m[0] in '"«»“”„‟':
                events.append((None, "Q", 0.0))
            else:
                events.append((n, *lexicon.symbol(m[0])))
                n += 1
        score, negated, reported, quoted, target, waiting, last = 0.0, False, False, False, None, 0.0, None
        if not any(k in "IH" for _, k, _ in events if k):
            continue
        for place, kind, weight in events:
            if kind == "Q":
                quoted = not quoted
            if kind in ("", "Q"):
                continue
            negated &= last is None or place - last <= tx.GAP
            last = place
            if kind == "N":
                negated = True
            elif kind == "R":
                reported = True
            elif kind == "T":
                if target == "h":
                    score += waiting
                target = "t"
            else:
                f = (0.25 if kind == "I" else 0.1) if negated else 1.0
                f *= (0.5 if kind == "I" else 0.25) if reported else 1.0
                f *= (0.6 if kind == "I" else 0.4) if quoted else 1.0
                negated = False
                if kind == "I":
                    score += weight * f * (1.5 if target == "t" else 1.0)
                elif target == "t":
                    score += weight * f
                else:
                    target, waiting = "h", weight * f
        if score > 0:
            out.append(score)
    return out


def test_composition_equals_running_one_after_the_other():
    a = Transducer({(0, "a"): (1, "b", 0.5), (1, "b"): (0, "a", 3.0)})
    b = Transducer({(0, "b"): (1, "c", 2.0), (1, "a"): (0, "b", 0.25)})
    both = a.then(b, "abc")
    for text in map("".join, itertools.product("abc", repeat=6)):
        first = a.run(text)
        second = b.run("".join(w for w, _ in first))
        assert both.run(text) == [(w, u * v) for (_, u), (w, v) in zip(first, second)]


@pytest.mark.parametrize(("text", "score"), [
    ("What an idiot", 1), ("the weather is fine", 0), ("", 0), (None, 0),
    ("You are an idiot", 1.5), ("He is not an idiot", 1.5 * 0.25), ("not today or tomorrow or ever an idiot", 1),
    ("She said he was an idiot", 1.5 * 0.5), ('the word "idiot" is old', 0.6), ("«idiot» is old", 0.6),
    ("She said so. What an idiot", 1), ("IDIOT!!! IDIOT", 2)])
def test_clauses(text, score):
    _, found = tx.clause_scores(pa.array([text or ""]), LEXICON)
    assert found[:, 1].sum() == pytest.approx(score * WEIGHT, abs=1e-5)


def test_threats_need_a_target():
    scores = [tx.clause_scores(pa.array([t]), LEXICON)[1][:, 1].sum() for t in (
        "I will kill you", "they kill", "kill the lights", "I did not kill you", "kill the lights. you")]
    assert scores == pytest.approx([2, 2, 0, 0.2, 0])


def test_random_texts_equal_plain_rules():
    rng = np.random.default_rng(4)
    words = ["idiot", "stupid", "kill", "you", "not", "said", "the", "house", "é", "x", '"', ".", "\n", "«", "”", "—", "Trottel", "DU", "1", ","]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.integers(0, 40))) for _ in range(1500)]
    n, found = tx.clause_scores(pa.array(texts), LEXICON)
    for i, text in enumerate(texts):
        assert found[found[:, 0] == i, 1].tolist() == pytest.approx(plain_scores(text, LEXICON)), text
        assert n[i] == len(re.findall(r"[a-zÀ-῿₀-\U0010ffff]+", text.lower()))


def test_lexicon_weights():
    lexicon = tx.build_lexicon([(k, 40, 42) for k in ("q", "qu", "qua", "quax")] + [("quaxo", 0, 20), ("quaxi", 3, 3), ("r", 12, 100)], 110, 1000)
    base = np.log(110.1 / 1001 / (1 - 110.1 / 1001))
    own = (40 + 8 * 110.1 / 1001) / 50
    assert lexicon.weight("quaxi") == lexicon.weight("qu") == pytest.approx(np.log(own / (1 - own)) - base, abs=1e-5)
    assert lexicon.symbol("quaxyz")[0] == "I" and lexicon.symbol("quaxotl")[0] == ""  # told apart below a shared beginning
    assert lexicon.weight("rust") == 0 and lexicon.symbol("moron")[0] == "I"


def test_held_out_texts(spark):
    """Invented insults that only labels tell, in a language of their own."""
    rng = np.random.default_rng(1)
    stems = ["vor", "lan", "mig", "tes", "dun", "kal", "pir", "sov"]

    def word():
        return "".join(rng.choice(stems) for _ in range(rng.integers(1, 4)))

    rows, labels = [], []
    for i in range(3000):
        toxic = int(rng.random() < 0.15)
        text = [word() for _ in range(rng.integers(20, 120))]
        for _ in range(toxic * rng.integers(2, 6)):
            text[rng.integers(len(text))] = "zrak" + word()
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = tx.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert {r["held_out"] for r in got} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.99 * len(held)


def test_labels_of_held_out_rows_do_not_matter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", (tx.held_out(labels["doc_id"]) != (labels["toxic"] == 1)).cast("int"))
    want = sorted(tx.toxicity(docs, labels).collect())
    assert sorted(tx.toxicity(docs.drop("lang", "source"), flipped.drop("quality")).collect()) == want
    got = op13_clause_grammar_toxicity(spark, sf_dir).collect()
    assert sorted(got) == want and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(i % 11, i % 2, 1) for i in range(30)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, Toxic2 int")
    got = tx.toxicity(awkward, labels).collect()
    assert len(got) == awkward.count() and all(r["score"] is not None and r["predicted"] in (0, 1) for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert len(tx.toxicity(awkward, labels.limit(0)).collect()) == awkward.count()
    assert tx.toxicity(awkward.limit(0), labels).count() == 0
