"""License scan, quality rules and personal data."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import license_rules, pii, quality_outliers
from tally.llm import queries as q
from tally.llm.license_rules import license_scan, rules, scan, scanner
from tests.llm import brute

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_base(text):
    w = LICENSE_WORD.findall(re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))
    hits = [(i, label) for phrase, label in license_rules.BASE for i in range(len(w))
            if w[i:i + len(phrase.split())] == phrase.split()]
    return (len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None),
            ",".join(sorted({label for _, label in hits})))


def test_license_rules_are_many_and_gated():
    assert len(rules()) >= 300
    for rule in rules():
        assert rule.keyword and len(rule.keyword) >= 3


@pytest.mark.parametrize("text, labels", [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("GNU Lesser General Public License v2.1", "lgpl"), ("GNU Affero General Public License", "agpl"),
    ("released under the Mozilla Public License 2.0", "mpl"), ("nothing here", ""), ("", ""), ("mit", ""),
    ("submit license", ""), ("Apache  License,\nVersion 2.0", "apache")])
def test_license_labels(text, labels):
    assert scan(text.encode(), scanner())[5] == labels


def test_license_suppression():
    kept = scanner().detect("this work is licensed under the gnu general public license version 3 or later")
    spans = [(a, b) for a, b, _ in kept]
    assert not any(a <= c and d <= b for i, (a, b) in enumerate(spans) for j, (c, d) in enumerate(spans) if i != j)
    best = max(kept, key=lambda d: d[2].priority)
    assert (best[2].label, best[2].priority) == ("gpl", 40)


def plain_detections(joined, use):
    """Matches of all rules without the gate, and of them those in no stronger one."""
    order = {rule: i for i, rule in enumerate(use.rules)}
    found = [(m.start(), m.end(), r) for r in use.rules if r.keyword in joined for m in r.regex.finditer(joined)]

    def stronger(d, e):
        key = lambda x: (-x[2].priority, x[0] - x[1], order[x[2]])
        return e[0] <= d[0] and d[1] <= e[1] and key(e) < key(d)

    return sorted(d[:2] + (d[2].label,) for d in found if not any(stronger(d, e) for e in found))


def test_detections_equal_all_pairs():
    rng = random.Random(6)
    bits = ["licensed under the", "gnu general public license", "version 3", "or later", "v2", "apache license", "apache", "mit license", "the", "spdx license identifier",
            "mit", "bsd", "license", "released under", "mozilla public license", "2 0", "lesser", "gnu", "public domain", "cc by", "sa 4 0", "and", "word"]
    for _ in range(150):
        joined = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        kept = scanner().detect(joined)
        assert sorted((a, b, r.label) for a, b, r in kept) == plain_detections(joined, scanner()), joined
        row = scan(joined.encode(), scanner())
        assert row[5].split(",") == sorted({x for x in [*row[4].split(","), *(r.label for _, _, r in kept)] if x}) or not row[5]
        assert [(d["first"], d["last"], d["label"]) for d in row[7]] == [(joined[:a].count(" "), joined[:b].count(" "), r.label) for a, b, r in kept]
        assert scan(joined.encode(), scanner(), False)[:7] == row[:7]


def seconds(run, *args):
    import time
    best = 9e9
    for _ in range(3):
        t = time.perf_counter()
        run(*args)
        best = min(best, time.perf_counter() - t)
    return best


def test_scan_time_grows_with_the_text():
    texts = [("licensed under the apache license version 2 0 é " * n).encode() for n in (4000, 16000)]
    small, large = (seconds(scan, t, scanner()) for t in texts)
    assert large < 6.5 * small


def plain_spans(cands):
    """Spans of (start, order, end, kind, base) candidates, pair by pair."""
    base = {c for c in cands if c[4]}
    touch = lambda a, b: a[3] == b[3] and a[0] < b[2] and b[0] < a[2]
    more = {c for c in cands if not c[4] and not any(touch(c, b) for b in base)}
    size = lambda c: c[2] - c[0]
    free = {c for c in more if not any(touch(c, o) and (size(o) > size(c) or size(o) == size(c) and o[0] < c[0]) for o in more)}
    return sorted(base | free)


def test_spans_equal_all_pairs(spark):
    rng, rows = random.Random(8), []
    for i in range(300):
        cands, at = [], 0
        for _ in range(rng.randint(0, 12)):  # base spans of a kind do not overlap
            at += rng.randint(0, 9)
            order = rng.randrange(3)
            cands.append((at, order, at + 4, pii.KINDS[order], True))
            at += 4
        for _ in range(rng.randint(0, 25)):
            start, order = rng.randrange(100), rng.randrange(3)
            cands.append((start, order, start + rng.randint(1, 12), pii.KINDS[order], False))
        cands += [c for c in cands if rng.random() < 0.1]
        rng.shuffle(cands)
        text = "".join(rng.choice("ab é\U0001F600\ufeff") for _ in range(rng.randint(115, 150)))
        rows.append((i, text, [(*c[:5], "1" * pii.LABELERS, []) for c in cands]))
    kind = "array<struct<start:int,order:int,end:int,kind:string,base:boolean,votes:string,features:array<string>>>"
    df = spark.createDataFrame(rows, f"i int, text string, cands {kind}")
    weights = {k: 5.0 for k in pii.KINDS}
    out = df.select("i", "text", "cands", pii.spans(F.col("cands"), weights).alias("s")).withColumn("r", pii.redacted(F.col("text"), F.col("s"))).collect()
    for r in out:
        want = plain_spans([tuple(c)[:5] for c in r["cands"]])
        assert [tuple(x) for x in r["s"]] == want
        assert r["r"] == brute.redact(r["text"], [(s, o, e, k) for s, o, e, k, _ in want])


def test_many_spans_in_one_text(spark):
    def took(n):
        text = " ".join(f"write joe{i}@example.com now" for i in range(n))
        found = spark.createDataFrame([(text,)], "text string").select("text", pii.candidates(F.col("text")).alias("c")).checkpoint()
        out = found.select(pii.redacted(F.col("text"), pii.spans(F.col("c"), {})).alias("r"))
        assert out.first()["r"] == " ".join(["write [EMAIL] now"] * n)
        return seconds(out.collect)

    took(1000)
    small, large = took(8000), took(16000)
    assert large < 3 and large < 2.3 * small + 0.5


def test_license_query(spark, sf_dir, documents):
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = q.op4_license_rules(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_base(text[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_awkward(awkward):
    rows = license_scan(awkward).collect()
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(key((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in rows) == \
        sorted(key(license_base(r["text"])) for r in awkward.collect())
    assert license_scan(awkward.limit(0)).collect() == []


def test_quality_query(spark, sf_dir):
    wide = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{wide}/documents.parquet").collect()
    counts, failed, kept = brute.quality([(r["text"], r["lang"], r["source"]) for r in docs])
    got = {r["doc_id"]: r for r in q.op5_quality_outliers(spark, wide).collect()}
    assert len(got) == len(docs)
    for r, c, f, k in zip(docs, counts, failed, kept):
        row = got[r["doc_id"]]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == c[:5]
        assert (row["base_failed"], row["kept"]) == (f, k)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{wide}/labels.parquet").collect()}
    passed = [(labels[i], row["kept"]) for i, row in got.items() if i in labels and not row["base_failed"]]
    assert all(good == keep for good, keep in passed if good is not None)


def test_quality_matches_its_sql(spark, sf_dir, duck):
    from tally.llm.registry import ORACLE_SQL
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(duck.execute(ORACLE_SQL["op5_quality_outliers"]).fetchall())
    assert sorted(map(tuple, q.op5_quality_outliers(spark, sf_dir).select(*columns).collect())) == want


def test_quality_repeats(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    texts += ["a b c a b c", "a a a", "a a a a", "x y", "a b c d " * 500, "\n\n", "a\x0bb\x0cc a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", quality_outliers.features(F.col("text")).alias("f")).select("text", "f.*").collect()
    for r in got:
        assert tuple(r)[1:] == brute.quality_counts(r["text"]), r["text"]


def test_quality_of_many_groups(spark, documents, monkeypatch):
    """Beyond the broadcast bound the joins are salted; the verdicts stay."""
    want = sorted(map(tuple, quality_outliers.quality(documents).drop("distance").collect()))
    monkeypatch.setattr(quality_outliers, "BROADCAST_ROWS", 0)
    salted = quality_outliers.quality(documents).drop("distance")
    assert "_salt" in salted._jdf.queryExecution().logical().toString()
    assert sorted(map(tuple, salted.collect())) == want


def test_quality_awkward(awkward):
    rows = quality_outliers.quality(awkward).collect()
    assert len(rows) == awkward.count()
    assert not any(r["kept"] for r in rows if r["n_words"] < 50)
    kept = quality_outliers.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality_outliers.quality(awkward.limit(0)).collect() == []
    assert quality_outliers.keep_good(awkward.limit(0)).collect() == []


def test_quality_rejects_outliers_of_a_group(spark):
    rnd = random.Random(1)

    def prose(n, odd=""):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) + odd for _ in range(n))

    rows = [(i, prose(120), "en", "a") for i in range(300)] + [(1000 + i, prose(120, "#"), "en", "a") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in quality_outliers.quality(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(60))


def test_pii_base_spans(spark, documents):
    rnd = random.Random(5)
    texts = ["a@b.c_d@e.f x@y.zz. 1.2.3.4.5.6.7.8 300.1.2.3 +1 (555) 123-4567 4111 1111 1111 1111", None, "", "1 " * 3000,
             "+1" * 1000 + "a" * 20000, "@" * 300 + "a.b@c.d" * 50, "\U0001F600 x@y.com \U0001F600 001.002.003.255 " * 300]
    texts += ["".join(rnd.choice("0123456789.+- ()@ab%é") for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts, 10**6)), "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = pii.find_personal_data(df).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = brute.base_spans(text[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(brute.listing(want)), text[r["doc_id"]]
        assert tuple(r[f"n_{k}"] for k in pii.BASE_KINDS) == tuple(sum(s[3] == k for s in want) for k in pii.BASE_KINDS)
        assert set(brute.listing(want).split(",")) <= set(r["spans"].split(","))


def test_pii_adds_spans_and_leaves_clean_texts_alone(spark, documents):
    extra = ["write to joe (at) mail (dot) example.com please", "call 555-123-4567 now", "ssn 123-45-6789 is mine",
             "des +1 (826) 555-4081 190.4.5.6 la", "no personal data, version 3.0, 12 of 40", "order no 4111111111111112"]
    df = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string") \
        .unionByName(documents.select("doc_id", "text"))
    got = {r["doc_id"] - 10**6: r for r in pii.find_personal_data(df).collect()}
    kinds = [{s["kind"] for s in got[i]["span_list"]} for i in range(len(extra))]
    assert kinds == [{"email"}, {"phone"}, {"id"}, {"phone", "ip"}, set(), set()]
    out = {r["doc_id"] - 10**6: r["text"] for r in pii.redact(df).collect()}
    assert out[2] == "ssn [ID] is mine" and out[4] == extra[4]
    assert out[3] == "des [PHONE] [IP] la"


def test_pii_model_follows_em(spark):
    """The fold of the plan gives what plain expectation-maximisation gives."""
    patterns = {"111---": 40.0, "110---": 10.0, "00----": 30.0, "0011--": 5.0, "1-1--0": 7.0, "-1---0": 3.0}
    share, hit, miss = 0.5, [0.8] * 6, [0.2] * 6
    for _ in range(pii.ROUNDS):
        q_ = {}
        for votes in patterns:
            odds = share / (1 - share)
            for i, v in enumerate(votes):
                odds *= {"1": hit[i] / miss[i], "0": (1 - hit[i]) / (1 - miss[i]), "-": 1.0}[v]
            q_[votes] = 0.0 if votes[pii.CHECK] == "0" else odds / (1 + odds)
        n = sum(patterns.values())
        share = (sum(c * q_[v] for v, c in patterns.items()) + 1) / (n + 2)

        def rate(i, weight, prior):
            said = sum(c * weight(v) for v, c in patterns.items() if v[i] != "-")
            return (sum(c * weight(v) for v, c in patterns.items() if v[i] == "1") + 2 * prior) / (said + 2)

        hit = [rate(i, lambda v: q_[v], 0.8) for i in range(6)]
        miss = [rate(i, lambda v: 1 - q_[v], 0.2) for i in range(6)]
    df = spark.createDataFrame([("card", v, int(c)) for v, c in patterns.items()], "kind string, votes string, n long")
    model = pii.reliabilities(df).first()["model"]
    assert model["share"] == pytest.approx(share, rel=1e-9)
    assert np.allclose([model[f"hit{i}"] for i in range(6)], hit) and np.allclose([model[f"miss{i}"] for i in range(6)], miss)


def test_pii_awkward(awkward):
    rows = pii.find_personal_data(awkward).collect()
    assert sorted(r["base_sha256"] for r in rows) == sorted(brute.sha(brute.listing(brute.base_spans(r["text"]))) for r in awkward.collect())
    out = pii.redact(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert pii.find_personal_data(awkward.limit(0)).collect() == [] and pii.redact(awkward.limit(0)).collect() == []
    assert any("[EMAIL]" in (r["text"] or "") and r["n_chars"] == len(r["text"]) for r in out.collect())
