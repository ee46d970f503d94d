import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tally.llm import spelling as sp
from tally.llm.common import pick
from tally.llm.queries import op11_fm_index_spelling


def plain_counts(rows, least=6, every=199):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                out[w] += 1
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(counts, times=5, factor=5):
    words = {w: n for w, n in counts.items() if n >= times}
    lost: dict = {}
    for w in words:  # words one edit apart share a word with a character less, or one is it
        for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            lost.setdefault(k, set()).add(w)
    near = {w: {v for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))} for v in lost[k] if one_edit(v, w)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= factor * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdeféÿ"])
def test_search_schemes_find_each_pair(letters):
    rng = random.Random(letters)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(120)})
    index = sp.BidirectionalIndex(words[::2])
    for left in (True, False):
        got = {(words[a], words[::2][b]) for a, b in zip(*(x.tolist() for x in sp.one_error(index, words, left)))}
        assert got == {(w, v) for w in words for v in words[::2] if one_edit(w, v) and (
            v.startswith(w[:len(w) // 2]) if left else v.endswith(w[len(w) // 2:]))}


def test_query_equals_plain_version(spark, sf_dir, documents):
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in op11_fm_index_spelling(spark, sf_dir).collect()}
    want = plain_groups(plain_counts(documents.select("doc_id", "text").collect()))
    assert got == want and sum(r[4] > 0 for r in want) > 20 and any(r[1] for r in want)


def test_chains_hot_halves_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(sp, "HOT", 8)
    monkeypatch.setattr(sp, "SHARD", 64)
    rng = random.Random(2)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(150)}
    counts = {w: rng.choice([5, 6, 30, 31, 200]) for w in sorted(words)}
    chain = ["rootword", "rootwor", "rootwo", "ootwor", "rotwoé"]
    counts |= dict(zip(chain, (4000, 700, 6, 100, 5)))
    rows = [(None, (w + "-") * n) for w, n in counts.items()]
    got = {tuple(r) for r in sp.variant_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_groups(counts)
    assert got == want and max(n for n in Counter(r[2] for r in want).values()) > 2
    assert any(r[2] not in (r[0], r[1]) for r in want)


def test_awkward_rows(spark, awkward):
    rows = pick(awkward, doc_id="doc_id", text="text")
    short = rows.withColumn("text", F.regexp_replace("text", "x{57000}", ""))  # the plain version takes each letter out in turn
    got = {tuple(r) for r in sp.variant_groups(short, times=1).collect()}
    assert got == plain_groups(plain_counts(short.collect()), times=1)
    assert max(len(r[0]) for r in got) > 2900
    assert sp.variant_groups(awkward.limit(0)).count() == 0
