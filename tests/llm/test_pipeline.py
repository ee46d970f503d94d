import sentencepiece
from collections import Counter

import corpus_pipeline
from tally.llm import pii
from tally.llm import queries as q
from tests.llm import brute


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixture", "tokens"]


def test_run_against_brute_force(spark, sf_dir, documents):
    rows = sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect())
    _, _, kept = brute.quality([r[1:] for r in rows])
    rows = [r for r, k in zip(rows, kept) if k]
    fps = [brute.fingerprint(r[1]) for r in rows]
    head = brute.groups(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    rows = [r for i, r in enumerate(rows) if head[i] == i]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    added = {r["doc_id"]: [s for s in r["span_list"] if not s["base"]] for r in pii.find_personal_data(df).collect()}
    spans = {i: sorted(brute.base_spans(t) + [(s["start"], s["order"], s["end"], s["kind"]) for s in added[i]]) for i, t, _, _ in rows}
    rows = [(i, brute.redact(t, spans[i]), la, s) for i, t, la, s in rows]
    mixed = brute.mix([(i, t, s) for i, t, _, s in rows])
    pieces = sentencepiece.SentencePieceProcessor(model_file=q.vocabulary("piece_bpe_32k.model"))
    want = Counter()
    for (i, t, _, _), (size, _, _, taken) in zip(rows, mixed):
        if times := int(taken / max(size, 1) + 0.5):
            want[i, tuple(pieces.encode(t))] = times
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want


def test_awkward(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "").checkpoint()
        assert name == "tokens" or out.columns == docs.columns
        docs = out
    empty = awkward.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "").checkpoint()
        assert empty.count() == 0
