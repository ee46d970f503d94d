import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tally.llm import queries as q
from tally.llm import simple8b
from tally.llm.segments import Coded, Memo, byte_level, metaspace
from tally.llm.sentencepiece_backend import Backend, backend, encode_decode
from tally.llm.token_files import encoder, read_range, read_tokens, write_tokens
from tally.llm.token_prefix import counter, prefix_tables, token_counts
from tally.session import scratch_dir

PIECES, BYTES = q.vocabulary("piece_bpe_32k.model"), q.vocabulary("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    letters = "ab ▁\n\r;{}é日<s> 0Ж \tthe  ing </s>"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_every_prefix_has_the_count_of_the_library(pieces):
    model = counter(PIECES)
    for text in odd_texts(250) + ["", " ", "  ", "internationalization of the token"]:
        want = [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]
        assert model.prefix_counts(text) == want
        n, (fits,) = model.totals(metaspace(pa.array([text, "x"])), (5,))
        assert n[0] == want[-1] and fits[0] == max(i for i, c in enumerate(want) if c <= 5)


def test_token_counts_query(spark, sf_dir, documents, pieces):
    got = {r["doc_id"]: r for r in q.op6_token_prefix(spark, sf_dir).collect()}
    for r in documents.collect():
        n = len(pieces.encode(r["text"]))
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["over_limit"]) == \
            (n, len(r["text"].encode()), n > q.TOKEN_LIMIT)


def test_token_counts_awkward(awkward, pieces):
    rows = token_counts(awkward, PIECES, 10).collect()
    want = sorted((len(pieces.encode(r["text"] or "")), len((r["text"] or "").encode())) for r in awkward.collect())
    assert sorted((r["n_tokens"], r["n_bytes"]) for r in rows) == want
    assert token_counts(awkward.limit(0), PIECES, 10).collect() == []
    spark = awkward.sparkSession
    table = prefix_tables(spark.createDataFrame([r for r in awkward.collect() if r[0] == 5], awkward.schema), PIECES).collect()
    assert len(table) == 2 and len(table[0]["counts"]) == len("same text here today") + 1


def test_backend_agrees_with_the_library(pieces):
    model = backend(PIECES, 1)
    for text in odd_texts(400, 2):
        assert model.encode([text]) == [pieces.encode(text)]
        assert model.decode([pieces.encode(text)]) == [text.replace("▁", " ")]


def handmade(path, pieces, kind=1, fallback=True, **spec):
    """A model with given scores, unigram unless ``kind`` is 2, written as a protobuf."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in pieces:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type = kind
    m.trainer_spec.byte_fallback = fallback
    m.normalizer_spec.name = "identity"
    for k, v in spec.items():
        setattr(m.normalizer_spec, k, v)
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("strip", [False, True])
def test_backend_unigram(tmp_path, strip):
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("c", -5.0, 1), ("ab", -5.5, 1), ("▁ab", -6.0, 1), ("bc", -7.25, 1), ("▁a", -6.5, 1)]
    path = handmade(tmp_path / "m.model", pieces, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=strip)
    model, rnd = Backend(path), random.Random(3)
    assert model.cuts is not strip
    for _ in range(300):
        text = "".join(rnd.choice("abc dé ") for _ in range(rnd.randint(0, 20)))
        assert model.encode([text]) == model.expected([text]), text


@pytest.mark.parametrize("kind", [1, 2])
def test_models_without_byte_fallback(spark, tmp_path, kind):
    """Characters that no piece has become the unknown id, with parity."""
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -2.5, 1), ("▁ab", -2.0, 1), ("▁a", -6.5, 1)]
    path = handmade(tmp_path / "m.model", pieces, kind, False, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=False)
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["ab z a", "", "z", "abab a b  ab", "é\U0001F600 ab", None]
    got = encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for r in got:
        assert r["ids"] == reference.encode(texts[r["doc_id"]] or ""), (r, texts[r["doc_id"]])
        assert r["round_trip"] == (reference.unk_id() not in r["ids"])


def test_memo_is_bounded_in_bytes(pieces):
    """Long segments fill no worker, and what is met again is kept."""
    model, rnd, most = Backend(PIECES), random.Random(5), 0
    for _ in range(24):
        texts = ["word " + "".join(rnd.choice("abcdefgh") for _ in range(1 << 20))]
        tokens, _, _ = model.rows(pa.array(texts))
        assert tokens.ids.tolist() == pieces.encode(texts[0])
        coded = model.memo.coded
        most = max(most, model.memo.known.nbytes + sum(x.nbytes for x in (coded.flat, coded.first, coded.size, coded.flags)))
    assert 0 < most <= 16 << 20
    assert " word" in model.memo.known.to_pylist()


def test_memo_gives_the_ids_of_its_encoder():
    made = []

    def encode(segments):
        made.append(segments.to_pylist())
        ids = [[len(s), *s.encode()] for s in made[-1]]
        size = np.array([len(x) for x in ids], np.int64)
        return Coded(np.array([y for x in ids for y in x], np.uint32), np.cumsum(size) - size, size, np.ones((len(ids), 1), bool))

    rnd = random.Random(6)
    for most, room in ((1 << 20, 1 << 20), (5, 1 << 20), (100, 700), (0, 0)):
        memo = Memo(encode, 1, most, room)
        for _ in range(40):
            texts = [" ".join(rnd.choice(["a", "b", "c", "dd", "e" * 30, "f" * 99, "", str(rnd.random())]) for _ in range(rnd.randint(0, 6))) for _ in range(3)]
            found = metaspace(pa.array(texts))
            tokens, flags = memo(found)
            want = [[y for u in found.use[a:b] for s in [found.distinct[int(u)].as_py()] for y in (len(s), *s.encode())] for a, b in zip(found.bounds, found.bounds[1:])]
            assert [tokens.ids[a:b].tolist() for a, b in zip(tokens.bounds, tokens.bounds[1:])] == want
            assert flags.all() and len(memo.known) <= most
        if most == 1 << 20:
            assert sorted(x for y in made for x in y) == sorted({x for y in made for x in y})  # none twice


def test_ids_are_the_backends(tmp_path, monkeypatch):
    """Ids come from the rebuilt backend, and from sentencepiece where the two differ."""
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.5, 1)]
    model = Backend(handmade(tmp_path / "m.model", pieces, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=False))
    texts, encode, made = ["ab a", "b", "a"], model.encode, []

    def spied(x):
        made.extend(encode(x))
        made[1] = made[1] + [0]
        return made

    monkeypatch.setattr(model, "encode", spied)
    ids, same, back = model.both(texts)
    assert same.tolist() == [True, False, True] and back.all()
    assert ids[0] is made[0] and ids[2] is made[2] and ids == model.expected(texts)


def test_sentencepiece_query(spark, sf_dir, documents, pieces):
    got = {r["doc_id"]: r for r in q.op9_sentencepiece_backend(spark, sf_dir).collect()}
    for r in documents.collect():
        ids = pieces.encode(r["text"])
        row = got[r["doc_id"]]
        assert (row["n_tokens"], row["ids_crc32"], row["parity"], row["round_trip"]) == (len(ids), crc(ids), True, True)


def test_sentencepiece_awkward(awkward, pieces):
    rows = encode_decode(awkward, PIECES).collect()
    assert sorted(map(tuple, (r["ids"] for r in rows))) == sorted(tuple(pieces.encode(r["text"] or "")) for r in awkward.collect())
    assert all(r["parity"] and r["round_trip"] for r in rows)
    assert encode_decode(awkward.limit(0), PIECES).collect() == []


@pytest.mark.parametrize("most", [1, 2, 100, 50_000, 2**33, 2**60, 2**64 - 1])
def test_simple8b_round_trip(most):
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 4000):
        v = rng.integers(0, most, n, dtype=np.uint64, endpoint=True)
        v[::7] = rng.integers(0, 3, len(v[::7]))
        words, offsets = simple8b.encode(v)
        assert np.array_equal(simple8b.decode(words, n), v)
        for b in range(len(offsets) - 1):
            assert np.array_equal(simple8b.decode(words[offsets[b]:offsets[b + 1]], min(1024, n - 1024 * b)), v[1024 * b:1024 * (b + 1)])


def test_byte_encoder_agrees_with_whole_texts():
    encode = encoder(BYTES)
    texts = odd_texts(300, 4) + ["a<|endoftext|> b <|endoftext|>", "x  y\n\n z", " lead", "trail ", "é è à", ""]
    got = encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert got.ids[got.bounds[i]:got.bounds[i + 1]].tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert byte_level(pa.array(["", "a b"])).bounds.tolist() == [0, 0, 2]


def test_token_files_query(spark, sf_dir, documents):
    tokenizer, start, want = Tokenizer.from_file(BYTES), 0, []
    for r in sorted(documents.collect(), key=lambda r: r["doc_id"]):
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in q.op8_token_files(spark, sf_dir).collect())
    assert got == want


def test_decode_range():
    rng = np.random.default_rng(8)
    v = rng.integers(0, 50_000, 5000).astype(np.uint64)
    v[rng.integers(0, 5000, 40)] = 2**63 + 5
    words, offsets = simple8b.encode(v)
    for lo, hi in [(0, 5000), (0, 0), (1023, 1025), (1024, 2048), (4999, 5000), (-5, 3), (4990, 9000), (6000, 7000), (7, 4)]:
        assert np.array_equal(simple8b.decode_range(words, offsets, 5000, lo, hi), v[max(lo, 0):max(hi, 0)])
    # words of other blocks are not looked at
    broken = words.copy()
    broken[:offsets[2]], broken[offsets[3]:] = 0, 0
    assert np.array_equal(simple8b.decode_range(broken, offsets, 5000, 2100, 3000), v[2100:3000])


def test_read_range(spark, documents, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(documents, path, q.vocabulary("byte_bpe_50k.json"), 2)
    rows = read_tokens(spark, path, with_ids=True).collect()
    stream = [i for r in sorted(rows, key=lambda r: r["start"]) for i in r["ids"]]
    n = len(stream)
    for lo, hi in [(0, n), (n // 3, n // 3 + 5000), (n - 7, n + 100), (17, 18), (n, n + 5), (9, 9)]:
        got = sorted((r["start"], r["ids"]) for r in read_range(spark, path, lo, hi).collect())
        assert [i for _, ids in got for i in ids] == stream[lo:hi]
        assert all(s == lo + sum(len(x) for _, x in got[:k]) for k, (s, _) in enumerate(got))


def test_token_files_awkward(spark, awkward):
    tokenizer = Tokenizer.from_file(BYTES)
    path = scratch_dir(spark, "test")
    write_tokens(awkward, path, BYTES, 2)
    rows = read_tokens(spark, path, with_ids=True).collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])
                  for r in awkward.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in rows) == want
    by_start = sorted(rows, key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in by_start]
    assert ids == sorted(ids)
    assert [r["start"] for r in by_start] == np.cumsum([0] + [r["n_tokens"] for r in by_start])[:-1].tolist()
    empty = scratch_dir(spark, "test")
    write_tokens(awkward.limit(0), empty, BYTES, 2)
    assert read_tokens(spark, empty).collect() == []
