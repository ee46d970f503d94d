"""SentencePiece models run by the tokenizers library.

``Backend`` parses the model protobuf and rebuilds its parts there: normaliser
(character map, white-space rules, dummy prefix, U+2581 marker), the piece model
(unigram scores, or for a BPE model the merges that its piece scores stand for)
with byte fallback, and the decoder.  Every distinct segment that a worker meets is
encoded by both libraries, and the ids are those of the tokenizers library;
where they differ the ids of the sentencepiece library are kept and the row says
so (``parity`` false).

Defined results: null text counts as empty and gives no ids; repeated rows give
repeated rows; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tally.llm.common import pick, text_slices, utf8_buffer
from tally.llm.segments import Coded, Memo, Tokens, metaspace, strung

SPACE = "▁"
#: Texts that the library encodes at a time, and bytes of text that a task works on at a time.
TOGETHER, SLICE = 256, 2 << 20
#: Segments, and bytes of them and their ids, that a worker keeps: two workers share an executor with a full heap.
KEPT, ROOM = 1 << 18, 16 << 20
UNIGRAM, BPE = 1, 2  # model types of the protobuf
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # piece types of the protobuf


class Backend:
    """A tokenizers-library tokenizer rebuilt from a SentencePiece model."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            self.proto.ParseFromString(f.read())
        self.reference = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = [(p.piece, p.score, p.type) for p in self.proto.pieces]
        self.id = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        self.extra: dict[int, list[int]] = {}  # ids of helper characters -> the ids that stand for them
        self.tokenizer = self._build()
        spec = self.proto.normalizer_spec
        self.sizes = np.array([1 if t == BYTE else len(p.replace(SPACE, " ").encode()) for p, _, t in self.pieces], np.int64)
        self.memo = Memo(self.code, marks=2, most=KEPT, room=ROOM)
        #: Texts may be cut at spaces: no rule looks across one, no piece joins one, and
        #: every id stands for a known number of bytes (an unknown piece would not).
        self.cuts = (self.proto.trainer_spec.byte_fallback and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
                     and not spec.precompiled_charsmap
                     and not any(SPACE in p.lstrip(SPACE) or " " in p for p, _, t in self.pieces if t in (NORMAL, USER)))

    def _build(self):
        from tokenizers import AddedToken, Tokenizer, decoders

        byte_fallback = self.proto.trainer_spec.byte_fallback
        kind = self.proto.trainer_spec.model_type
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} is not supported")
        tokenizer = Tokenizer(self._unigram(byte_fallback) if kind == UNIGRAM else self._bpe(byte_fallback))
        if (normalizer := self._normalizer()) is not None:
            tokenizer.normalizer = normalizer
        user = [AddedToken(p, normalized=True, special=False) for p, _, t in self.pieces if t == USER]
        if user:
            tokenizer.add_tokens(user)
        steps = [decoders.Replace(SPACE, " ")]
        if byte_fallback:
            steps.append(decoders.ByteFallback())
        steps.append(decoders.Fuse())
        if self.proto.normalizer_spec.add_dummy_prefix:
            steps.append(decoders.Strip(" ", 1, 0))
        tokenizer.decoder = decoders.Sequence(steps)
        return tokenizer

    def _normalizer(self):
        from tokenizers import Regex, normalizers

        spec, steps = self.proto.normalizer_spec, []
        if spec.precompiled_charsmap:
            steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if spec.add_dummy_prefix:
            steps.append(normalizers.Prepend(SPACE if spec.escape_whitespaces else " "))
        if spec.escape_whitespaces:
            steps.append(normalizers.Replace(" ", SPACE))
        return normalizers.Sequence(steps) if steps else None

    def _unigram(self, byte_fallback: bool):
        from tokenizers import models

        unknown = next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        return models.Unigram([(p, s) for p, s, _ in self.pieces], unknown, byte_fallback)

    def _bpe(self, byte_fallback: bool):
        """Merges in score order: each way to cut a piece into two pieces.  A
        character that is no piece of its own but begins one gets a helper id,
        replaced after encoding by what stands for the bare character."""
        from tokenizers import models

        scored = sorted(((s, i, p) for i, (p, s, t) in enumerate(self.pieces) if t == NORMAL and len(p) > 1),
                        key=lambda x: (-x[0], x[1]))
        vocab = dict(self.id)
        for char in sorted({c for _, _, p in scored for c in p if c not in self.id}):
            vocab[char] = len(vocab)
            self.extra[vocab[char]] = ([self.id[f"<0x{b:02X}>"] for b in char.encode()] if byte_fallback
                                       else [self.reference.unk_id()])
        merges = [(p[:k], p[k:]) for _, _, p in scored for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab]
        return models.BPE(vocab, merges, byte_fallback=byte_fallback,
                          unk_token=self.reference.id_to_piece(self.reference.unk_id()), fuse_unk=True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids by the tokenizers library, over its own threads."""
        out = []
        for i in range(0, len(texts), TOGETHER):  # the library's results are many times larger than the ids
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i:i + TOGETHER], add_special_tokens=False)]
        if self.extra:
            for i, ids in enumerate(out):
                if max(ids, default=0) >= len(self.pieces):
                    out[i] = [y for x in ids for y in self.extra.get(x, (x,))]
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def expected(self, texts: list[str]) -> list[list[int]]:
        """Ids by the sentencepiece library."""
        return self.reference.encode(texts, num_threads=1)

    def both(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Ids of each text, whether both libraries agree on them (else they are
        the sentencepiece library's), and whether they decode to the text."""
        ids, expected = self.encode(texts), self.expected(texts)
        same = np.fromiter((a == b for a, b in zip(ids, expected)), bool, len(texts))
        ids = [a if s else b for a, b, s in zip(ids, expected, same)]
        back = np.fromiter((a == b for a, b in zip(self.decode(ids), texts)), bool, len(texts))
        return ids, same, back

    def code(self, segments: pa.Array) -> Coded:
        """Ids and marks of segments, each with its first space.  Segments that
        end in no space and hold no U+2581 are strung together and come apart by
        the bytes that ids stand for; if a string fails a check, its segments are
        checked one by one."""
        data, off = utf8_buffer(segments)
        marker = np.zeros(len(data) + 1, np.int64)
        if len(data) > 2:
            marker[3:] = np.cumsum((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        apart = (data[off[1:] - 1] == 0x20) | (marker[off[1:]] != marker[off[:-1]])
        order, alone, groups, counts = strung(segments, apart, 128)
        texts = [t[1:] for t in alone + groups]  # the tokenizers put the first marker there themselves
        ids, same, back = self.both(texts)
        each = np.repeat(np.arange(len(texts)), [1] * len(alone) + counts)
        flags = np.column_stack([same[each], back[each]])
        for g in np.flatnonzero(~(same & back)):
            if g >= len(alone):
                parts = np.flatnonzero(each == g)
                single = [t[1:] for t in segments.take(pa.array(order[parts])).to_pylist()]
                flags[parts] = np.column_stack(self.both(single)[1:])
        flat = np.concatenate([np.zeros(0, np.uint32), *[np.asarray(x, np.uint32) for x in ids]])
        heads = np.cumsum([len(x) for x in ids[:len(alone)]], dtype=np.int64)
        done = int(heads[-1]) if len(heads) else 0
        end = np.cumsum(np.diff(off)[order[len(alone):]])
        reach = np.append(0, np.cumsum(self.sizes[flat[done:]]))
        last = np.searchsorted(reach, end)
        if not np.array_equal(reach[np.minimum(last, len(reach) - 1)], end):
            raise ValueError("ids of the model do not end where segments end")
        stop = np.concatenate([heads, done + last])
        out = Coded(flat, np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros((len(order), 2), bool))
        out.first[order], out.size[order] = np.append(0, stop)[:-1], np.diff(stop, prepend=0)
        out.flags[order] = flags
        return out

    def rows(self, text: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """Ids of each text, and whether the libraries agree and the ids decode to it."""
        if self.cuts:
            found = metaspace(text)
            tokens, flags = self.memo(found)
            bad = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(~flags, axis=0)])
            good = bad[found.bounds[1:]] == bad[found.bounds[:-1]]
            return tokens, good[:, 0], good[:, 1]
        texts = text.to_pylist()
        ids, same, back = self.both(texts)
        bounds = np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64))
        return Tokens(np.concatenate([np.zeros(0, np.uint32), *[np.asarray(x, np.uint32) for x in ids]]), bounds), same, back


@lru_cache(maxsize=2)
def backend(model_path: str, threads: int) -> Backend:
    """Called in the worker: the thread count holds from the first batch on."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    return Backend(model_path)


def encode_decode(docs: DataFrame, model_path: str, threads: int = 2, with_ids: bool = True,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, ids_crc32, parity, round_trip[, ids]``.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned
    32-bit integers, ``parity`` whether both libraries gave the same ids, and
    ``round_trip`` whether the decoded ids are the text.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend(model_path, threads)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                text = pc.fill_null(part.column("text"), "")
                yield pa.RecordBatch.from_arrays(_columns(part.column("doc_id"), text, *model.rows(text), with_ids), names)
            pa.default_memory_pool().release_unused()  # else the pool keeps what its largest slice took

    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "parity", "round_trip"] + ["ids"] * with_ids
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, ids_crc32 long, parity boolean, "
                               "round_trip boolean" + ", ids array<int>" * with_ids)


def _columns(doc_id: pa.Array, text: pa.Array, tokens: Tokens, same: np.ndarray, back: np.ndarray,
             with_ids: bool) -> list[pa.Array]:
    crc = [zlib.crc32(tokens.ids[a:b].astype("<u4").tobytes()) for a, b in zip(tokens.bounds[:-1], tokens.bounds[1:])]
    out = [doc_id, pc.binary_length(text).cast(pa.int64()), pa.array(np.diff(tokens.bounds)),
           pa.array(crc, pa.int64()), pa.array(same), pa.array(back)]
    if with_ids:
        out.append(pa.ListArray.from_arrays(pa.array(tokens.bounds.astype(np.int32)), pa.array(tokens.ids.astype(np.int32))))
    return out
