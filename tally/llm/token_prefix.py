"""Token counts by prefix dynamic programming.

For a byte-fallback BPE piece model, the tokens of a string's prefix are fixed
by one value per prefix: its last token.  A token ``t`` ends the tokens of
``w[:i]`` exactly if the last token of ``w[:i - len(t)]`` followed by ``t`` is
left as it is when the two are encoded together; one such ``t`` exists for each
``i``.  So ``count[i] = count[i - len(t)] + 1`` gives the exact token count of
every prefix, and truncation and budget questions are lookups.

No piece joins a visible character to a following space, so the table of a text
is the sum of the tables of its space-separated segments.  Each distinct
segment of a batch is solved once, in sorted order, where it goes on from the
prefix that it shares with the one before it.

Defined results: null text counts as empty; an empty text has 0 tokens; repeated
rows give repeated rows; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tally.llm.common import pick, text_slices
from tally.llm.segments import Segments, metaspace

SPACE = "▁"
#: Pair verdicts kept at a time by one worker; beyond that the memo starts anew.
MEMO = 1_000_000


class PrefixCounter:
    """Exact token counts of all prefixes, for one piece model."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(sp.get_piece_size())
               if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        self._check(sp)
        self.ends: dict[str, list[int]] = {}  # last two characters -> lengths, longest first
        for piece in self.score:
            if len(piece) > 1 and self._merge(piece) == [piece]:
                self.ends.setdefault(piece[-2:], []).append(len(piece))
        self.ends = {k: sorted(set(v), reverse=True) for k, v in self.ends.items()}
        self.memo: dict[tuple[str, str], bool] = {}

    def _check(self, sp) -> None:
        """Refuse models whose tables this recurrence would not give."""
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece joins a character to a following space")
        probe = " a  b "
        if "".join(sp.encode(probe, out_type=str)) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model's normaliser changes texts")
        if sp.is_byte(sp.unk_id()) or not any(sp.is_byte(i) for i in range(sp.get_piece_size())):
            raise ValueError("the model has no byte fallback")

    def _merge(self, text: str) -> list[str]:
        """Tokens of a short string: best-scored adjacent pair first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(self.score.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = max((x for x in scored if x[0] is not None), default=None)
            if best is None:
                break
            at = -best[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _joins(self, left: str, right: str) -> bool:
        known = self.memo.get((left, right))
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[left, right] = self._merge(left + right) == [left, right]
        return known

    def tables(self, segments: list[str]) -> dict[str, list[int]]:
        """For each segment, the counts of the first 0, 1, 2, ... characters of
        the space marker followed by the segment."""
        score, ends, joins = self.score, self.ends, self._joins
        last, count, before, out = [""], [0], "", {}
        for segment in sorted(segments):
            word = SPACE + segment.replace(" ", SPACE)
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1:], count[same + 1:]
            for i in range(same + 1, len(word) + 1):
                for size in ends.get(word[i - 2:i], ()) if i > 1 else ():
                    if size <= i and (piece := word[i - size:i]) in score and (size == i or joins(last[i - size], piece)):
                        break
                else:
                    size, piece = 1, word[i - 1]
                last.append(piece)
                count.append(count[i - size] + (1 if piece in score else len(piece.encode())))
            out[segment] = count[:]
            before = word
        return out

    def count(self, text: str | None) -> int:
        """Token count of one text."""
        found = metaspace(pa.array([text], pa.string()))
        return int(self.totals(found)[0][0])

    def prefix_counts(self, text: str | None) -> list[int]:
        """Token counts of the first 0, 1, ..., n code points of one text."""
        found, out, base = metaspace(pa.array([text], pa.string())), [0], 0
        distinct = bare(found)
        tables = self.tables(distinct)
        for k, use in enumerate(found.use.tolist()):
            counts = tables[distinct[use]]
            out += [base + c for c in counts[2 if k == 0 else 1:]]
            base += counts[-1] if len(counts) > 2 or k else 0
        return out

    def totals(self, found: Segments, budgets: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
        """Token count of each row, and for each budget the code points of the
        longest prefix that keeps it."""
        distinct = bare(found)
        tables = self.tables(distinct)
        size = np.array([len(s) for s in distinct], np.int64)
        each = np.array([tables[s][-1] for s in distinct], np.int64)[found.use]
        chars = size[found.use] + 1
        first = np.zeros(len(found.use), bool)
        first[found.bounds[:-1]] = True
        each[first & (size[found.use] == 0)] = 0  # an empty first segment has no marker
        end, at = np.append(0, np.cumsum(each)), np.append(0, np.cumsum(chars))
        lo, hi = found.bounds[:-1], found.bounds[1:]
        n = end[hi] - end[lo]
        cuts = []
        for budget in budgets:
            cut = at[hi] - at[lo] - 1
            for row in np.flatnonzero(n > budget):
                before = end[lo[row]:hi[row]] - end[lo[row]]
                k = max(0, int(np.searchsorted(before, budget, "left")) - 1)
                counts = np.array(tables[distinct[found.use[lo[row] + k]]])
                inside = np.flatnonzero(before[k] + counts <= budget)[-1]
                cut[row] = max(0, at[lo[row] + k] - at[lo[row]] + inside - 1)
            cuts.append(cut)
        return n, cuts


def bare(found: Segments) -> list[str]:
    """Distinct segments without their first space."""
    return [s[1:] for s in found.distinct.to_pylist()]


@lru_cache(maxsize=2)
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


def token_counts(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fits``: UTF-8 bytes, tokens,
    whether there are more than ``limit`` tokens, and the code points of the
    longest prefix with at most ``limit`` tokens.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                text = pc.fill_null(part.column("text"), "")
                n, (fits,) = model.totals(metaspace(text), (limit,))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n),
                     pa.array(n > limit), pa.array(fits, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits"])

    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fits long")


def prefix_tables(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, counts``: the token counts of the first 0, 1, ..., n code points
    of each text, for readers that ask many budget questions of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                counts = [model.prefix_counts(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "counts"])

    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, counts array<int>")
