"""Spelling variants among the words of a corpus, by search schemes on a
bidirectional FM-index.

Words are counted over all texts.  Two words one edit apart agree in a half of
either: with ``w`` cut in the middle, an edit in its right half leaves its left
half at the other word's start, one in the left half its right half at the
other's end.  So each word is sent, as an entry, to the shards of those of its
starts and ends that may be such a half, and asks, as a query, in the shards of
its own two halves.  A shard holds a bidirectional FM-index (suffix arrays of its
delimited words and of their reverse, a wavelet matrix over each
Burrows-Wheeler transform, suffix-rank intervals that follow each other).  A query
matches its half and the delimiter on that side exactly, then goes on across the
other half and its delimiter with one inserted, deleted or replaced character.
Pairs are counted where they are found: a left-half error that leaves the left
half as it is belongs to the right-half search, so that none is found twice.

Halves with more than ``HOT`` words are cut into parts by hash of the entry; their
queries ask in each part.  So a shard's size does not grow with the corpus.  A
shard's time grows with its longest word (about a millisecond a character).

Defined results: null texts have no words; a null id changes no word; repeated
rows count repeatedly; other columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import pick, strings, text_slices, utf8_buffer
from tally.llm.suffixes import Names, Wavelet
from tally.session import ensure_checkpoint_dir

#: Words of one half in one index, and rows in one shard.
HOT, SHARD = 1 << 14, 1 << 15
#: Words with at most so many bytes take their checksum from tables.
_SHORT = 48


@lru_cache(maxsize=1)
def _zero_bytes() -> np.ndarray:
    """``[l, b, v]``: what byte b with value v of a checksum becomes after l zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    out = np.zeros((_SHORT + 1, 4, 256), np.uint32)
    for b in range(4):
        out[0, b] = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
    for n in range(1, _SHORT + 1):
        out[n] = out[n - 1] >> np.uint32(8) ^ step[out[n - 1] & 255]
    return out


def crc_joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC32 of two byte strings joined, from theirs and the second one's size."""
    table = _zero_bytes()
    return table[size, 0, left & 255] ^ table[size, 1, left >> 8 & 255] ^ table[size, 2, left >> 16 & 255] ^ table[size, 3, left >> 24] ^ right


def _letter_runs(col: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` in lower case (A-Z only), and
    the first run of each row with the number of all runs at the end."""
    data, off = utf8_buffer(col)
    upper = (data >= 0x41) & (data <= 0x5A)
    lead = data == 0xC3
    word = upper | ((data >= 0x61) & (data <= 0x7A)) | lead
    word[1:] |= lead[:-1]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[edge], last[edge - 1] = word[edge], word[edge - 1]
    starts = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - starts
    low = data | (upper.astype(np.uint8) << 5)
    return strings(low[word], np.append(0, np.cumsum(size))).dictionary_encode(), np.searchsorted(starts, off)


def _counts(ids: list, texts: pa.Array, least: int, every: int) -> Counter:
    """Occurrences of the words of some rows, after the deletions."""
    runs, bounds = _letter_runs(texts)
    use = runs.indices.to_numpy(zero_copy_only=False)
    words = runs.dictionary.to_pylist()
    raw = [w.encode() for w in words]
    size = np.array([len(b) for b in raw], np.int64)
    crc = np.array([zlib.crc32(b) for b in raw], np.uint32)
    left = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    row = np.repeat(np.arange(len(ids)), np.diff(bounds))
    h = crc_joined(left[row], crc[use], np.minimum(size, _SHORT)[use]) if len(use) else np.zeros(0, np.uint32)
    for k in np.flatnonzero(size[use] > _SHORT).tolist():
        h[k] = zlib.crc32(raw[use[k]], int(left[row[k]]))
    known = np.array([i is not None for i in ids], bool)[row]
    hit = (h % every == 0) & known
    out: Counter = Counter()
    plain = np.bincount(use[~hit], minlength=len(words))
    for k in np.flatnonzero(plain).tolist():
        if len(words[k]) >= least:
            out[words[k]] += int(plain[k])
    for k, v in zip(use[hit].tolist(), h[hit].tolist()):
        w = words[k]
        at = v % len(w)
        if len(w) - 1 >= least:
            out[w[:at] + w[at + 1:]] += 1
    return out


def count_words(docs: DataFrame, least: int = 6, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: words of ``least`` code points or more, where one occurrence in
    about ``every`` has lost a character, chosen by checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = _counts(part.column("doc_id").to_pylist(), pc.fill_null(part.column("text"), ""), least, every)
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    src = pick(docs, doc_id=id_col, text=text_col)
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class BidirectionalIndex:
    """FM-index of ``$word$word$...$`` and of its reverse; an interval is its
    place in either suffix array and its size."""

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet, code = np.unique(text, return_inverse=True)
        code = code.astype(np.int64)
        self.n = len(code)
        self.first = np.searchsorted(np.sort(code), np.arange(len(self.alphabet)))
        stop = np.full(self.n, self.n)
        self.place = Names(code, stop, keep=False).suffix_array()
        back = Names(code[::-1].copy(), stop, keep=False).suffix_array()
        self.before, self.after = code[self.place - 1], code[self.n - back - self.n * (back == 0)]
        most = len(self.alphabet)
        self.left, self.right = Wavelet(self.before, most), Wavelet(self.after, most)
        self.starts = np.flatnonzero(code == 0)

    def codes(self, text: np.ndarray) -> np.ndarray:
        """Codes of characters; those that no word has become -1."""
        at = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == text, at, -1)

    def whole(self, many: int) -> np.ndarray:
        """Intervals of the empty pattern, as columns: place, place in reverse, size."""
        return np.repeat(np.array([[0], [0], [self.n]], np.int64), many, axis=1)

    def extend(self, states: np.ndarray, code: np.ndarray, rightward: bool) -> np.ndarray:
        """Intervals after one more character; absent ones have size 0."""
        tree, (mine, other) = (self.right, (1, 0)) if rightward else (self.left, (0, 1))
        known = np.maximum(code, 0)
        lo = states[mine]
        less, a, b = tree.narrow(lo, lo + states[2], known)
        out = np.empty_like(states)
        out[mine], out[other], out[2] = self.first[known] + a, states[other] + less, np.where(code < 0, 0, b - a)
        return out

    def followers(self, states: np.ndarray, rightward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a state and a character, no delimiter, that may come next."""
        lo, size = states[1 if rightward else 0], states[2]
        wide = size > len(self.alphabet)
        few, many = np.flatnonzero(~wide), np.flatnonzero(wide)
        rows = np.repeat(few, size[few])
        at = np.repeat(lo[few], size[few]) + np.arange(len(rows)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
        key = np.unique(rows * len(self.alphabet) + (self.after if rightward else self.before)[at])
        letters = np.arange(1, len(self.alphabet))
        key = np.concatenate([key, np.repeat(many, len(letters)) * len(self.alphabet) + np.tile(letters, len(many))])
        state, code = key // len(self.alphabet), key % len(self.alphabet)
        return state[code > 0], code[code > 0]

    def located(self, states: np.ndarray) -> np.ndarray:
        """Index of the word that a state of a whole delimited word stands for."""
        return np.searchsorted(self.starts, self.place[states[0]])


def one_error(index: BidirectionalIndex, queries: list[str], rightward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and an index word that begins with the query's left half
    (``rightward``; else ends with its right half) and is one edit away."""
    size = np.array([len(q) for q in queries], np.int64)
    half = size // 2
    code = index.codes(np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32))
    base = np.append(0, np.cumsum(size))[:-1]
    every = np.arange(len(queries))

    def char(query: np.ndarray, first: np.ndarray, count: np.ndarray, step: int, done: int) -> tuple[np.ndarray, np.ndarray]:
        """The pattern's character after ``done`` others, or the delimiter, and
        which of the two it is."""
        inside = done < count
        at = np.clip(base[query] + first + step * done, 0, max(len(code) - 1, 0))
        return np.where(inside, code[at], 0), inside

    def half_matched(first: np.ndarray, count: np.ndarray, toward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Queries whose half occurs next to a delimiter, from the middle outwards."""
        query, states, done, out = every, index.whole(len(queries)), 0, []
        while len(query):
            want, inside = char(query, first[query], count[query], 1 if toward else -1, done)
            states, done = index.extend(states, want, toward), done + 1
            live = states[2] > 0
            out.append((query[live & ~inside], states[:, live & ~inside]))
            query, states = query[live & inside], states[:, live & inside]
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out], axis=1)

    if not len(queries):
        return every, every
    if rightward:
        query, states = half_matched(half - 1, half, False)
        first, count, step = half, size - half, 1
    else:
        query, states = half_matched(half, size - half, True)
        first, count, step = half - 1, half, -1

    # the other half: states without an error yet, and states with one, both after as many characters of the pattern
    wrong_q, wrong, done, out = np.zeros(0, np.int64), np.zeros((3, 0), np.int64), 0, []
    while len(query) or len(wrong_q):
        want, inside = char(query, first[query], count[query], step, done)
        row, letter = index.followers(states, rightward)
        more = index.extend(states[:, row], letter, rightward)
        # inserted: the same character of the pattern comes next
        wrong_q, wrong = np.append(wrong_q, query[row]), np.concatenate([wrong, more], axis=1)
        next_, within = char(wrong_q, first[wrong_q], count[wrong_q], step, done)
        wrong = index.extend(wrong, next_, rightward)
        live = wrong[2] > 0
        out.append((wrong_q[live & ~within], wrong[:, live & ~within]))
        # replaced, and deleted
        swap = inside[row] & (letter != want[row])
        wrong_q = np.concatenate([wrong_q[live & within], query[row][swap], query[inside]])
        wrong = np.concatenate([wrong[:, live & within], more[:, swap], states[:, inside]], axis=1)
        if len(wrong_q) > 1:  # errors at different places may lead to one interval
            order = np.lexsort((wrong[2], wrong[0], wrong_q))
            wrong_q, wrong = wrong_q[order], wrong[:, order]
            new = np.ones(len(order), bool)
            new[1:] = (wrong_q[1:] != wrong_q[:-1]) | (wrong[:, 1:] != wrong[:, :-1]).any(axis=0)
            wrong_q, wrong = wrong_q[new], wrong[:, new]
        states = index.extend(states, want, rightward)
        go = inside & (states[2] > 0)
        query, states, done = query[go], states[:, go], done + 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    query, states = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out], axis=1)
    pairs = np.unique(query * (len(index.starts) + 1) + index.located(states))
    return pairs // (len(index.starts) + 1), pairs % (len(index.starts) + 1)


_FOUND = "word string, n_near long, form string, form_n long"
#: Queries that are searched together.
_TOGETHER = 4096


def _shard(rows: pa.Table) -> pa.Table:
    """Near words that one shard's queries find in its entries, as a row for each
    query: how many, and the most frequent one."""
    entry = rows.column("entry").to_numpy(zero_copy_only=False)
    words, side = rows.column("word").to_pylist(), rows.column("side").to_pylist()
    part, n = rows.column("size").to_pylist(), rows.column("n").to_pylist()
    count = {w: c for w, c, e in zip(words, n, entry) if e}
    vocabulary = sorted(count)
    held = {(s, w, z) for s, w, z, e in zip(side, words, part, entry) if e}
    out: dict[str, tuple] = {}
    if len(vocabulary) > 1:
        index = BidirectionalIndex(vocabulary)
        asks = rows.column("query").to_pylist()
        for left in (True, False):
            all_queries = sorted({w for w, s, q in zip(words, side, asks) if q and s == left})
            for lo in range(0, len(all_queries), _TOGETHER):
                queries = all_queries[lo:lo + _TOGETHER]
                for a, b in zip(*(x.tolist() for x in one_error(index, queries, left))):
                    w, v = queries[a], vocabulary[b]
                    half = len(w) // 2
                    if (left, v, half if left else len(w) - half) in held and (left or not v.startswith(w[:half])):
                        near, best = out.get(w, (0, None))
                        out[w] = near + 1, min(best or (0, ""), (-count[v], v))
    return pa.table({"word": pa.array(out, pa.string()), "n_near": pa.array([x[0] for x in out.values()], pa.int64()),
                     "form": pa.array([x[1][1] for x in out.values()], pa.string()),
                     "form_n": pa.array([-x[1][0] for x in out.values()], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n`` of a table of distinct ``word, n``: words
    one edit away, and the most frequent of them (ties: the smallest)."""
    size = F.length("word")

    def sides(left: bool):
        def key(of):
            return F.floor(of / 2) if left else F.ceil(of / 2)

        return F.transform(F.array_distinct(F.array(key(size - 1), key(size), key(size + 1)).cast("array<int>")), lambda m: F.struct(
            F.lit(left).alias("side"), m.alias("size"), (m == key(size).cast("int")).alias("query"),
            (F.substring(F.col("word"), F.lit(1), m) if left else F.substring(F.col("word"), size - m + 1, m)).alias("key")))

    parts = words.select("word", "n", F.explode(F.concat(sides(True), sides(False))).alias("s")).select("word", "n", "s.*")
    # at most 4 rows a word over HOT: so few halves are hot that their table is broadcast
    hot = parts.groupBy("side", "key").count().where(F.col("count") > HOT) \
        .select("side", "key", F.ceil(F.col("count") / HOT).cast("int").alias("cuts"))
    parts = parts.join(F.broadcast(hot), ["side", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))) \
        .withColumn("mine", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int"))
    parts = parts.withColumn("cut", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array("mine")))) \
        .withColumn("entry", F.col("cut") == F.col("mine"))
    shards = max(1, -(-4 * words.count() // SHARD))
    found = parts.select(F.pmod(F.xxhash64("side", "key", "cut"), F.lit(shards)).alias("shard"), "side", "word", "n", "size", "query", "entry") \
        .groupBy("shard").applyInArrow(_shard, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word"))).alias("best")
    near = found.groupBy(F.col("word").alias("w")).agg(F.sum("n_near").alias("n_near"), best)
    return words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def _roots(linked: DataFrame, factor: int) -> DataFrame:
    """``word, root`` of the words that have a form.  Counts grow by ``factor`` a
    link, so the largest count bounds the rounds in which links are doubled."""
    most = linked.agg(F.max("form_n")).first()[0] or 0
    links, length = linked.select("word", F.col("form").alias("root")), 1
    salts = 16  # a form that very many words have
    while factor ** length < most:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further")) \
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        links = links.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int")) \
            .join(ahead, ["root", "salt"], "left").select("word", F.coalesce("further", "root").alias("root")).checkpoint()
        length *= 2
    return links


def variant_groups(docs: DataFrame, least: int = 6, times: int = 5, factor: int = 5, every: int = 199,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word with at least ``least``
    code points and ``times`` occurrences: its form is the near word with the
    largest count, if that is ``factor`` times its own or more; its root the last
    of its forms, or itself."""
    ensure_checkpoint_dir(docs.sparkSession)
    words = count_words(docs, least, every, id_col, text_col).where(F.col("n") >= times).checkpoint()
    near = near_words(words).withColumn("form", F.when(F.col("form_n") >= factor * F.col("n"), F.col("form"))) \
        .withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n"))).checkpoint()
    roots = _roots(near.where(F.col("form").isNotNull()), factor).withColumnRenamed("word", "w")
    return near.join(roots, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
