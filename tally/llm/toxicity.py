"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer, a letter trie with weights, turns each word into a symbol:
insult (with the log odds of its deepest trie node), threat, target, negation or
reporting word.  Clauses (between ``. ! ? ; :`` and line ends) that hold an insult
or a threat then run through the composition of four transducers: negation reaches
three words on, a reporting word to the clause's end and a quotation mark to the
next one; an insult counts for more where a target stands in its clause, a threat
only there.  A clause's score is the sum over its matches of lexical weight times
the weights on the path.  A logistic model over the clause scores of a text gives
the score.

The trie's weights come from labelled rows: log odds of toxicity by documents that
hold a word with that beginning, each node shrunk towards its parent and equal to
it unless the counts differ clearly; a short list of insults has prior counts, so
it works without labels.  Texts of one half of the rows are scored with the trie
of the other half when the logistic model is fitted.

Training takes about ``SAMPLE`` labelled rows by hash of the id (documented bound
of the trie and of what reaches the driver); every row of the table is scored.

Defined results: null text counts as empty, which has no clauses and the score of
a text without matches; repeated labels of an id count once, the largest; null
ids and null labels are not learned from; a null id is not held out; repeated rows
give repeated rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import pick, strings, text_slices, utf8_buffer
from tally.llm.grammar import Transducer

SAMPLE = 1 << 16
#: Toxic documents that hold a beginning before it is counted at all, and its longest size.
SUPPORT, LONGEST = 4, 12
#: Prior documents a node takes from its parent, and twice the log likelihood ratio that parts it from its parent.
SHRINK, CLEAR = 8.0, 24.0
#: Share of toxic documents from which a word is an insult, and what a threat weighs.
INSULT, THREAT = 0.4, 2.0
#: Share of toxic documents that a listed insult starts from.
SEEDED = 0.9
#: End of a word in the trie.
END = "$"

# Words of the grammar in English, French, German and Spanish.
SEEDS = ("idiot idiots idiotic moron morons moronic stupid loser losers scum scumbag trash garbage clown clowns pathetic worthless "
         "disgusting imbecile asshole bastard bitch cretin dumbass jerk vermin filth coward fool retard degenerate pig whore slut "
         "connard connasse salope salaud crétin abruti imbécile ordure débile arschloch idiotin trottel schlampe dummkopf "
         "abschaum versager imbécil estúpido estúpida gilipollas cabrón basura idiota idiotas").split()
THREATS = ("kill hurt burn destroy stab shoot hang strangle murder tuer frapper brûler étrangler poignarder "
           "töten umbringen verprügeln erstechen erschießen matar golpear quemar apuñalar").split()
TARGETS = ("you your yours u he she him her they them these those people tu toi vous ton ta votre il elle ils elles eux "
           "du dich dir ihr euch dein deine er sie ihnen tú ti usted ustedes vosotros él ella ellos ellas").split()
NEGATIONS = ("not no never isn aren wasn weren don doesn didn won cannot without pas jamais aucun sans nicht kein keine nie "
             "niemals ohne nunca jamás sin tampoco").split()
REPORTS = ("said says say called calls wrote writes claimed quoted reported dit écrit appelle appelé sagte sagt schrieb "
           "nannte behauptet dijo dice escribió llamó").split()
SYMBOLS = {**dict.fromkeys(THREATS, "H"), **dict.fromkeys(TARGETS, "T"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(REPORTS, "R")}
#: Symbols: insult, threat, target, negation, reporting word, quotation mark, gap of more than three words.
ALPHABET = "IHTNRQG"
GAP = 3


@lru_cache(maxsize=1)
def clause_grammar() -> Transducer:
    """Composition of the transducers of negation, reported speech, quotation and
    target.  Matches are written as I (insult), X (threat at a target)."""
    negation = Transducer({(0, "N"): (1, "N", 1.0), (1, "G"): (0, "G", 1.0), (1, "I"): (0, "I", 0.25), (1, "H"): (0, "H", 0.1)})
    reported = Transducer({(0, "R"): (1, "R", 1.0), (1, "I"): (1, "I", 0.5), (1, "H"): (1, "H", 0.25)})
    quoted = Transducer({(0, "Q"): (1, "Q", 1.0), (1, "Q"): (0, "Q", 1.0), (1, "I"): (1, "I", 0.6), (1, "H"): (1, "H", 0.4)})
    # 0: neither; t: target seen; h: threat waits for its target, which then writes the match
    target = Transducer({(0, "T"): ("t", "T", 1.0), ("t", "I"): ("t", "I", 1.5), ("t", "H"): ("t", "X", 1.0),
                         (0, "H"): ("h", "H", 1.0), ("h", "T"): ("t", "X", 1.0)})
    return negation.then(reported, ALPHABET).then(quoted, ALPHABET).then(target, ALPHABET)


class Lexicon:
    """Letter trie: ``nodes`` holds beginnings, whole words with ``END``, and by how
    much their log odds exceed those of all documents; a word weighs what its
    deepest node does, and is an insult from weight ``least``."""

    def __init__(self, nodes: dict[str, float], least: float):
        self.nodes, self.least = nodes, least

    def weight(self, word: str) -> float:
        nodes, best = self.nodes, 0.0
        for size in range(1, len(word) + 1):
            found = nodes.get(word[:size])
            if found is None:
                return best
            best = found
        return nodes.get(word + END, best)

    def symbol(self, word: str) -> tuple[str, float]:
        weight = self.weight(word)
        if weight >= self.least:
            return "I", weight
        kind = SYMBOLS.get(word, "")
        return kind, THREAT if kind == "H" else 0.0


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def build_lexicon(counts: Iterable[tuple[str, int, int]], toxic: int, total: int) -> Lexicon:
    """Lexicon of ``(beginning, toxic documents, documents)``."""
    base = (toxic + 0.1) / (total + 1.0)
    table = {k: (a, n) for k, a, n in counts}
    for seed in SEEDS:
        for key in (*(seed[:i] for i in range(1, len(seed) + 1)), seed + END):
            table.setdefault(key, (0, 0))
    share: dict[str, float] = {"": base}
    for key in sorted(table, key=len):
        a, n = table[key]
        above = max(base, SEEDED) if key.endswith(END) and key[:-1] in SEEDS else share.get(key[:-1], base)
        own = (a + SHRINK * above) / (n + SHRINK)
        ratio = 2 * (a * np.log(max(a, 1e-9) / (n * above)) + (n - a) * np.log(max(n - a, 1e-9) / (n * (1 - above)))) if n else 0.0
        share[key] = own if ratio >= CLEAR else above
    kept: dict[str, float] = {}
    for key in sorted(share, key=len, reverse=True):
        apart = key and share[key] != share.get(key[:-1], base)
        if key and (apart or key in kept):
            kept[key] = round(_logit(share[key]) - _logit(base), 6)
            if len(key) > 1:
                kept.setdefault(key[:-1], 0.0)
    return Lexicon(kept, max(1.0, _logit(INSULT) - _logit(base)))


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words, first byte of each, first word of each row (and the
    number of words), clause of each word, and places of quotation marks."""
    data, off = utf8_buffer(pc.utf8_lower(texts))
    lead = np.zeros(len(data), bool)   # punctuation beyond ASCII: U+0080..U+00BF and U+2000..U+207F
    lead[:-1] = (data[:-1] == 0xC2) | (data[:-1] == 0xE2) & ((data[1:] == 0x80) | (data[1:] == 0x81))
    mark = lead.copy()
    mark[1:] |= lead[:-1]
    mark[2:] |= lead[:-2] & (data[:-2] == 0xE2)
    word = ((data >= 0x61) & (data <= 0x7A) | (data >= 0x80)) & ~mark
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[edge], last[edge - 1] = word[edge], word[edge - 1]
    starts = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - starts
    ends = np.flatnonzero(np.isin(data, np.frombuffer(b".!?;:\n", np.uint8)))
    cuts = np.sort(np.concatenate([2 * ends, 2 * off[:-1] - 1]))  # in half bytes: rows are cut between two bytes
    quote = data == 0x22
    quote[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))
    quote[:-2] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x9C) & (data[2:] <= 0x9F)
    coded = strings(data[word], np.append(0, np.cumsum(size))).dictionary_encode()
    return coded, starts, np.searchsorted(starts, off), np.searchsorted(cuts, 2 * starts), np.stack(
        [at := np.flatnonzero(quote), np.searchsorted(cuts, 2 * at)])


FEATURES = ("log_sum", "most", "log_rate", "log_words")


def clause_scores(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each row, and rows of ``row, clause score`` of the
    clauses with matches."""
    coded, starts, bounds, clause, quotes = _words(texts)
    use = coded.indices.to_numpy(zero_copy_only=False)
    known = [lexicon.symbol(w) for w in coded.dictionary.to_pylist()]
    kind = np.array([ALPHABET.find(k) if k else -1 for k, _ in known], np.int8)[use] if known else np.zeros(0, np.int8)
    hit = np.flatnonzero((kind == 0) | (kind == 1))
    live = np.unique(clause[hit])
    mine = np.flatnonzero((kind >= 0) & np.isin(clause, live))
    marks = quotes[:, np.isin(quotes[1], live)]
    events = sorted(chain(zip(starts[mine].tolist(), mine.tolist()), ((at, -1) for at in marks[0].tolist())))
    grammar, out, state, before, score, now = clause_grammar(), [], None, 0, 0.0, -1
    row_of = np.searchsorted(bounds, mine, "right") - 1
    row_at = dict(zip(mine.tolist(), row_of.tolist()))
    clause_at = dict(zip(mine.tolist(), clause[mine].tolist()))
    mark_at = dict(zip(marks[0].tolist(), marks[1].tolist()))
    row, waiting = -1, 0.0
    for at, place in events:
        here = mark_at[at] if place < 0 else clause_at[place]
        if here != now:
            if score > 0:
                out.append((row, score))
            now, state, score, before, waiting = here, grammar.start, 0.0, place, 0.0
        if place < 0:
            state, _, _ = grammar.step(state, "Q")
            continue
        row = row_at[place]
        if before >= 0 and place - before > GAP:
            state, _, _ = grammar.step(state, "G")
        before = place
        symbol, weight = known[use[place]]
        state, written, factor = grammar.step(state, symbol)
        if symbol == "H":
            waiting = weight * factor
        if written == "I":
            score += weight * factor
        elif written == "X":
            score += waiting * factor if symbol == "T" else waiting
    if score > 0:
        out.append((row, score))
    return np.diff(bounds), np.array(out, np.float64).reshape(-1, 2)


def features_of(n: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Rows of ``FEATURES``: log of one plus the sum of the clause scores, the
    highest one, log of one plus that sum in 100 words, log of one plus the words."""
    row = found[:, 0].astype(np.int64)
    total, most = np.zeros(len(n)), np.zeros(len(n))
    np.add.at(total, row, found[:, 1])
    np.maximum.at(most, row, found[:, 1])
    return np.stack([np.log1p(total), most, np.log1p(100 * total / np.maximum(n, 20)), np.log1p(n)], axis=1)


#: Coefficients, the last one constant, where the labels hold one class only.
PLAIN = np.array([1.5, 0.3, 0.8, -0.1, -4.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps; the constant
    comes last and is not shrunk."""
    if len(y) == 0 or y.min() == y.max():
        return PLAIN
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / scale
    return np.append(slope, w[-1] - slope @ mean)


def _beginnings(texts: pa.Array, only: set[str] | None) -> Iterator[tuple[np.ndarray, list[str]]]:
    """For each size of a beginning, and for whole words: which row holds which
    of the listed ones, once each."""
    coded, _, bounds, _, _ = _words(texts)
    use = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words, row = coded.dictionary.to_pylist(), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = np.unique(row * max(1, len(words)) + use)
    row, use = pairs // max(1, len(words)), pairs % max(1, len(words))
    for size in range(1, LONGEST + 2):
        code: dict[str, int] = {}
        of = np.full(len(words), -1, np.int64)
        for i, w in enumerate(words):
            key = w + END if size > LONGEST else w[:size] if len(w) >= size else None
            if key is not None and (only is None or key in only):
                of[i] = code.setdefault(key, len(code))
        at = of[use]
        some = at >= 0
        yield np.unique(at[some] * len(texts) + row[some]), list(code)


def _count_beginnings(rows: DataFrame, only: set[str] | None) -> DataFrame:
    """``key, toxic0, n0, toxic1, n1``: documents, toxic ones and all, of either
    half of ``text, toxic, fold`` that hold each beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                fold = part.column("fold").to_numpy(zero_copy_only=False).astype(np.int64)
                for held, keys in _beginnings(pc.fill_null(part.column("text"), ""), only):
                    key, row = held // max(1, part.num_rows), held % max(1, part.num_rows)
                    cols = [np.bincount(key[m], minlength=len(keys)) for f in (0, 1) for m in ((fold[row] == f) & (toxic[row] == 1), fold[row] == f)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names)

    names = ["key", "toxic0", "n0", "toxic1", "n1"]
    found = rows.mapInArrow(run, "key string, " + ", ".join(f"{c} long" for c in names[1:]))
    return found.groupBy("key").agg(*[F.sum(c).alias(c) for c in names[1:]])


def held_out(doc_id: Column) -> Column:
    """Whether the id's checksum leaves remainder 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``text, toxic, fold`` of about ``most`` labelled rows that are not held out
    (all, if fewer); ``docs`` is ``doc_id, text``."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    many = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    if many > most:
        known = known.where(place < (1 << 30) * most // many)
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int"))
    return docs.join(F.broadcast(known), "doc_id").select("text", "toxic", "fold")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and logistic coefficients."""
    rows = labelled_rows(docs, labels, most)
    toxic = rows.where("toxic = 1")
    often = {r["key"] for r in _count_beginnings(toxic, None).where(F.col("n0") + F.col("n1") >= SUPPORT).select("key").collect()}
    counts = [tuple(r) for r in _count_beginnings(rows, often).collect()] if often else []
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    t, n = ([sum(v for (f, x), v in sizes.items() if f == fold and x >= least) for fold in (0, 1)] for least in (1, 0))
    whole = build_lexicon(((k, a + c, b + d) for k, a, b, c, d in counts), sum(t), sum(n))
    # texts of a half are scored with the other half's lexicon
    other = [build_lexicon(((k, c, d) for k, _, _, c, d in counts), t[1], n[1]), build_lexicon(((k, a, b) for k, a, b, _, _ in counts), t[0], n[0])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                text, fold = pc.fill_null(part.column("text"), ""), part.column("fold").to_numpy(zero_copy_only=False)
                x = np.where((fold == 0)[:, None], *(features_of(*clause_scores(text, o)) for o in other))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["toxic", *FEATURES])

    found = rows.mapInArrow(run, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).orderBy("toxic", *FEATURES).collect()
    table = np.array([list(r) for r in found], np.float64).reshape(-1, 1 + len(FEATURES))
    return whole, fit_logistic(table[:, 1:], (table[:, 0] == 1).astype(float))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = SAMPLE, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted, n_words, n_clauses, clause_score``:
    for each whole text its score (0 to 1) and whether it reaches ``threshold``,
    its words, the clauses that the grammar matches and their highest score."""
    src = pick(docs, doc_id=id_col, text=text_col)
    lexicon, weights = train(src, pick(labels, doc_id=id_col, toxic=label_col), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                text = pc.fill_null(part.column("text"), "")
                n, found = clause_scores(text, lexicon)
                x = features_of(n, found)
                clauses = np.bincount(found[:, 0].astype(np.int64), minlength=len(n))
                score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(n, pa.int64()),
                                                  pa.array(clauses, pa.int64()), pa.array(x[:, 1])], names)

    names = ["doc_id", "score", "n_words", "n_clauses", "clause_score"]
    kind = src.schema["doc_id"].dataType.simpleString()
    scored = src.mapInArrow(run, f"doc_id {kind}, score double, n_words long, n_clauses long, clause_score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "n_clauses", "clause_score")
