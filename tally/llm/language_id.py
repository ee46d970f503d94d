"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model over runs of ``ORDER``
characters of the lower-cased text, in which every run of other characters than
letters is one space.  Counting covers all training rows: tasks count runs, a
combined aggregate adds them up, and continuation counts, discounts and context
weights follow by aggregates on those counts.  The model is kept as arrays of
sorted 64-bit hashes of runs and contexts, each beside a column per language.
If it would pass ``MAX_ROWS`` runs or ``MAX_CELLS`` values, it stays a table, and
the counted runs of the texts are joined with it; no run is left out.

A text gets the language with the lowest cross-entropy per character.  Its
score is the probability that this is right, by a logistic curve over the lead
on the second language, fitted to training rows that a first model does not see
(about ``CALIBRATION_ROWS`` of the rows set aside, give or take); the counts of all
rows set aside are then added for the final model.  ``accepted`` says whether it
reaches ``ACCEPT`` and the cross-entropy is no further than ``SPREAD`` standard
deviations above that of those rows.

Defined results: null texts and texts without a letter get ``und``, score 0;
if no row is labelled, so do all; of equal languages the first by name wins;
rows with null ids count as not held out and are not learned from; repeated rows
give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import pick, strings, text_slices, utf8_buffer
from tally.session import ensure_checkpoint_dir

ORDER = 4
UNKNOWN = "und"
#: Bytes of text that a task works on at a time (one row at least).
SLICE = 3 << 20
MAX_ROWS, MAX_CELLS = 2 << 20, 64 << 20
#: Bits of a model that stays a table are integers, in so many parts of a bit.
UNIT = 1 << 24
#: One of so many training rows serves calibration.
CALIBRATION_SHARE = 16
CALIBRATION_ROWS = 4096
ACCEPT, SPREAD = 0.5, 6.0
_STEP, _CHAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Runs:
    """Code points of a batch, each text after ORDER - 1 spaces and before one."""

    codes: np.ndarray
    bounds: np.ndarray   # rows + 1 positions in codes
    places: np.ndarray   # where runs of ORDER characters end
    counts: np.ndarray   # runs of each row

    def hashes(self, order: int, shift: int = 0) -> np.ndarray:
        """Hash of the ``order`` characters that end ``shift`` before each place."""
        out = np.zeros(len(self.places), np.uint64)
        for k in range(order):
            out = out * _STEP + (self.codes[self.places - (order - 1 - k) - shift].astype(np.uint64) + np.uint64(1)) * _CHAR
        return out


def runs(text: pa.Array) -> Runs:
    low = pc.utf8_lower(pc.fill_null(text.cast(pa.string()), ""))
    flat = pc.utf8_trim(pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", " "), " ")
    some = pc.match_substring_regex(low, r"\p{L}")  # marks alone are no letters
    padded = pc.if_else(some, pc.binary_join_element_wise(" " * (ORDER - 1), flat, " ", ""), "")
    data, _ = utf8_buffer(padded)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    size = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.append(0, np.cumsum(size))
    inner = np.ones(len(codes), bool)
    starts = bounds[:-1][size > 0]
    for k in range(ORDER - 1):
        inner[starts + k] = False
    return Runs(codes, bounds, np.flatnonzero(inner).astype(np.int32), np.maximum(size - (ORDER - 1), 0))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each key's value among the distinct ones, and a place of each of them."""
    index = pa.array(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    place = np.zeros(int(index.max(initial=-1)) + 1, np.int64)
    place[index] = np.arange(len(index))
    return index, place


def _tally(found: Runs, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Group, run and count of the different pairs of these; ``group`` is a number by row."""
    of = np.repeat(group.astype(np.uint64), found.counts)
    index, place = _distinct(found.hashes(ORDER) ^ (of * np.uint64(0xA24BAED4963EE407)))
    at = found.places[place]
    codes = found.codes[(at[:, None] + np.arange(1 - ORDER, 1)).ravel()]
    flat = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    # byte offsets of every ORDER-th character
    heads = np.append(np.flatnonzero((flat & 0xC0) != 0x80)[::ORDER], len(flat))
    return of[place].astype(np.int64), strings(flat, heads).cast(pa.string()), np.bincount(index, minlength=len(place))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts ``lang, gram, n`` of rows ``text, lang``, per slice."""
    for batch in batches:
        for part in text_slices(batch, "text", SLICE):
            coded = part.column("lang").dictionary_encode()
            lang, gram, n = _tally(runs(part.column("text")), coded.indices.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(lang)), gram, pa.array(n)], ["lang", "gram", "n"])


def _values(grams: DataFrame) -> DataFrame:
    """``part, k, lang, gram, value`` of a Kneser-Ney model: for part 'run' the
    discounted share of a run of k characters in its context, for part 'context'
    the weight that a context of k - 1 characters leaves to the lower order."""
    size = F.col("k")
    ends = grams.select("lang", "gram", "n", F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("k")) \
        .groupBy("lang", "k", F.expr("right(gram, k)").alias("gram")).agg(F.sum("n").alias("n"))
    # below ORDER, n is in how many ways a run is continued to the left
    table = ends.select("lang", F.explode(F.filter(F.array(
        F.when(size == ORDER, F.struct("k", "gram", "n")),
        F.when(size > 1, F.struct((size - 1).alias("k"), F.expr("right(gram, k - 1)").alias("gram"), F.lit(1).cast("long").alias("n")))),
        lambda x: x.isNotNull())).alias("x")).select("lang", "x.*").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")) \
        .withColumn("context", F.expr("left(gram, k - 1)")).checkpoint()
    once, twice = F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))
    discount = table.groupBy("lang", "k").agg(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.coalesce(
        F.try_divide(once, once + 2 * twice), F.lit(0.5)))).alias("d"))
    context = table.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types")) \
        .join(F.broadcast(discount), ["lang", "k"])  # a row per order and language
    run = table.join(context, ["lang", "k", "context"])
    return run.select(F.lit("run").alias("part"), "k", "lang", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("value")) \
        .unionByName(context.select(F.lit("context").alias("part"), "k", "lang", F.col("context").alias("gram"),
                                    (F.col("d") * F.col("types") / F.col("total")).alias("value")))


def _hash(grams: pa.Array) -> np.ndarray:
    """Hashes of strings, as ``Runs.hashes`` gives them."""
    out = np.zeros(len(grams), np.uint64)
    sizes = pc.utf8_length(grams).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        data, _ = utf8_buffer(grams.take(pa.array(mine)))
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).reshape(len(mine), size)
        h = np.zeros(len(mine), np.uint64)
        for k in range(size):
            h = h * _STEP + (codes[:, k].astype(np.uint64) + np.uint64(1)) * _CHAR
        out[mine] = h
    return out


@dataclass
class Model:
    langs: list[str]
    tables: dict          # (part, k) -> (sorted hashes, values by language)
    alphabet: int
    curve: tuple[float, float] = (1.0, 0.0)
    most_bits: float = float("inf")

    @classmethod
    def build(cls, values: pa.Table) -> Model:
        """From rows ``part, k, lang, gram, value``."""
        langs = sorted(pc.unique(values["lang"]).to_pylist())
        number = pc.index_in(values["lang"], value_set=pa.array(langs, pa.string())).to_numpy()
        which = {p: pc.equal(values["part"], p).to_numpy() for p in ("run", "context")}
        order, value = values["k"].to_numpy(), values["value"].to_numpy()
        tables = {}
        for part in which:
            for k in range(1, ORDER + 1):
                mine = np.flatnonzero(which[part] & (order == k))
                if not len(mine):
                    continue
                keys, index = np.unique(_hash(values["gram"].take(pa.array(mine)).combine_chunks()), return_inverse=True)
                fill = 0.0 if part == "run" else 1.0  # a context never seen leaves everything to the lower order
                cells = np.full((len(keys), len(langs)), fill, np.float32)
                cells[index, number[mine]] = value[mine]
                tables[part, k] = keys, cells
        alphabet = len(tables["run", 1][0]) + 1 if tables else 1
        return cls(langs, tables, alphabet)

    def _look(self, part: str, k: int, keys: np.ndarray) -> np.ndarray:
        known, cells = self.tables[part, k]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = cells[at]
        out[known[at] != keys] = 0.0 if part == "run" else 1.0
        return out

    def entropies(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per character, by row and language, and the
        number of characters of each row."""
        found = runs(text)
        index, place = _distinct(found.hashes(ORDER))
        kinds = Runs(found.codes, found.bounds, found.places[place], found.counts)
        p = np.full((len(place), len(self.langs)), 1.0 / self.alphabet, np.float32)
        for k in range(1, ORDER + 1):
            p = self._look("run", k, kinds.hashes(k)) + self._look("context", k, kinds.hashes(k - 1, 1)) * p
        bits = -np.log2(np.maximum(p, 1e-30)).astype(np.float64)
        end = np.append(0, np.cumsum(found.counts))
        out = np.zeros((len(found.counts), len(self.langs)))
        for j in range(len(self.langs)):
            total = np.append(0.0, np.cumsum(bits[:, j][index]))
            out[:, j] = total[end[1:]] - total[end[:-1]]
        return out / np.maximum(found.counts, 1)[:, None], found.counts

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, lead in bits per character on the next one, cross-entropy
        and whether there is a letter at all."""
        if not self.langs:
            n = len(text)
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
        bits, n = self.entropies(text)
        some = n > 0
        best = np.argmin(bits, axis=1)
        ordered = np.sort(bits, axis=1)
        lead = ordered[:, 1] - ordered[:, 0] if len(self.langs) > 1 else np.ones(len(n))
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, some)], lead, ordered[:, 0], some

    def score(self, lead: np.ndarray, some: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return np.where(some, 1 / (1 + np.exp(-np.clip(a * lead + b, -50, 50))), 0.0)


@dataclass
class Wide:
    """A model of any size: ``values`` stays a table."""

    langs: list[str]
    values: DataFrame
    alphabet: int
    curve: tuple[float, float] = (1.0, 0.0)
    most_bits: float = float("inf")

    def bits(self, grams: DataFrame) -> DataFrame:
        """``gram, _lang, bits`` (in units of 1 / UNIT) of runs ``gram``, for every language.

        Each order is worked out once per different ending of the runs, so a key
        of a join has as many rows as there are characters, at most."""
        langs = F.broadcast(grams.sparkSession.createDataFrame([(x,) for x in self.langs], "_lang string"))
        known, p = self.values.withColumnRenamed("lang", "_lang"), None
        for k in range(1, ORDER + 1):
            def part(name: str, key: str, value: str) -> DataFrame:
                return known.where((F.col("part") == name) & (F.col("k") == k)).select("_lang", F.col("gram").alias(key), F.col("value").alias(value))

            ends = grams.select(F.substring("gram", ORDER - k + 1, k).alias("gram")).distinct().crossJoin(langs) \
                .withColumns({"context": F.substring("gram", 1, k - 1), "lower": F.substring("gram", 2, k - 1)}) \
                .join(part("run", "gram", "share"), ["_lang", "gram"], "left").join(part("context", "context", "left_over"), ["_lang", "context"], "left")
            if p is None:
                ends = ends.withColumn("below", F.lit(1.0 / self.alphabet))
            else:
                ends = ends.join(p.select("_lang", F.col("gram").alias("lower"), F.col("p").alias("below")), ["_lang", "lower"])
            p = ends.select("_lang", "gram", (F.coalesce("share", F.lit(0.0)) + F.coalesce("left_over", F.lit(1.0)) * F.col("below")).alias("p"))
        return p.select("gram", "_lang", F.round(-F.log2(F.greatest("p", F.lit(1e-30))) * UNIT).cast("long").alias("bits"))

    def apply(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """What ``_apply`` gives: counted runs of each text joined with their bits.
        Sums are of integers, so equal languages stay equal."""
        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, "text", SLICE):
                    found = runs(part.column("text"))
                    row, gram, n = _tally(found, np.arange(part.num_rows))
                    none = np.flatnonzero(found.counts == 0)
                    at = pa.array(np.concatenate([row, none]))
                    # rows without a letter get a key of their own, which is no run
                    own = part.column("_row").take(pa.array(none)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c).take(at) for c in [*keep, "_row"]], pa.concat_arrays([gram, own]),
                         pa.array(np.concatenate([n, np.zeros(len(none), np.int64)]))], [*keep, "_row", "gram", "n"])

        src = rows.select(*keep, "text")
        kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in keep)
        grams = src.select("text", F.lit("").alias("lang")).mapInArrow(_count, "lang string, gram string, n long").select("gram").distinct().checkpoint()
        counted = src.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(pairs, f"{kinds}, _row long, gram string, n long")
        row = [*keep, "_row"]
        found = counted.join(self.bits(grams), "gram", "left").groupBy(*row, "_lang") \
            .agg(F.sum(F.col("n") * F.col("bits")).alias("total"), F.sum("n").alias("chars")) \
            .groupBy(*row).agg(F.max("chars").alias("chars"), F.array_sort(F.collect_list(
                F.when(F.col("_lang").isNotNull(), F.struct("total", "_lang")))).alias("found"))  # a value per language
        some = F.size("found") > 0
        first, second = F.get("found", F.lit(0)), F.get("found", F.lit(1))
        size = F.col("chars") * F.lit(float(UNIT))
        a, b = self.curve
        lead = F.coalesce((second["total"] - first["total"]) / size, F.lit(1.0))
        found = found.select(*keep, F.coalesce(first["_lang"], F.lit(UNKNOWN)).alias("lang_pred"), F.when(some, lead).otherwise(0.0).alias("lead"),
                             F.when(some, first["total"] / size).otherwise(0.0).alias("bits"), some.alias("has_letter"))
        sure = 1 / (1 + F.exp(-F.least(F.greatest(a * F.col("lead") + b, F.lit(-50.0)), F.lit(50.0))))
        return found.withColumn("score", F.when(F.col("has_letter"), sure).otherwise(0.0)) \
            .withColumn("accepted", (F.col("score") >= ACCEPT) & (F.col("bits") <= self.most_bits)) \
            .select(*keep, "lang_pred", "lead", "bits", "score", "has_letter", "accepted")


def fit_curve(lead: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Logistic curve of being right over the lead: Newton steps on smoothed
    targets with a weak prior, rising in the lead."""
    if len(lead) == 0:
        return 10.0, 0.0
    target = np.where(right, 1 - 1 / (right.sum() + 2), 1 / ((~right).sum() + 2))
    x = np.column_stack([lead, np.ones_like(lead)])
    w = np.array([10.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - target) + 1e-2 * (w - [10.0, 0.0])
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -5, 5)
    return max(float(w[0]), 1e-3), float(w[1])


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def _model(grams: DataFrame) -> Model | Wide:
    """The model of all counts, in arrays if they are small enough."""
    values = _values(grams).checkpoint()
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    rows = values.count()
    if rows > MAX_ROWS or rows * len(langs) > MAX_CELLS:
        return Wide(langs, values, values.where("part = 'run' AND k = 1").select("gram").distinct().count() + 1)
    return Model.build(values.toArrow())


def _grams(labelled: DataFrame) -> DataFrame:
    counted = labelled.select("text", "lang").mapInArrow(_count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _calibrate(model: Model | Wide, aside: DataFrame) -> None:
    """Set curve and bits by rows that the model does not see, as far as it knows their languages."""
    if not model.langs:
        model.curve = fit_curve(np.zeros(0), np.zeros(0, bool))
        return
    spare = max(1, aside.count())
    part = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(spare)) < CALIBRATION_ROWS
    got = _apply(aside.where(part & F.col("lang").isin(model.langs)), model, ["lang"]).where("has_letter") \
        .select("lead", "bits", (F.col("lang") == F.col("lang_pred")).alias("right")).toArrow()
    right = got["right"].to_numpy().astype(bool)
    model.curve = fit_curve(got["lead"].to_numpy().astype(float), right)
    bits = got["bits"].to_numpy()[right]
    if len(bits):
        model.most_bits = float(bits.mean() + SPREAD * max(bits.std(), 0.05))


def _split(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that the calibrating model learns from and rows set aside for it."""
    aside = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATION_SHARE)) == 0
    return labelled.where(~aside), labelled.where(aside)


def fit(labelled: DataFrame) -> Model | Wide:
    """A calibrated model from the ``doc_id, text, lang`` rows that are not set aside."""
    seen, aside = _split(labelled)
    model = _model(_grams(seen).checkpoint())
    _calibrate(model, aside)
    return model


def learn(labelled: DataFrame) -> Model | Wide:
    """A model from all ``doc_id, text, lang`` rows with an id, calibrated by one
    that does not see the rows set aside; their counts are then added."""
    seen, aside = _split(labelled)
    grams = _grams(seen).checkpoint()
    held_back = _model(grams)
    _calibrate(held_back, aside)
    model = _model(grams.unionByName(_grams(aside)).groupBy("lang", "gram").agg(F.sum("n").alias("n")).checkpoint())
    model.curve, model.most_bits = held_back.curve, held_back.most_bits
    return model


def _apply(rows: DataFrame, model: Model | Wide, keep: list[str]) -> DataFrame:
    """``keep``, then ``lang_pred, lead, bits, score, has_letter, accepted``."""
    if isinstance(model, Wide):
        return model.apply(rows, keep)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = held.value
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                lang, lead, bits, some = use.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(lead, pa.float64()),
                     pa.array(bits, pa.float64()), pa.array(use.score(lead, some), pa.float64()), pa.array(some),
                     pa.array((use.score(lead, some) >= ACCEPT) & (bits <= use.most_bits))], names)

    names = [*keep, "lang_pred", "lead", "bits", "score", "has_letter", "accepted"]
    src = rows.select(*keep, "text")
    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{kinds}, lang_pred string, lead double, bits double, score double, has_letter boolean, accepted boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted, bits``: models learn from
    the labelled rows that are not held out, and every row gets a prediction."""
    ensure_checkpoint_dir(docs.sparkSession)
    src = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = learn(src.where((remainder(F.col("doc_id")) != 1) & F.col("lang").isNotNull()))
    rows = src.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text")
    return _apply(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "accepted", "bits")
