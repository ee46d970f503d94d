"""Quality rules and robust multivariate outliers, in DataFrame operations only.

``features`` counts words, symbols, repeated lines and repeated 3-word windows
in one pass over each text.  Documents that pass the base rules form groups of
one language and source; per group a minimum-covariance-determinant estimate
gives location and covariance of the transformed statistics ``STATS``, and a
document whose squared Mahalanobis distance exceeds ``CUTOFF`` is rejected.

The estimate runs concentration steps from two starts and keeps the one with
the smaller determinant.  A step needs one combined aggregate: rows are counted
and summed per group and distance bin, so the nearest ``CORE`` share of a group
is a prefix of its bins, however large the group is.  Standard deviations have
the floors of ``STATS``, so a statistic that is constant in the core does not
make the covariance singular.  Groups of fewer than ``MIN_GROUP`` documents are
pooled by language, and pools that are still smaller all together.

Defined results: null text counts as empty (no words, so base_failed); null
language or source counts as ''; repeated rows give repeated rows, each counted;
null ids stay null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import WHITE, let, pick, words, written
from tally.session import ensure_checkpoint_dir

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Transformed statistics and the floors of their standard deviations.
STATS = {"word_length": 0.1, "symbol_rate": 0.05, "dup_line_rate": 0.1, "repeat_rate": 0.1}
#: Words of average length 5 that are added to a document before its mean word length is taken,
#: so that the spread of the mean does not depend on the document's length.
PRIOR_WORDS, PRIOR_LENGTH = 100, 5
CORE = 0.75
MIN_GROUP = 100
STEPS = 4
#: Rows up to which a table with a row per group is broadcast; beyond that each of its rows meets a
#: group's documents in so many tasks.
BROADCAST_ROWS, SALTS = 100_000, 32


def _chi2_cdf(x: float, df: int) -> float:
    """Chi-squared distribution function, even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def _chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, df) < p else (lo, mid)
    return lo


#: Makes the core's covariance consistent for normal data.
CONSISTENCY = CORE / _chi2_cdf(_chi2_quantile(CORE, len(STATS)), len(STATS) + 2)
CUTOFF = _chi2_quantile(1 - 1e-5, len(STATS))


def _repeat_words(w: Column) -> Column:
    """Words of an array that lie in a 3-word window found twice or more.

    Window hashes are sorted together with their places: the high bits of a
    64-bit value are the hash's, the low bits the place.  Neighbours with equal
    high bits are compared by their whole hashes.  The words covered by windows
    at sorted places p are the sum of min(3, next p - p)."""

    def over(hashes: Column) -> Column:
        bits = F.length(F.bin(F.size(hashes).cast("long")))

        def packed(b: Column) -> Column:
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
            keys = F.sort_array(F.transform(
                hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

            def scan(k: Column) -> Column:
                def same(x: Column, y: Column) -> Column:
                    return (x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(mask)) == 0) \
                        & (F.get(hashes, x.bitwiseAND(mask).cast("int")) == F.get(hashes, y.bitwiseAND(mask).cast("int")))

                again = F.filter(k, lambda x, i: F.coalesce(same(x, F.get(k, i + 1)), F.lit(False))
                                 | F.coalesce(same(x, F.get(k, i - 1)), F.lit(False)))
                return let(F.sort_array(F.transform(again, lambda x: x.bitwiseAND(mask).cast("int"))), lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                    F.lit(0), lambda a, x: a + x))

            return let(keys, scan)

        return let(bits, packed)

    def windows(a: Column) -> Column:
        return let(F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - 2, F.lit(0))),
                               lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2))), over)

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(windows(w)).cast("long")


def features(text: Column) -> Column:
    """Struct of the counts of one text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda s: F.length(F.translate(s, WHITE, "")) > 0)

    def of(w: Column) -> Column:
        return let(lines, lambda n: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(whole, WHITE, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(n) - F.size(F.array_distinct(n))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(n).cast("long").alias("n_lines")))

    return let(words(whole), of)


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds the counts, ``base_failed``, the statistics and the group's names to
    rows with ``text, lang, source``."""
    got = docs.withColumn("_f", features(F.col("text"))).select(*docs.columns, "_f.*")
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return got.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        "word_length": (F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (F.col("n_words") + PRIOR_WORDS),
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / lines,
        "repeat_rate": F.col("n_repeat_words") / n,
        "g_lang": F.coalesce("lang", F.lit("")),
        "g_source": F.coalesce("source", F.lit("")),
    })


def _factor(rows: DataFrame) -> DataFrame:
    """Adds the Cholesky factor ``l_ij`` of the covariance ``c_ij`` with floors,
    and ``det``, the product of its diagonal."""
    d, floors = len(STATS), list(STATS.values())
    det = F.lit(1.0)
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}") + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            rows = rows.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2 * 1e-6))) if i == j
                                   else rest / F.col(f"l_{j}{j}"))
        det = det * F.col(f"l_{i}{i}")
    return rows.withColumn("det", det)


def _distance() -> Column:
    """Squared Mahalanobis distance of a row's statistics from its estimate."""
    solved: list[Column] = []
    for i, name in enumerate(STATS):
        rest = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}{k}") * solved[k]
        solved.append(rest / F.col(f"l_{i}{i}"))
    return sum((y * y for y in solved), F.lit(0.0))


def _sums() -> list[Column]:
    names = list(STATS)
    return [F.count("*").alias("n"), *[F.sum(a).alias(f"s_{i}") for i, a in enumerate(names)],
            *[F.sum(F.col(a) * F.col(names[j])).alias(f"q_{i}{j}") for i, a in enumerate(names) for j in range(i + 1)]]


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    """Means and covariances from sums, to 12 decimals, so that the order in
    which tasks add up does not show."""
    d = len(STATS)
    means = {f"m_{i}": F.round(F.col(f"s_{i}") / F.col("n"), 12) for i in range(d)}
    rows = rows.withColumns(means)
    return rows.withColumns({f"c_{i}{j}": F.round((F.col(f"q_{i}{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * scale, 12)
                             for i in range(d) for j in range(i + 1)})


def with_groups(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows to a table with a row per group, so that a group with very many
    rows is not gathered in one task."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*STATS), F.lit(SALTS)).cast("int")) \
        .join(salted, [*keys, "_salt"], how).drop("_salt")


def group_keys(stats: DataFrame) -> DataFrame:
    """``g_lang, g_source, g_key``: the estimate that each language and source uses."""
    sizes = stats.groupBy("g_lang", "g_source").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n"))
    own = F.col("n") >= MIN_GROUP
    by_lang = sizes.where(~own).groupBy(F.col("g_lang").alias("p_lang")).agg((F.sum("n") >= MIN_GROUP).alias("enough"))
    return sizes.join(by_lang, sizes.g_lang == by_lang.p_lang, "left").select(
        "g_lang", "g_source", F.when(own, F.to_json(F.array("g_lang", "g_source")))
        .when(F.col("enough"), F.to_json(F.array("g_lang"))).otherwise(F.lit("")).alias("g_key"))


def estimates(stats: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per ``g_key``: location ``m_i``, factor ``l_ij`` and ``det`` of
    its minimum-covariance-determinant estimate."""
    clean = with_groups(stats.where(~F.col("base_failed")), keys, ["g_lang", "g_source"]).select("g_key", *STATS)
    wide = _factor(_moments(clean.groupBy("g_key").agg(*_sums()), 1.0))
    # the second start ignores how the statistics depend on each other and starts from the axes' floors
    near = wide.withColumns({f"l_{i}{j}": F.lit(10.0 * f if i == j else 0.0)
                             for i, f in enumerate(STATS.values()) for j in range(i + 1)})
    model = wide.withColumn("start", F.lit(0)).unionByName(near.withColumn("start", F.lit(1)))
    keep = ["g_key", "start", "det", *[f"m_{i}" for i in range(len(STATS))],
            *[f"l_{i}{j}" for i in range(len(STATS)) for j in range(i + 1)]]
    model = model.select(*keep).checkpoint()
    for _ in range(STEPS):
        bin_ = F.floor(16 * F.log2(_distance() + 1e-4)).cast("int")
        bins = with_groups(clean, model, ["g_key"]).groupBy("g_key", "start", bin_.alias("bin")).agg(*_sums())
        by = Window.partitionBy("g_key", "start")
        before = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        core = bins.withColumns({"before": F.coalesce(before, F.lit(0)), "all": F.sum("n").over(by)}) \
            .where(F.col("before") < CORE * F.col("all"))
        total = core.groupBy("g_key", "start").agg(*[F.sum(c).alias(c) for c in bins.columns if c not in ("g_key", "start", "bin")])
        model = _factor(_moments(total, CONSISTENCY)).select(*keep).checkpoint()
    first = F.row_number().over(Window.partitionBy("g_key").orderBy("det", "start"))
    return model.withColumn("_n", first).where("_n = 1").drop("_n", "start")


def judge(rows: DataFrame, keys: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``distance`` and ``kept`` to rows with statistics."""
    table = keys.join(model, "g_key", "left").checkpoint()
    far = F.coalesce(_distance(), F.lit(0.0))
    joined = with_groups(rows, table, ["g_lang", "g_source"], "left").withColumn("distance", far)
    # one expression over both sides, so that no part of it is pushed below the join and counts the words again
    return joined.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.col("distance") <= CUTOFF))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``distance``."""
    ensure_checkpoint_dir(docs.sparkSession)
    src = pick(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col)
    stats = with_statistics(src).drop("text", "lang", "source").checkpoint()
    keys = group_keys(stats).checkpoint()
    return judge(stats, keys, estimates(stats, keys)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The kept rows of ``docs`` with all their columns.  Rows are written beside
    their statistics once; estimates read the statistics only."""
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    rows = written(with_statistics(flat.select(F.struct("*").alias("_row"), *[
        F.col(f"_c{names.index(c)}").alias(n) for n, c in (("text", text_col), ("lang", lang_col), ("source", source_col))]))
        .select("_row", "g_lang", "g_source", "base_failed", *STATS), "quality-statistics")
    stats = rows.drop("_row")
    keys = group_keys(stats).checkpoint()
    return judge(rows, keys, estimates(stats, keys)).where("kept").select("_row.*").toDF(*names)
