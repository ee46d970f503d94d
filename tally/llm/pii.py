"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the matches of ``BASE`` and of the looser ``LOOSE`` patterns.
Six labelers (shape and validity regexes, a gazetteer, cue words before the span
for and against, characters around it) vote yes, no or nothing on each.
Expectation-maximisation over the counts of vote patterns estimates, per kind,
the share of true spans and each labeler's reliability; candidates that fail
their kind's check are known to be false, which ties the two classes down.  The
posteriors weigh the candidates from which the final classifier, naive Bayes
over span features, is trained; it decides on the candidates that pass their
check and are no base spans.  Base spans that pass their checks always stay.

The texts are read once.  What is summed over the corpus are counts of vote and
feature patterns, whose number does not depend on the corpus; the classifier's
weights are a few hundred numbers.

All patterns are possessive where nothing could be given back and start only
where a run of their first character class starts (or where the last match
ended), so they find what the plain patterns find in linear time.

Defined results: null and empty texts have no spans; repeated rows give repeated
rows; null ids stay null; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import let, pick, written
from tally.session import ensure_checkpoint_dir

#: Kinds in the order of their spans at one start.
KINDS = ("email", "ip", "card", "phone", "id")
BASE_KINDS = KINDS[:4]

#: Leftmost non-overlapping matches of the contract's patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns: kind, pattern, and a string or class without which it cannot match.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|&#64;)\x20?[A-Za-z0-9-]++"
              r"(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\.)[A-Za-z0-9-]++)++", r"\(at\)|\[at\]|\{at\}|&#64;"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", r"[0-9]{4}[\x20./_-][0-9]{4}"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9])", r"\+[0-9]"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|00[1-9][0-9]{1,2}\x20|0[1-9][0-9]{1,3}[\x20/-]|[2-9][0-9]{2}[\x20.-])"
              r"[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-]?[0-9]{4}"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
)
#: Words in the gazetteer of each kind: top-level domains, dialling codes and issuer digits. Fixed values.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "us", "ca", "ch", "at")
DIALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55",
            "61", "64", "65", "81", "82", "86", "90", "91")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|6011|65)"
#: Cue words shortly before a span. Fixed values.
CUES = {
    "email": "e-?mail|mail|contact|write to|reach|correo|courriel",
    "ip": r"\bip\b|server|host|address|gateway|login from|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|fax|mobile|cell|whatsapp|telefon",
    "id": "ssn|social security|iban|account|passport|national id|konto|compte|cuenta",
}
COUNTER_CUES = r"isbn|issn|version|\bv\.?$|invoice|order no|serial|section|chapter|doi|token|hash|sha"
LABELERS = 6
#: The labeler that repeats the check of a kind.
CHECK = 1
ROUNDS = 25
CONTEXT = 32


def _sums_before(lens: Column) -> Column:
    """Sum of the elements before each element, in runs of 64 so that the cost
    stays close to linear."""

    def over(n: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 64).cast("int")),
                           lambda r: F.aggregate(F.slice(n, r * 64 + 1, F.lit(64)), F.lit(0), lambda a, x: a + x))
        heads = F.aggregate(runs, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")),
                            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")),
                            lambda a: a["all"])
        return let(heads, lambda h: F.transform(n, lambda _, i: F.get(h, F.floor(i / 64).cast("int")) + F.aggregate(
            F.slice(n, F.floor(i / 64).cast("int") * 64 + 1, i % 64), F.lit(0), lambda a, x: a + x)))

    return let(lens, over)


def _matches(text: Column, pattern: str, gate: str) -> Column:
    """Matches in order: ``start, end`` in code points, ``value``, and up to
    ``CONTEXT`` characters on both sides, as far as the neighbouring matches."""

    def of(hits: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(
            _sums_before(F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))),
            lambda before: F.transform(hits, lambda h, i: F.struct(
                (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"),
                (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"), h.alias("value"),
                F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("right")))))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    return F.when(text.rlike(gate), let(hits, lambda h: F.when(F.size(h) > 0, of(h)).otherwise(none))).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    each = F.transform(F.split(F.reverse(digits), ""), term)
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """The contract's check of a match (for looser patterns, the same on their digits)."""
    n = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return value.rlike(rf"^{octet}(?:\.{octet}){{3}}$") | value.rlike(":")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.when(value.rlike("^[0-9]"), ~value.rlike("^(?:000|666|9)|-00-|0000$")).otherwise(F.length(F.replace(value, F.lit(" "))) >= 15)


def _shape(kind: str, value: Column) -> Column:
    """Regex labeler: whether a match has a usual written form."""
    if kind == "email":
        return value.rlike(r"^[A-Za-z0-9][^@]*[@(\[{& ].*[A-Za-z]{2,24}$")
    if kind == "ip":
        return value.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$") | value.rlike(":")
    if kind == "card":
        return value.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$")
    if kind == "phone":
        return value.rlike(r"^[+(0-9][0-9 ().-]*[0-9]$") & ~value.rlike(r"[ .()-]{3}")
    return value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}")


def _listed(kind: str, value: Column) -> Column:
    """Gazetteer labeler (null: it has no say)."""
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(*TOP_LEVEL), F.lit(True))
    if kind == "ip":
        return F.when(value.rlike(":"), F.lit(None).cast("boolean")).otherwise(~value.rlike(r"^(?:0|255)\."))
    if kind == "card":
        return _digits(value).rlike(ISSUERS)
    if kind == "phone":
        return F.when(value.rlike(r"^\+"), value.rlike(rf"^\+(?:{'|'.join(DIALLING)})"))
    return F.lit(None).cast("boolean")


def _candidate(kind: str, base: bool, m: Column) -> Column:
    value, left, right = m["value"], F.lower(m["left"]), m["right"]
    valid, cue, counter = _valid(kind, value), left.rlike(CUES[kind]), left.rlike(COUNTER_CUES)
    glued = m["left"].rlike(r"[\p{L}0-9]$") | right.rlike(r"^[\p{L}0-9]")
    yes, no, say = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    votes = [valid & _shape(kind, value), valid, _listed(kind, value), F.when(cue, yes).otherwise(say),
             F.when(counter, no).otherwise(say), F.when(glued, no).otherwise(say)]
    text = F.concat(*[F.when(v, "1").when(~v, "0").otherwise("-") for v in votes])

    def side(s: Column, at: str) -> Column:
        one = [r"\s", r"\p{L}", "[0-9]"]
        pattern = ["{}$", "^{}"][at == "next"]
        return F.when(s == "", "edge").when(s.rlike(pattern.format(one[0])), "space") \
            .when(s.rlike(pattern.format(one[1])), "letter").when(s.rlike(pattern.format(one[2])), "digit").otherwise("mark")

    features = F.array(
        F.concat(F.lit("valid="), valid.cast("string")),
        F.concat(F.lit("length="), F.least(F.floor(F.log2(F.length(value))), F.lit(6)).cast("string")),
        F.concat(F.lit("digits="), F.least(F.floor(F.length(_digits(value)) / 4), F.lit(5)).cast("string")),
        F.concat(F.lit("inside="), F.when(value.rlike(r"\s"), "space").when(value.rlike("-"), "dash")
                 .when(value.rlike(r"\."), "dot").otherwise("none")),
        F.concat(F.lit("before="), side(m["left"], "last")),
        F.concat(F.lit("after="), side(m["right"], "next")),
        F.concat(F.lit("cue="), F.when(counter, "against").when(cue, "for").otherwise("none")))
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), m["end"].alias("end"),
                    F.lit(kind).alias("kind"), (F.lit(base) & valid).alias("base"), text.alias("votes"), features.alias("features"))


def candidates(text: Column) -> Column:
    """All candidates of a text, base matches first."""
    whole = F.coalesce(text, F.lit(""))
    gates = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

    def described(kind: str, base: bool, matches: Column) -> Column:
        return F.transform(matches, lambda m: _candidate(kind, base, m))

    return F.concat(*[described(k, True, _matches(whole, BASE[k], gates[k])) for k in BASE_KINDS],
                    *[described(k, False, _matches(whole, p, gate)) for k, p, gate in LOOSE])


def _vote(votes: Column, i: int) -> Column:
    return F.substring(votes, i + 1, 1)


def _posterior(p: Column, votes: Column) -> Column:
    """Probability of a true span, from a kind's parameters and a vote pattern."""
    logit = F.log(p["share"] / (1 - p["share"]))
    for i in range(LABELERS):
        hit, miss = p[f"hit{i}"], p[f"miss{i}"]
        logit = logit + F.when(_vote(votes, i) == "1", F.log(hit / miss)).when(_vote(votes, i) == "0", F.log((1 - hit) / (1 - miss))) \
            .otherwise(0.0)
    return F.when(_vote(votes, CHECK) == "0", 0.0).otherwise(1 / (1 + F.exp(-logit)))


def _maximise(patterns: Column) -> Column:
    """Parameters from patterns ``votes, n, q``: the share of true spans, and per
    labeler how often it says yes to true and to false ones.  Two added votes
    that follow the labeler's meaning keep unused rates away from 0 and 1."""

    def total(weight) -> Column:
        return F.aggregate(patterns, F.lit(0.0), lambda a, x: a + weight(x))

    def rate(i: int, q, prior: float) -> Column:
        said = total(lambda x: F.when(_vote(x["votes"], i) != "-", x["n"] * q(x)).otherwise(0.0))
        yes = total(lambda x: F.when(_vote(x["votes"], i) == "1", x["n"] * q(x)).otherwise(0.0))
        return (yes + 2 * prior) / (said + 2)

    def true(x):
        return x["q"]

    def false(x):
        return 1 - x["q"]

    n = total(lambda x: x["n"])
    fields = [((total(lambda x: x["n"] * x["q"]) + 1) / (n + 2)).alias("share")]
    for i in range(LABELERS):
        fields += [rate(i, true, 0.8).alias(f"hit{i}"), rate(i, false, 0.2).alias(f"miss{i}")]
    return F.struct(*fields)


def reliabilities(patterns: DataFrame) -> DataFrame:
    """``kind, model`` of ``kind, votes, n``: EM per kind over its vote patterns
    (at most 3 ** LABELERS of them), as one fold over the rounds."""
    rows = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"))
    start = F.struct(F.lit(0.5).alias("share"), *[F.lit(x).alias(f"{name}{i}") for i in range(LABELERS)
                                                  for name, x in (("hit", 0.8), ("miss", 0.2))])

    def step(model: Column, _: Column) -> Column:
        weighed = F.transform(F.col("rows"), lambda x: F.struct(
            x["votes"].alias("votes"), x["n"].alias("n"), _posterior(model, x["votes"]).alias("q")))
        return let(weighed, _maximise)

    return rows.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("model"))


def train(found: DataFrame) -> dict[str, float]:
    """Weights of the final classifier from rows with ``cands``: for each kind
    the log odds of a true span, and of each feature how much it adds.  Kinds,
    votes and features are finite lists, so this is a bounded table."""
    seen = found.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n")).checkpoint()
    patterns = seen.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    models = reliabilities(patterns)
    soft = seen.join(F.broadcast(models), "kind").withColumn("q", _posterior(F.col("model"), F.col("votes"))).checkpoint()
    true, false = F.sum(F.col("n") * F.col("q")), F.sum(F.col("n") * (1 - F.col("q")))
    kinds = soft.groupBy("kind").agg(true.alias("all1"), false.alias("all0"))
    each = soft.select("kind", "n", "q", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(true.alias("n1"), false.alias("n0"))
    rows = each.join(F.broadcast(kinds), "kind").select(F.concat_ws("|", "kind", "feature").alias("key"), (
        F.log((F.col("n1") + 0.5) / (F.col("all1") + 1)) - F.log((F.col("n0") + 0.5) / (F.col("all0") + 1))).alias("weight"))
    rows = rows.unionByName(kinds.select(F.col("kind").alias("key"), F.log((F.col("all1") + 0.5) / (F.col("all0") + 0.5)).alias("weight")))
    return {r["key"]: round(r["weight"], 9) for r in rows.collect()}


def _score(c: Column, weights: dict[str, float]) -> Column:
    """Log odds that a candidate is a true span; features never seen add nothing."""
    if not weights:
        return F.lit(-1.0)
    keys = sorted(weights)
    table = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.lit(float(weights[k])) for k in keys]))
    prior = F.coalesce(F.try_element_at(table, c["kind"]), F.lit(-100.0))
    return prior + F.aggregate(c["features"], F.lit(0.0), lambda a, f: a + F.coalesce(
        F.try_element_at(table, F.concat_ws("|", c["kind"], f)), F.lit(0.0)))


SPANS = "array<struct<start:int,order:int,end:int,kind:string,base:boolean>>"
#: More than any text's code points.
_FAR = 1 << 32
_BOM = bytearray(b"\x00\x00\xfe\xff")


def _running(values: Column, better) -> Column:
    """Best of each value and those before it, by doubling: O(n log n)."""
    return let(values, lambda v: F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(v) + 1)).cast("int")), v, lambda a, j: F.transform(
        a, lambda x, i: better(x, F.coalesce(F.get(a, i - F.pow(F.lit(2), j).cast("int")), x)))))


def spans(cands: Column, weights: dict[str, float]) -> Column:
    """Base spans and the accepted others that no base span of their kind
    touches, by start, then kind: ``start, order, end, kind, base``."""

    def plain(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["order"].alias("order"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))

    def struct(c: Column) -> Column:
        return F.struct(*[c[f].alias(f) for f in ("order", "start", "end", "kind", "base")])

    def alone(a: Column, others) -> Column:
        """Per span, whether no span of its kind that ``others`` holds for overlaps it."""
        ends = _running(F.transform(a, lambda x: x["order"] * _FAR + F.when(others(x), x["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(_running(F.reverse(F.transform(a, lambda x: x["order"] * _FAR + F.when(others(x), x["start"]).otherwise(_FAR - 1))), F.least))
        return F.arrays_zip(ends.alias("ends"), starts.alias("starts"))

    def clear(a: Column) -> Column:  # no base span of its kind touches it
        return let(alone(a, lambda x: x["base"]), lambda at: F.filter(a, lambda x, i: x["base"] | ~(
            (F.get(at, i)["ends"] > x["order"] * _FAR + x["start"]) | (F.get(at, i)["starts"] < x["order"] * _FAR + x["end"]))))

    def free(m: Column) -> Column:  # of touching accepted spans of a kind the longest stays, then the first
        def touching(at: Column, x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(at, i - 1)["ends"], F.lit(0)) > x["order"] * _FAR + x["start"]
            return before | (F.coalesce(F.get(at, i + 1)["starts"], F.lit(_FAR << 20)) < x["order"] * _FAR + x["end"])

        def beaten(c: Column, o: Column) -> Column:
            size, other = c["end"] - c["start"], o["end"] - o["start"]
            return (o["kind"] == c["kind"]) & (o["start"] < c["end"]) & (c["start"] < o["end"]) & (
                (other > size) | ((other == size) & (o["start"] < c["start"])))

        return let(alone(m, lambda x: F.lit(True)), lambda at: let(F.filter(m, lambda x, i: touching(at, x, i)), lambda few: F.filter(
            m, lambda x, i: ~touching(at, x, i) | ~F.exists(few, lambda o: beaten(x, o)))))

    def of(all_: Column) -> Column:
        picked = F.filter(all_, lambda c: c["base"] | ((_vote(c["votes"], CHECK) == "1") & (_score(c, weights) > 0)))
        ordered = let(F.sort_array(F.transform(picked, struct)), lambda a: F.filter(
            a, lambda x, i: ~F.coalesce(x == F.get(a, i - 1), F.lit(False))))
        kept = let(let(ordered, clear), lambda a: F.concat(F.filter(a, lambda x: x["base"]), let(F.filter(a, lambda x: ~x["base"]), free)))
        return F.sort_array(F.transform(kept, plain))

    return F.when(F.size(cands) > 0, let(cands, of)).otherwise(F.array().cast(SPANS))


def _listing(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added,
    span_list``: counts and hash of base spans, and all spans as text and as a
    list."""
    ensure_checkpoint_dir(docs.sparkSession)
    src = pick(docs, doc_id=id_col, text=text_col)
    found = src.select("doc_id", candidates(F.col("text")).alias("cands")).checkpoint()
    weights = train(found)
    all_ = found.select("doc_id", spans(F.col("cands"), weights).alias("span_list"))
    base = F.filter("span_list", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("span_list", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return all_.select("doc_id", *counts, F.sha2(_listing(base), 256).alias("base_sha256"), _listing(F.col("span_list")).alias("spans"),
                       (F.size("span_list") - F.size(base)).cast("long").alias("n_added"), "span_list")


def redacted(text: Column, found: Column) -> Column:
    """The text with each run of touching spans replaced by ``[KIND]`` of its
    first span."""

    def of(ends: Column) -> Column:
        heads = F.filter(F.transform(found, lambda s, i: F.struct(
            s["start"].alias("start"), F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("before"), s["kind"].alias("kind"))), lambda h: h["start"] >= h["before"])
        # four bytes a character, so that a piece costs its own length only
        return let(F.encode(text, "UTF-32"), lambda b: F.concat(
            F.array_join(F.transform(heads, lambda h: F.concat(_piece(b, h["before"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]"))), ""),
            _piece(b, F.get(ends, F.size(ends) - 1), F.length(b) / 4)))

    def _piece(b: Column, start: Column, end: Column) -> Column:  # behind a mark, so that one in the text is kept
        size = (4 * (end - start)).cast("int")
        return F.when(size > 0, F.decode(F.concat(F.lit(_BOM), F.substring(b, 4 * start + 1, size)), "UTF-32")).otherwise("")

    return F.when(F.size(found) > 0, let(_running(F.transform(found, lambda s: s["end"]), F.greatest), of)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the spans of ``text_col`` replaced; ``chars_col``, if there
    is such a column, becomes the new number of code points of changed texts.
    Rows are written beside their candidates once; training reads the candidates
    only."""
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    text = f"_c{names.index(text_col)}"
    found = written(flat.withColumn("_cands", candidates(F.col(text))), "personal-data")
    weights = train(found.select(F.col("_cands").alias("cands")))
    out = found.withColumn("_spans", spans(F.col("_cands"), weights)).drop("_cands")
    if chars_col in names:
        chars = f"_c{names.index(chars_col)}"
        kind = out.schema[chars].dataType
        out = out.withColumn(chars, F.when(F.size("_spans") > 0, F.length(redacted(F.col(text), F.col("_spans"))).cast(kind)).otherwise(F.col(chars)))
    return out.withColumn(text, redacted(F.col(text), F.col("_spans"))).drop("_spans").toDF(*names)
