"""Patterns compiled to Java's syntax find what Python's ``re`` finds."""

import random
import re
import warnings

import pytest
from pyspark.sql import functions as F

from tally.functions.patterns import java_pattern
from tally.operators.filters import ReportFilter, check_java_pattern

TEXTS = ["", "a", "café", "CAFÉ bar", "Müller", "MÜLLER & Söhne", "٣", "x٣y", "a\rb", "a\nb", "shop\r", "shop\n", "shop\n\n", "\nshop", "&", "a&&b",
         "straße", "STRASSE", "ſtop", "Kelvin K", "İstanbul", "ıstanbul", "ΣΊΣΥΦΟΣ σίσυφος", "naïve-naïve", "日本 語", "\u2028x\u2029", "a\x1cb", "\x85z",
         "e\u0301t", "😀 ok", "b[c]", "^caret", "$5.00", "xxyyy", "aba", "abab", "aa bb", "a_1-b", "µ Μ μ", "ǆ ǅ Ǆ", "foo\tbar", "1 2", "ÅÅ Å", "ﬁn ſt ﬅ"]

PATTERNS = [r"caf\w$", r"^\w+$", r"\d", r"a.b", r"shop$", r"[a&&b]", r"(?P<my_x>a)(?P=my_x)?b", r"x{,2}y", r"[[]c", r"\bm\w+\b", r"\B", r"^$", r"\Ashop\Z",
            r"(?s)a.b", r"(?m)^shop$", r"(?m)b$", r"(?a)\w+é", r"(?a:\d)|٢", r"s", r"k", r"[j-l]", r"[^a-z ]", r"\W", r"[\W\d]", r"[^\W\d_]+", r"\s", r"[^\s]",
            r"(a)(b)?(?(2)c|a)", r"(?:(x)|y)(?(1)x|y)", r"(\w)\1", r"(\w+)-\1", r"(?<=ü)l", r"(?<!a)b", r"a(?=\W|$)", r"a++b", r"(?>a|ab)c|aba", r"\$5\.00",
            r"é|É|e\u0301", r"(?-i:É)", r"(?x) caf \w # comment", r"[\]^-]", r"\x41", r"\u00e9", r"İ", r"ı", r"σ", r"ß", r"\t", r"(?!)", r"a{2}", r"a{1,2}?b", r"", r"|x", r"\01|a1",
            r"(a)\1", r"[a-zà-ÿ]+ [&]", r"(?i:STRASSE)", r"[À-Ý]", r"ﬅ", r"µ", r"ǅ", r"[\d\s]+$", r"(?u)\w{4}", r"\N{LATIN SMALL LETTER E WITH ACUTE}"]


def _finder(spark, pattern):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        compiled = spark._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    return lambda text: compiled.matcher(text).find()


def _search(pattern, text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return re.search(pattern, text, re.IGNORECASE) is not None


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_texts_are_found(spark, pattern):
    find = _finder(spark, pattern)
    assert [t for t in TEXTS if find(t)] == [t for t in TEXTS if _search(pattern, t)]


def _random_pattern(rng, depth=0):
    atoms = [*"abkséÉßσ٣ &-", r"\w", r"\W", r"\d", r"\s", r"\S", ".", "^", "$", r"\b", r"\B", "[a-z]", "[^a-z]", "[À-Ý]", r"[\w&&-]", r"[^\W_]", "[k-sé]", r"\n", r"\r"]
    out = ""
    for _ in range(rng.randint(1, 4)):
        part = rng.choice(atoms)
        if depth < 2 and rng.random() < 0.35:
            part = rng.choice(["({})", "(?:{})", "(?={})", "(?!{})", "(?i:{})", "(?-i:{})", "(?a:{})", "(?s:{})", "(?m:{})", "(?>{})"]).format(_random_pattern(rng, depth + 1))
        if part not in ("^", "$", r"\b", r"\B") and not part.startswith(("(?=", "(?!")) and rng.random() < 0.3:
            part += rng.choice(["*", "+", "?", "{2}", "{,2}", "{1,3}", "*?", "+?", "?+"])
        out += part
    return out + (f"|{_random_pattern(rng, depth + 1)}" if depth < 2 and rng.random() < 0.2 else "")


def test_random_patterns(spark):
    rng = random.Random(7)
    letters = "aAbkKsSſéÉßẞσΣς٣1_ &-\n\r\t日ıİiI\u2028\x1c😀"
    found = tried = 0
    while tried < 400:
        pattern = _random_pattern(rng)
        try:
            re.compile(pattern, re.IGNORECASE)
        except re.error:
            continue
        find = _finder(spark, pattern)
        for _ in range(12):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))
            want = _search(pattern, text)
            assert find(text) == want, (pattern, text)
            found += want
        tried += 1
    assert 500 < found < 4500


def test_every_assigned_letter_class(spark):
    """Word, digit and space characters and case pairs of the first plane, where the JVM knows the character."""
    known = spark._jvm.java.lang.Character
    for pattern in (r"^\w$", r"^\d$", r"^\s$", r"^[à-þα-ω]$", r"^[^k-s]$"):
        find = _finder(spark, pattern)
        for c in [*range(0, 0x250), *range(0x370, 0x600, 3), 0x1E9E, 0x212A, 0x2126, *range(0x2150, 0x2190, 5), 0x3007, 0xFF21, *range(0x2000, 0x2030)]:
            assert find(chr(c)) == _search(pattern, chr(c)) or not known.isDefined(c), (pattern, hex(c))


def test_filters_on_names_with_accents(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "id int, merchant string")
    for patterns in ([r"caf\w$", r"^m.ller"], [r"(?P<a_b>a)(?P=a_b)", r"\d"], [r"[[]c"]):
        joined = "|".join(patterns)
        kept = {r["id"] for r in ReportFilter(merchants=patterns).apply(df).collect()}
        assert kept == {i for i, t in enumerate(TEXTS) if _search(joined, t)}
        left = {r["id"] for r in ReportFilter(exclude_merchants=patterns).apply(df).collect()}
        assert left == {i for i in range(len(TEXTS)) if i not in kept} | {99}
    assert df.where(F.col("merchant").rlike(java_pattern("müller"))).count() == 2


def test_bad_patterns_fail_before_a_job(spark):
    for bad in ("(", "[a", "*a", r"(?P<a>x)(?P<a>y)", r"(?<=a+)b", r"(a)(?<=\1)b"):
        with pytest.raises(ValueError):
            ReportFilter(description_contains=bad)
    with pytest.raises(ValueError):  # flags in the middle of a joined list
        ReportFilter(merchants=["a", "(?s)b"])
    check_java_pattern(spark, r"(?P<my_x>a)")
