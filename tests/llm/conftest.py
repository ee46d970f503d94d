import pytest

#: Names that operators use themselves or that differ from real ones in case only.
CLASH = "fp long, _c0 string, TEXT2 string, Doc_ID string, n_words int, cands int, part int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    texts = [None, "", " \t\n", "word", "two words", "same text here today", "same text here today",
             "x" * 60_000, "long word " * 20_000, "\U0001F600 joe@example.com \U0001F600 Apache License", "1 " * 3000,
             "line\nline\n\nline", "Ünïcödé ñandú straße 日本語 текст"]
    rows = [(i if i != 4 else None, t, ("en", "fr", None)[i % 3], ("a", "b", None, "c")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], rows[4]]
    rows = [r + (7, "c", "T", "D", 1, 2, 3) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
