"""The quality rules and outlier estimates as one SQL statement, for DuckDB.

Written from the definitions: counts by unnesting words and windows, the
concentration steps as a chain of grouped subqueries."""

from __future__ import annotations

from tally.llm import quality_outliers as m

WORD, BLANK = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"

COUNTS = rf"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS g_lang,
             coalesce(source, '') AS g_source FROM documents),
tok AS (SELECT *, regexp_extract_all(text, '{WORD}+') AS w,
               [x for x in string_split(text, chr(10)) if regexp_matches(x, '{WORD}')] AS lines FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM tok WHERE len(w) >= 3) u),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) s WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) s GROUP BY rid),
f AS (SELECT doc_id, g_lang, g_source, len(w) AS n_words, length(regexp_replace(text, '{BLANK}', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^{m.SYMBOLS}]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines
      FROM tok LEFT JOIN covered USING (rid)),
st AS (SELECT *, n_words < {m.MIN_WORDS} OR 100 * n_repeat_words > {m.REPEAT_PERCENT} * n_words AS base_failed,
              CAST(word_chars + {m.PRIOR_WORDS * m.PRIOR_LENGTH} AS DOUBLE) / (n_words + {m.PRIOR_WORDS}) AS x0,
              CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) AS x1, CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS x2,
              CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1) AS x3 FROM f),
sizes AS (SELECT g_lang, g_source, count(*) FILTER (WHERE NOT base_failed) AS n FROM st GROUP BY ALL),
pool AS (SELECT g_lang, sum(n) AS n FROM sizes WHERE n < {m.MIN_GROUP} GROUP BY g_lang),
keyed AS (SELECT sizes.g_lang, sizes.g_source, CASE WHEN sizes.n >= {m.MIN_GROUP} THEN 's' || sizes.g_lang || '|' || sizes.g_source
                 WHEN pool.n >= {m.MIN_GROUP} THEN 'l' || sizes.g_lang ELSE '' END AS g_key FROM sizes LEFT JOIN pool USING (g_lang)),
clean AS (SELECT g_key, x0, x1, x2, x3 FROM st JOIN keyed USING (g_lang, g_source) WHERE NOT base_failed)"""

_N = range(len(m.STATS))
_PAIRS = [(i, j) for i in _N for j in range(i + 1)]
_FLOORS = list(m.STATS.values())
_SUMS = ", ".join(["count(*) AS n", *[f"sum(x{i}) AS s{i}" for i in _N], *[f"sum(x{i} * x{j}) AS q{i}{j}" for i, j in _PAIRS]])
_MODEL = ", ".join([*[f"m{i}" for i in _N], *[f"l{i}{j}" for i, j in _PAIRS], "det"])


def _moments(scale: float) -> str:
    return ", ".join([*[f"round(s{i} / n, 12) AS m{i}" for i in _N],
                      *[f"round((q{i}{j} / n - m{i} * m{j}) * {scale!r}, 12) AS c{i}{j}" for i, j in _PAIRS]])


def _factor() -> str:
    out = []
    for i, j in _PAIRS:
        rest = f"c{i}{j}" + (f" + {_FLOORS[i] ** 2!r}" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out.append(f"sqrt(greatest({rest}, {_FLOORS[i] ** 2 * 1e-6!r})) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return ", ".join([*out, " * ".join(f"l{i}{i}" for i in _N) + " AS det"])


def _distance() -> str:
    solved = [f"(x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i} AS y{i}" for i in _N]
    return ", ".join([*solved, " + ".join(f"y{i} * y{i}" for i in _N) + " AS far"])


def statement() -> str:
    parts = [COUNTS, f"""
wide AS (SELECT *, {_factor()} FROM (SELECT g_key, {_moments(1.0)} FROM (SELECT g_key, {_SUMS} FROM clean GROUP BY g_key) a) b),
model0 AS (SELECT g_key, 0 AS start, {_MODEL} FROM wide UNION ALL
  SELECT g_key, 1, {", ".join(f"m{i}" for i in _N)}, {", ".join(repr(10 * _FLOORS[i]) if i == j else "0.0" for i, j in _PAIRS)}, det FROM wide)"""]
    for step in range(m.STEPS):
        parts.append(f"""
bins{step} AS (SELECT g_key, start, floor(16 * log2(far + 1e-4)) AS bin, {_SUMS}
  FROM (SELECT *, {_distance()} FROM clean JOIN model{step} USING (g_key)) a GROUP BY ALL),
core{step} AS (SELECT * FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY g_key, start ORDER BY bin
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearer, sum(n) OVER (PARTITION BY g_key, start) AS every FROM bins{step}) a
  WHERE nearer < {m.CORE} * every),
model{step + 1} AS (SELECT g_key, start, {_MODEL} FROM (SELECT *, {_factor()} FROM (SELECT g_key, start, {_moments(m.CONSISTENCY)}
  FROM (SELECT g_key, start, {", ".join(f"sum({c}) AS {c}" for c in ["n", *[f"s{i}" for i in _N], *[f"q{i}{j}" for i, j in _PAIRS]])}
        FROM core{step} GROUP BY ALL) a) b) c)""")
    parts.append(f"""
best AS (SELECT * FROM model{m.STEPS} QUALIFY row_number() OVER (PARTITION BY g_key ORDER BY det, start) = 1)""")
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN FALSE ELSE coalesce(far, 0) <= {m.CUTOFF!r} END AS kept
FROM (SELECT st.*, {_distance()} FROM st JOIN keyed USING (g_lang, g_source) LEFT JOIN best USING (g_key)) a"""
