"""Quality rules with thresholds from quantile sketches per language and source, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.llm.tables import BREAK_PATTERN, stored

_BLANKS = " \t\n\x0b\f\r"
#: Measures under an adaptive rule: what is counted, per what, and the constant of the square-root scale.
#: On that scale (Anscombe's) a measure spreads by chance alone as its size allows, also where most counts
#: are 0. A repeated window marks six words at least, so repeats count in sixes.
RATES = {"symbols": ("n_symbols", "n_words", 0.375), "dup_lines": ("n_dup_lines", "n_lines", 0.375), "repeats": ("n_repeat_words", "n_words", 2.25), "capitals": ("n_capitals", "word_chars", 0.375)}
RULES = ("mean_word", *RATES)
#: A threshold lies so many quartile distances beyond the quartile.
REACH = 5.0
#: Accuracy of the quantile sketches.
ACCURACY = 2_000
#: A group's own limit weighs as its documents, its language's limit as so many.
PRIOR_DOCS = 30
#: Relative room for rounding at a limit.
ROOM = 1e-9
LEAST_WORDS = 50
MOST_REPEATS_PERCENT = 50


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of every whole text in a struct ``m``; the columns of ``docs`` are in a struct ``doc``.

    All counts are array and string functions inside one row: repeated three-word windows are found by
    sorting window hashes next to each other, in n log n steps for a text of n words.
    """
    text = F.coalesce(F.col(f"doc.`{text_col}`").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK_PATTERN))
    with_word = lambda line: F.btrim(line, F.lit(_BLANKS)) != ""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", text.alias("text"), words.alias("words"), F.filter(F.split(text, "\n"), with_word).alias("lines"))
    rows = rows.select(
        "doc",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get("hashes", i)
    rows = rows.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).drop("hashes")
    paired = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeated = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.withColumn("sorted", F.when(repeated, F.sort_array(paired))).drop("windows")
    beside = lambda k: F.get("sorted", k)["h"]
    same = lambda s, k: F.coalesce(s["h"] == beside(k - 1), F.lit(False)) | F.coalesce(s["h"] == beside(k + 1), F.lit(False))
    rows = rows.withColumn("marked", F.sort_array(F.transform(F.filter("sorted", same), lambda s: s["i"]))).drop("sorted")
    # Each marked window covers three words, up to where the next marked one begins.
    covered = F.aggregate(
        F.transform("marked", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("marked", k + 1) - s, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS_PERCENT * F.col("n_words"))
    scaled = lambda c, n, add: F.sqrt((F.col(c) + F.lit(add)) / F.greatest(F.col(n), F.lit(1).cast("bigint")))
    return rows.select(
        "doc",
        F.struct(
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            failed.alias("base_failed"),
            F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(0.0)).alias("mean_word"),
            *[scaled(*rate).alias(rule) for rule, rate in RATES.items()],
        ).alias("m"),
    )


def _limits(prefix: str) -> list[Column]:
    """Aggregates: the number of documents, and the sketch's quartiles of each measure turned into an upper limit."""
    out = [F.count("*").alias(f"{prefix}n")]
    for rule in RULES:
        q = F.percentile_approx(f"m.{rule}", [0.25, 0.75], ACCURACY)
        out.append((q[1] + REACH * (q[1] - q[0])).alias(f"{prefix}{rule}"))
    return out


def _towards(own: Column, n: Column, wider: Column) -> Column:
    """A limit drawn towards that of the wider group, the less the more documents it comes from."""
    return (n * own + PRIOR_DOCS * wider) / (n + PRIOR_DOCS)


def limits(rows: DataFrame) -> DataFrame:
    """``l, s, most_<rule>``: the limits of each language and source of ``rows(lang, source, m)``.

    Each level has sketches of its own, which merge: source, language and all documents. A small source
    leans on its language and a small language on all, by weights that grow with their documents.
    """
    sound = rows.where(~F.col("m.base_failed"))
    groups = sound.groupBy("lang", "source").agg(*_limits("g_"))
    langs = sound.groupBy(F.col("lang").alias("of")).agg(*_limits("l_"))
    pooled = sound.agg(*_limits("all_"))
    wide = groups.join(langs, F.col("lang").eqNullSafe(F.col("of"))).crossJoin(F.broadcast(pooled))  # one row
    most = [_towards(F.col(f"g_{r}"), F.col("g_n"), _towards(F.col(f"l_{r}"), F.col("l_n"), F.col(f"all_{r}"))).alias(f"most_{r}") for r in RULES]
    return wide.select(F.col("lang").alias("l"), F.col("source").alias("s"), *most)


def judge(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc`` (the row), ``m`` (its counts and measures) and ``kept``.

    A document goes if it fails the base rules, or if one of its measures lies beyond the limit of its
    language and source: the upper quartile there plus ``REACH`` quartile distances. Quartiles come from
    quantile sketches over all documents that pass the base rules; sketches merge, so a dominant source is
    combined before the shuffle. No limit has a floor: the group's distribution sets it, see :func:`limits`.
    Null languages and sources are groups of their own.

    Null and empty texts have no words and fail. Repeated rows are judged one by one, ties with a limit
    stay. An empty table gives none. Extra columns are kept inside ``doc``, so their names cannot clash.
    """
    rows = stored(measured(docs, text_col), "measured")
    rows = rows.select("doc", "m", F.col(f"doc.`{lang_col}`").cast("string").alias("lang"), F.col(f"doc.`{source_col}`").cast("string").alias("source"))
    joined = rows.join(limits(rows), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    within = F.lit(True)
    for rule in RULES:
        within = within & F.coalesce(F.col(f"m.{rule}") <= F.col(f"most_{rule}") * (1 + ROOM), F.lit(True))
    return joined.select("doc", "m", (~F.col("m.base_failed") & within).alias("kept"))


def keep_documents(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    kept = judge(docs, **columns).where("kept")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


_SQL_LIMITS = "count(*) AS n, " + ", ".join(f"quantile_disc({r}, 0.75) + {REACH}::DOUBLE * (quantile_disc({r}, 0.75) - quantile_disc({r}, 0.25)) AS {r}" for r in RULES)
QUALITY_SQL = rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
counts AS (
  SELECT doc_id, lang, source, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM base
),
windows AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM counts WHERE n_words >= 3)
),
marked AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1
),
covered AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n FROM marked GROUP BY doc_id),
m AS (
  SELECT counts.*, coalesce(n, 0) AS n_repeat_words, n_words < {LEAST_WORDS} OR 100 * coalesce(n, 0) > {MOST_REPEATS_PERCENT} * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word,
    {", ".join(f"sqrt((coalesce({'n' if c == 'n_repeat_words' else c}, 0) + {add}::DOUBLE) / greatest({per}, 1)) AS {r}" for r, (c, per, add) in RATES.items())}
  FROM counts LEFT JOIN covered USING (doc_id)
),
all_ AS (SELECT {_SQL_LIMITS} FROM m WHERE NOT base_failed),
lang_ AS (SELECT lang, {_SQL_LIMITS} FROM m WHERE NOT base_failed GROUP BY lang),
group_ AS (SELECT lang, source, {_SQL_LIMITS} FROM m WHERE NOT base_failed GROUP BY lang, source),
most AS (
  SELECT g.lang, g.source, {", ".join(f"(g.n * g.{r} + {PRIOR_DOCS} * ((l.n * l.{r} + {PRIOR_DOCS} * a.{r}) / (l.n + {PRIOR_DOCS}))) / (g.n + {PRIOR_DOCS}) AS {r}" for r in RULES)}
  FROM group_ g JOIN lang_ l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN all_ a
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"coalesce(m.{r} <= most.{r} * (1 + {ROOM}::DOUBLE), true)" for r in RULES)} AS kept
FROM m LEFT JOIN most ON m.lang IS NOT DISTINCT FROM most.lang AND m.source IS NOT DISTINCT FROM most.source
"""
