"""Quality rules: a threshold table compiled into one projection.

Every metric is a Spark expression over the whole text and every rule is a row
``(name, metric, low, high)`` of a table; the table becomes a single ``select``
of native expressions, with no user function and no shuffle. A document is kept
when the base rules and all table rules hold.

Defined cases: null text has no words; an empty or blank text fails the base
rules; ratios of an empty denominator are 0; repeated rows give repeated rows;
an empty table gives an empty result; columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import SPACE_CHARS, SPACE_RUN, let, read

SYMBOLS = "#*$%&|<>"
#: The most frequent function words of the corpus languages (en, de, fr, es).
STOP_WORDS = (
    "the a and of to in is that it for was on with as be by at this are or an from "
    "der die das und den dem ein eine ist zu von mit im für auf nicht sich des "
    "le la les de et un une des du en est que pour dans sur au pas ou qui avec "
    "el los las y se del al lo con una su no es por"
).split()


#: Punctuation and marks that may follow a stop word.
TRAILING = ".,;:!?" + SYMBOLS


class Rule(NamedTuple):
    name: str
    metric: str
    low: float | None
    high: float | None


#: Production thresholds. They reject what is clearly no prose and leave short,
#: odd or foreign prose alone.
RULES = (
    Rule("enough_words", "n_words", 10, None),
    Rule("word_length", "mean_word_chars", 1.5, 20),
    Rule("symbols_per_word", "symbol_ratio", None, 0.35),
    Rule("stop_words", "stop_ratio", 0.005, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5),
)


def _repeated_words(words: Column) -> Column:
    """Words covered by five-word windows that occur at least twice, all occurrences included."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.concat_ws(" ", F.slice(words, i, 5)))

    def covered(w: Column) -> Column:
        def marked(s: Column) -> Column:
            n = F.size(s)
            again = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["w"] == x["w"])) | ((i < n - 1) & (F.get(s, i + 1)["w"] == x["w"])),
            )
            places = F.sort_array(F.transform(again, lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-5).alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).cast("bigint").alias("n"), p.alias("last"))
            return F.aggregate(places, zero, step, lambda a: a["n"])

        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(ordered, marked))

    return F.when(F.size(words) < 6, F.lit(0).cast("bigint")).otherwise(let(windows, covered))


def quality_metrics(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        F.filter(F.split(text, SPACE_RUN), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0).alias("lines"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    counted = base.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(TRAILING))).isin(STOP_WORDS))).cast("bigint").alias("n_stops"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike(r"^[-*•]"))).cast("bigint").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("bigint").alias("n_ellipsis_lines"),
    )
    return counted.select(
        "*",
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_stops", "n_words").alias("stop_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        per("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the metric columns."""
    holds = F.lit(True)
    for r in rules:
        if r.low is not None:
            holds = holds & (F.col(r.metric) >= F.lit(r.low))
        if r.high is not None:
            holds = holds & (F.col(r.metric) <= F.lit(r.high))
    return holds


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a document breaks, in table order."""
    return F.array_compact(F.array(*[F.when(~compiled((r,)), F.lit(r.name)) for r in rules]))


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics, ``base_failed``, ``kept`` and the names of broken rules, one row per input row."""
    return quality_metrics(docs).select(
        "*",
        base_failed().alias("base_failed"),
        (~base_failed() & compiled(rules)).alias("kept"),
        failed_rules(rules).alias("failed_rules"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    words = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    checks = []
    for r in RULES:
        if r.low is not None:
            checks.append(f"{r.metric} >= {r.low}")
        if r.high is not None:
            checks.append(f"{r.metric} <= {r.high}")
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
win AS (
  SELECT rid, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
keyed AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS k FROM win),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM keyed) WHERE n > 1),
cover AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM again) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(cover.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(rtrim(x, '{TRAILING}')) IN ({words}))) AS n_stops,
         len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullets,
         len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipses
  FROM w LEFT JOIN cover ON cover.rid = w.rid),
r AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
         coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
         coalesce(n_stops / nullif(n_words, 0), 0) AS stop_ratio,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
         coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_line_ratio,
         coalesce(n_ellipses / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(checks)} AS kept
FROM r
"""


OP3_SQL = _sql()
