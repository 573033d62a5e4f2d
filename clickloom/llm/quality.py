"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The counts that the rules read come from one pass over each text. The rules after them form one CASE expression, so a
document that a rule rejects costs nothing in the later ones. Their order comes from a sample: the share of documents
that a rule rejects per second it takes there. The verdict is the same in every order.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import WORD, Scratch, query, table

#: About so many documents are looked at to order the rules.
SAMPLE_ROWS = 2000
SYMBOLS = "[#*$%&|<>]"

# Positions covered by three-word windows that occur twice or more: hash the windows, sort them with their positions
# (only if some hash repeats), keep those equal to a neighbour, and add up the words each adds to the ones before.
# transform(array(x), v -> ...)[0] binds x to a name, so that it is computed once.
_REPEATED = """
transform(array({words}), w -> CASE WHEN size(w) < 3 THEN 0 ELSE
  transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
    CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE
      transform(array(array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), t ->
        aggregate(
          array_sort(transform(
            filter(t, (x, i) -> x.h <=> get(t, i - 1).h OR x.h <=> get(t, i + 1).h), x -> x.i)),
          named_struct('last', -3, 'n', 0),
          (s, p) -> named_struct('last', p, 'n', s.n + least(3, p - s.last)),
          s -> s.n))[0]
    END)[0]
  END)[0]
"""


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document to reject; a null counts as passing."""

    name: str
    fails: Column


def measures(docs: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    A null text counts as empty. n_lines are the lines that hold a word.
    """
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    docs = docs.withColumn("_words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    docs = docs.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    return docs.select(
        *[c for c in docs.columns if c not in ("_words", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED.format(words="_words")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Junk that no clean text of any language comes near: symbols, capitals, shouting, repeated lines, endless words."""
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 8 * F.col("word_chars")),
        Rule("repeated lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("capitals", 100 * F.regexp_count("text", F.lit("[A-Z]")) > 30 * F.col("word_chars")),
        Rule("shouting", 2 * F.regexp_count("text", F.lit("!")) > F.col("n_words")),
        Rule("long words", F.col("word_chars") > 20 * F.col("n_words")),
    ]


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of about ``sample_rows`` documents, which alone are measured here."""
    scratch = Scratch(docs.sparkSession, "quality")
    share = min(1.0, sample_rows / max(1, docs.select(F.lit(1)).count()))
    sample = scratch.write(measures(docs.sample(share, seed=11)))
    score = {}
    for rule in rules:
        started = time.perf_counter()
        rejected = sample.agg(F.count(F.when(rule.fails, 1))).first()[0]
        score[rule.name] = rejected / (time.perf_counter() - started)
    scratch.drop(sample)
    return sorted(rules, key=lambda r: -score[r.name])


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects the row, in the given order; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails, F.lit(rule.name)).otherwise(out)
    return out


def quality_filter(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with their measures, base_failed and kept. Empty table: no rows; repeated rows are judged each."""
    rules = default_rules() if rules is None else list(rules)
    plain = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    ordered = order_rules(plain, rules, sample_rows)
    out = measures(plain).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & cascade(ordered).isNull())


SQL = r"""
WITH t AS (
  SELECT doc_id, text, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), m AS (
  SELECT doc_id, coalesce(text, '') AS text, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN covered USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 8 * word_chars OR 2 * n_dup_lines > n_lines
            OR 100 * len(regexp_extract_all(text, '[A-Z]')) > 30 * word_chars
            OR 2 * len(regexp_extract_all(text, '!')) > n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""


@query("op4_quality", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
