"""Spelling variants by permuterm rotations.

Every rotation of a word and a terminator stands for the word with one place turned to its end. Words that differ by one
character there share all of the rotation but its last character, and a word without that character is a rotation that
equals the rest. So the rotations, sorted by prefix, hold each word's neighbours in one run; a run has at most one
member for each character of the alphabet, plus the shorter word. A run's members get what the run says about their
neighbours - how many, and which of them is the most frequent - without any pairs being written. Forms are followed
by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, query, table

END = "$"
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shortest word, least number of occurrences, and how many times as frequent a form must be.
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a character.
NOISE = 97


def noisy_words(docs: DataFrame, least: int = LEAST_LENGTH, noise: int = NOISE) -> DataFrame:
    """(word, n): the words of all texts with their occurrences, after one of ``noise`` runs lost a character.

    Which, and where, follows from the crc32 of document and run. A null text has no words; a null id counts as empty.
    """
    run = F.col("run")
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        # A run shorter than ``least`` cannot become a word; the pattern starts at the run's first letter in any case.
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"),
    )
    small = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    hashed = runs.select("doc_id", small.alias("run")).withColumn(
        "h", F.crc32(F.concat("doc_id", F.lit(":"), run).cast("binary"))
    )
    at = (F.col("h") % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(run)
    return hashed.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, last, n): each rotation as it is (last is empty), and without its last character, which ``last`` holds.

    The terminator is never an edited character, so a rotation that ends in it is only written whole.
    """
    k = F.length("word")
    twice = F.concat("word", F.lit(END), "word", F.lit(END))
    turned = words.select("n", F.explode(F.transform(F.sequence(F.lit(0), k), lambda i: F.substring(twice, i + 1, k + 1))).alias("r"))
    last = F.substring("r", -1, 1)
    whole = F.struct(F.col("r").alias("prefix"), F.lit("").alias("last"))
    open_ = F.struct(F.expr("substring(r, 1, length(r) - 1)").alias("prefix"), last.alias("last"))
    both = F.when(last == END, F.array(whole)).otherwise(F.array(whole, open_))
    return turned.select("n", F.explode(both).alias("x")).select("x.prefix", "x.last", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best) for the words that have a neighbour; best is (minus its n, word), the smallest such pair.

    A word that loses either of two equal characters in a row gives the same word, so only the first of such characters
    counts for the shorter word.
    """
    rotated = F.concat("prefix", "last")
    word = F.concat(F.substring_index(rotated, END, -1), F.substring_index(rotated, END, 1))
    whole = F.col("last") == ""
    # The character before the edited one: the word's text after the terminator, or nothing at the word's start.
    before = F.substring(F.substring_index("prefix", END, -1), -1, 1)
    rows = rotations(words).repartitionByRange("prefix").select(
        "prefix", F.struct((-F.col("n")).alias("n"), word.alias("word"), whole.alias("whole"), (before != F.col("last")).alias("first")).alias("x"),
    )
    runs = rows.groupBy("prefix").agg(F.sort_array(F.collect_list("x")).alias("run")).where(F.size("run") > 1)
    longer = F.size(F.filter("run", lambda x: ~x.whole))
    firsts = F.size(F.filter("run", lambda x: ~x.whole & x["first"]))
    runs = runs.select("run", longer.alias("longer"), firsts.alias("firsts"), (longer < F.size("run")).cast("int").alias("whole"))
    own = F.col("x.word")
    member = runs.select("*", F.explode("run").alias("x"))
    near = F.when(F.col("x.whole"), F.col("firsts")).otherwise(F.col("longer") - 1 + F.col("whole") * F.col("x.first").cast("int"))
    other = F.when(F.get("run", F.lit(0)).word == own, F.get("run", F.lit(1))).otherwise(F.get("run", F.lit(0)))
    member = member.select(own.alias("word"), near.cast("long").alias("near"), F.struct(other.n.alias("n"), other.word.alias("word")).alias("best"))
    return member.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for each row of ``forms(word, form)``: the last form of its chain; each round doubles the reach."""
    at = scratch.write(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.write(at.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        ))
        scratch.drop(at)
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at
        scratch.paths[id(at)] = (at, scratch.paths.pop(id(step))[1])


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words(word, n)``, whose words are distinct.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest
    n, ties to the smallest, if that n is at least ``ratio`` times the word's own; its root is the end of the chain of
    forms, or the word itself. Words must not hold the terminator ``$``; rows with a null word or n take no part. An
    empty table gives no rows.
    """
    scratch = Scratch(words.sparkSession, "variants")
    words = scratch.write(words.where("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    near = words.join(neighbours(words), "word", "left")
    best_n = -F.col("best.n")
    has = best_n >= ratio * F.col("n")
    known = scratch.write(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("best.word")).alias("form"), F.when(has, best_n).alias("form_n"),
    ))
    ends = roots(known.where("form IS NOT NULL").select("word", "form"), scratch)
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


SQL = r"""
WITH RECURSIVE crc(k, c) AS (
  SELECT k, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k)
  FROM (SELECT unnest(range(0, 256))::BIGINT AS k)
), crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY k) AS t FROM crc
), runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
           translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(
    flatten(list_transform(string_split(doc_id || ':' || run, ''),
            lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM runs, crc_table
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
    FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS MATERIALIZED (
  SELECT x.word, y.word AS near, y.n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.a || c.b
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(n := -n, near := near)) AS best FROM pairs GROUP BY word
), known AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN -best.n >= 2 * words.n THEN best.near END AS form, CASE WHEN -best.n >= 2 * words.n THEN -best.n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS reached, 0 AS depth FROM known
  UNION ALL SELECT chain.word, known.form, depth + 1 FROM chain JOIN known ON known.word = chain.reached WHERE known.form IS NOT NULL
)
SELECT known.word, form, max_by(reached, depth) AS root, known.n, n_near, form_n::BIGINT AS form_n
FROM known JOIN chain USING (word) GROUP BY ALL
"""


@query("op12_variants", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = noisy_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return variants(words.where(F.col("n") >= LEAST_COUNT))
