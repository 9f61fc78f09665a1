"""Line-first quality rules.

Every line is judged by itself; lines that fail a rule are removed, and a document that
loses more than ``MAX_LOSS`` of its word characters is rejected. The rules of a line with
w words:
  symbols      3 or more of ``#*$%&|<>`` for every 10 words
  shouting     half the words or more end in ``!!``
  navigation   up to 25 words with 2 or more of the separators ``SEPARATORS``
  boilerplate  up to 25 words with one of the phrases ``BOILERPLATE``
  fragment     under 4 words and no closing punctuation at the end
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.exprs import BLANKS, WORD, count_of

MAX_LOSS = 0.5
SYMBOLS = "#*$%&|<>"
SEPARATORS = "›»·•→"
# fixed values: phrases of boilerplate lines
BOILERPLATE = (
    "accept all cookies|all rights reserved|back to top|click here|cookie policy|enable javascript|follow us on|forgot your password"
    "|log in to|privacy policy|read more|share on|sign in|sign up|skip to content|skip to main content|subscribe to|terms of service|terms of use"
)
CLOSING = r"[.!?…:;\"'»”’)\]][ \t-\r]*$"
SHORT_LINE = 25


def _line_fails(line: Column, n: Column) -> Column:
    lower = F.lower(line)
    return (
        (10 * count_of(line, SYMBOLS) >= 3 * n)
        | (2 * F.regexp_count(line, F.lit(r"!!([ \t-\r]|$)")) >= n)
        | ((n <= SHORT_LINE) & (count_of(line, SEPARATORS) >= 2))
        | ((n <= SHORT_LINE) & lower.rlike(BOILERPLATE))
        | ((n < 4) & ~line.rlike(CLOSING))
    )


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per row of ``docs``, with the cleaned text in ``clean_text``.

    A null text has no words and is rejected, as is any text of under 10 words. Repeated
    rows are judged each by itself, null ids too; other columns, whatever their names, are
    not read. Very long texts are judged whole; a line that equals an earlier one is the
    repeated one. An empty table gives no rows. All work is inside a row, so there is no
    shuffle and no key to be skewed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    window = lambda i: F.struct(F.xxhash64(*[F.get("words", i + k) for k in range(5)]).alias("h"), i.alias("i"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    second = first.select(
        "doc_id",
        "t",
        n.cast("long").alias("n_words"),
        F.sort_array(F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(none)).alias("windows"),
        F.transform(
            F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0),
            lambda x: F.struct(x.alias("s"), F.length(F.translate(x, BLANKS, "")).alias("chars"), F.regexp_count(x, F.lit(WORD)).alias("n")),
        ).alias("lines"),
    )
    twice = F.filter(
        "windows", lambda x, i: (x["h"] == F.get("windows", i - 1)["h"]) | (x["h"] == F.get("windows", i + 1)["h"])
    )
    third = second.select(
        "doc_id",
        "t",
        "n_words",
        F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"),
        "lines",
        F.filter("lines", lambda x: ~_line_fails(x["s"], x["n"])).alias("good"),
    )
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(5), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    fourth = third.select(
        "doc_id",
        "n_words",
        chars("lines").alias("word_chars"),
        count_of(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(F.transform("lines", lambda x: x["s"])))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("good").cast("long").alias("n_good_lines"),
        chars("good").alias("good_chars"),
        F.array_join(F.transform("good", lambda x: x["s"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    enough = F.col("good_chars") >= F.col("word_chars") * F.lit(1 - max_loss)
    return fourth.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & enough).alias("kept"), "n_lines", "n_good_lines", "good_chars", "clean_text",
    )


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_good_lines", "good_chars"]

ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT r, words, unnest(range(len(words) - 4)) AS i FROM w WHERE len(words) >= 5),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i + 1], words[i + 2], words[i + 3], words[i + 4], words[i + 5]) AS n FROM p),
rep AS (SELECT r, sum(least(5, i - last)) AS n FROM
  (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -5) AS last FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS s FROM d),
m AS (SELECT r, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM l),
f AS (SELECT *, (10 * length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')) >= 3 * n
    OR 2 * len(regexp_extract_all(s, '!!([ \t-\r]|$)')) >= n
    OR (n <= 25 AND length(regexp_replace(s, '[^›»·•→]+', '', 'g')) >= 2)
    OR (n <= 25 AND regexp_matches(lower(s), 'accept all cookies|all rights reserved|back to top|click here|cookie policy|enable javascript|follow us on|forgot your password|log in to|privacy policy|read more|share on|sign in|sign up|skip to content|skip to main content|subscribe to|terms of service|terms of use'))
    OR (n < 4 AND NOT regexp_matches(s, '[.!?…:;"''»”’)\]][ \t-\r]*$'))) AS bad FROM m WHERE n > 0),
a AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT s) AS n_dup, sum(chars) AS chars,
    count(*) FILTER (NOT bad) AS n_good, coalesce(sum(chars) FILTER (NOT bad), 0) AS good FROM f GROUP BY r),
o AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_good, 0) AS BIGINT) AS n_good_lines, CAST(coalesce(good, 0) AS BIGINT) AS good_chars
  FROM d JOIN w USING (r) LEFT JOIN a USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words AND good_chars >= word_chars * 0.5) AS kept,
  n_lines, n_good_lines, good_chars
FROM o
"""
