"""Line-first cleaning, in DataFrame functions alone.

Rules on punctuation, navigation and boilerplate look at one line each; lines that fail are removed, and a document
that loses too many of its words with them is rejected. Beside that verdict, a base check rejects documents that are
short or repeat themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LOST_PERCENT = 66  # a document that loses more than two thirds of its words is rejected
#: Phrases of page furniture, matched in either case.
BOILERPLATE = (
    r"cookie|javascript|all rights reserved|terms of (use|service)|privacy policy|click here|sign in|log in|sign up|subscribe|newsletter|read more|lorem ipsum|share this|skip to content"
    r"|alle rechte vorbehalten|datenschutz|impressum|jetzt anmelden|mehr lesen|weiterlesen|nutzungsbedingungen|hier klicken"
    r"|tous droits réservés|mentions légales|politique de confidentialité|lire la suite|en savoir plus|cliquez ici|abonnez-vous"
    r"|todos los derechos reservados|aviso legal|política de privacidad|leer más|haz clic|suscríbete"
)
#: An end of a sentence, with quotes or brackets after it, at a line's end.
ENDED = r"""[.!?:;…。]["'”’»)\]]*[\x20\x09-\x0D]*$"""
#: Signs that separate links, and the share of a line's words from which it is a row of them.
LINKS = r"[|›»•·→▸]|->|>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once: within a lambda, an outer expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """How many words lie in WINDOW-word windows that occur twice or more. Windows are compared by 64-bit hash, sorted, so the cost is n log n."""
    n = F.size(w)
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) & (i > 0) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    starts = lambda h: F.array_sort(F.transform(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice), lambda x: x["i"]))
    covered = lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(starts(h), covered)))).cast("long")


def bad_line(line: Column) -> Column:
    """Whether a line with words fails a rule."""
    n = F.regexp_count(line, F.lit(WORD))
    unended = ~F.rlike(line, F.lit(ENDED))
    navigation = F.regexp_count(line, F.lit(LINKS)) * 5 > n
    marks = F.regexp_count(line, F.lit(r"[!?#*$%&=~^_]{2,}")) * 4 > n
    shout = (n >= 4) & F.rlike(line, F.lit(r"\p{Lu}.*\p{Lu}")) & ~F.rlike(line, F.lit(r"\p{Ll}"))
    return unended | navigation | marks | shout | F.rlike(line, F.lit(r"[{}]")) | F.rlike(line, F.lit("(?i)" + BOILERPLATE))


def clean_lines(docs: DataFrame, max_lost_percent: int = LOST_PERCENT, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Evaluate and clean documents (doc_id, text).

    Returns doc_id; n_words; word_chars (code points in words); n_symbols; n_dup_lines (lines with a word that equal an
    earlier line); n_repeat_words; base_failed; lost_words (words of removed lines); kept; clean_text (the lines that
    stay). Null text counts as empty: no words, base_failed, not kept. Every row of the input gives one row, repeated
    ids too; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("w", words(F.col("text")))
    lines = F.split("text", "\n", -1)
    marked = F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(WORD))), lambda x: F.struct(x.alias("line"), bad_line(x).alias("bad")))
    out = base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        marked.alias("marked"),
    )
    have = lambda x: F.size(F.split(F.trim(F.regexp_replace(x, SPACE, " ")), " ", -1))
    out = out.withColumns({
        "n_dup_lines": (F.size("marked") - F.size(F.array_distinct(F.col("marked.line")))).cast("long"),
        "lost_words": F.aggregate(F.filter("marked", lambda x: x["bad"]), F.lit(0), lambda a, x: a + have(x["line"])).cast("long"),
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    })
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words",
        (~F.col("base_failed") & (100 * F.col("lost_words") <= max_lost_percent * F.col("n_words"))).alias("kept"),
        F.array_join(F.transform(F.filter("marked", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, unnest(range(0, len(w) - {WINDOW - 1})) AS i, w FROM w WHERE len(w) >= {WINDOW}),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i + 1 : i + {WINDOW}], ' ')) AS c FROM win),
cov AS (SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS k FROM rep WHERE c > 1),
covered AS (SELECT r, sum(k)::BIGINT AS n FROM cov GROUP BY r),
ln AS (SELECT r, unnest(lines) AS line FROM w),
m AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM ln),
bad AS (SELECT r, sum(n) AS lost FROM m WHERE
    NOT regexp_matches(line, '{ENDED.replace("'", "''")}')
    OR len(regexp_extract_all(line, '{LINKS}')) * 5 > n
    OR len(regexp_extract_all(line, '[!?#*$%&=~^_]{{2,}}')) * 4 > n
    OR (n >= 4 AND regexp_matches(line, '\p{{Lu}}.*\p{{Lu}}') AND NOT regexp_matches(line, '\p{{Ll}}'))
    OR regexp_matches(line, '[{{}}]') OR regexp_matches(line, '(?i){BOILERPLATE}') GROUP BY r),
s AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words
    FROM w LEFT JOIN covered USING (r) LEFT JOIN bad USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_words <= {LOST_PERCENT} * n_words) AS kept FROM s
"""
