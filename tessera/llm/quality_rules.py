"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text goes.

Everything is built from SQL functions. Only arrays within one row are sorted; no row leaves its partition.

A line fails when any of these holds (blank lines are neither kept nor counted):
  navigation   three or more separators (| » › · •), or at most three words and no sentence mark at its end
  boilerplate  a stock phrase of web pages, or a line that repeats an earlier one of the document
  punctuation  more than four in ten of its visible characters are no letters or digits, or most of its words
               end in "!!"
A document is kept when it passes the base rules and at most ``max_loss`` of its words' characters are removed.

Edge cases: null text has no words and is not kept; an empty text likewise; a null doc_id is passed through;
repeated rows are judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, WS_SQL, let, table, words_sql

MAX_LOSS = 0.5
BOILERPLATE = "(?i)\\\\b(cookies?|javascript|terms of (use|service)|privacy policy|all rights reserved|click here|sign in|log in|subscribe|newsletter|lorem ipsum|read more|share this)\\\\b"
NAVIGATION = "(?s)[|»›·•].*[|»›·•].*[|»›·•]"
SENTENCE_END = '[.!?…:;。！？][)\\"»”’]*$'

#: Words of the text that lie in a three-word window found twice or more in it. Windows are sorted by hash with
#: their places, so equal ones are neighbours; the places found are sorted again and their cover summed.
_WINDOWS = "transform(slice(ws, 1, greatest(size(ws) - 2, 0)), (w, i) -> struct(xxhash64(w, ws[i + 1], ws[i + 2]) AS h, i AS p))"
_PLACES = "sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[i - 1].h = x.h) OR (i < size(s) - 1 AND s[i + 1].h = x.h)), x -> x.p))"
_COVER = "aggregate(transform(q, (p, i) -> if(i = size(q) - 1, 3, least(3, q[i + 1] - p))), 0L, (a, x) -> a + x)"
REPEATS = let(f"sort_array({_WINDOWS})", "s", let(_PLACES, "q", _COVER))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = docs.select("doc_id", F.expr("coalesce(text, '')").alias("text"))
    counted = text.select(
        "doc_id",
        "text",
        F.expr(let(words_sql("text"), "ws", f"struct(cast(size(ws) AS long) AS n_words, cast(length(array_join(ws, '')) AS long) AS word_chars, {REPEATS} AS n_repeat_words)")).alias("m"),
        F.expr("cast(regexp_count(text, '[#*$%&|<>]') AS long)").alias("n_symbols"),
        F.expr(let(f"filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')", "ls", "cast(size(ls) - size(array_distinct(ls)) AS long)")).alias("n_dup_lines"),
    )
    return counted.select(
        "doc_id", "text", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", F.expr("m.n_words < 50 OR 100 * m.n_repeat_words > 50 * m.n_words").alias("base_failed")
    )


_FAILS = f"""(
    l rlike '{NAVIGATION}'
    OR l rlike '{BOILERPLATE}'
    OR (NOT l rlike '{SENTENCE_END}' AND NOT l rlike '^{WS_SQL}*([^\\\\x20\\\\x09-\\\\x0D]+{WS_SQL}+){{3}}[^\\\\x20]')
    OR length(regexp_replace(l, '[\\\\p{{L}}\\\\p{{N}}\\\\x20\\\\x09-\\\\x0D]+', '')) > 0.4 * length(replace(replace(replace(l, ' ', ''), '\\t', ''), '\\r', ''))
    OR 2 * (length(l) - length(replace(l, '!!', '!'))) > size(split(l, ' '))
)"""


def clean_lines(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The measures of each document, its text without failing lines (``clean_text``) and ``kept``."""
    lines = "transform(array_distinct(filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')), l -> rtrim(l))"
    cleaned = measure(docs).withColumn("clean_text", F.expr(f"concat_ws('\\n', filter({lines}, l -> NOT {_FAILS}))"))
    left = F.length(F.regexp_replace("clean_text", f"{WS}+", ""))
    return cleaned.withColumn("kept", ~F.col("base_failed") & (left >= (1 - max_loss) * F.col("word_chars")))


def op7_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
