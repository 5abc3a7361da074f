"""Quality rules, line first: lines that fail a rule go, then documents that lose too much.

Every line of a text is held against rules on its own: navigation, symbols,
shouting, repeated marks, stuttered words, boilerplate, and short lines that end
without a mark.
Lines that fail are removed, and a document is rejected when more than
`MAX_LOST` of its words went with them. Base facts of the whole text (repeated
five-word windows, repeated lines, symbols) are counted beside it and reject on
their own. Everything is a Column expression over one row: nothing shuffles, and
a text's cost grows with its length (times the logarithm, for the sorting of
its windows).

Defined results: a null text is an empty one; lines without a word fail no rule
and stay; a document without words has lost nothing, and fails the base rule of
`MIN_WORDS`. Rows of one id are treated one by one, null ids like others, and
columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.llm.common import SPACE_CLASS, SPACES

WINDOW = 5
MIN_WORDS = 10
# Per cent of the words that may stand in repeated windows, and in removed lines.
MAX_REPEATED = 20
MAX_LOST = 30

SYMBOLS = "[#*$%&|<>]"
# Characters that part the entries of a menu, and that end a sentence.
SEPARATORS = "[|»›·•→]"
LAST_MARKS = "[.!?…:;。！？।؟\"'”’»)\\]]$"
# Wording of pages around a text, in lines of fewer than BOILERPLATE_WORDS words.
BOILERPLATE = (
    "all rights reserved",
    "cookie",
    "javascript",
    "lorem ipsum",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "click here",
    "read more",
    "sign in",
    "log in",
    "subscribe to",
    "share this",
    "skip to content",
    "powered by",
)
BOILERPLATE_WORDS = 20
SHORT_WORDS = 5
SHOUT_WORDS = 8
RULES = ("navigation", "symbols", "shouting", "marks", "stutter", "boilerplate", "short")

# A window's sort key: hash above, place below; a text has fewer words than that many places.
_PLACE_BITS = 30


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def failed_rule(line: Column, words: Column) -> Column:
    """Name of the first rule that a trimmed line with these words fails, else null."""
    n_words = F.size(words)
    again = F.size(F.filter(words, lambda word, i: word == F.get(words, i - 1)))
    symbols = _count(line, SYMBOLS)
    separators = _count(line, SEPARATORS)
    phrase = line.rlike("(?i)" + "|".join(BOILERPLATE))
    return (
        F.when(n_words == 0, F.lit(None).cast("string"))
        .when((separators >= 3) & (separators * 5 >= n_words), "navigation")
        .when((symbols >= 3) & (symbols * 10 > n_words), "symbols")
        .when((n_words >= SHOUT_WORDS) & (_count(line, r"\p{Lu}{2,}") * 2 > n_words), "shouting")
        .when((n_words >= 3) & (_count(line, "[!?]{2,}") * 4 > n_words), "marks")
        .when((n_words >= SHORT_WORDS) & (again * 10 > n_words * 3), "stutter")
        .when((n_words < BOILERPLATE_WORDS) & phrase, "boilerplate")
        .when((n_words < SHORT_WORDS) & ~line.rlike(LAST_MARKS), "short")
    )


def _failing(rule: str) -> Column:
    return F.size(F.filter("rules", lambda failed: failed == rule))


def with_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text, and of each \\n-split line: the line, its words and the rule it fails."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("_bare", F.transform("lines", lambda line: F.trim(line, F.lit(SPACES))))
    none = F.array().cast("array<string>")
    apart = F.transform(
        "_bare", lambda line: F.when(line == "", none).otherwise(F.split(line, SPACE_CLASS + "+"))
    )
    rows = rows.withColumn("line_words", apart)
    rules = F.transform("_bare", lambda line, i: failed_rule(line, F.get("line_words", i)))
    return rows.withColumn("rules", rules).drop("_bare")


def repeated_words(rows: DataFrame, words: str, out: str, width: int = WINDOW) -> DataFrame:
    """Adds `out`: how many words of `words` stand in a window that occurs twice or more.

    Windows are sorted by part of a hash and their place, as plain numbers;
    those that meet another in the hash are then compared word by word.
    """
    last = F.greatest(F.size(words) - width, F.lit(0)).cast("long")
    places = F.sequence(F.lit(0).cast("long"), last)
    mask = F.lit((1 << _PLACE_BITS) - 1)
    # A text shorter than a window is one window, which nothing repeats.
    keys = F.transform(
        places,
        lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(width)))
        .bitwiseAND(F.lit(-(1 << _PLACE_BITS)))
        .bitwiseOR(i),
    )
    rows = rows.withColumn("_keys", F.sort_array(keys))

    def alike(key: Column, other: Column) -> Column:
        return F.shiftright(key, _PLACE_BITS) == F.shiftright(other, _PLACE_BITS)

    met = F.filter(
        "_keys", lambda k, i: alike(k, F.get("_keys", i - 1)) | alike(k, F.get("_keys", i + 1))
    )
    # Words are fetched one by one: a slice would walk the whole text for each window.
    window = F.transform(
        met,
        lambda k: F.struct(
            F.array(*(F.get(words, k.bitwiseAND(mask) + j) for j in range(width))).alias("words"),
            k.bitwiseAND(mask).alias("place"),
        ),
    )
    rows = rows.withColumn("_met", F.sort_array(window))
    twice = F.filter(
        "_met",
        lambda w, i: (w["words"] == F.get("_met", i - 1)["words"])
        | (w["words"] == F.get("_met", i + 1)["words"]),
    )
    rows = rows.withColumn("_at", F.sort_array(F.transform(twice, lambda w: w["place"])))
    # Each window adds the words up to the next one, its whole width at most.
    added = F.transform(
        "_at",
        lambda at, i: F.coalesce(F.least(F.get("_at", i + 1) - at, F.lit(width)), F.lit(width)),
    )
    total = F.aggregate(added, F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.withColumn(out, total).drop("_keys", "_met", "_at")


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents line by line: facts, the text that is left, and the verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept; n_lines, n_removed, lost_words, removed_by (rule → lines),
    cleaned (the text without the removed lines).
    """
    rows = with_lines(docs).withColumn("words", F.flatten("line_words"))
    rows = repeated_words(rows, "words", "n_repeat_words")
    zero = F.lit(0).cast("long")
    n_words = F.size("words").cast("long")
    # Lines with a word, and those of them that fail.
    filled = F.filter("lines", lambda line, i: F.size(F.get("line_words", i)) > 0)
    left = F.filter("lines", lambda line, i: F.get("rules", i).isNull())
    lost = F.transform(
        "line_words", lambda w, i: F.when(F.get("rules", i).isNotNull(), F.size(w)).otherwise(0)
    )
    by_rule = F.map_from_arrays(
        F.array(*(F.lit(rule) for rule in RULES)), F.array(*(_failing(rule) for rule in RULES))
    )
    rows = rows.withColumn("_filled", filled).withColumn("_left", left)
    facts = rows.select(
        "doc_id",
        n_words.alias("n_words"),
        F.aggregate("words", zero, lambda a, w: a + F.char_length(w)).alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("_left")).cast("long").alias("n_removed"),
        F.aggregate(lost, zero, lambda a, n: a + n).alias("lost_words"),
        by_rule.alias("removed_by"),
        F.array_join("_left", "\n").alias("cleaned"),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    )
    kept = ~base_failed & (100 * F.col("lost_words") <= MAX_LOST * F.col("n_words"))
    return facts.withColumn("base_failed", base_failed).withColumn("kept", kept)
