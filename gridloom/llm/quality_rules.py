"""Line-first quality rules, with DataFrame functions only.

Each line is judged by punctuation, symbol, navigation and boilerplate rules;
failing lines are removed, and a document that loses too much of its text is
rejected.  Base counts (words, symbols, repeated lines, repeated three-word
windows) reject documents as well.

Defined cases: a null text counts as no text; a very long text is judged whole,
and its repeats are found exactly at any length; a loss or repeat share that
equals its limit passes; a null id stays null; repeated rows are judged one by
one; an empty table gives an empty result.  Only the id and text columns are
read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import text_or_empty

#: White space between words, as the characters of a regex class and as literal characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A sentence in the line (a full stop or its like, closing quotes or brackets, white space), or a line that ends in a closing mark.
SENTENCE_END = "[.!?…。！？][\"'”’»)\\]]*([" + SPACE_CLASS + "]|\\z)|[:;][\"'”’»)\\]]*[" + SPACE_CLASS + "]*\\z"
#: Three separators of menu entries.
NAVIGATION = "([|»›·•→][^|»›·•→]*){3}"
BOILERPLATE = (
    "(?i)(all rights reserved|cookie (policy|settings|consent)|we use cookies|privacy policy|terms of (use|service)"
    "|enable javascript|javascript is (disabled|required)|lorem ipsum|click here|subscribe to (our|the)"
    "|sign (in|up) (to|for|with)|share (this|on)|read more|powered by|back to top|skip to content)"
)
#: Default of ``boilerplate_chars``: a line of more characters holds more than a boilerplate phrase, which alone does not fail it.
BOILERPLATE_CHARS = 160
#: A line fails beyond these percentages of symbols and of exclamation or question marks among its characters.
SYMBOL_PCT, SHOUT_PCT = 5, 5


def _less(text: Column, chars: str) -> Column:
    """How many of ``chars`` a text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_ok(line: Column, boilerplate_chars: int = BOILERPLATE_CHARS) -> Column:
    """Whether a line passes every line rule; a line without a word passes."""
    return (
        (F.length(F.btrim(line, F.lit(SPACES))) == 0)
        | (
            line.rlike(SENTENCE_END)
            & ~(line.rlike(f"[{SYMBOLS}]") & (_less(line, SYMBOLS) * 100 > F.length(line) * SYMBOL_PCT))
            & ~(line.rlike("[!?]") & (_less(line, "!?") * 100 > F.length(line) * SHOUT_PCT))
            & ~line.rlike(NAVIGATION)
            & ~((F.length(line) <= boilerplate_chars) & line.rlike(BOILERPLATE))
        )
    )


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_loss_pct: int = 50, boilerplate_chars: int = BOILERPLATE_CHARS) -> DataFrame:
    """Counts, verdict and cleaned text of each document.

    Returns the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_bad_lines, lost_chars (bigint), base_failed, kept (boolean) and
    cleaned, the text of the lines that pass.  ``kept`` is false if there are
    fewer than ``min_words`` words, if more than ``max_repeat_pct`` percent of
    the words stand in repeated windows, or if more than ``max_loss_pct``
    percent of the characters of lines are lost.  Boilerplate phrases fail lines of
    at most ``boilerplate_chars`` characters.
    """
    split = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t")).select("_id", "_t", F.btrim("_t", F.lit(SPACES)).alias("_b"), F.split("_t", "\n", -1).alias("_lines"))
    split = split.select("_id", "_t", "_lines", F.when(F.length("_b") == 0, F.array().cast("array<string>")).otherwise(F.split("_b", f"[{SPACE_CLASS}]+", -1)).alias("_w"))
    hashed = split.select(
        "_id",
        "_t",
        "_w",
        F.filter("_lines", lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("_full"),
        F.transform("_lines", lambda x: F.struct(x.alias("line"), line_ok(x, boilerplate_chars).alias("ok"))).alias("_judged"),
        F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))).alias("_h"),
    )
    # A window's hash that is met twice shows that windows must be compared; without one there is no repeat.
    inner = F.slice("_h", 1, F.size("_w") - 2)
    distinct = hashed.select("*", F.when(F.size("_w") < 3, F.lit(0)).otherwise(F.size("_w") - 2 - F.size(F.array_distinct(inner))).alias("_again"))
    # Sort integers that hold the hash's upper bits and the place: neighbours that share the bits are candidates.
    # Candidates are then sorted by their words, so that equal windows are neighbours, whatever their hashes are.
    place = F.when(F.size("_w") < 1 << 20, F.lit((1 << 20) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("bigint")
    tagged = F.when(F.col("_again") > 0, F.sort_array(F.transform(inner, lambda x, i: (x.bitwiseOR(place) - place).bitwiseOR(i.cast("bigint"))))).otherwise(F.array().cast("array<bigint>"))
    ordered = distinct.select("_id", "_t", "_w", "_full", "_judged", place.alias("_mask"), tagged.alias("_s"))
    bits = lambda e: e.bitwiseOR(F.col("_mask"))
    shares = lambda e, i: F.coalesce(bits(e) == bits(F.get("_s", i - 1)), F.lit(False)) | F.coalesce(bits(e) == bits(F.get("_s", i + 1)), F.lit(False))
    at = lambda e: e.bitwiseAND(F.col("_mask")).cast("int")
    words = lambda p: F.struct(F.get("_w", p).alias("a"), F.get("_w", p + 1).alias("b"), F.get("_w", p + 2).alias("c"), p.alias("p"))
    windows = ordered.select("_id", "_t", "_w", "_full", "_judged", F.sort_array(F.transform(F.filter("_s", shares), lambda e: words(at(e)))).alias("_c"))
    equal = lambda e, o: F.coalesce((e["a"] == o["a"]) & (e["b"] == o["b"]) & (e["c"] == o["c"]), F.lit(False))
    same = lambda e, i: equal(e, F.get("_c", i - 1)) | equal(e, F.get("_c", i + 1))
    placed = windows.select("_id", "_t", "_w", "_full", "_judged", F.sort_array(F.transform(F.filter("_c", same), lambda e: e["p"])).alias("_p"))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["line"]))
    counted = placed.select(
        F.col("_id"),
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.when(F.col("_t").rlike(f"[{SYMBOLS}]"), _less(F.col("_t"), SYMBOLS)).otherwise(0).cast("bigint").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_judged").cast("bigint").alias("n_lines"),
        chars("_judged").alias("_chars"),
        F.filter("_judged", lambda x: ~x["ok"]).alias("_bad"),
        F.array_join(F.transform(F.filter("_judged", lambda x: x["ok"]), lambda x: x["line"]), "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    summed = counted.select("*", F.size("_bad").cast("bigint").alias("n_bad_lines"), chars("_bad").alias("lost_chars"), failed.alias("base_failed"))
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("_chars") * max_loss_pct)
    columns = (F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "lost_chars", "base_failed", kept.alias("kept"), "cleaned")
    # One row each through a generator: a filter on the verdict stays above it, and so does not compute the counts
    # that the verdict is made of once more.
    return summed.select(F.inline(F.array(F.struct(*columns))))
