"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over the whole text; every rule is one row
of :data:`RULES` (measure, bound, limit) and the verdict is the conjunction of
all rows.  No user function, no join and no shuffle: the plan is a scan and
projections, so it scales with the input alone and a hot source, a long text or
a group of copies costs no more than its own characters.

A *word* is a run of characters other than blank and 0x09-0x0D.

Defined results: a null or empty text has no words (all counts 0, rejected by
the minimum of words); ties and repeated rows give a row each; an empty table
gives an empty result; extra columns are ignored by :func:`measure` and carried
by :func:`keep_clean`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.llm.frames import carry, pick, restore
from haulspark.operators.rows import keep_rows

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four corpus languages.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "that", "is", "was", "for", "on", "with", "be", "by", "or", "as"),
    "de": ("der", "die", "das", "und", "in", "zu", "den", "mit", "von", "ist", "im", "auf", "für", "ein", "eine"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "en", "dans", "pour", "par", "sur"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "del", "se"),
}

# (rule, measure, bound, limit).  ``max`` rejects above, ``min`` below.
BASE_RULES = (
    ("words", "n_words", "min", 50),
    ("repeated_words", "repeat_percent", "max", 50.0),
)
RULES = (
    ("symbols_per_word", "symbol_ratio", "max", 0.10),
    ("word_length_low", "mean_word_length", "min", 2.5),
    ("word_length_high", "mean_word_length", "max", 20.0),
    ("stop_words", "stop_ratio", "min", 0.02),
    ("duplicate_lines", "dup_line_ratio", "max", 0.50),
    ("symbol_lines", "symbol_line_ratio", "max", 0.50),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _strip(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _measured(docs: DataFrame) -> DataFrame:
    """``text`` -> counts.  Steps are separate projections so that an array is
    built once and later steps read it by index."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    df = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.length(_strip(x, BLANKS)) > 0))
    n = F.size("_words")
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(_strip(text, BLANKS)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_strip(text, SYMBOLS))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_symbol_lines": F.size(F.filter("_lines", lambda x: F.length(x) - F.length(_strip(x, SYMBOLS)) > 0)).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*stop))).cast("long"),
        "_bits": F.length(F.bin(n.cast("long"))).cast("int"),
    })
    # 3-word windows as one long each, high bits of the hash above the position:
    # sorted, equal windows become neighbours, and neighbours are compared word by word
    df = df.withColumn("_win", F.sort_array(F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.call_function("shiftleft", F.xxhash64(
            F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)), F.col("_bits")).bitwiseOR(i.cast("long"))))
        .otherwise(F.array().cast("array<bigint>"))))

    def at(x):
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).cast("int")

    def same(x, y):
        near = F.call_function("shiftright", x, F.col("_bits")) == F.call_function("shiftright", y, F.col("_bits"))
        return F.coalesce(near, F.lit(False)) & (F.slice("_words", at(x) + 1, 3) == F.slice("_words", at(y) + 1, 3))

    df = df.withColumn("_again", F.sort_array(F.transform(F.filter(
        "_win", lambda x, k: same(x, F.get("_win", k + 1)) | same(x, F.get("_win", k - 1))), at)))
    # words covered by a repeated window: each start adds up to 3, less what the next start covers
    cover = F.transform("_again", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("_again", k + 1) - at, F.lit(3))))
    return df.withColumn("n_repeat_words", F.coalesce(
        F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))


def _ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "repeat_percent": _ratio(100.0 * F.col("n_repeat_words"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "mean_word_length": _ratio(F.col("word_chars"), F.col("n_words")),
        "stop_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "symbol_line_ratio": _ratio(F.col("n_symbol_lines"), F.col("n_lines")),
    })


def compile_rules(rules) -> Column:
    """True where some row of the threshold table rejects."""
    tests = [F.col(m) > F.lit(limit) if bound == "max" else F.col(m) < F.lit(limit) for _, m, bound, limit in rules]
    return reduce(lambda a, b: a | b, tests)


def _judged(df: DataFrame, base=BASE_RULES, rules=RULES) -> DataFrame:
    df = _ratios(_measured(df))
    failed = F.filter(F.array(*[
        F.when((F.col(m) > F.lit(limit)) if bound == "max" else (F.col(m) < F.lit(limit)), F.lit(name))
        for name, m, bound, limit in (*base, *rules)]), lambda x: x.isNotNull())
    return df.withColumns({"base_failed": compile_rules(base), "failed_rules": failed,
                           "kept": ~(compile_rules(base) | compile_rules(rules))})


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, base=BASE_RULES, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, the ratios, the failed rules and ``kept``."""
    judged = _judged(pick(docs, doc_id=id_col, text=text_col), base, rules)
    results = (*MEASURES, "base_failed", "kept", "n_lines", "n_stop_words", "n_symbol_lines", "repeat_percent", "symbol_ratio",
               "mean_word_length", "stop_ratio", "dup_line_ratio", "symbol_line_ratio", "failed_rules")
    # a caller's filter on a result must not be pushed into the projections, where it would copy their expressions
    return judged.select("doc_id", F.explode(F.array(F.struct(*results))).alias("r")).select("doc_id", "r.*")


def keep_clean(docs: DataFrame, base=BASE_RULES, rules=RULES, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the columns they came with.

    The text is the only input column the rules read; the others are carried."""
    names = docs.columns
    judged = _judged(carry(docs, text=text_col), base, rules)
    # a plain filter would be pushed below the projections with their expressions copied into it
    return restore(keep_rows(judged, F.col("kept")), names)
