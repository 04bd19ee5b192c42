"""Statistics of one text as column expressions: no Python, no shuffle.

Every function takes and returns columns. A null text is an empty one. Columns that a
lambda reads are made in a projection of their own, so that they are computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
_BITS = 20


def strip_chars(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_chars(text: Column, chars: str) -> Column:
    """How often the given ASCII characters occur."""
    return (F.octet_length(text) - F.octet_length(strip_chars(text, chars))).cast("long")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+"))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def _repeats_fast(h: str, s: str) -> Column:
    """Positions of windows that occur twice: neighbours of the sorted (hash, position)
    words that agree on the hash bits."""
    same = lambda i, j: F.shiftright(F.get(F.col(s), i), _BITS) == F.shiftright(F.get(F.col(s), j), _BITS)
    return F.filter(F.col(s), lambda x, k: ((k > 0) & same(k, k - 1)) | ((k < F.size(s) - 1) & same(k, k + 1)))


def with_repeat_words(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Words inside 3-word windows that occur at least twice in the text, first included.

    Windows are sorted as one long each (44 hash bits, 20 position bits). Where two
    windows agree on those bits but not on the whole hash, or the text has more than
    2**20 windows, the pairs (hash, position) are sorted instead."""
    mask = (1 << _BITS) - 1
    at = lambda i: F.get(F.col(words_col), i)
    n = F.size(words_col) - 2
    keep = [c for c in df.columns if c != out]
    df = df.withColumn("_h", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
                       .otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_s", F.when(F.size("_h") <= mask, F.sort_array(
        F.transform("_h", lambda x, i: F.shiftleft(x, _BITS).bitwiseOR(i.cast("long"))))))
    df = df.withColumn("_d", _repeats_fast("_h", "_s"))
    h_of = lambda x: F.get(F.col("_h"), x.bitwiseAND(F.lit(mask)).cast("int"))
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size("_d") - 1, F.lit(1))),
                     lambda k: (F.shiftright(F.get("_d", k), _BITS) == F.shiftright(F.get("_d", k - 1), _BITS))
                     & (h_of(F.get("_d", k)) != h_of(F.get("_d", k - 1))))
    df = df.withColumn("_slow", F.col("_s").isNull() | F.coalesce(clash, F.lit(False)))
    df = df.withColumn("_p", F.when(F.col("_slow"), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.get("_p", i)["h"] == F.get("_p", j)["h"]
    slow = F.transform(F.filter(F.col("_p"), lambda x, k: ((k > 0) & same(k, k - 1)) | ((k < F.size("_p") - 1) & same(k, k + 1))),
                       lambda x: x["i"].cast("long"))
    fast = F.transform("_d", lambda x: x.bitwiseAND(F.lit(mask)))
    df = df.withColumn("_at", F.sort_array(F.when(F.col("_slow"), slow).otherwise(fast)))
    covered = F.aggregate(F.col("_at"), F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")))
    return df.withColumn(out, covered["n"]).select(*keep, out)


def with_counts(df: DataFrame, text_col: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text column that
    holds no nulls; the text itself is dropped."""
    keep = [c for c in df.columns if c != text_col]
    df = df.select(*keep, text_col, words(F.col(text_col)).alias("_w"), lines_with_words(F.col(text_col)).alias("_lines"))
    df = df.select(
        *keep, "_w", F.size("_w").cast("long").alias("n_words"),
        F.char_length(strip_chars(F.col(text_col), WHITE)).cast("long").alias("word_chars"),
        count_chars(F.col(text_col), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    return with_repeat_words(df, "_w", "n_repeat_words").drop("_w")
