"""Quality rules: a table of thresholds compiled into one projection of ratios, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAP = r"[ \t\n\x0B\f\r]"
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it was for on are as with his they at be this from or had by not but what have you "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son lui nous "
    "el los y del las por con una su para como más pero sus al lo o este sí porque esta entre cuando muy sin"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= ratio <= high. A ratio over nothing is 0."""

    name: str
    ratio: str
    low: float = float("-inf")
    high: float = float("inf")


#: The threshold table. Ratios are named in `ratios`.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 12.0),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("marks", "marks_per_word", high=0.4),
    Rule("stop_words", "stop_word_share", low=0.02),
    Rule("capitals", "capital_word_share", high=0.4),
    Rule("duplicate_lines", "dup_line_share", high=0.5),
)


def base_counts(text: Column) -> dict[str, Column]:
    """The counts that need one pass over the text; `words` and `lines` are arrays for the later ones."""
    words = F.array_remove(F.split(text, _GAP + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return {"words": words, "lines": lines}


def repeated_words(words: str, n: int = 3) -> tuple[dict[str, Column], Column]:
    """Steps (columns by name, in order) and the count of words in n-word windows that occur twice or more.

    Windows are hashed to 64 bits. Where all hashes differ nothing is repeated. Otherwise the hashes, cut to make room
    for the place, are sorted with their places, and a window is repeated if its neighbour in that order has the same
    cut hash and the same words. The union of repeated windows is counted in one pass over the sorted places. The cost
    is n log n for a text of any length.
    """
    size = F.size(words)
    heads = F.slice(words, F.lit(1), F.greatest(size - (n - 1), F.lit(0)))
    hashes = F.transform(heads, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]))
    bits = F.length(F.bin(size))
    steps = {"_h": hashes, "_bits": bits}
    steps["_keys"] = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: _shift(h, "_bits").bitwiseOR(i.cast("long")))))

    def same(x: Column, y: Column) -> Column:
        p, q = _place(x), _place(y)
        equal = (_cut(x) == _cut(y)) & (F.get(words, p) == F.get(words, q))
        for k in range(1, n):
            equal &= F.get(words, p + k) == F.get(words, q + k)
        return F.coalesce(equal, F.lit(False))

    hits = F.filter("_keys", lambda x, k: same(x, F.get("_keys", k - 1)) | same(x, F.get("_keys", k + 1)))
    steps["_at"] = F.when(F.col("_keys").isNotNull(), F.sort_array(F.transform(hits, _place)))
    first = F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("total"))
    union = F.aggregate("_at", first, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(n), p - a["last"])).alias("total")), lambda a: a["total"])
    return steps, F.coalesce(union, F.lit(0).cast("long"))


def _shift(h: Column, bits: str) -> Column:
    return F.call_function("shiftleft", h, F.col(bits))


def _cut(x: Column) -> Column:
    return F.call_function("shiftright", x, F.col("_bits"))


def _place(x: Column) -> Column:
    return x.bitwiseAND(_shift(F.lit(1).cast("long"), "_bits") - 1).cast("int")


def ratios() -> dict[str, Column]:
    """Ratios of the rule table over the counts and arrays of `measured`."""
    per_word = lambda c: F.coalesce(F.try_divide(c, F.col("n_words")), F.lit(0.0))
    stop_count = F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS)))
    return {
        "mean_word_length": per_word(F.col("word_chars")),
        "symbols_per_word": per_word(F.col("n_symbols")),
        "marks_per_word": per_word(F.regexp_count("text", F.lit("[!?]"))),
        "stop_word_share": per_word(stop_count),
        "capital_word_share": per_word(F.regexp_count("text", F.lit(r"\p{Lu}{2,}"))),
        "dup_line_share": F.coalesce(F.try_divide(F.col("n_dup_lines"), F.size("lines")), F.lit(0.0)),
    }


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base_failed, every ratio of the rule table and kept, for each row of docs.

    A null or empty text has no words: all counts and ratios are 0, base_failed is true and kept false. Repeated rows
    and repeated keys each give their row. Other columns of docs are not read. A ratio at a threshold passes. The
    length of a text is bounded by memory for its arrays only, about 60 bytes a word.
    """
    t = F.col("text")
    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = out.select("*", *[c.alias(k) for k, c in base_counts(t).items()])
    steps, n_repeat = repeated_words("words")
    for name, c in steps.items():
        out = out.withColumn(name, c)
    out = out.select(
        "doc_id", "text", "words", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
    )
    named = ratios()
    used = [r for r in named if any(rule.ratio == r for rule in rules)]
    out = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[named[r].alias(r) for r in used])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & F.col(rule.ratio).between(rule.low, rule.high)
    return out.withColumns({"base_failed": failed, "kept": ~failed & verdict})
