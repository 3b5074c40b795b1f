"""Quality rules: repetition and length first, then how far a text's character classes and common words stray from its language.

For each document two histograms are compared with the reference of its language by Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1): classes of non-space characters, and shares of the language's
commonest function words. A reference is the mean of the histograms of all documents of that language that are
long enough, so it costs one aggregation to a row per language and is broadcast (five rows at most, since
languages without a word list share one). Words count as common where they stand bare, in lower case.

Edge cases: a null or empty text has no words and fails the base rule; a text under a minimum length skips the
distance it is too short for; null or unknown languages share the reference "other", whose word histogram is all
"rest" and so never rejects; repeated rows get equal verdicts; columns of the input that are named like results
are replaced by the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.native_text import window_hashes, words
from kilnworks.llm.names import whole_row
from kilnworks.llm.scratch import cut

# The commonest function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "des", "auf", "für", "ist", "im", "nicht", "dem", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "are", "this", "at", "from"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "las", "se", "del", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
    "fr": ["de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "est", "pour", "par", "dans", "avec", "qui", "pas", "sur", "au"],
}
SYMBOLS = r"[#*$%&|<>]"
CLASSES = {"upper": r"[A-Z]", "digit": r"[0-9]", "symbol": SYMBOLS, "stop": r"[.,;:!?'\"()\-]"}
LINE_WITH_WORD = r"[^\x20\x09-\x0D]"
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules. Percentages are of the document's words; distances lie between 0 and 1."""

    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    min_chars_for_classes: int = 100
    min_words_for_common: int = 50
    max_char_distance: float = 0.30
    max_word_distance: float = 0.38


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two arrays of shares of equal length."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, given the hash of the window at each word.

    Windows are sorted by hash, those equal to a neighbour keep their position, and each adds the words up to the
    next kept window, five at most.
    """
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(ordered))


def _covered(ordered: Column, window: int = 5) -> Column:
    # One-element arrays name an intermediate result, so that it is computed once.
    def twins(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        alike = lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: alike(j)), lambda x: x["i"]))

    def span(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    at = F.element_at(F.transform(F.array(ordered), twins), 1)
    return F.element_at(F.transform(F.array(at), span), 1)


def _with_histograms(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Adds _text, _lang, _words, the counts of words and characters, and those of classes (_parts) and common words (_found)."""
    known = F.when(F.col(lang).isin(sorted(COMMON_WORDS)), F.col(lang)).otherwise("other")
    df = docs.withColumns({"_text": F.coalesce(F.col(text), F.lit("")), "_lang": known})
    df = df.withColumn("_words", words(F.col("_text")))
    listed_anywhere = sorted({w for listed in COMMON_WORDS.values() for w in listed})
    df = df.withColumn("_hits", F.filter("_words", lambda w: w.isin(listed_anywhere)))
    common = F.array().cast("array<string>")
    for name, listed in COMMON_WORDS.items():
        common = F.when(F.col("_lang") == name, F.array(*map(F.lit, listed))).otherwise(common)
    times = lambda w: (F.size("_hits") - F.size(F.array_remove("_hits", w))).cast("double")
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_parts": F.array(*[F.regexp_count("_text", F.lit(x)).cast("double") for x in CLASSES.values()]),
            "_found": F.transform(common, times),
        }
    ).drop("_hits")


def _shares(counts: Column, total: Column) -> Column:
    """Shares of the total, and the rest as the last."""
    rest = total - F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(F.concat(counts, F.array(rest)), lambda x: x / total))


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits | None = None) -> DataFrame:
    """docs with the counts of the base rule and the two histograms, before any language is compared."""
    limits = limits or Limits()
    df = _with_histograms(docs.drop(*[x for x in RESULTS if x in docs.columns]), text, lang)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(LINE_WITH_WORD))
    df = df.withColumns({"_lines": lines, "_windows": window_hashes(F.col("_words"), F.size("_words"), limits.window)}).drop("_words")
    return df.withColumns(
        {
            "n_symbols": F.get("_parts", F.lit(list(CLASSES).index("symbol"))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_windows")).cast("long"),
            "_chars": F.when(F.col("word_chars") >= limits.min_chars_for_classes, _shares(F.col("_parts"), F.col("word_chars").cast("double"))),
            "_common": F.when(F.col("n_words") >= limits.min_words_for_common, _shares(F.col("_found"), F.col("n_words").cast("double"))),
        }
    ).drop("_lines", "_windows", "_text", "_parts", "_found")


def language_references(measured: DataFrame) -> DataFrame:
    """A row for each language: the mean histograms of all of its documents that are long enough (null if none is)."""
    wide, many = len(CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 1
    mean = lambda name, k: F.avg(F.get(name, F.lit(k))).alias(f"{name}{k}")
    made = measured.groupBy("_lang").agg(*[mean("_chars", k) for k in range(wide)], *[mean("_common", k) for k in range(many)])
    whole = lambda name, n: F.array_compact(F.array(*[F.col(f"{name}{k}") for k in range(n)]))
    return made.select("_lang", whole("_chars", wide).alias("_ref_chars"), whole("_common", many).alias("_ref_common"))


def apply_rules(docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (default: all) with the counts, distances and verdict of each document (RESULTS).

    Texts are read once: what is measured goes to a table in the shared folder, from which references and verdicts
    are made.
    """
    limits = limits or Limits()
    carry = [x for x in (docs.columns if carry is None else carry) if x not in RESULTS]
    rows = docs.select(whole_row(carry).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    measured = cut(measure(rows, limits=limits).select("row", *RESULTS[:5], "_lang", "_chars", "_common"), "quality")
    df = measured.join(F.broadcast(language_references(measured)), "_lang", "left")
    distance = lambda mine, ref: F.when(F.size(mine) == F.size(ref), jensen_shannon(F.col(mine), F.col(ref)))
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words")),
            "char_distance": distance("_chars", "_ref_chars"),
            "word_distance": distance("_common", "_ref_common"),
        }
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= limits.max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= limits.max_word_distance)
    return df.withColumn("kept", ~F.col("base_failed") & near).select(*[F.col("row")[c].alias(c) for c in carry], *RESULTS)
