"""Quality rules: form counts, and divergence from the language's usual characters and words.

Each document's histogram of character classes and of common words (all other
words are one more bin) is compared with the one of all documents of its
language, by Jensen-Shannon distance. Characters fail above a fixed distance,
words above what is usual in the language: its mean distance and two standard
deviations. Short documents are not judged. Everything is DataFrame functions: a
document is one row throughout, and only sums per language are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Workspace

# Frequent function words of the languages the corpus declares.
COMMON_WORDS = (
    "the of and to in is it that for with "
    "der die das und ist von mit den nicht zu "
    "le la les des et que est pour dans une "
    "el los las del por con para una se no"
).split()
SPACES = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
# Character classes counted by deleting everything else.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "high": r"\x{80}-\x{10FFFF}"}
HISTOGRAM = ["lower", "upper", "digit", "high", "symbol", "space", "mark"]
# Words a document needs before its histograms are judged.
LEAST_WORDS = 50
# Largest distance of characters that passes.
MOST_CHARACTERS = 0.3
# Distances of words pass up to so many standard deviations above the language's mean, and always up to the floor.
WORD_DEVIATIONS = 2
WORD_FLOOR = 0.15
GRAM = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def deleted_length(text: Column, pattern: str) -> Column:
    """Code points left after deleting what matches."""
    return F.char_length(F.regexp_replace(text, pattern, ""))


def split_words(text: Column) -> Column:
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def repeated_words(words: Column, gram: int = GRAM) -> Column:
    """Words inside windows of ``gram`` words that occur twice or more; windows compared by 64-bit hash."""

    def covered(places: Column) -> Column:
        gaps = F.sequence(F.lit(0), F.size(places) - 2)
        step = F.aggregate(
            F.when(F.size(places) > 1, gaps).otherwise(F.array().cast("array<int>")),
            F.lit(0),
            lambda total, k: total + F.least(F.lit(gram), F.get(places, k + 1) - F.get(places, k)),
        )
        return F.when(F.size(places) > 0, step + gram).otherwise(0)

    def places(ordered: Column) -> Column:
        def same(k: Column, by: int) -> Column:
            return F.coalesce(F.get(ordered, k + by)["h"] == F.get(ordered, k)["h"], F.lit(False))

        marked = F.transform(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda k: F.when((k > 0) & same(k, -1) | same(k, 1), F.get(ordered, k)["i"]),
        )
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def of_grams(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
            let(ordered, lambda o: let(places(o), covered))
        )

    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - gram),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(gram)]),
    )
    return F.when(F.size(words) < gram, F.lit(0)).otherwise(let(grams, of_grams))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def common_counts(words: Column) -> Column:
    """Occurrences of each common word, in the order of ``COMMON_WORDS``."""
    found = F.filter(F.transform(words, F.lower), lambda w: w.isin(COMMON_WORDS))
    # Each word between blanks of its own, so that deleting one leaves the others whole.
    joined = F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))
    return let(
        joined,
        lambda s: F.array(
            *[
                ((F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
                for w in COMMON_WORDS
            ]
        ),
    )


def form_counts(text: Column) -> Column:
    """All counts of a text as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            common_counts(words).alias("common"),
        )

    return F.struct(
        let(split_words(text), of_words).alias("words"),
        F.char_length(text).cast("long").alias("chars"),
        deleted_length(text, f"[{SPACES}]+").cast("long").alias("word_chars"),
        deleted_length(text, r"[^#*$%&|<>]+").cast("long").alias("symbol"),
        repeated_lines(text).cast("long").alias("n_dup_lines"),
        *[deleted_length(text, f"[^{c}]+").cast("long").alias(name) for name, c in CLASSES.items()],
    )


def array_sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda total, x: total + x)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts; null if one is empty or null."""

    def part(x: Column, middle: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))

    def of_sums(sums: Column) -> Column:
        whole_p, whole_q = F.get(sums, F.lit(0)), F.get(sums, F.lit(1))

        def term(a: Column, b: Column) -> Column:
            pair = F.struct((a / whole_p).alias("x"), (b / whole_q).alias("y"))
            return let(pair, lambda s: part(s["x"], (s["x"] + s["y"]) / 2) + part(s["y"], (s["x"] + s["y"]) / 2))

        total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda t, x: t + x)
        return F.when((whole_p > 0) & (whole_q > 0), F.sqrt(F.greatest(total / 2, F.lit(0.0))))

    return let(F.array(array_sum(p), array_sum(q)), of_sums)


def apply_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    keep_cols: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep_cols`` of every row with its counts, both distances, base_failed and kept.

    Null text: as the empty text (no words, so base_failed). Null language: a
    language of its own. The language's histograms add up all its documents that
    pass the base rules; without any there is no distance and nothing to fail.
    The mean and deviation of word distances are those of the documents that the
    histograms judge, from sums of whole millionths, so reruns agree. Repeated
    rows count repeatedly.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "rules")
    counted = docs.select(
        *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep_cols)], F.col(lang_col).cast("string").alias("_lang"), form_counts(F.col(text_col).cast("string")).alias("_c")
    )
    counted = workspace.write(counted, "counts")
    c = F.col("_c")
    n_words = c["words"]["n_words"]
    failed = (n_words < 10) | (100 * c["words"]["n_repeat_words"] > 20 * n_words)

    counts = {name: c[name] for name in [*CLASSES, "symbol"]}
    counts["space"] = c["chars"] - c["word_chars"]
    known = [counts[name] for name in HISTOGRAM[:-1]]
    classes = F.array(*known, c["chars"] - sum(known[1:], known[0]))
    common = c["words"]["common"]
    words = F.concat(common, F.array(n_words - array_sum(common)))
    counted = counted.withColumns({"_p_classes": classes, "_p_words": words})

    def sums(column: str, width: int) -> Column:
        return F.array(*[F.sum(F.get(column, F.lit(k))) for k in range(width)])

    reference = (
        counted.where(~failed)
        .groupBy(F.col("_lang").alias("_of"))
        .agg(sums("_p_classes", len(HISTOGRAM)).alias("_q_classes"), sums("_p_words", len(COMMON_WORDS) + 1).alias("_q_words"))
    )
    joined = counted.join(workspace.write(reference, "reference"), F.col("_lang").eqNullSafe(F.col("_of")), "left")
    long = n_words >= LEAST_WORDS
    measured = joined.select(
        *[f"k{k}" for k in range(len(keep_cols))],
        "_lang",
        n_words.alias("n_words"),
        c["word_chars"].alias("word_chars"),
        c["symbol"].alias("n_symbols"),
        c["n_dup_lines"].alias("n_dup_lines"),
        c["words"]["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.when(long, distance(F.col("_p_classes"), F.col("_q_classes"))).alias("js_characters"),
        F.when(long, F.round(distance(F.col("_p_words"), F.col("_q_words")), 6)).alias("js_words"),
    )
    measured = workspace.write(measured, "measured")

    # Sums of whole numbers do not depend on their order.
    millionths = F.round(F.col("js_words") * 1_000_000).cast("decimal(20,0)")
    usual = (
        measured.where(~F.col("base_failed") & F.col("js_words").isNotNull())
        .groupBy(F.col("_lang").alias("_of"))
        .agg(F.count("*").alias("n"), F.sum(millionths).cast("double").alias("s"), F.sum(millionths * millionths).cast("double").alias("s2"))
    )
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    most = F.greatest((mean + WORD_DEVIATIONS * deviation) / 1_000_000, F.lit(WORD_FLOOR))
    usual = workspace.write(usual.select("_of", most.alias("_most")), "usual")
    result = measured.join(usual, F.col("_lang").eqNullSafe(F.col("_of")), "left")
    diverges = F.coalesce(F.col("js_characters") > MOST_CHARACTERS, F.lit(False)) | F.coalesce(
        F.col("js_words") > F.col("_most"), F.lit(False)
    )
    return result.select(
        *[F.col(f"k{k}").alias(c) for k, c in enumerate(keep_cols)],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "js_characters",
        "js_words",
        (~F.col("base_failed") & ~diverges).alias("kept"),
    )
