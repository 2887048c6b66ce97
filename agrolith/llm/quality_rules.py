"""Quality rules: counts of a text, and the divergence of its distributions from those of languages. DataFrame expressions only.

Two histograms of a text are compared with each language's: character classes, and common words (the `COMMON` most frequent words of each
language, all others as one). The references come from all documents: counts summed by the column of languages. The distance is
Jensen-Shannon's (the root of the divergence in bits, 0 to 1); a text's distance is that to the nearest language. Guards: class
distances count from `LEAST_CHARS` characters on, word distances from `LEAST_WORDS` words on; shorter texts are judged by counts alone.

Every text is handled in one row. Higher-order functions work on lambda variables only, so that no array is computed twice.

Defined results: null and empty texts have zero counts and fail the base rules; texts are read whole; rows without a language are judged
but don't shape a reference; without any reference there is no distance and the base rules decide; repeated rows get equal results;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.common import SPACE, forget, written

COMMON, LEAST_WORDS, LEAST_CHARS = 32, 100, 400
#: Distances from which on a text is rejected.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.32, 0.45
SYMBOLS = r"[#*$%&|<>]"
CLASSES = ("space", "upper", "digit", "symbol", "sign", "other", "lower")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), 0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def from_place(items: Column, place: int) -> Column:
    return F.slice(items, place, F.greatest(F.size(items), F.lit(1)))


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more; words is a lambda variable.

    Windows are compared by 64-bit hashes, within one text.
    """

    def covered(window: Column) -> Column:
        def positions(ranked: Column) -> Column:
            follows = F.zip_with(ranked, from_place(ranked, 2), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
            return bound(
                follows,
                lambda f: F.sort_array(
                    F.filter(
                        F.zip_with(ranked, F.zip_with(f, F.concat(F.array(F.lit(False)), f), lambda a, b: F.coalesce(a, F.lit(False)) | b), lambda r, twice: F.when(twice, r["i"])),
                        lambda i: i.isNotNull(),
                    )
                ),
            )

        ranked = F.sort_array(F.transform(window, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        total = bound(
            bound(ranked, positions),
            lambda at: F.aggregate(F.zip_with(at, from_place(at, 2), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda n, step: n + step),
        )
        return F.when(F.size(F.array_distinct(window)) < F.size(window), total).otherwise(0)

    def windows(h: Column) -> Column:
        pairs = F.zip_with(h, from_place(h, 2), lambda a, b: F.xxhash64(a, b))
        triples = F.zip_with(pairs, from_place(h, 3), lambda ab, c: F.xxhash64(ab, c))
        return F.slice(triples, 1, F.greatest(F.size(h) - 2, F.lit(0)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > 3, bound(bound(hashed, windows), covered)).otherwise(0)


def class_counts(text: Column) -> Column:
    """How many characters of each of CLASSES the text has, as an array."""
    t = F.coalesce(text, F.lit(""))
    counted = [F.regexp_count(t, F.lit(p)).cast("long") for p in (SPACE, "[A-Z]", "[0-9]", SYMBOLS, r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]", r"[^\x00-\x7F]")]
    return bound(
        F.struct(F.array(*counted).alias("some"), F.length(t).cast("long").alias("all")),
        lambda x: F.concat(x["some"], F.array(x["all"] - F.aggregate(x["some"], F.lit(0).cast("long"), lambda a, n: a + n))),
    )


def counts(docs: DataFrame, references: list[dict[str, float]], text: str, *others: str) -> DataFrame:
    """The base counts, the word distance and the character classes (in the order of CLASSES) of each row's text, beside the columns `others`."""
    t = F.coalesce(F.col(text), F.lit(""))
    worded = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    from_words = bound(
        words_of(t),
        lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"), word_distance(w, references).alias("distance")),
    )
    rows = docs.select(*others, from_words.alias("w"), F.length(t).alias("chars"), class_counts(t).alias("classes"), bound(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    return rows.select(
        *others,
        F.col("w.n_words").cast("long").alias("n_words"),
        (F.col("chars") - F.get("classes", 0)).alias("word_chars"),
        F.get("classes", CLASSES.index("symbol")).alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("w.distance").alias("word_distance"),
        "classes",
    )


def _term(p: Column, q: Column) -> Column:
    """A cell's part of the divergence in bits: p log2(p / m) / 2 + q log2(q / m) / 2 with m = (p + q) / 2."""

    def half(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (p + q)) / 2).otherwise(0.0)

    return half(p) + half(q)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def class_distance(classes: Column, references: list[list[float]]) -> Column:
    """Distance to the nearest of the languages' class shares; null without references or characters."""
    total = F.aggregate(classes, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = F.lit(references).cast("array<array<double>>") if references else F.lit(None).cast("array<array<double>>")
    shares = F.transform(classes, lambda x: x / total)
    return F.when(
        total > 0,
        bound(shares, lambda p: F.array_min(F.transform(rows, lambda q: _distance(F.aggregate(F.zip_with(p, q, _term), F.lit(0.0), lambda a, x: a + x))))),
    )


def word_distance(words: Column, references: list[dict[str, float]]) -> Column:
    """Distance of a text's shares of common words, all other words as one, to the nearest language; null without references or words.

    Words that the text lacks add half their share, so only the text's own common words are looked up.
    """
    vocabulary = sorted(set().union(*references)) if references else []
    if not vocabulary:
        return F.lit(None).cast("double")
    shares = F.create_map(*(x for w in vocabulary for x in (F.lit(w), F.lit([float(r.get(w, 0.0)) for r in references]))))
    rest = F.lit([max(0.0, 1.0 - sum(r.values())) for r in references])

    def runs(common: Column) -> Column:
        """(word, its count) of sorted words."""
        numbered = F.transform(common, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        lasts = F.filter(F.zip_with(numbered, from_place(common, 2), lambda m, after: F.when(after.isNull() | (after != m["w"]), m)), lambda m: m.isNotNull())
        return bound(lasts, lambda x: F.slice(F.zip_with(x, F.concat(F.array(F.lit(-1)), F.transform(x, lambda m: m["i"])), lambda m, before: F.struct(m["w"].alias("w"), (m["i"] - before).alias("n"))), 1, F.size(x)))

    def nearest(words: Column) -> Column:
        common = F.sort_array(F.filter(words, lambda w: w.isin(vocabulary)))
        found = F.transform(bound(common, runs), lambda r: F.struct((r["n"] / F.size(words)).alias("p"), F.element_at(shares, r["w"]).alias("q")))

        def to_language(cells: Column, k: Column) -> Column:
            known = F.aggregate(cells, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")), lambda a, c: F.struct((a["d"] + _term(c["p"], F.get(c["q"], k))).alias("d"), (a["p"] + c["p"]).alias("p"), (a["q"] + F.get(c["q"], k)).alias("q")))
            return bound(known, lambda a: _distance(a["d"] + F.greatest(1 - F.get(rest, k) - a["q"], F.lit(0.0)) / 2 + _term(F.greatest(1 - a["p"], F.lit(0.0)), F.get(rest, k))))

        return F.when(F.size(words) > 0, bound(found, lambda cells: F.array_min(F.transform(F.lit(list(range(len(references)))), lambda k: to_language(cells, k)))))

    return nearest(words)


def word_references(docs: DataFrame, text: str, lang: str, common: int = COMMON) -> list[dict[str, float]]:
    """Shares of the most frequent words of each language, from all rows that name one; `common` words for each come to the driver."""
    named = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(words_of(F.col(text))).alias("w"))
    each = written(named.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")))
    totals = {r[0]: r[1] for r in each.groupBy("lang").agg(F.sum("n")).collect()}
    words: dict[str, dict[str, float]] = {}
    for r in _most(each, common).collect():
        words.setdefault(r["lang"], {})[r["w"]] = r["n"] / totals[r["lang"]]
    forget(each)
    return [words[x] for x in sorted(words)]


def class_references(counted: DataFrame, lang: str) -> list[list[float]]:
    """Shares of the character classes in all rows of each language; a row for each language comes to the driver."""
    sums = counted.where(F.col(lang).isNotNull()).groupBy(lang).agg(*(F.sum(F.get("classes", k)) for k in range(len(CLASSES)))).collect()
    return [[x / sum(r[1:]) for x in r[1:]] for r in sorted(sums) if sum(r[1:])]


def _most(each: DataFrame, common: int) -> DataFrame:
    """The most frequent words of each language, ties by word, found in parts of the vocabulary first, so that no task ranks it all."""
    order = [F.desc("n"), F.asc("w")]
    parts = each.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(64)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= common)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= common).select("lang", "w", "n")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, counts, class_distance, word_distance, base_failed, kept) for each row. Texts are read twice: for the common words, and to be counted."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = written(counts(rows, word_references(rows, "text", "lang"), "text", "key", "lang"))
    judged = counted.withColumn("class_distance", class_distance(F.col("classes"), class_references(counted, "lang")))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    strange_classes = (F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x) >= LEAST_CHARS) & (F.col("class_distance") > MOST_CLASS_DISTANCE)
    strange_words = (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > MOST_WORD_DISTANCE)
    strange = F.coalesce(strange_classes, F.lit(False)) | F.coalesce(strange_words, F.lit(False))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance")
    return judged.select(F.col("key").alias(key), *names, base_failed.alias("base_failed"), (~base_failed & ~strange).alias("kept"))
