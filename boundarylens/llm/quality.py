"""Quality rules by distribution divergence, in DataFrame functions only.

Every text gets two histograms: of character classes and of common words. The common words of a language are
those that most of its documents hold, found in the corpus itself. References for each language
are the summed histograms of all its documents that pass the plain rules. A document is kept if both
Jensen-Shannon distances to its language's reference stay under limits that widen for short texts;
texts under a minimum length are not judged by divergence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundarylens.llm.common import SPACE, durable

#: So many common words a language; one histogram bin each, plus one for all other words.
COMMON_WORDS = 24
_CODES = " " + "".join(chr(65 + i) for i in range(COMMON_WORDS))  # of the other words and of each common one
#: A reference is an array of some 30 numbers, so so many of them take 3 MB; beyond that they are joined by a shuffle.
MOST_BROADCAST_LANGUAGES = 10_000
#: Common words of all languages together, as measured; beyond that they are joined by a shuffle.
MOST_BROADCAST_BYTES = 8_000_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for a row, however often `use` needs it."""
    return F.get(F.transform(F.array(value), use), 0)


def words_of(text: Column) -> Column:
    """Words as an array; empty for a text without any."""
    bare = F.trim(text, F.lit(" \t\n\v\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def _joined(values: Column, step: int) -> Column:
    """Hash of each value with the one `step` places on."""
    n = F.size(values) - step
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column, width: int) -> Column:
    """Words in windows that are found twice or more: by sorted (hash, place), equal neighbours, then the union of their spans."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def repeated(s: Column) -> Column:
        same = lambda x, i: F.coalesce(x.h == F.get(s, i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(s, i + 1).h, F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x.p))

    def spans(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1), x + width) - x))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    return let(placed, lambda s: let(repeated(s), spans))


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words in `width`-word windows (a power of two) found at least twice in the text, the first included."""

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w, width))

    def joined(values: Column, have: int) -> Column:
        return values if have == width else joined(let(values, lambda v: _joined(v, have)), 2 * have)

    def counted(ws: Column) -> Column:
        return let(joined(F.transform(ws, lambda w: F.xxhash64(w)), 1), count)

    return let(words, lambda ws: F.when(F.size(ws) < width, F.lit(0)).otherwise(counted(ws))).cast("long")


def _only(text: Column, kept: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _read(docs: DataFrame, text: str, doc_id: str, lang: str) -> DataFrame:
    """doc_id, lang (a key that is never null), t."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def common_words(docs: DataFrame, *, text: str = "text", lang: str = "lang", most: int = COMMON_WORDS) -> DataFrame:
    """lang (key), common: the words of each language that most of its documents hold, at most `most`, in that order; ties by the word.

    Documents count, not occurrences, so that one that repeats itself counts once. A language of blank texts has no row.
    """
    held = _read(docs, text, lang, lang).select("lang", F.explode(F.array_distinct(words_of(F.lower("t")))).alias("word"))
    counted = held.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    first = counted.withColumn("place", place).where(F.col("place") <= most)
    return first.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w")).select("lang", F.col("w.word").alias("common"))


def text_statistics(docs: DataFrame, words: DataFrame, text: str, doc_id: str, lang: str) -> DataFrame:
    """One row per document: the counts the rules need and the two histograms. words: (durable) common words of each language."""
    bytes_ = words.agg(F.sum(F.aggregate("common", F.lit(0), lambda a, w: a + F.octet_length(w)))).first()[0] or 0
    base = _read(docs, text, doc_id, lang).join(F.broadcast(words) if bytes_ <= MOST_BROADCAST_BYTES and words.count() <= MOST_BROADCAST_LANGUAGES else words, "lang", "left")
    size = F.length("t").cast("long")
    code = lambda w: F.substring(F.lit(_CODES), F.array_position("common", F.lower(w)).cast("int") + 1, F.lit(1))
    measured = base.select(
        "doc_id", "lang",
        let(words_of(F.col("t")), lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeated_words(ws).alias("n_repeat_words"),
            F.coalesce(F.array_join(F.transform(ws, code), ""), F.lit("")).alias("codes"),
        )).alias("w"),
        _only(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        let(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        size.alias("chars"),
        _only(F.col("t"), "A-Z").alias("upper"),
        _only(F.col("t"), "0-9").alias("digits"),
        _only(F.col("t"), ".,;:!?'\"()-").alias("points"),
        _only(F.col("t"), r"\x{80}-\x{10FFFF}").alias("wide"),
    )
    rest = F.col("chars") - F.col("upper") - F.col("digits") - F.col("points") - F.col("n_symbols") - F.col("wide") - (F.col("chars") - F.col("w.word_chars"))
    classes = F.array("upper", "digits", "points", "n_symbols", "wide", F.col("chars") - F.col("w.word_chars"), rest)
    counts = [(F.length("w.codes") - F.length(F.replace(F.col("w.codes"), F.lit(c), F.lit("")))).cast("long") for c in (*_CODES[1:], _CODES[0])]
    return measured.select(
        "doc_id", "lang", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words",
        classes.alias("classes"), F.array(*counts).alias("common"),
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (root of the divergence in bits) of two histograms of counts; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(s: Column) -> Column:
        both = F.zip_with(p, q, lambda x, y: F.struct((x / s.a).alias("x"), (y / s.b).alias("y")))
        terms = F.transform(both, lambda v: 0.5 * (part(v.x, (v.x + v.y) / 2) + part(v.y, (v.x + v.y) / 2)))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)))

    sums = F.struct(total(p).alias("a"), total(q).alias("b"))
    return let(sums, lambda s: F.when((s.a > 0) & (s.b > 0), of(s)))


def language_references(measured: DataFrame) -> DataFrame:
    """One row per language: both histograms summed over its documents."""
    bins = lambda name, n: F.array(*[F.sum(F.get(F.col(name), i)) for i in range(n)])
    return measured.groupBy("lang").agg(bins("classes", 7).alias("lang_classes"), bins("common", COMMON_WORDS + 1).alias("lang_common"))


def _compared(measured: DataFrame, references: DataFrame, limits: tuple[float, float], widening: tuple[float, float]) -> DataFrame:
    """Distances to the language's (durable) reference, and whether one of them is over its limit for so many words."""
    slack = lambda w: F.lit(w) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    over = [F.coalesce(c, F.lit(0.0)) > F.lit(most) + slack(w) for c, most, w in zip(("class_distance", "common_distance"), limits, widening, strict=True)]
    return measured.join(F.broadcast(references) if references.count() <= MOST_BROADCAST_LANGUAGES else references, "lang", "left").select(
        *measured.columns, jensen_shannon(F.col("classes"), F.col("lang_classes")).alias("class_distance"),
        jensen_shannon(F.col("common"), F.col("lang_common")).alias("common_distance"),
    ).withColumn("far", over[0] | over[1])


def quality_rules(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang",
    min_words: int = 40, limits: tuple[float, float] = (0.14, 0.22), widening: tuple[float, float] = (0.8, 1.2),
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, common_distance.

    A limit is its base value plus its widening / sqrt(words); class distance first, common words second. Texts under `min_words` words are judged by
    the plain rules alone, as are languages of which no document passes these. A null text is empty and
    fails; a null language is a language of its own, not the same as an empty one. Every row is judged for itself, repeated ids
    included. An empty table gives an empty result. Other columns are not read.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    words = durable(common_words(docs, text=text, lang=lang), "quality-words")
    measured = durable(text_statistics(docs, words, text, doc_id, lang).withColumn("base_failed", failed), "quality-statistics")
    first = durable(language_references(measured.where(~F.col("base_failed"))), "quality-first-references")
    near = _compared(measured.where(~F.col("base_failed")), first, limits, widening).where(~F.col("far"))
    references = durable(language_references(near), "quality-references")
    kept = ~F.col("base_failed") & ((F.col("n_words") < min_words) | ~F.col("far"))
    return _compared(measured, references, limits, widening).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), "class_distance", "common_distance",
    )
