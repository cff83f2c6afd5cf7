"""Document quality by distribution divergence, in DataFrame operations alone.

A document is described by two histograms: how its characters fall into classes, and how often it uses the most
common words of its language. Both are compared by Jensen-Shannon distance (base 2, so from 0 to 1) with
references gathered over all documents of the language. A document fails where a distance is beyond its limit;
documents shorter than the minimum length are not judged by distances, since a few words make no histogram.

Defined cases: a null or empty text has no words and fails the base rule; a null language
counts as the empty one, with a reference of its own; rows that repeat count again; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypost.llm.common import settled
from waypost.operators.sizing import broadcast_if_small

#: Fixed values of the base rules.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEATED_PERCENT = 50

#: Classes of characters, as patterns, in the order of the histogram; all other characters make the last class.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]", r"[#*$%&|<>@+=/\\^~_{}\[\]]")
#: Words in a language's reference.
COMMON_WORDS = 40
#: Limits of the two distances, and the least characters and words for them to count. A text without any common word has
#: a word distance of 0.43 where these make a third of the tokens; the limit is below that.
CLASS_LIMIT, WORD_LIMIT, MIN_CHARS, MIN_JUDGED = 0.25, 0.42, 200, 50
#: Languages whose references may be broadcast.
MAX_LANGUAGES = 1000


def with_repeats(df: DataFrame) -> DataFrame:
    """Add n_repeat_words from `_words`: words in three-word windows that occur twice or more in the text.

    Each word is hashed once; the hashes of neighbours are combined to those of pairs, and these to those of windows.
    Where some window occurs again, the windows' hashes are sorted with their positions, so equal ones are neighbours.
    The positions of the repeated ones, sorted again, cover three words each less what they overlap. Every step is its
    own projection: an expression that is used more than once is then evaluated once.
    """

    def neighbours(column):
        return F.zip_with(column, F.slice(column, F.lit(2), F.size(column)), lambda a, b: F.xxhash64(a, b))

    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_pairs", neighbours("_hashes"))
    # The last two of these lack a word.
    df = df.withColumn("_keys", F.slice(neighbours("_pairs"), F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))))
    windows = F.transform("_keys", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("_keys")) < F.size("_keys")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(windows))).withColumn("_keys", F.col("_sorted.h"))
    # 1 where a window equals the next one in order; each such mark also covers that next one.
    same = F.zip_with("_keys", F.slice("_keys", F.lit(2), F.size("_keys")), lambda a, b: a.eqNullSafe(b))
    df = df.withColumn("_same", same)
    hit = F.zip_with(F.concat(F.array(F.lit(False)), "_same"), "_same", lambda a, b: a | F.coalesce(b, F.lit(False)))
    at = F.filter(F.zip_with("_sorted", hit, lambda x, y: F.when(y, x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_at", F.sort_array(at))
    gaps = F.zip_with("_at", F.slice("_at", F.lit(2), F.size("_at")), lambda i, j: F.least(F.lit(3), F.coalesce(j - i, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0), lambda total, x: total + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
    return df.drop("_hashes", "_pairs", "_keys", "_sorted", "_same", "_at")


def base_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with `_text`."""
    df = docs.withColumn("_words", F.filter(F.split("_text", SPACE + "+"), lambda w: w != ""))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(NOT_SPACE))
    df = df.withColumn("_lines", lines).select(
        "*",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
    )
    df = with_repeats(df).drop("_words", "_lines")
    return df.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    )


def with_classes(df: DataFrame) -> DataFrame:
    """Add `_chars` and `_classes` (characters of each class, and the rest) from `_text`.

    No character is in two classes, so each is counted in what the ones before it leave, by a projection of its own.
    """
    df = df.withColumn("_chars", F.length("_text")).withColumn("_left0", F.col("_text"))
    for i, c in enumerate(CLASSES):
        df = df.withColumn(f"_left{i + 1}", F.regexp_replace(f"_left{i}", f"(?:{c})+", ""))
    left = [F.length(f"_left{i}").cast("bigint") for i in range(len(CLASSES) + 1)]
    df = df.withColumn("_classes", F.array(*[a - b for a, b in zip(left, left[1:])], left[-1]))
    return df.drop(*[f"_left{i}" for i in range(len(CLASSES) + 1)])


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def with_text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"))


def common_words(docs: DataFrame) -> DataFrame:
    """One row per language with words (_ref_lang): its commonest words and their counts, over all its documents."""
    counted = with_text(docs).select("_lang", F.explode(letter_words(F.col("_text"))).alias("word"))
    counted = counted.groupBy("_lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS)
    listed = top.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    return listed.select(F.col("_lang").alias("_ref_lang"), F.col("top.word").alias("_common"), F.col("top.n").alias("_common_n"))


def describe(docs: DataFrame, common: DataFrame) -> DataFrame:
    """One pass over the texts: the base counts, the characters of each class, and the uses of each common word."""
    df = with_classes(base_counts(with_text(docs)))
    df = df.withColumn("_tokens", letter_words(F.col("_text"))).withColumn("n_tokens", F.size("_tokens").cast("bigint")).drop("_text")
    listed = common.select("_ref_lang", "_common", F.array_max(F.transform("_common", F.length)).alias("_longest"))
    df = df.join(broadcast_if_small(listed, MAX_LANGUAGES), F.col("_lang") == F.col("_ref_lang"), "left").drop("_ref_lang")
    may = F.filter("_tokens", lambda w: F.length(w) <= F.col("_longest"))
    # Two blanks between words, so that " word " never overlaps its neighbour.
    df = df.withColumn("_listed", F.concat(F.lit("  "), F.array_join(may, "  "), F.lit("  "))).drop("_tokens")

    def uses(word):
        marked = F.concat(F.lit(" "), word, F.lit(" "))
        return (F.octet_length("_listed") - F.octet_length(F.replace(F.col("_listed"), marked, F.lit("")))) / F.octet_length(marked)

    none = F.array().cast("array<double>")
    return df.withColumn("_uses", F.coalesce(F.transform("_common", uses), none)).drop("_listed", "_common", "_longest")


def references(described: DataFrame, common: DataFrame) -> DataFrame:
    """One row per language (_ref_lang): class shares and the shares of its common words, over all its documents."""
    n = len(CLASSES) + 1
    sums = [F.sum(F.get("_classes", F.lit(i))).alias(f"c{i}") for i in range(n)]
    classes = described.groupBy("_lang").agg(*sums, F.sum("_chars").alias("chars"), F.sum("n_tokens").alias("tokens"))
    shares = F.array(*[F.col(f"c{i}") / F.greatest(F.col("chars"), F.lit(1)) for i in range(n)])
    joined = classes.join(common, F.col("_lang") == F.col("_ref_lang"), "left")
    words_total = F.greatest(F.col("tokens"), F.lit(1))
    word_shares = F.transform("_common_n", lambda n: n / words_total)
    rest = F.lit(1.0) - F.aggregate(word_shares, F.lit(0.0), lambda a, x: a + x)
    return joined.select(
        F.col("_lang").alias("_ref_lang"),
        shares.alias("_ref_classes"),
        F.coalesce(F.concat(word_shares, F.array(rest)), F.array(F.lit(1.0))).alias("_ref_words"),
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms in the same order, base 2."""

    def half(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda total, x: total + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, *, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, the base counts, class_distance, word_distance, kept of every document (doc_id, text, lang)."""
    common = settled(common_words(docs), "common")
    described = settled(describe(docs, common), "described")
    reference = broadcast_if_small(settled(references(described, common), "references"), MAX_LANGUAGES)
    df = described.join(reference, F.col("_lang") == F.col("_ref_lang"), "left")
    total = F.greatest(F.col("_chars"), F.lit(1))
    histogram = F.transform("_classes", lambda n: n / total)
    df = df.withColumn("_histogram", histogram)
    tokens = F.greatest(F.col("n_tokens"), F.lit(1))
    word_shares = F.transform("_uses", lambda n: n / tokens)
    df = df.withColumn("_shares", word_shares)
    rest = F.lit(1.0) - F.aggregate("_shares", F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("class_distance", divergence(F.col("_histogram"), F.col("_ref_classes")))
    df = df.withColumn("word_distance", divergence(F.concat("_shares", F.array(rest)), F.col("_ref_words")))
    odd_classes = (F.col("_chars") >= MIN_CHARS) & (F.col("class_distance") > class_limit)
    odd_words = (F.col("n_tokens") >= MIN_JUDGED) & (F.col("word_distance") > word_limit)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~odd_classes & ~odd_words).alias("kept"), "class_distance", "word_distance",
    )
