"""Quality rules by distribution divergence.

Each document's histograms over character classes and over common words are
compared with those of its language by Jensen-Shannon distance (base 2, 0 to
1); a document without a language is compared with the whole corpus. The
references are counted over all documents and all their words: class totals,
and the ``n_common`` most frequent words. A text too short for a histogram is
not judged by it. Only DataFrame operations.

The words are counted first (per language, reduced in each task before they are
shuffled), so that the pass over the texts keeps one count per common word and
not one per word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE, let, stage, text_of, words


@dataclass(frozen=True)
class Limits:
    """Production parameters."""

    min_words: int = 50            # fewer: base_failed
    max_repeat_percent: int = 50   # more repeated words: base_failed
    n_common: int = 40
    min_class_chars: int = 200     # guard of the character-class distance
    max_class_distance: float = 0.2
    min_histogram_words: int = 100  # guard of the common-word distance
    max_word_distance: float = 0.35


#: Character classes in order; the first is what no other class holds.
CLASSES = ("letters a to z", "letters A to Z", "digits", "white space", "ASCII punctuation", "beyond ASCII")
UPPER, DIGITS, PUNCTUATION, BEYOND = "[A-Z]+", "[0-9]+", "[!-/:-@\\[-`{-~]+", "[^\\x00-\\x7F]+"
SYMBOLS = "[#*$%&|<>]+"
#: Windows are first compared by 44 hash bits packed over 20 bits of position.
POSITION_BITS = 20
#: A word whose hash has none of the common words' slots is none of them.
SLOTS = 1024


def _count(text: Column, pattern: str) -> Column:
    """Code points of ``text`` in runs of ``pattern``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def class_counts(text: Column) -> Column:
    """(classes, n_symbols): one count per class, controls counting with the
    first. One pass drops blanks and a to z, the bulk of most texts; the other
    patterns read the rest."""

    def counted(rest: Column) -> Column:
        inner = F.array(_count(rest, UPPER), _count(rest, DIGITS), _count(rest, r"[\x09-\x0D]+"), _count(rest, PUNCTUATION), _count(rest, BEYOND))
        blanks = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")
        size = F.length(text).cast("long")
        classes = let(inner, lambda c: F.array(size - blanks - c[0] - c[1] - c[2] - c[3] - c[4], c[0], c[1], c[2] + blanks, c[3], c[4]))
        return F.struct(classes.alias("classes"), _count(rest, SYMBOLS).alias("n_symbols"))

    return let(F.regexp_replace(text, "[a-z ]+", ""), counted)


def _covered(at: Column) -> Column:
    """Words under windows of three that start at the ascending positions."""
    gaps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _repeated_by_text(tokens: Column, starts: Column) -> Column:
    """Ascending positions of repeated windows, by sorting "w1 w2 w3 position":
    a word holds no blank, so equal windows are neighbours."""
    marked = F.transform(starts, lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2), F.lpad(i.cast("string"), 10, "0")))

    def repeated(order: Column, body: Column) -> Column:
        found = F.transform(order, lambda x, i: F.when(
            F.get(body, i).eqNullSafe(F.get(body, i - 1)) | F.get(body, i).eqNullSafe(F.get(body, i + 1)), F.right(x, F.lit(10)).cast("int")))
        return F.sort_array(F.filter(found, lambda p: p.isNotNull()))

    return let(F.sort_array(marked), lambda order: let(
        F.transform(order, lambda x: F.substring(x, 1, F.length(x) - 11)), lambda body: repeated(order, body)))


def _repeated(tokens: Column, packed: Column) -> Column:
    """The same by sorting hashes packed with positions. Only what has a
    neighbour of equal hash goes on; such neighbours are compared word by word;
    if a pair differs, or the positions don't fit, the texts are sorted instead,
    so the result is exact."""
    low = (1 << POSITION_BITS) - 1

    def hash_of(x: Column) -> Column:
        return F.shiftright(x, POSITION_BITS)

    def shared(every: Column) -> Column:
        """Runs of equal hashes; windows of a hash of their own are left out."""
        return F.filter(every, lambda x, i: (hash_of(x) == hash_of(F.get(every, i + 1))) | (hash_of(x) == hash_of(F.get(every, i - 1))))

    def pair(x: Column, y: Column) -> Column:
        """0: other windows, 1: equal, 2: equal hashes of other windows."""
        a, b = x.bitwiseAND(F.lit(low)).cast("int"), y.bitwiseAND(F.lit(low)).cast("int")
        equal = (F.get(tokens, a) == F.get(tokens, b)) & (F.get(tokens, a + 1) == F.get(tokens, b + 1)) & (F.get(tokens, a + 2) == F.get(tokens, b + 2))
        return F.when(y.isNull() | (hash_of(x) != hash_of(y)), 0).when(equal, 1).otherwise(2)

    def positions(order: Column) -> Column:
        return F.sort_array(F.transform(order, lambda x: x.bitwiseAND(F.lit(low)).cast("int")))

    by_text = _repeated_by_text(tokens, F.sequence(F.lit(0), F.size(tokens) - 3))
    exact = let(F.sort_array(packed), lambda every: let(shared(every), lambda order: F.when(
        F.exists(F.transform(order, lambda x, i: pair(x, F.get(order, i + 1))), lambda p: p == 2), by_text).otherwise(positions(order))))
    return F.when(F.size(tokens) <= low, exact).otherwise(by_text)


def repeated_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: n log n in the
    words of a document, of small steps for windows that occur once."""
    packed = F.transform(F.slice(tokens, 1, F.size(tokens) - 2), lambda w, i: F.shiftleft(
        F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")))
    return F.when(F.size(tokens) < 3, 0).otherwise(let(_repeated(tokens, packed), _covered)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _slot(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def slots_of(common: Column) -> Column:
    """Which slots the words ``common`` have, as an array of booleans."""
    return let(F.transform(common, _slot), lambda taken: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.array_contains(taken, i)))


def counts_of(tokens: Column, common: Column, slots: Column | None = None) -> Column:
    """How often each of the distinct words ``common`` is in ``tokens``: the
    others are left out, the rest is sorted and its runs are counted. With
    ``slots`` (``slots_of(common)``) most others are not compared with each."""

    def counts(order: Column) -> Column:
        last = F.filter(F.transform(order, lambda w, i: F.when(
            ~w.eqNullSafe(F.get(order, i + 1)), F.struct(w.alias("w"), (i + 1).alias("upto")))), lambda e: e.isNotNull())
        return let(last, lambda e: F.map_from_entries(F.transform(e, lambda x, i: F.struct(
            x["w"], (x["upto"] - F.coalesce(F.get(e, i - 1)["upto"], F.lit(0))).cast("long")))))

    def is_common(w: Column) -> Column:
        return F.array_contains(common, w) if slots is None else F.get(slots, _slot(w)) & F.array_contains(common, w)

    found = let(F.sort_array(F.filter(tokens, is_common)), counts)
    return let(found, lambda m: F.transform(common, lambda w: F.coalesce(F.try_element_at(m, w), F.lit(0).cast("long"))))


def common_words(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(of, common, common_shares): per language, and for all documents in the
    row whose language is null, the most frequent words (ties by code point)
    and their shares of all words, followed by the rest's share."""
    counted = (docs.select(docs["lang"].cast("string").alias("lang"), F.explode(words(text_of(docs))).alias("word"))
               .groupBy("lang", "word").agg(F.count("*").alias("n")))
    counted = stage(counted, "words")
    everywhere = counted.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("of"), "word", "n")
    each = counted.where("lang IS NOT NULL").select(F.col("lang").alias("of"), "word", "n").unionByName(everywhere)
    top = each.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("n"), "word"))).where(F.col("place") <= limits.n_common)
    lists = top.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("t"))
    totals = each.groupBy("of").agg(F.sum("n").alias("total")).withColumnRenamed("of", "to")
    both = lists.join(totals, lists["of"].eqNullSafe(totals["to"]))
    shares = F.transform("t.n", lambda x: x.cast("double") / F.col("total"))
    return both.select("of", F.col("t.word").alias("common"), with_rest(shares).alias("common_shares"))


def document_profiles(docs: DataFrame, common: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All that the rules need of a text, in one pass over it: the base counts,
    the class counts and the counts of its language's common words."""
    text = text_of(docs)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), text.alias("text"))
    common = common.withColumn("slots", slots_of(F.col("common")))  # once a language
    own = own.join(common, own["lang"].eqNullSafe(common["of"]), "left").drop("of")
    text = F.col("text")
    per_word = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
        F.when(F.col("common").isNotNull(), counts_of(w, F.col("common"), F.col("slots"))).alias("common_counts")))
    return own.select("doc_id", "lang", F.length(text).cast("long").alias("size"), class_counts(text).alias("c"),
                      duplicate_lines(text).alias("n_dup_lines"), per_word.alias("w"), "common_shares"
                      ).select("doc_id", "lang", "size", "c.*", "n_dup_lines", "w.*", "common_shares")


def class_references(profiles: DataFrame) -> DataFrame:
    """(of, ref_classes): the shares of the character classes per language, and
    of all documents where it is null."""
    n = len(CLASSES)
    sums = [F.sum("size").alias("size"), *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n)]]
    per = profiles.groupBy("lang").agg(*sums)
    whole = per.agg(F.sum("size").alias("size"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]).withColumn("lang", F.lit(None).cast("string"))
    shares = F.array(*[F.col(f"c{i}").cast("double") / F.col("size") for i in range(n)])
    return per.where("lang IS NOT NULL").unionByName(whole).where("size > 0").select(F.col("lang").alias("of"), shares.alias("ref_classes"))


def references(docs: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """The (common words, class shares) of ``docs`` as written tables."""
    common = stage(common_words(docs, limits), "common-words")
    return common, stage(class_references(document_profiles(docs, common, limits)), "class-shares")


def with_rest(shares: Column) -> Column:
    return let(shares, lambda s: F.concat(s, F.array(F.lit(1.0) - F.aggregate(s, F.lit(0.0), lambda a, x: a + x))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def judge_quality(docs: DataFrame, limits: Limits = Limits(), against: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept) per row.

    kept is false if base_failed, or if a distance that its length guard allows
    is over its limit. A null lang is judged by the whole corpus. A distance is
    null under its guard and for a language that ``against`` (default: the
    references of ``docs``) lacks; then it rejects nothing. Null text has no
    words and fails the base. Repeated rows repeat; an empty table gives no
    rows; other columns are ignored.
    """
    common = stage(common_words(docs, limits), "common-words") if against is None else against[0]
    profiles = stage(document_profiles(docs, common, limits), "profiles")
    classes = stage(class_references(profiles), "class-shares") if against is None else against[1]
    both = profiles.join(classes, profiles["lang"].eqNullSafe(classes["of"]), "left")
    class_shares = F.transform("classes", lambda x: x.cast("double") / F.col("size"))
    word_shares = with_rest(F.transform("common_counts", lambda n: n.cast("double") / F.col("n_words")))
    classes_judged = (F.col("size") >= limits.min_class_chars) & F.col("ref_classes").isNotNull()
    words_judged = (F.col("n_words") >= limits.min_histogram_words) & F.col("common_counts").isNotNull()
    measured = both.withColumn("class_distance", F.when(classes_judged, js_distance(class_shares, F.col("ref_classes")))) \
                   .withColumn("word_distance", F.when(words_judged, js_distance(word_shares, F.col("common_shares"))))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > limits.max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > limits.max_word_distance)
    return measured.select(
        "doc_id", "n_words", (F.col("size") - F.get("classes", F.lit(CLASSES.index("white space")))).alias("word_chars"), "n_symbols", "n_dup_lines",
        "n_repeat_words", failed.alias("base_failed"), F.round("class_distance", 6).alias("class_distance"),
        F.round("word_distance", 6).alias("word_distance"), (~failed & ~far).alias("kept"))
