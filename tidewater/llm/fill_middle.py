"""Fill-in-the-middle transformation by a counted quantifier.

``regexp_count`` gives a text's number of units (lines, by default). Two of its
borders are drawn by hash, and a pattern made for the row, with possessive
``unit{a}`` and ``unit{b-a}`` groups, captures prefix, middle and suffix in one
match that the replacement writes in the new order. Possessive groups repeat in
a loop without going back, so neither time nor stack grows with the square or
the number of units. One projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_of

#: A line with its end, or the last one without.
LINE = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PSM, SPM = f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and the identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output and its form were made of."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = LINE, seed: str = "7", percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row.

    n: units in the text. form: ``psm`` (prefix, suffix, middle), ``spm``
    (suffix, prefix, middle), or ``plain`` where output is the text itself: a
    text that is empty or null, that holds a mark of its own, or that the draw
    leaves alone (``percent`` of the others are cut). The character counts are
    code points, null if plain. ``unit`` is a pattern that cuts any text into
    pieces without a rest. Cuts depend on the seed and doc_id alone (a null one
    as an empty string), so rows repeated under one doc_id are cut at the same
    draws. An empty table gives no rows; other columns are ignored.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    h = draws(F.col("doc_id"), seed)
    n = F.regexp_count("text", F.lit(unit)).cast("long")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    drawn = own.select("doc_id", "text", n.alias("n"), *[x.alias(f"h{i}") for i, x in enumerate(h)])
    first, second = F.col("h0") % (F.col("n") + 1), F.col("h1") % (F.col("n") + 1)
    form = (F.when((F.col("text") == "") | marked | (F.col("h2") % 100 >= percent), "plain")
            .when(F.col("h3") % 100 < spm_percent, "spm").otherwise("psm"))
    cut = drawn.select("doc_id", "text", "n", form.alias("form"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
    whole = F.concat(F.lit(rf"(?s)\A((?:{unit}){{"), F.col("a").cast("string"), F.lit(rf"}}+)((?:{unit}){{"),
                     (F.col("b") - F.col("a")).cast("string"), F.lit(r"}+)(.*)\z"))
    order = F.when(F.col("form") == "spm", SPM).otherwise(PSM)
    written = cut.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", whole, order)).alias("output"))

    def between(left: str, right: str) -> Column:
        """Code points between two marks: a cut text holds each mark once."""
        return (F.instr("output", right) - F.instr("output", left) - len(left)).cast("long")

    prefix = F.when(F.col("form") == "psm", between(PREFIX, SUFFIX)).when(F.col("form") == "spm", between(PREFIX, MIDDLE))
    middle = F.length("output") - F.instr("output", MIDDLE) - (len(MIDDLE) - 1)
    return written.select("doc_id", "n", "form", prefix.alias("prefix_chars"),
                          F.when(F.col("form") != "plain", middle.cast("long")).alias("middle_chars"), "output")
