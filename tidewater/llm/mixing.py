"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its share of all words by weight, at most ``cap`` times
what it has; the excess goes to the other sources by weight. target / size is
the expected number of copies of each of its words: the whole part are certain
copies of every document, the rest of the target is filled by one more copy of
some. Their inclusion probabilities are unequal, p = min(1, c * weight), with c
such that the expected words make up the rest; those that reach 1 are certain
copies too. The others are ranked by Pareto's random odds over inclusion odds,
u/(1-u) : p/(1-p), with u from the document's identifier, and the sample of
fixed size (in words) is the head of that ranking.

No source is sorted whole. c comes from one row per source and weight. The rank is mapped to (0, 1), summed in ``buckets``
equal bins per source, and only the bin in which the fixed size is reached is
ordered document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE, stage, text_of

WEIGHTS = (1, 2, 3)
CAP = 3
BUCKETS = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words: white space runs between words, plus one."""
    squeezed = F.regexp_replace(text, f"{SPACE}+", " ")
    body = F.trim(squeezed)
    return F.when(body == "", 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long")


def unit(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the seed and the identifier alone:
    the first 52 bits of an MD5, plus one half."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Water filling in closed form: sources in order of cap * size / weight are
    full as long as the level they need is at or under what the rest would get.
    The window runs over one row per source, after the aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pattern = F.array(*[F.lit(w) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    per = per.withColumn("weight", F.element_at(pattern, (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    full = F.col("source_size") * F.lit(cap)
    order = Window.orderBy(full / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("full", full)
           .withColumn("words_left", F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0)))
           .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    exact = "decimal(38,0)"
    is_full = F.col("full").cast(exact) * F.col("weight_left") <= F.col("words_left").cast(exact) * F.col("weight")
    # The level is that of the first source in this order that isn't full.
    per = per.withColumn("is_full", is_full)
    per = per.withColumn("level", F.max(F.when(~F.col("is_full"), F.struct("weight_left", "words_left"))).over(everything))
    share = (F.col("weight") * F.col("level.words_left")).cast("double") / F.col("level.weight_left").cast("double")
    target = F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(share)
    return per.select("source", "source_size", "weight", target.alias("target"))


def inclusion_odds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(of, odd, certain, room, left, odds): per source and weight whether its
    documents are certain, the words left for those that aren't, and their
    odds p/(1-p). A weight is certain if c * weight reaches 1 with all heavier
    ones certain; the window runs over one row per source and weight."""
    classes = sized.groupBy("source", "odd").agg(F.sum("size").alias("words")).withColumn("mass", F.col("odd") * F.col("words"))
    classes = classes.join(plan.select("of", "rest"), classes["source"].eqNullSafe(F.col("of"))).drop("source")
    heavier = Window.partitionBy("of").orderBy(F.desc("odd"))
    lighter = Window.partitionBy("of").orderBy("odd")
    classes = (classes.withColumn("above", F.coalesce(F.sum("words").over(heavier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("upto", F.sum("mass").over(lighter.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    certain = (F.col("rest") > 0) & (F.col("words") > 0) & (F.col("odd") * (F.col("rest") - F.col("above")) >= F.col("upto"))
    classes = classes.withColumn("certain", certain)
    whole = Window.partitionBy("of").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    classes = (classes.withColumn("sure", F.coalesce(F.sum(F.when(F.col("certain"), F.col("words"))).over(whole), F.lit(0)))
               .withColumn("open", F.coalesce(F.sum(F.when(~F.col("certain"), F.col("mass"))).over(whole), F.lit(0.0)))
               .withColumn("room", F.col("rest") - F.col("sure")))
    p = F.when(F.col("open") > 0, F.col("room") / F.col("open") * F.col("odd")).otherwise(F.lit(0.0))
    return classes.select("of", "odd", "certain", "room", (p / F.greatest(1 - p, F.lit(1e-300))).alias("odds"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, buckets: int = BUCKETS,
        inclusion_weight: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row.

    ``inclusion_weight`` (a positive expression over (doc_id, source, size) or
    the columns of ``docs``, of few different values) is what inclusion
    probabilities are proportional to; default the whole root of the size, so
    that long documents are likelier and short ones keep a share. Null text has
    size 0; a null source is a source of its own, the last one. Ties in the
    ranking go by doc_id, then size. Rows repeated under one doc_id are rows of
    their own. Sources without words have target 0. An empty table gives no
    rows; other columns are ignored.
    """
    text = text_of(docs)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(text).alias("size"),
                      (inclusion_weight if inclusion_weight is not None else F.lit(None)).cast("double").alias("odd"))
    sized = stage(own.withColumn("odd", F.coalesce("odd", F.floor(F.sqrt("size")).cast("double"))), "sizes")
    targets = stage(source_targets(sized.select("source", "size"), weights, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = (targets.withColumn("whole", F.floor(ratio).cast("long"))
            .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
            .withColumnRenamed("source", "of"))
    chances = stage(inclusion_odds(sized, plan), "inclusion").withColumnsRenamed({"of": "__of", "odd": "__odd"})
    joined = (sized.join(plan, sized["source"].eqNullSafe(plan["of"]))
              .join(chances, sized["source"].eqNullSafe(F.col("__of")) & (sized["odd"] == F.col("__odd"))).drop("__of", "__odd"))
    # Pareto's ratio u/(1-u) : p/(1-p) as a number from 0 to 1.
    u = unit(F.col("doc_id"), seed)
    rank = u / (u + F.col("odds") * (1 - u))
    ranked = joined.withColumn("rank", rank).withColumn("bin", F.floor(rank * buckets).cast("int"))
    drawn = ranked.where(~F.col("certain"))
    bins = stage(drawn.groupBy("of", "bin").agg(F.sum("size").alias("words"), F.first("room").alias("room")), "bins")
    running = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.sum("words").over(running))
    # The first bin that reaches the fixed size; each source has a row, also if none does.
    edge = bins.groupBy("of").agg(F.min(F.when(F.col("upto") >= F.col("room"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))).alias("edge"))
    edge = stage(edge.select(F.col("of").alias("at"), F.coalesce("edge.bin", F.lit(buckets + 1)).alias("edge_bin"), F.coalesce("edge.before", F.lit(0)).cast("long").alias("before")), "edges")
    placed = drawn.join(edge, drawn["of"].eqNullSafe(edge["at"])).drop("at")
    inside = placed.where(F.col("bin") == F.col("edge_bin"))
    head = Window.partitionBy("of").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The document on the edge is in if that comes nearer to the fixed size.
    inside = inside.withColumn("extra", 2 * (F.sum("size").over(head) + F.col("before")) - F.col("size") <= 2 * F.col("room"))
    outside = placed.where(F.col("bin") != F.col("edge_bin")).withColumn("extra", F.col("bin") < F.col("edge_bin"))
    sure = ranked.where("certain").withColumns({"edge_bin": F.lit(0), "before": F.lit(0).cast("long"), "extra": F.lit(True)})
    out = inside.unionByName(outside).unionByName(sure)
    copies = F.col("whole") + F.when(F.col("extra") & (F.col("rest") > 0), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows repeated
    under one doc_id are each taken as often as the mix takes the row that it
    takes most."""
    copies = mix(docs, **options).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("__copies")).withColumnRenamed("doc_id", "__taken")
    names = docs.columns
    joined = docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(copies["__taken"]))
    return joined.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*names)
