"""SimHash near-duplicates: a byte-position index with count filtering.

Two 64-bit fingerprints within 3 bits differ in at most 3 of their 8 bytes, so
they share at least 5 positional bytes. A posting list per single (position,
byte) would hold 1/256 of all rows and its pairs would grow with the square of
the table. The index therefore posts each distinct fingerprint under every set
of 5 positions with the 5 bytes found there (56 postings of 40 bits). Every
pair that reaches the guaranteed minimum meets there; it is tallied (shared
positional bytes), emitted only from the first 5 positions that it shares,
kept from 5 on, and verified by its bit distance. Since a posting already
stands for 5 shared bytes, the tally can drop no pair that met: the count
filter is the index itself, and what it spares are the pairs that share fewer.

A posting list over ``max_posting`` fingerprints (a huge group of near copies)
is not paired up. Its members are linked exactly in linear space: each posts
itself under all values within 1 and within 2 bits; whatever is within 2 bits
of a value links to the smallest fingerprint within 1 bit of it. Two
fingerprints within 3 bits always meet at such a value, and all links made this
way are within 3 bits, so the components are the same.

Spark sizes a table after an explode as one row for each row before it, here up
to 2,081 times too low, and would broadcast it. Each join over such rows says how
it is done: as a merge join, unless the counted rows are few.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewater.llm.common import record_batches, stage, workers_import
from tidewater.llm.graph import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
POSITIONS = 8
#: Values within 1 bit of so many members of overlong postings are broadcast.
FEW_MEMBERS = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed integer; no words give 0."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII space change
    if not found:
        return 0
    n = max(1, len(found) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # some shingles at a time
        part = min(65536, n - at)
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[i:i + shingle]), SEED) for i in range(at, at + part)), np.uint64, part)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; Arrow batches, a few MB of text at a time."""

    def run(batches):
        for batch in record_batches(batches, "text", 8 << 20):
            fps = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    workers_import(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _position_sets(need: int) -> list[tuple[int, int, int]]:
    """(positions as bits, bits up to the last position, byte mask)."""
    out = []
    for chosen in combinations(range(POSITIONS), need):
        bits = sum(1 << p for p in chosen)
        out.append((bits, (2 << chosen[-1]) - 1, _signed(sum(255 << 8 * p for p in chosen))))
    return out


def shared_positions(x: Column) -> Column:
    """Bits of the positions at which the XOR of two fingerprints is zero."""
    total = F.lit(0)
    for p in range(POSITIONS):
        same = F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0
        total = total + F.when(same, F.lit(1 << p)).otherwise(F.lit(0))
    return total


def _near_values(bits: int) -> list[tuple[int, int]]:
    """(mask, number of bits) for every mask of up to ``bits`` bits."""
    return [(_signed(sum(1 << b for b in chosen)), n) for n in range(bits + 1) for chosen in combinations(range(64), n)]


def _star_links(heavy: DataFrame, max_bits: int) -> DataFrame:
    """Links of the members of overlong postings, linear in their number."""
    inner, outer = max_bits // 2, max_bits - max_bits // 2
    masks = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(n).alias("n")) for m, n in _near_values(outer)]))
    posted = heavy.select("fp", masks.alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m.mask")).alias("at"), F.col("m.n").alias("n"))
    centres = posted.where(F.col("n") <= inner).groupBy("at").agg(F.min("fp").alias("centre"))
    centres = centres.hint("broadcast" if heavy.count() <= FEW_MEMBERS else "merge")
    return posted.join(centres, "at").where("fp <> centre").select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_posting: int = 256) -> DataFrame:
    """(a, b) between distinct fingerprints (column ``fp``) that connect all
    fingerprints within ``max_bits`` bits; every link is within them."""
    need = POSITIONS - max_bits
    sets = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.lit(u).alias("upto"), F.lit(m).alias("mask")) for b, u, m in _position_sets(need)]))
    posted = (fps.select("fp", sets.alias("s"))
              .select("fp", F.col("s.bits").alias("bits"), F.col("s.upto").alias("upto"), F.col("fp").bitwiseAND(F.col("s.mask")).alias("key")))
    long_lists = stage(posted.groupBy("bits", "key").count().where(F.col("count") > max_posting).select("bits", "key"), "heavy")
    light = posted.join(long_lists, ["bits", "key"], "left_anti")
    left = light.select("bits", "upto", "key", F.col("fp").alias("a"))
    right = light.select("bits", "key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (left.join(right.hint("merge"), ["bits", "key"]).where("a < b")
             .withColumn("shared", shared_positions(x))
             .where(F.col("shared").bitwiseAND(F.col("upto")) == F.col("bits"))  # once a pair
             .where(F.bit_count("shared") >= need)
             .where(F.bit_count(x) <= max_bits)
             .select("a", "b"))
    if long_lists.isEmpty():
        return pairs
    members = stage(posted.join(long_lists, ["bits", "key"], "left_semi").select("fp").distinct(), "members")
    return pairs.union(_star_links(members, max_bits))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, max_posting: int = 256) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Null and empty texts have fingerprint zero, which links like any other.
    component_id is the smallest doc_id reachable; a null doc_id never is one.
    Repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored.
    """
    found = _components(fingerprints(docs, shingle), max_bits, max_posting)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(marked: DataFrame, max_bits: int = MAX_BITS, max_posting: int = 256) -> DataFrame:
    """``marked`` (doc_id, fp) with component_id and root, a fingerprint that
    identifies the component: two may have the same smallest doc_id."""
    marked = stage(marked, "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp"), max_bits, max_posting))
    classes = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(roots, "root").select("fp", "component_id", "root")
    return marked.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id", "root")  # repeated rows make small files of any number


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` of which each group keeps the smallest doc_id. Rows
    under one doc_id are told apart by their fingerprints: each group that
    keeps it keeps one of them. Rows without a doc_id can't be told apart from
    others and stay."""
    groups = stage(_components(fingerprints(docs, shingle), max_bits), "groups")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    repeated = stage(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__rep")), "repeated")
    own = docs["doc_id"].cast("long")
    if repeated.isEmpty():
        return docs.join(gone, own == gone["__gone"], "left_anti")
    once = docs.join(repeated, own == repeated["__rep"], "left_anti")
    once = once.join(gone, once["doc_id"].cast("long") == gone["__gone"], "left_anti")
    several = _with_fingerprint(docs.join(repeated, own == repeated["__rep"], "left_semi"), shingle)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__of"), F.col("fp").alias("__fp_of"), F.col("root").alias("__root")).distinct()
    several = several.join(kept, (several["doc_id"].cast("long") == kept["__of"]) & (several["__fp"] == kept["__fp_of"]))
    return once.union(several.dropDuplicates(["doc_id", "__root"]).select(*docs.columns))


def _with_fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """Whole rows with their fingerprint."""
    def run(batches):
        for batch in record_batches(batches, "__text", 8 << 20):
            fps = [fingerprint(t, shingle) for t in batch.column("__text").to_pylist()]
            yield batch.append_column("__fp", pa.array(fps, pa.int64()))

    rows = docs.withColumn("__text", docs["text"].cast("string"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("__fp", LongType())]))
