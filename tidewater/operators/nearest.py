"""Exact nearest neighbours over a metric index.

The angle between two vectors is a metric, so distances to a few pivots bound
the distance to everything else. The collection is dealt to its nearest pivot
and each pivot's cell is cut into rings by distance; a (pivot, ring) is a block
with its exact inner and outer radius, stored in chunks of about ``chunk_rows``
documents, one row each.

A question first visits the blocks that lie nearest until they hold k
documents. Its k-th best angle then bounds the search: only blocks that the
triangle inequality can't exclude are visited in the second round. Both rounds
send a question only to the blocks it needs; a block that many questions need
is copied once per ``question_rows`` of them, so no task holds all of either.

The layout (pivots, rings, radii) is at most ``pivots * rings`` entries a
representation, whatever the collection's size; it is all that is broadcast.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidewater.functions import bound
from tidewater.session import shared_path

#: Angles are compared with this slack, which covers their rounding.
SLACK = 1e-6
#: Cosines of a matrix product are trusted to this; nearer ones are computed again.
CHOICE = 1e-9


@dataclass(frozen=True)
class Layout:
    """Sizes of an index. ``pivots`` and ``rings`` bound what is broadcast."""

    pivots: int = 32
    rings: int = 32
    chunk_rows: int = 1024
    question_rows: int = 4096


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def similarity(a: Column, a_norm: Column, b: Column, b_norm: Column) -> Column:
    """Cosine; 0 if a vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), a_norm * b_norm), F.lit(0.0))


def angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, "nearest", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class MetricIndex:
    """``chunks``: (model, pivot, ring, chunk, docs); ``blocks``: one row per
    (model, pivot, ring) with inner and outer angle, documents and chunks;
    ``pivots``: one row per model. Documents without a direction (norm 0) are
    the block with pivot -1: every question is at similarity 0 to them."""

    chunks: DataFrame
    blocks: DataFrame
    pivots: DataFrame
    layout: Layout


def build_index(collection: DataFrame, payload: list[str], layout: Layout = Layout()) -> MetricIndex:
    """Index of (model, doc_id, vec, norm, ...payload)."""
    docs = _written(collection.select("model", "doc_id", "vec", "norm", *payload), "collection")
    # Pivots: the first documents of a model by hash, at most ``pivots``; which ones they are never changes a result.
    order = W.partitionBy("model").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.where("norm > 0").withColumn("n", F.row_number().over(order)).where(F.col("n") <= layout.pivots)
    sizes = docs.groupBy("model").agg(F.ceil(F.count("*") / layout.chunk_rows).alias("most"))
    chosen = chosen.join(F.broadcast(sizes), "model").where(F.col("n") <= F.col("most"))  # a chunk or more for each
    pivots = _written(chosen.groupBy("model").agg(F.collect_list(F.struct((F.col("n") - 1).alias("pivot"), "vec", "norm")).alias("pivots")), "pivots")

    def nearest(ps: Column) -> Column:
        return F.array_min(F.transform(ps, lambda p: F.struct(angle(similarity(F.col("vec"), F.col("norm"), p["vec"], p["norm"])).alias("angle"), p["pivot"].alias("pivot"))))

    own = F.when(F.col("norm") > 0, nearest(F.col("pivots"))).otherwise(F.struct(F.lit(math.pi / 2).alias("angle"), F.lit(-1).alias("pivot")))
    dealt = _written(docs.join(F.broadcast(pivots), "model", "left").withColumn("own", own).select(*docs.columns, "own.*"), "dealt")
    # Rings of about equal numbers, as many as a cell has chunks, at most ``rings``; borders may be approximate, radii are not.
    steps = [F.lit(i / layout.rings) for i in range(1, layout.rings)]
    cells = dealt.groupBy("model", "pivot").agg(F.count("*").alias("n"), F.percentile_approx("angle", F.array(*steps), 1000).alias("borders"))
    cells = cells.withColumn("rings", F.least(F.lit(layout.rings), F.ceil(F.col("n") / layout.chunk_rows)).cast("int"))
    fine = F.size(F.filter("borders", lambda b: b < F.col("angle")))
    ringed = dealt.join(F.broadcast(cells.select("model", "pivot", "rings", "borders")), ["model", "pivot"])
    ringed = ringed.withColumn("ring", F.floor(fine * F.col("rings") / layout.rings).cast("int")).drop("rings", "borders")
    blocks = _written(ringed.groupBy("model", "pivot", "ring").agg(
        F.min("angle").alias("inner"), F.max("angle").alias("outer"), F.count("*").alias("n"),
        F.ceil(F.count("*") / layout.chunk_rows).cast("int").alias("n_chunks")), "blocks")
    placed = ringed.join(F.broadcast(blocks.select("model", "pivot", "ring", "n_chunks")), ["model", "pivot", "ring"])
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("n_chunks")).cast("int")
    chunks = placed.groupBy("model", "pivot", "ring", chunk.alias("chunk")).agg(
        F.collect_list(F.struct("doc_id", "vec", "norm", *payload)).alias("docs"))
    return MetricIndex(_written(chunks, "chunks"), blocks, pivots, layout)


def with_pivot_angles(asked: DataFrame, index: MetricIndex) -> DataFrame:
    """``asked`` (model, vec, norm, ...) with ``at``: its angles to the pivots in order."""
    at = F.transform(F.array_sort(F.transform("pivots", lambda p: F.struct(
        p["pivot"], angle(similarity(F.col("vec"), F.col("norm"), p["vec"], p["norm"])).alias("angle")))), lambda p: p["angle"])
    return asked.join(F.broadcast(index.pivots), "model", "left").withColumn("at", at).drop("pivots")


def with_reach(asked: DataFrame, index: MetricIndex) -> DataFrame:
    """``asked`` with ``reach``: every block's least possible angle to the
    question, nearest blocks first."""
    layout = index.blocks.groupBy("model").agg(F.collect_list(F.struct("pivot", "ring", "inner", "outer", "n", "n_chunks")).alias("blocks"))

    def least(b: Column, closest: Column) -> Column:
        here = F.get("at", b["pivot"])
        ring = F.greatest(F.lit(0.0), here - b["outer"], b["inner"] - here)
        # A document of another cell is at least half the difference of the two pivots away.
        return F.when(b["pivot"] < 0, F.lit(math.pi / 2)).otherwise(F.greatest(ring, (here - closest) / 2))

    reach = bound(F.array_min("at"), lambda closest: F.array_sort(F.transform("blocks", lambda b: F.struct(
        least(b, closest).alias("least"), b["pivot"].alias("pivot"), b["ring"].alias("ring"), b["n"].alias("n"), b["n_chunks"].alias("n_chunks")))))
    return asked.join(F.broadcast(layout), "model").withColumn("reach", reach).drop("blocks")


def _first_blocks(k: int) -> Column:
    """The nearest blocks up to the one that makes k documents together."""
    none = F.array().cast("array<struct<least:double,pivot:int,ring:int,n:bigint,n_chunks:int>>")
    start = F.struct(F.lit(0).cast("bigint").alias("n"), none.alias("taken"))
    return F.aggregate("reach", start, lambda acc, b: F.when(acc["n"] >= k, acc).otherwise(
        F.struct((acc["n"] + b["n"]).alias("n"), F.concat(acc["taken"], F.array(b)).alias("taken"))))["taken"]


def _meet(asked: DataFrame, keys: list[str], index: MetricIndex, payload: list[str], k: int) -> DataFrame:
    """The best k documents of each (question, chunk) for questions with a
    column ``visits`` of blocks."""
    sent = asked.select(*keys, "vec", "norm", F.explode("visits").alias("b")).select(*keys, "vec", "norm", "b.pivot", "b.ring", "b.n_chunks")
    block = ["model", "pivot", "ring"]
    # Bounded by the layout: one row per block.
    demand = sent.groupBy(*block).agg(F.ceil(F.count("*") / index.layout.question_rows).cast("int").alias("parts"))
    spread = sent.join(F.broadcast(demand), block).withColumn("part", F.pmod(F.xxhash64(*keys), F.col("parts")).cast("int"))
    spread = spread.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).drop("n_chunks", "parts")
    copies = index.chunks.join(F.broadcast(demand), block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    copies = copies.select(*block, "chunk", "part", F.explode("docs").alias("d")).select(*block, "chunk", "part", "d.*")
    place = [*block, "chunk", "part"]
    found = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [
        *asked.select(*keys).schema, *copies.select("doc_id", *payload).schema]) + ", distance double"
    met = spread.groupBy(*place).cogroup(copies.groupBy(*place)).applyInArrow(best_in_chunk(keys, payload, k), found)
    return met.select(*keys, "distance", "doc_id", *payload)


def best_in_chunk(keys: list[str], payload: list[str], k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best k documents of a chunk for each of the questions that meet it.

    A matrix product only chooses: what lies within ``CHOICE`` of the k-th best
    is compared again, summed in the order of ``dot``, so that results and ties
    are those of ``similarity`` to the last bit.
    """

    def matrix(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, norms and lengths; without a direction: zeros and length -1."""
        vecs, norms = rows["vec"].combine_chunks(), rows["norm"].to_numpy(zero_copy_only=False).astype(float)
        sizes = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy(zero_copy_only=False).astype(int)
        sizes[~((norms > 0) | np.isnan(norms)) | rows["norm"].is_null().to_numpy(zero_copy_only=False)] = -1
        out = np.zeros((rows.num_rows, width))
        flat = vecs.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False)]).astype(int)
        for size in np.unique(sizes[sizes > 0]):  # usually one
            at = np.flatnonzero(sizes == size)
            out[at, :size] = flat[starts[at][:, None] + np.arange(size)]
        return out, np.where(sizes < 0, 0.0, norms), sizes

    def meet(questions: pa.Table, docs: pa.Table) -> pa.Table:
        docs = docs.take(pc.sort_indices(docs["doc_id"], null_placement="at_start"))  # so that ties go by place
        width = max([0, *(pc.max(pc.list_value_length(x["vec"])).as_py() or 0 for x in (questions, docs))])
        (a, a_norm, a_size), (b, b_norm, b_size) = matrix(questions, width), matrix(docs, width)
        with np.errstate(all="ignore"):
            scale = lambda v, n: v / np.where(n > 0, n, 1.0)[:, None]
            near = scale(a, a_norm) @ scale(b, b_norm).T
            near[a_size[:, None] != b_size[None, :]] = 0.0  # lengths that differ have no cosine
            least = np.partition(near, -k, axis=1)[:, -k] if k < docs.num_rows else np.full(len(near), -np.inf)
            sure = lambda n: (n == 0) | ((n > 1e-100) & (n < 1e100))  # noqa: E731  norms whose quotients are precise
            chosen = ~(near < least[:, None] - CHOICE) | ~sure(b_norm)[None, :] | ~sure(a_norm)[:, None]
            if not sure(b_norm).all():
                chosen[:] = True
            q, d = np.nonzero(chosen)
            distance = np.empty(len(q))
            columns, others = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
            for start in range(0, len(q), 1 << 16):
                i, j = q[start:start + (1 << 16)], d[start:start + (1 << 16)]
                total = np.zeros(len(i))
                for x, y in zip(columns, others):
                    total += x[i] * y[j]
                size = a_norm[i] * b_norm[j]
                distance[start:start + len(i)] = -np.where((size == 0) | (a_size[i] != b_size[j]), 0.0, total / np.where(size == 0, 1.0, size))
        order = np.lexsort((d, distance, q))
        first = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(order)) - first < k]
        asked, hit = questions.select(keys).take(pa.array(q[order])), docs.select(["doc_id", *payload]).take(pa.array(d[order]))
        return pa.table([*asked.columns, *hit.columns, pa.array(distance[order])], names=[*keys, "doc_id", *payload, "distance"])

    def best(questions: pa.Table, docs: pa.Table) -> pa.Table:
        # About 4 million pairs at once, whatever the layout.
        step = max(1, (1 << 22) // max(1, docs.num_rows))
        parts = [meet(questions.slice(i, step), docs) for i in range(0, questions.num_rows, step)] if docs.num_rows else []
        return pa.concat_tables(parts) if parts else meet(questions.slice(0, 0), docs.slice(0, 0))

    return best


def rounds(asked: DataFrame, keys: list[str], index: MetricIndex, payload: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions with the ``visits`` of the first round, its hits, and questions
    with the visits of the second."""
    angled = _written(with_pivot_angles(asked, index), "asked")
    early = with_reach(angled, index).withColumn("visits", _first_blocks(k)).drop("reach")
    first = _written(_meet(early, keys, index, payload, k), "first")
    ranked = first.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("distance", "doc_id")))
    limit = ranked.where(F.col("place") == k).select(*keys, angle(-F.col("distance")).alias("limit"))
    later = with_reach(angled.join(limit, keys, "left"), index)
    rest = F.slice("reach", F.size(_first_blocks(k)) + 1, F.size("reach"))
    needed = F.filter(rest, lambda b: b["least"] <= F.coalesce("limit", F.lit(math.pi)) + SLACK)
    return early, first, later.withColumn("visits", needed).drop("reach")


def nearest(asked: DataFrame, keys: list[str], index: MetricIndex, payload: list[str], k: int) -> DataFrame:
    """(keys, rank, doc_id, payload): the exact k most similar documents of each
    question, ties by doc_id. ``asked``: (model, vec, norm) and ``keys``, which
    hold model and tell questions apart. A question without a direction is at
    similarity 0 to every document: its first k are the smallest doc_ids, found
    once for all such questions."""
    _, first, later = rounds(asked.where("norm > 0"), keys, index, payload, k)
    hits = first.unionByName(_meet(later, keys, index, payload, k))
    still = asked.where("norm = 0 OR norm IS NULL").select(*keys)
    flat = index.chunks.select("model", F.explode(F.slice(F.array_sort(F.transform("docs", lambda d: F.struct(
        F.lit(0.0).alias("distance"), d["doc_id"].alias("doc_id"), *[d[c].alias(c) for c in payload]))), 1, k)).alias("hit")).select("model", "hit.*")
    smallest = flat.withColumn("n", F.row_number().over(W.partitionBy("model").orderBy("doc_id"))).where(F.col("n") <= k).drop("n")
    hits = hits.unionByName(still.join(F.broadcast(smallest), "model").select(*hits.columns))
    w = W.partitionBy(*keys).orderBy("distance", "doc_id")  # k rows per visited chunk
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "rank", "doc_id", *payload)
