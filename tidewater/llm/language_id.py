"""Language identification by nearest centroid.

Texts become character n-gram counts (1 to 3 characters, letters only, hashed
into ``dimensions`` bins), damped by a logarithm, weighted by inverse document
frequency and normalised. Per language, spherical k-means groups the training
vectors into a few centroids; a text gets the language of the nearest centroid
by cosine. Each centroid has a radius from its training members; a text beyond
the radius of its nearest centroid is marked as rejected.

The model is fitted on at most ``per_language`` labelled texts per language,
picked by a hash of the identifier. Texts are counted in tasks (16 KB a text),
document frequencies are summed there, and each language is clustered as one
group of that bounded size. The driver gets the centroids: 128 KB a language.
Prediction reads every whole text, in Arrow batches.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_sample, record_batches, stage, workers_import

UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    """Parameters of the fit."""

    per_language: int = 400   # bound of the training sample
    dimensions: int = 4096
    centroids: int = 4
    rounds: int = 12
    radius_quantile: float = 0.995
    radius_slack: float = 1.25
    seed: int = 11


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray       # one row per centroid, normalised
    owner: np.ndarray           # index into languages
    radius: np.ndarray          # cosine distance beyond which a text is rejected


_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Lower-case code of every letter, 32 for other characters."""
    global _letters
    if _letters is None:
        codes = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                codes[c] = ord(low) if len(low) == 1 else c
        _letters = codes
    return _letters


def grams(text: str, dimensions: int) -> np.ndarray | None:
    """Hashed n-gram counts of the text's letters; None without letters."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not len(codes) or codes.max() == 32:
        return None
    counts = np.zeros(dimensions, np.int64)
    for at in range(0, len(codes), 1 << 20):  # overlapping slices bound the memory of very long texts
        one = codes[at:at + (1 << 20) + 2].astype(np.uint64)
        first = min(1 << 20, len(codes) - at)
        two = one[:-1] * np.uint64(0x9E3779B1) + one[1:]
        three = two[:-1] * np.uint64(0x85EBCA77) + one[2:]
        blank = one == 32
        for n, values in ((1, one), (2, two), (3, three)):
            values = values[:first]
            values = values[~blank[:len(values)] | (n == 3)]  # words' starts count in threes only
            mixed = (values + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
            counts += np.bincount((mixed >> np.uint64(40)) % np.uint64(dimensions), minlength=dimensions)
    return counts


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def _counted(params: Fit):
    """(lang, counts) of (lang, text) batches; texts without letters teach nothing."""

    def run(batches):
        for batch in record_batches(batches, "text", 1 << 20):
            rows = [(lang, c) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)
                    if t and (c := grams(t, params.dimensions)) is not None]
            for at in range(0, len(rows), 256):
                part = rows[at:at + 256]
                yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in part], pa.string()), pa.array([c.astype("<i4").tobytes() for _, c in part], pa.binary())], ["lang", "counts"])

    return run


def _matrix(counts: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x, "<i4") for x in counts.to_pylist()], dtype=np.int64)


def _seen(batches):
    """One row a task: its rows, and in how many of them each bin occurs."""
    n, seen = 0, None
    for batch in batches:
        if batch.num_rows:
            found = (_matrix(batch.column("counts")) > 0).sum(0)
            n, seen = n + batch.num_rows, found if seen is None else seen + found
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], ["n", "seen"])


def _clustered(idf: np.ndarray, params: Fit):
    def run(table: pa.Table) -> pa.Table:
        # In one order whatever the partitions: the same rows give the same centroids.
        table = table.sort_by("counts")
        lang = table.column("lang")[0].as_py()
        own = np.array([vector(c, idf) for c in _matrix(table.column("counts"))])
        centres = _spherical(own, min(params.centroids, len(own)), params.rounds, np.random.default_rng([params.seed, zlib.crc32(lang.encode())]))
        nearest = own @ centres.T
        member = nearest.argmax(1)
        rows = []
        for i, centre in enumerate(centres):
            distances = 1 - nearest[member == i, i]
            if len(distances):
                rows.append((i, centre.astype("<f8").tobytes(), min(1.0, float(np.quantile(distances, params.radius_quantile)) * params.radius_slack)))
        return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "place": pa.array([r[0] for r in rows], pa.int32()),
                         "centre": pa.array([r[1] for r in rows], pa.binary()), "radius": pa.array([r[2] for r in rows], pa.float64())})

    return run


def fit(rows: DataFrame, params: Fit = Fit()) -> Model:
    """A model of (lang, text) rows, a bounded number per language."""
    workers_import(rows.sparkSession)
    counted = stage(rows.select("lang", "text").mapInArrow(_counted(params), "lang string, counts binary"), "language-grams")
    sums = counted.mapInArrow(_seen, "n long, seen binary").collect()
    if not sums:
        return Model([], np.ones(params.dimensions), np.zeros((0, params.dimensions)), np.zeros(0, int), np.zeros(0))
    seen = np.sum([np.frombuffer(r.seen, "<i8") for r in sums], axis=0)
    idf = np.log((1 + sum(r.n for r in sums)) / (1 + seen)) + 1
    found = counted.groupBy("lang").applyInArrow(_clustered(idf, params), "lang string, place int, centre binary, radius double").collect()
    found.sort(key=lambda r: (r.lang, r.place))
    languages = sorted({r.lang for r in found})
    return Model(languages, idf, np.array([np.frombuffer(r.centre, "<f8") for r in found]), np.array([languages.index(r.lang) for r in found]), np.array([r.radius for r in found]))


def _spherical(own: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    centres = own[random.choice(len(own), k, replace=False)]
    for _ in range(rounds):
        member = (own @ centres.T).argmax(1)
        sums = np.array([own[member == i].sum(0) if (member == i).any() else centres[i] for i in range(k)])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(norms > 0, norms, 1)
    return centres


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    """(language, cosine, rejected); UNKNOWN, 0 and True without letters."""
    counts = grams(text or "", len(model.idf)) if model.languages else None
    if counts is None:
        return UNKNOWN, 0.0, True
    near = model.centroids @ vector(counts, model.idf)
    best = int(near.argmax())  # the first of equals: languages in code point order
    score = float(min(1.0, max(0.0, near[best])))
    return model.languages[model.owner[best]], score, bool(1 - near[best] > model.radius[best])


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the identifier's digits, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, params: Fit = Fit()) -> DataFrame:
    """(lang, text): at most ``per_language`` identifiers per language from
    outside the held-out fold, the first by a hash of the identifier."""
    learnable = docs.where(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"]))
    ids = learnable.select(docs["lang"].cast("string").alias("l"), docs["doc_id"].cast("long").alias("d"))
    chosen = bounded_sample(ids, "l", "d", F.lit(params.per_language))
    # A written table of known size: the join below moves it and not the texts, as long as Spark finds it small.
    first = stage(chosen.select("l", F.col("d").alias("chosen")).distinct(), "language-sample")
    texts = learnable.select(docs["lang"].cast("string").alias("lang"), docs["doc_id"].cast("long").alias("d"), docs["text"].cast("string").alias("text"))
    rows = texts.join(first, (F.col("d") == F.col("chosen")) & (F.col("lang") == F.col("l")))
    return rows.select("lang", "text")


def identify_languages(docs: DataFrame, params: Fit = Fit(), model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per row of ``docs``.

    lang_pred is the nearest centroid's language, ``und`` for a null text, one
    without a letter, or if no row could teach; score is its cosine. rejected:
    beyond the centroid's radius. Repeated rows repeat; an empty table gives no
    rows; other columns are ignored.
    """
    workers_import(docs.sparkSession)
    learned = model if model is not None else fit(training_sample(docs, params), params)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        fitted = shared.value
        for batch in record_batches(batches, "text", 8 << 20):
            found = [predict(fitted, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
