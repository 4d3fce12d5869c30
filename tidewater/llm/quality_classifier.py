"""Quality classification by co-training on two views.

One classifier sees only the text's content, the other only the page's metadata
(source, language, stated length). Starting from the labelled documents, each
round lets every classifier name the unlabelled documents that it is sure of,
and those become training rows of the *other* one. Both are then calibrated on
labelled documents that neither has learned from, and their calibrated odds
are combined to score every document.

Fitting reads features of at most ``per_class`` labelled documents a class,
picked by a hash of the identifier, and the pseudo-labelled ones. These are
searched for among all unlabelled documents: every round scores the stored
features of each of them and takes the surest ``per_round`` a view and class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_sample, record_batches, stage, workers_import


@dataclass(frozen=True)
class Training:
    """Parameters of the fit."""

    per_class: int = 3000     # bound of the labelled sample, per class
    rounds: int = 5
    sure: float = 0.97        # calibrated confidence of a pseudo-label
    per_round: int = 400      # pseudo-labels a view may give per class and round
    held_back: float = 0.3    # share of labelled rows for calibration
    ridge: float = 1e-2
    accept: float = 0.5       # a document under this score is rejected


SLICE = 2048  # rows whose features are expanded at a time
MERGES = 16   # tasks a class and view in which candidates meet first
_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_LETTER = bytes([*range(65, 91), *range(97, 123)])
_SYMBOL = b"#*$%&<>^~@=+_\\{}[]"
_STOP = b".,;:"
_BEYOND = bytes(range(128, 256))
TEXT_FEATURES = 18


def text_features(text: str | None) -> list[float]:
    """What the content shows: character make-up, repetition, word shapes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return [0.0] * (TEXT_FEATURES - 1) + [1.0]

    def holds(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    letters = max(1, holds(_LETTER))
    unique = len(set(words)) / n
    threes = max(1, n - 2)
    lines = [x for x in data.split(b"\n") if x.strip()]
    long = np.log1p(n)
    return [
        holds(_UPPER) / letters, min(2.0, holds(_SYMBOL) / n), min(2.0, holds(b"|") / n), min(2.0, holds(b"!?") / n), holds(_DIGIT) / size,
        unique, sum(map(eq, words, words[1:])) / n, 1 - len(set(zip(words, words[1:], words[2:]))) / threes if n > 2 else 0.0,
        size / n / 10, long / 10, unique * long / 5, 1 - len(set(lines)) / max(1, len(lines)), holds(_BEYOND) / size, min(2.0, holds(_STOP) / n),
        sum(1 for w in words if len(w) <= 3) / n, np.log1p(max(map(len, words))) / 5, n / max(1, len(lines)) / 100, 0.0,
    ]


@dataclass
class Vocabulary:
    """A place for each source and language that occurs twice in the labelled
    sample; the last place of either is for all others."""

    sources: dict[str, int]
    langs: dict[str, int]

    @classmethod
    def of(cls, sources: list[str | None], langs: list[str | None]) -> Vocabulary:
        return cls(*({w: i for i, w in enumerate(sorted(w for w, n in Counter(x or "" for x in values).items() if n > 1))} for values in (sources, langs)))

    def features(self, source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
        first = 3 + len(self.sources) + 1
        out = [0.0] * (first + len(self.langs) + 1)
        known = n_chars is not None and n_chars >= 0
        out[0], out[1] = (np.log1p(n_chars) / 10, (np.log1p(n_chars) / 10) ** 2) if known else (0.0, 0.0)
        out[2] = 0.0 if known else 1.0
        out[3 + self.sources.get(source or "", len(self.sources))] = 1.0
        out[first + self.langs.get(lang or "", len(self.langs))] = 1.0
        return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0     # calibration: odds = slope * margin + offset
    offset: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        return cls(mean, scale, _newton(z, y, ridge * len(y) / 10 + 1e-3))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(np.unique(y)) == 2:
            # Smoothed targets keep the odds finite when a view separates its classes.
            good, bad = y.sum(), len(y) - y.sum()
            target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
            self.slope, self.offset = _newton(np.column_stack([self.margin(x), np.ones(len(x))]), target, 1e-3)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.offset, -12, 12)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _newton(z: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-6)) @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class CoTrained:
    views: list[Logistic]
    vocabulary: Vocabulary
    prior: float           # log odds of the labelled sample
    pseudo: list[int]      # rows that each view learned from the other

    def odds(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Each view adds what it says beyond the prior."""
        return self.prior + sum(view.odds(x) - self.prior for view, x in zip(self.views, (text, meta), strict=True))


#: (views, per view the identifiers that it has learned) -> per view and label the surest
#: other documents, as (doc_id, the two views' features).
Search = Callable[[list[Logistic], list[list[int]]], dict[tuple[int, int], list[tuple[int, list[np.ndarray]]]]]


def co_train(labelled: list[np.ndarray], y: np.ndarray, vocabulary: Vocabulary, search: Search, params: Training = Training()) -> CoTrained | None:
    """``labelled``: the two views' feature rows in one order. None if the
    labels don't have both classes on either side of the split."""
    back = np.arange(len(y)) % 10 < round(params.held_back * 10)
    if len(np.unique(y[~back])) < 2 or len(np.unique(y[back])) < 2:
        return None
    extra: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]  # per view: document -> label given by the other view, features

    def trained(v: int) -> Logistic:
        rows = [extra[v][d] for d in sorted(extra[v])]
        x = np.vstack([labelled[v][~back], *[r[1] for r in rows]])
        view = Logistic.fit(x, np.concatenate([y[~back], [r[0] for r in rows]]), params.ridge)
        view.calibrate(labelled[v][back], y[back])
        return view

    views = [trained(0), trained(1)]
    for _ in range(params.rounds):
        found = search(views, [sorted(e) for e in extra])
        for (v, label), best in found.items():
            for doc_id, features in best:
                extra[1 - v][doc_id] = (float(label), features[1 - v])
        if not any(found.values()):
            break
        views = [trained(0), trained(1)]
    share = y[~back].mean()
    return CoTrained(views, vocabulary, float(np.log(share / (1 - share))), [len(e) for e in extra])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["source"].cast("string").alias("source"),
                       docs["lang"].cast("string").alias("lang"), docs["n_chars"].cast("long").alias("n_chars"))


FEATURES = "doc_id long, text_view array<double>, source string, lang string, n_chars long"
META = ("source", "lang", "n_chars")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in record_batches(batches, "text", 8 << 20):
        text = pa.array([text_features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, *map(batch.column, META)], ["doc_id", "text_view", *META])


def feature_rows(docs: DataFrame) -> DataFrame:
    """What both views read of each row."""
    return _narrow(docs).mapInArrow(_feature_rows, FEATURES)


def _views(batch: pa.RecordBatch, vocabulary: Vocabulary) -> list[np.ndarray]:
    text = batch.column("text_view").flatten().to_numpy(zero_copy_only=False).reshape(-1, TEXT_FEATURES)
    return [text, np.array([vocabulary.features(*x) for x in zip(*(batch.column(c).to_pylist() for c in META), strict=True)], dtype=float)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def surest(pool: DataFrame, vocabulary: Vocabulary, params: Training) -> Search:
    """A search over every row of ``pool``: FEATURES with distinct doc_ids and
    a ``tie``. Each task keeps its surest rows, these meet in MERGES tasks a
    view and label, and what those keep is merged here: never more than
    4 * MERGES * per_round rows, whatever the table's size."""
    most, sure = params.per_round, params.sure
    order = [("p", "descending"), ("tie", "ascending"), ("doc_id", "ascending")]
    columns = [c.split()[0] for c in FEATURES.split(", ")]

    def search(views, learned):
        shared = pool.sparkSession.sparkContext.broadcast((views, [np.array(x, dtype=np.int64) for x in learned]))

        def run(batches):
            views, learned = shared.value
            best: dict[tuple[int, int], pa.Table] = {}
            for batch in _slices(batches):
                ids = batch.column("doc_id").to_numpy()
                for v, x in enumerate(_views(batch, vocabulary)):
                    p = np.round(_sigmoid(views[v].odds(x)), 12)
                    new = ~np.isin(ids, learned[1 - v])
                    for label, own in ((1, p), (0, np.round(1 - p, 12))):
                        at = np.flatnonzero(new & (own >= sure))
                        if len(at):
                            rows = pa.Table.from_batches([batch.take(pa.array(at))]).append_column("p", pa.array(own[at]))
                            known = [best[v, label]] if (v, label) in best else []
                            best[v, label] = pa.concat_tables([*known, rows]).sort_by(order).slice(0, most)
            for (v, label), rows in best.items():
                n = rows.num_rows
                rows = rows.append_column("v", pa.array([v] * n, pa.int32())).append_column("label", pa.array([label] * n, pa.int32()))
                yield from rows.append_column("part", pa.array([TaskContext.get().partitionId() % MERGES] * n, pa.int32())).combine_chunks().to_batches()

        out = pool.mapInArrow(run, f"{FEATURES}, tie long, p double, v int, label int, part int")
        place = F.row_number().over(Window.partitionBy("v", "label", "part").orderBy(F.desc("p"), "tie", "doc_id"))
        kept = out.withColumn("place", place).where(F.col("place") <= most).drop("place", "part").toArrow().sort_by(order)
        shared.unpersist()
        found = {}
        for key in ((0, 1), (0, 0), (1, 1), (1, 0)):
            rows = kept.filter((pa.compute.field("v") == key[0]) & (pa.compute.field("label") == key[1])).slice(0, most)
            batches = rows.select(columns).combine_chunks().to_batches()
            found[key] = [(d, [x[0][i], x[1][i]]) for b in batches if b.num_rows for x in [_views(b, vocabulary)] for i, d in enumerate(b.column("doc_id").to_pylist())]
        return found

    return search


def train(docs: DataFrame, labels: DataFrame, params: Training = Training(), features: DataFrame | None = None) -> CoTrained | None:
    """Fit on a bounded sample of the labelled documents and on pseudo-labels
    from all others; ``labels`` is (doc_id, quality). A document with several
    labels has their majority (a tie is good); null labels don't count.
    ``features``: the stored feature_rows of ``docs``."""
    rows = stage(feature_rows(docs), "quality-features") if features is None else features
    given = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("d")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # Of rows under one identifier the smallest, so that every run learns from the same.
    single = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("text_view", *META)).alias("m")).select("doc_id", "m.*")
    marked = single.join(given, F.col("doc_id") == F.col("d"), "left").drop("d")
    marked = stage(marked.withColumn("tie", F.xxhash64("doc_id")), "quality-marked")
    sample = bounded_sample(marked.where("y IS NOT NULL"), "y", "doc_id", F.lit(params.per_class)).toArrow().sort_by([("tie", "ascending"), ("doc_id", "ascending")])
    if not sample.num_rows:
        return None
    vocabulary = Vocabulary.of(sample.column("source").to_pylist(), sample.column("lang").to_pylist())
    views = [np.vstack(x) for x in zip(*(_views(b, vocabulary) for b in sample.to_batches()), strict=True)]
    search = surest(marked.where("y IS NULL").drop("y"), vocabulary, params)
    return co_train(views, sample.column("y").to_numpy().astype(float), vocabulary, search, params)


def score_quality(docs: DataFrame, labels: DataFrame, params: Training = Training(), model: CoTrained | None = None) -> DataFrame:
    """(doc_id, text_score, meta_score, quality_score, accepted) per row.

    Scores are probabilities of good quality. Without labels of both classes
    nothing can be learned: scores are 0.5 and everything is accepted. Null and
    empty texts are scored by their own feature; null metadata likewise.
    Repeated rows repeat; an empty table gives no rows; other columns are
    ignored.
    """
    workers_import(docs.sparkSession)
    rows = feature_rows(docs)
    if model is None:
        rows = stage(rows, "quality-features")
        model = train(docs, labels, params, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    accept = params.accept

    def run(batches):
        fitted = shared.value
        for batch in _slices(batches):
            if fitted is None:
                text = meta = both = np.full(batch.num_rows, 0.5)
            else:
                views = _views(batch, fitted.vocabulary)
                text, meta = (_sigmoid(view.odds(x)) for view, x in zip(fitted.views, views, strict=True))
                both = _sigmoid(fitted.odds(*views))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text), pa.array(meta), pa.array(both), pa.array(both >= accept)],
                                             ["doc_id", "text_score", "meta_score", "quality_score", "accepted"])

    return rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, quality_score double, accepted boolean")


def drop_low_quality(docs: DataFrame, labels: DataFrame, params: Training = Training()) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts. A doc_id goes if every
    row under it is rejected; rows without one stay if any such row does."""
    verdicts = score_quality(docs, labels, params).groupBy("doc_id").agg(F.max("accepted").alias("ok"))
    gone = verdicts.where("NOT ok").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__gone"]), "left_anti")
