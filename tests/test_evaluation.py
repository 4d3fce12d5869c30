"""Retrieval scoring and model-response handling on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from tidewater.operators import evaluation as E
from tidewater.operators import nearest
from tidewater.operators.nearest import Layout


def test_question_scores(spark):
    df = spark.createDataFrame([
        ("m", 1.0, 1, 3, ["3", "1"]),       # relevant first
        ("m", 1.0, 2, 1, ["3", "5", "1"]),  # relevant third
        ("m", 1.0, 3, 7, ["3", "5"]),       # missed
        ("m", 1.0, 4, 2, []),               # nothing retrieved
    ], "model string, cost double, vec_id long, label int, retrieved array<string>")
    out = {r["vec_id"]: r for r in E.question_scores(df).collect()}
    assert (out[1]["hit"], out[1]["precision"], out[1]["reciprocal_rank"]) == (True, 0.5, 1.0)
    assert out[2]["reciprocal_rank"] == pytest.approx(1 / 3) and out[2]["precision"] == pytest.approx(1 / 3)
    assert (out[3]["hit"], out[3]["recall"], out[3]["reciprocal_rank"]) == (False, 0.0, 0.0)
    assert out[4]["precision"] == 0.0


def test_retrieved_tables_keep_rank_order(spark):
    hits = spark.createDataFrame([
        ("m", 1.0, 9, 0, 2, "rel_1_2", None, "1", "2"),
        ("m", 1.0, 9, 0, 1, "table_2", "2", None, None),
        ("m", 1.0, 9, 0, 3, "table_0", "0", None, None),
    ], "model string, cost double, vec_id long, label int, rank int, doc_id string, table string, "
       "from_table string, to_table string")
    r = E.retrieved_tables(hits).collect()[0]
    assert r["retrieved"] == ["2", "1", "0"]


def test_nearest_documents_exact_cosine(spark):
    emb = spark.createDataFrame([(0, [1.0] + [0.0] * 63, 0), (1, [0.0, 1.0] + [0.0] * 62, 1),
                                 (2, [0.9, 0.1] + [0.0] * 62, 0)], "vec_id long, embedding array<float>, label int")
    coll = E.knowledge_collection(emb)
    assert sorted(r["doc_id"] for r in coll.collect()) == ["rel_0_1", "table_0", "table_1"]
    hits = E.nearest_documents(emb, coll, k=1).filter(F.col("model") == "full")
    top = {r["vec_id"]: r["doc_id"] for r in hits.collect()}
    assert top[1] == "table_1" and top[2] == "table_0"


def test_nearest_documents_over_many_blocks_is_exact(spark):
    import math
    emb = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 11) - 5, float(i % 13) - 6], i) for i in range(300)],
                                "vec_id long, embedding array<float>, label int")
    coll = E.example_collection(emb)
    hits = E.nearest_documents(emb.filter("vec_id < 20"), coll, k=4, layout=Layout(pivots=6, rings=3, chunk_rows=16, question_rows=7)).filter("model = 'full'").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in emb.collect()}

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    for q in range(20):
        want = sorted(((-cosine(vectors[q], v), f"example_{i}") for i, v in vectors.items()))[:4]
        got = sorted((h["rank"], h["doc_id"]) for h in hits if h["vec_id"] == q)
        near = [-cosine(vectors[q], vectors[int(d.split("_")[1])]) for _, d in got]
        assert near == pytest.approx([w[0] for w in want]) and [r for r, _ in got] == [1, 2, 3, 4]


def test_blocks_are_skipped_and_hot_blocks_split(spark):
    """Clustered vectors: most blocks are out of reach, and still every row is that of a full comparison."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.02 * r.normal(size=8)).tolist(), i % 12) for i in range(2400)]
    rows += [(2400, [0.0] * 8, 0), (2401, rows[0][1], 0), (2402, None, 0)]  # without a direction; a copy; null
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coll = E.example_collection(emb.where("embedding IS NOT NULL").withColumn("label", F.col("vec_id").cast("int")))
    asked = E._represented(emb.where("vec_id % 10 = 0 OR vec_id > 2399"), "embedding").where("model = 'full'")
    keys, payload = ["model", "vec_id"], ["table"]
    index = nearest.build_index(E._represented(coll, "vec"), payload, Layout(pivots=16, rings=8, chunk_rows=100, question_rows=16))
    first, _, later = nearest.rounds(asked.where("norm > 0"), keys, index, payload, 5)
    blocks = index.blocks.where("model = 'full'").count()
    visits = first.unionByName(later.select(*first.columns)).groupBy("vec_id").agg(F.sum(F.size("visits")).alias("n")).agg(F.avg("n"), F.max("n")).first()
    assert blocks >= 16 and visits[0] < blocks / 4, (blocks, visits)
    # A block that many questions need meets them in several parts, and a question only chunks of blocks that it visits.
    met = nearest._meet(first, keys, index, payload, 5)
    chunks = index.blocks.where("model = 'full'").select("pivot", "ring", "n_chunks")
    sent = first.select("vec_id", F.explode("visits").alias("b")).select("b.*").groupBy("pivot", "ring").count().join(chunks, ["pivot", "ring"])
    assert met.count() <= 5 * sent.agg(F.sum(F.col("count") * F.col("n_chunks"))).first()[0]
    assert sent.agg(F.max("count")).first()[0] > 16
    got = {}
    for h in nearest.nearest(asked, keys, index, payload, 5).collect():
        got.setdefault(h.vec_id, {})[h["rank"]] = h.doc_id
    ids = [i for i, v, _ in rows if v is not None]
    matrix = np.array([v for _, v, _ in rows if v is not None])
    norms = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(norms > 0, norms, 1)[:, None]
    for q in [x for x in range(2403) if x % 10 == 0 or x > 2399]:
        v = rows[q][1]
        cosine = unit @ (np.array(v) / (np.linalg.norm(v) or 1)) if v is not None else np.zeros(len(ids))
        want = sorted((-round(float(c), 12), f"example_{i}") for c, i in zip(cosine, ids))[:5]
        near = [round(float(cosine[ids.index(int(d.split("_")[1]))]), 12) for _, d in sorted(got[q].items())]
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and near == [-w[0] for w in want], q
    assert [d for _, d in sorted(got[2400].items())] == sorted(f"example_{i}" for i in ids)[:5]


def test_chunks_meet_questions_as_matrices_with_the_ties_of_the_plain_cosine(spark):
    """Copies, ties, zeros, nulls, NaN and other lengths: rank by rank what comparing every pair gives."""
    r = np.random.default_rng(7)
    some = [r.integers(-2, 3, size=6).astype(float).tolist() for _ in range(120)] + [r.normal(size=6).tolist() for _ in range(60)]
    some += [some[130]] * 30 + [[0.0] * 6, None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [1.0, 2.0], [1e-160] * 6, [1e150, -1e150, 0.0, 0.0, 0.0, 1.0]]
    docs = E._represented(spark.createDataFrame([(f"d{i * 37 % 1000:03d}", v, str(i)) for i, v in enumerate(some)], "doc_id string, vec array<double>, table string"), "vec")
    asked = E._represented(spark.createDataFrame([(i, v) for i, v in enumerate(some) if i != 213 and (i % 3 == 0 or i > 205)], "vec_id long, vec array<double>"), "vec")
    keys = ["model", "vec_id"]
    docs, asked = docs.cache(), asked.cache()
    index = nearest.build_index(docs, ["table"], Layout(pivots=4, rings=2, chunk_rows=40, question_rows=16))
    got = nearest.nearest(asked, keys, index, ["table"], 5)
    pairs = asked.select(*keys, F.col("vec").alias("v"), F.col("norm").alias("n")).join(docs, "model")
    cosine = nearest.similarity(F.col("v"), F.col("n"), F.col("vec"), F.col("norm"))
    order = W.partitionBy(*keys).orderBy((-cosine).alias("distance"), "doc_id")
    want = pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    rows = lambda df: sorted(tuple(x) for x in df.select(*keys, "rank", "doc_id", "table").collect())
    assert rows(got) == rows(want)
    early, _, _ = nearest.rounds(asked.where("norm > 0"), keys, index, ["table"], 5)
    plan = nearest._meet(early, keys, index, ["table"], 5)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "transform(docs" not in plan


def test_category_matrix_takes_any_model(spark):
    rows = spark.createDataFrame([("a", "new/model-x", 1), ("a", "other/model-x", 0)], "category string, model string, correct_behavior int")
    assert {(r["model"], r["correct_pct"]) for r in E.category_matrix(rows).collect()} == {("new/model-x", 100.0), ("other/model-x", 0.0)}


def test_trailing_text_and_null_replies(spark):
    good = '{"sql": "SELECT 1"}'
    df = spark.createDataFrame([(0, good + " Hope it helps"), (1, None), (2, good + good), (3, "7"), (4, good + "}")], "id long, raw string")
    out = [r["p"]["parse_error"] for r in df.select("id", E.normalise_model_response(F.col("raw")).alias("p")).orderBy("id").collect()]
    assert out == ["JSON decode error", "Empty response from model", "JSON decode error", "Expected JSON object, got int",
                   "JSON decode error"]


def test_normalise_model_response(spark):
    good = '{"sql": "SELECT 1", "tables_used": "shipments"}'
    df = spark.createDataFrame(list(enumerate([
        good, "```json\n" + good + "\n```", "<think>hmm {x}</think>\n" + good, "Sure: " + good + " bye",
        '{"explanation": "no"}', "not json", "", "[1, 2]"])), "id long, raw string")
    out = [r["p"] for r in df.select("id", E.normalise_model_response(F.col("raw")).alias("p")).orderBy("id").collect()]
    for i in range(4):
        assert out[i]["json_parse_ok"] and out[i]["sql"] == "SELECT 1" and out[i]["tables_used"] == ["shipments"]
    assert (out[4]["json_parse_ok"], out[4]["parse_error"]) == (False, "JSON parsed but missing 'sql' key")
    assert out[5]["parse_error"] == "JSON decode error"
    assert out[6]["parse_error"] == "Empty response from model"
    assert out[7]["parse_error"] == "Expected JSON object, got list"


def test_behaviour_scoring(spark):
    df = spark.createDataFrame([
        ("answer", True, "SELECT 1", "", False), ("answer", True, "  ", "", False),
        ("refuse", True, "SELECT 1", "I cannot answer that", False), ("refuse", True, "SELECT 1", "ok", False),
        ("block", False, "", "", True), ("injection", True, "SELECT 1", "", False), ("other", True, "x", "", False),
    ], "expected string, ok boolean, sql string, raw string, blocked boolean")
    got = [r[0] for r in df.select(E.behaviour_correct(F.col("expected"), F.col("ok"), F.col("sql"), F.col("raw"),
                                                       F.col("blocked"))).collect()]
    assert got == [True, False, True, False, True, False, False]


def test_unreported_tokens_are_estimated(spark):
    rows = [(1, "q", "m", "c", "answer", None, "SELECT 1", "x" * 41, 10.0, 403, None, None), (2, "q", "m", "c", "answer", None, "SELECT 1", "x" * 41, 10.0, 403, 7, 9),
            (3, "q", "m", "c", "answer", None, "SELECT 1", None, 10.0, None, None, None)]
    replies = spark.createDataFrame(rows, "question_id long, text string, model string, category string, expected_behavior string, guardrail_reason string, truth_sql string, "
                                          "raw_response string, latency_ms double, prompt_chars long, input_tokens long, output_tokens long")
    got = {r.test_id: (r.input_tokens, r.output_tokens) for r in E.score_replies(replies).collect()}
    assert got == {1: (100, 10), 2: (7, 9), 3: (0, 0)}
