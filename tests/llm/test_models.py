import base64
import itertools
import math
import random
import re
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewater.llm import language_id, mixing, piece_codec, quality_classifier, queries, token_counts
from tidewater.llm.common import table
from tidewater.llm.queries import PIECES

ODD = ["a  b", " lead", "trail ", "a \n b\t c", "<|endoftext|>x<|endoftext|>", "don't  we'll", "  ", "\n", "日本語 テスト 123", "é́ x  y", "a b", "", None,
       "x <|endoftext|> y", "١٢٣ abc 𝔘𝔫 \U0001F600 ok", "a\x85b \x1c c", " a", "the " * 40000, "x" * 50000]


def test_token_counts_equal_the_library(spark, make, sf_dir):
    from tokenizers import Tokenizer
    path = public_tokenizers.path(queries.BYTE_BPE)
    library = Tokenizer.from_file(path)
    real = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    for rows, small in ((real, None), (list(enumerate(ODD)) + [(0, "a  b")], 50)):
        docs = make(rows)
        got = token_counts.count_tokens(docs, path, **({"block_bytes": small} if small else {})).collect()
        want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted(want)
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(make([]), path).count() == 0


def test_hot_pre_tokens_are_salted(make, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT_POSTINGS", 2)
    path = public_tokenizers.path(queries.BYTE_BPE)
    got = token_counts.count_tokens(make([(i, "zzqqxzzqqx common") for i in range(40)]), path, block_bytes=60).collect()
    assert len(got) == 40 and len({r.n_tokens for r in got}) == 1


@pytest.fixture(scope="module")
def pieces():
    return piece_codec.PieceModel.at(public_tokenizers.path(queries.PIECES))


def test_pieces_equal_the_library_and_decode_back(pieces):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz    \n\téß日本\U0001F600\x00.,!0123456789'<s>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("ern t") for _ in range(50)) for _ in range(1000)]
    texts += [" " * k + "x" * (k % 3) for k in range(80)] + ["<s>", "<unk>", "=" * 40, "x" * 20000]
    found = pieces.encode(texts)
    assert [list(x) for x in found] == library.encode(texts)
    assert [pieces.decode(x.tolist()) for x in found] == texts


def test_piece_queries(spark, make, odd_rows, pieces):
    path = public_tokenizers.path(queries.PIECES)
    docs = make(odd_rows)
    coded = piece_codec.code_documents(docs, path).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in coded) == sorted((d or -1, t or "") for d, t, *_ in odd_rows)
    back = piece_codec.decode_documents(piece_codec.encode_documents(docs, path), path)
    assert back.where("text IS NULL").count() == 0 and back.count() == len(odd_rows)
    kept = piece_codec.with_pieces(docs, path)
    assert kept.columns == docs.columns + ["n_pieces", "piece_ids"] and kept.where("n_pieces <> size(piece_ids)").count() == 0
    assert piece_codec.encode_documents(make([]), path).count() == 0


def test_language_id(spark, make, odd_rows, sf_dir):
    real = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify_languages(real).collect()
    langs = {r.doc_id: r.lang for r in real.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    # Predictions don't read lang, source or doc_id.
    model = language_id.fit(language_id.training_sample(real))
    blank = real.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z"))
    again = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(blank, model=model).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in got}
    odd = language_id.identify_languages(make(odd_rows), model=model).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3)} == {"und"}
    assert language_id.predict(model, "12 34 !!") == ("und", 0.0, True)
    assert language_id.predict(model, "щжыъ щъэюж ыыщ")[2]  # far from every centroid
    untaught = language_id.identify_languages(make([(1, "text", None)])).collect()
    assert (untaught[0].lang_pred, untaught[0].score) == ("und", 0.0)
    assert language_id.identify_languages(make([])).count() == 0


def test_held_out_texts_teach_nothing(spark):
    real = table(spark, "/root/testdata/sf0.01", "documents")
    spoiled = real.withColumn("text", F.when(language_id.held_out(F.col("doc_id")), "spoiled zzz").otherwise(F.col("text")))
    rows = lambda docs: sorted(map(tuple, language_id.training_sample(docs).collect()))
    assert rows(real) == rows(spoiled)


def test_language_id_equals_a_plain_computation(spark, sf_dir):
    """n-grams counted letter by letter, vectors and cosines by plain loops; the
    fit is the same whatever the partitions, and each centroid the mean of its members."""
    docs = table(spark, sf_dir, "documents")
    params = language_id.Fit(dimensions=256, centroids=2, rounds=30)
    model = language_id.fit(language_id.training_sample(docs, params), params)
    again = language_id.fit(language_id.training_sample(docs.repartition(7), params).repartition(3), params)
    assert model.languages == again.languages and np.array_equal(model.centroids, again.centroids) and np.array_equal(model.radius, again.radius)

    def counts(text):
        codes = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text or ""]
        out, mask = [0] * 256, (1 << 64) - 1
        for i, one in enumerate(codes):
            values = [one] if one != 32 else []
            if i + 1 < len(codes):
                two = (one * 0x9E3779B1 + codes[i + 1]) & mask
                values += [two] if one != 32 else []
            for k, value in enumerate(values):
                out[(((value + k + 1) * 0xC2B2AE3D27D4EB4F & mask) >> 40) % 256] += 1
            if i + 2 < len(codes):
                three = (two * 0x85EBCA77 + codes[i + 2]) & mask
                out[(((three + 3) * 0xC2B2AE3D27D4EB4F & mask) >> 40) % 256] += 1
        return out if any(c != 32 for c in codes) else None

    taught = [c for lang, text in language_id.training_sample(docs, params).collect() if (c := counts(text))]
    idf = [math.log((1 + len(taught)) / (1 + sum(c[k] > 0 for c in taught))) + 1 for k in range(256)]

    def unit(c):
        v = [math.log1p(x) * w for x, w in zip(c, idf)]
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v]

    for r in language_id.identify_languages(docs, params, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        c = counts(r.text)
        cosines = [sum(x * y for x, y in zip(unit(c), centre)) for centre in model.centroids] if c else []
        best = max(range(len(cosines)), key=lambda i: (round(cosines[i], 9), -i)) if c else None
        assert (r.lang_pred, r.score) == ((model.languages[model.owner[best]], pytest.approx(max(0, min(1, cosines[best])))) if c else ("und", 0.0))
    vectors = np.array([unit(c) for c in taught])
    labels = [lang for lang, text in language_id.training_sample(docs, params).collect() if counts(text)]
    for k, lang in enumerate(model.languages):
        own, centres = vectors[[x == lang for x in labels]], model.centroids[model.owner == k]
        member = (own @ centres.T).argmax(1)
        for i, centre in enumerate(centres):
            mean = own[member == i].sum(0)
            assert centre @ mean / np.linalg.norm(mean) > 0.999


def test_quality_classifier(spark, make, odd_rows):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0
    scored = quality_classifier.score_quality(docs, labels.where(~fold))
    judged = scored.join(labels.where(fold), "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int"))).collect()
    rate = {r[0]: r[1] for r in judged}
    assert rate[1] > 0.97 and rate[0] < 0.15
    none = labels.where("doc_id < 0")
    assert {(r.quality_score, r.accepted) for r in quality_classifier.score_quality(make(odd_rows), none).collect()} == {(0.5, True)}
    model = quality_classifier.train(docs, labels)
    assert sum(model.pseudo) > 0  # the views did exchange pseudo-labels
    odd = quality_classifier.score_quality(make(odd_rows), labels, model=model)
    assert odd.count() == len(odd_rows) and odd.where("quality_score IS NULL OR isnan(quality_score)").count() == 0
    assert quality_classifier.score_quality(make([]), none).count() == 0


def test_pseudo_labels_come_from_all_unlabelled_documents(spark):
    """More unlabelled documents than any sample: the surest of all are found."""
    import numpy as np
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000_000)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 20_000_000))
    model = quality_classifier.train(docs, labels, quality_classifier.Training(rounds=0))
    rows = quality_classifier.feature_rows(docs).join(labels.where("quality IS NOT NULL"), "doc_id", "left_anti").withColumn("tie", F.xxhash64("doc_id"))
    for learned in ([], [10_000_000 + k for k in range(5000)]):
        params = quality_classifier.Training(per_round=100)
        found = quality_classifier.surest(rows, model.vocabulary, params)(model.views, [learned, learned])
        every = rows.toArrow()
        views = [np.vstack(x) for x in zip(*(quality_classifier._views(b, model.vocabulary) for b in every.to_batches()))]
        ids, tie = every.column("doc_id").to_numpy(), every.column("tie").to_numpy()
        assert len(ids) > 18_000
        for (v, label), best in found.items():
            p = np.round(quality_classifier._sigmoid(model.views[v].odds(views[v])), 12)
            p = p if label else np.round(1 - p, 12)
            order = [int(ids[i]) for i in np.lexsort((ids, tie, -p)) if p[i] >= params.sure and ids[i] not in set(learned)][:100]
            assert [x[0] for x in best] == order


def test_repeated_identifiers_teach_the_same_model(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    docs = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))).withColumn("source", F.lit("zz")))
    scores = [{(r.doc_id, round(r.quality_score, 9)) for r in quality_classifier.score_quality(x, labels).collect()} for x in (docs.repartition(2), docs.repartition(9, "doc_id"))]
    assert scores[0] == scores[1]


def test_co_training_equals_a_plain_computation():
    """Rounds on a table that fits in memory, with the search and the scores by plain loops."""
    Q, r = quality_classifier, np.random.default_rng(2)
    params = Q.Training(rounds=2, per_round=15, sure=0.6)
    y = (np.arange(200) % 2).astype(float)
    views = [r.normal(size=(200, 4)) + y[:, None], r.normal(size=(200, 3)) - y[:, None]]
    pool = [r.normal(size=(300, 4)) + r.integers(0, 2, 300)[:, None], r.normal(size=(300, 3))]
    seen = []

    def search(fitted, learned):
        found = {}
        for v in (0, 1):
            odds = [fitted[v].odds(pool[v][i:i + 1])[0] for i in range(300)]
            for label in (1, 0):
                sure = sorted(((1 / (1 + math.exp(-o)) if label else 1 - 1 / (1 + math.exp(-o))), -i) for i, o in enumerate(odds))[::-1]
                best = [-i for p, i in sure if p >= params.sure and -i not in learned[1 - v]][:params.per_round]
                found[v, label] = [(i, [pool[0][i], pool[1][i]]) for i in best]
        seen.append((found, [list(x) for x in learned]))
        return found

    model = Q.co_train(views, y, None, search, params)
    assert len(seen) == 2 and seen[0][1] == [[], []]
    given = [{}, {}]  # what each view was taught by the other
    for found, learned in seen:
        assert learned == [sorted(g) for g in given]
        for (v, label), rows in found.items():
            for i, _ in rows:
                given[1 - v][i] = float(label)
    assert model.pseudo == [len(g) for g in given]
    back = np.arange(200) % 10 < round(params.held_back * 10)
    for v in (0, 1):
        x = np.vstack([views[v][~back], *[pool[v][i] for i in sorted(given[v])]])
        plain = Q.Logistic.fit(x, np.concatenate([y[~back], [given[v][i] for i in sorted(given[v])]]), params.ridge)
        plain.calibrate(views[v][back], y[back])
        assert np.allclose(plain.odds(pool[v]), model.views[v].odds(pool[v]))
    share = y[~back].mean()
    prior = math.log(share / (1 - share))
    both = prior + sum(model.views[v].odds(pool[v]) - prior for v in (0, 1))
    assert np.allclose(model.odds(*pool), both)


def test_sources_and_languages_do_not_share_weights():
    names = [f"s{i}" for i in range(100)]
    known = quality_classifier.Vocabulary.of(names * 2 + ["once"], ["de", "es"] * 100 + ["xx"])
    assert len({tuple(known.features(n, "de", 1)) for n in names}) == 100
    assert known.features("s1", "de", 1) != known.features("s1", "es", 1)
    assert known.features("once", "xx", 1) == known.features("new", None, 1)


def test_pipeline_stages(spark):
    import corpus_pipeline
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "pieces":
            assert out.columns == docs.columns
    rows = corpus_pipeline.run(spark, d)
    assert rows.columns == docs.columns + ["n_pieces", "piece_ids"]
    model = piece_codec.PieceModel.at(public_tokenizers.path(queries.PIECES))
    assert all(model.decode(r.piece_ids) == (r.text or "") for r in rows.limit(200).collect())


def test_pipeline_equals_plain_stages(spark, sf_dir):
    """Each stage's rows by plain Python from what its predecessor kept."""
    import corpus_pipeline
    sys.path.insert(0, str(Path(__file__).parent))
    from test_exact_and_near import WS, components, reference_fingerprint
    docs, kept = table(spark, sf_dir, "documents"), {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = stage_rows(function(spark, before, sf_dir))
        rows = [(r.doc_id, r.text) for r in before.collect()]
        got = Counter(r.doc_id for r in docs.collect())
        if name == "quality":
            judged = quality_classifier.score_quality(before, table(spark, sf_dir, "labels")).collect()
            assert got == Counter(r.doc_id for r in judged if r.accepted)
        elif name == "exact":
            groups = {}
            for d, t in rows:
                groups.setdefault(WS.sub("", t or ""), []).append((-len(t or ""), d))
            assert got == Counter(min(g)[1] for g in groups.values())
        elif name == "near":
            fps = {d: reference_fingerprint(t) for d, t in rows}
            root = components([(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3], fps)
            assert got == Counter(d for d in fps if root[d] == d)
        elif name == "mixed":
            sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows}
            source = {r.doc_id: r.source for r in before.collect()}
            taken, size = Counter(), Counter()
            for d, n in sizes.items():
                taken[source[d]] += n * got[d]
                size[source[d]] += n
            assert set(got) <= set(sizes) and max(got.values()) <= 3
            largest = {s: max(n for d, n in sizes.items() if source[d] == s) for s in size}
            targets = {r.source: r.target for r in mixing.source_targets(before.select("source", mixing.word_count(F.coalesce("text", F.lit(""))).alias("size"))).collect()}
            assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in size)
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
            assert got == Counter(d for d, _ in rows)
            assert all(r.piece_ids == library.encode(r.text or "") and r.n_pieces == len(r.piece_ids) for r in docs.collect())
        kept[name] = sum(got.values())
    assert kept["exact"] < kept["quality"] < 200


def stage_rows(df):
    from tidewater.llm.common import stage
    return stage(df, "test")


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, make, odd_rows, sf_dir):
    import corpus_pipeline
    for rows in (odd_rows, []):
        docs = make(rows)
        for name, function in corpus_pipeline.STAGES:
            docs = stage_rows(function(spark, docs, sf_dir))
            assert docs.columns == corpus_pipeline.COLUMNS + (["n_pieces", "piece_ids"] if name == "pieces" else [])
            assert (docs.count() > 0) == bool(rows), name


def blank_free(r):
    """Texts without blanks from small alphabets, which merge in many ways."""
    pieces = ["a", "b", "the", "in", "ing", "tion", "International", "ß", "Über", "日", "本", "語", "x" * 7, "=", "==", "0", "1", "\n", "é", "\U0001F600", "\U0010FFFF", "한", "ไท", "▁"]
    some = r.sample(pieces, r.randint(1, 5))
    return "".join(r.choice(some) for _ in range(r.randint(1, 900)))


@pytest.mark.parametrize("window,stride", [(192, 128), (24, 16), (40, 12)])
def test_stretches_without_blanks_equal_the_library(monkeypatch, window, stride):
    monkeypatch.setattr(piece_codec, "WINDOW", window)
    monkeypatch.setattr(piece_codec, "STRIDE", stride)
    path = public_tokenizers.path(PIECES)
    model, library = piece_codec.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(window)
    texts = [blank_free(r) + r.choice(["", " ", "  tail"]) for _ in range(400)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text


def test_a_megabyte_without_blanks_takes_seconds():
    path = public_tokenizers.path(PIECES)
    model, library = piece_codec.PieceModel.at(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r, size = random.Random(9), 1 << 20
    texts = {"Chinese": "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(size // 3)), "Japanese": "".join(r.choice("のをはが、。漢字語") + chr(r.randint(0x30A1, 0x30FA)) for _ in range(size // 6)),
             "base64": base64.b64encode(r.randbytes(size * 3 // 4)).decode(), "one letter": "x" * size, "uneven runs": ("a" * 1000 + "b") * (size // 1001), "line ends": "\n" * size}
    for name, text in texts.items():
        start = time.monotonic()
        ids = model.encode([text])[0]
        assert time.monotonic() - start < 10, name
        assert ids.tolist() == library.encode(text), name
    assert not any(len(w) > piece_codec.CACHED_WORD for w in model.words if w.strip("▁"))
