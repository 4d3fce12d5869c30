import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import fill_middle, line_dedup, token_alignment
from tidewater.llm.common import table
from tidewater.llm.queries import BYTE_BPE, PIECES, op11_token_alignment, op12_line_dedup, op13_fill_middle

PATHS = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES)
ENDS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# --- fill in the middle ---

def cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 50
    return doc_id, n, "spm" if spm else "psm", len(pre), len(mid), sha(f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)


MIDDLES = [(20, "a\nb\n\nc"), (21, "<P"), (22, "a <S> b\nc"), (23, "<\n<\n>\nS>\n<P\n>M"), (24, "\n" * 50), (25, "$1\\\n$2 {3}\n"), (26, "\r\n x\x85\ny\x0b\n"),
           (27, "line of some words\n" * 60_000), (28, "x" * 1_000_000), (29, "\U0001F600\n" * 500), (-5, "negative\nid\n"), (2**62, "a\nb\nc\n")]


def test_fill_middle_matches_brute_force(spark, make, odd_rows, sf_dir, tmp_path):
    make(odd_rows + MIDDLES).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (sf_dir, str(tmp_path)):
        same(op13_fill_middle(spark, folder).collect(), [cut(r.doc_id, r.text) for r in table(spark, folder, "documents").select("doc_id", "text").collect()])


def test_fill_middle_parameters(make):
    docs = make([(i, "one\ntwo\nthree\n") for i in range(200)])
    shares = Counter(r.form for r in fill_middle.fill_in_middle(docs, percent=50, spm_percent=0).collect())
    assert set(shares) == {"plain", "psm"} and 60 < shares["plain"] < 140
    by_char = fill_middle.fill_in_middle(docs, unit=r"[\s\S]").withColumn("back", fill_middle.restored_text(F.col("output"), F.col("form"))).collect()
    assert {r.n for r in by_char} == {14} and {r.back for r in by_char} == {"one\ntwo\nthree\n"}
    assert fill_middle.fill_in_middle(make([])).count() == 0


# --- line dedup ---

def key(line):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(ENDS))


def without_frequent(rows, least):
    docs = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")} if k)
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if docs[key(x)] < least]
        yield doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)


def lined(seed, n):
    r = random.Random(seed)
    pool = [f"{r.choice(ENDS.replace(chr(10), ''))}Line {i} ÄÖ {i}{r.choice(['', ' ', chr(9)])}" for i in range(40)]
    return [(i, "\n".join(r.choice(pool) if r.random() < 0.6 else r.choice(["", "  ", f"own {i} {r.random()}", "A line in ALL"]) for _ in range(r.randint(0, 12)))) for i in range(n)]


EVERYWHERE = [(100 + i, "Everywhere\nEVERYWHERE  \n\teverywhere") for i in range(12)] + [(200 + i, f"\nnine times\n{i}") for i in range(9)]


def test_line_dedup_matches_brute_force(spark, make, odd_rows, sf_dir, tmp_path):
    make(odd_rows + EVERYWHERE + [(None, "everywhere\nx"), (None, "everywhere\nx"), (300, "every line\n" * 50_000)]).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (sf_dir, str(tmp_path)):
        rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
        want = [(d, n, m, sha(t)) for d, n, m, t in without_frequent(rows, 10)]
        assert any(m for _, _, m, _ in want)
        same(op12_line_dedup(spark, folder).collect(), want)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (8, 3)])
def test_batches_and_merges_do_not_matter(make, batches, fanout):
    rows = lined(batches, 400)
    got = line_dedup.drop_frequent_lines(make(rows).repartition(8, "doc_id"), min_docs=7, batches=batches, fanout=fanout)
    same(got.collect(), list(without_frequent(rows, 7)))


def test_hot_lines_and_cold_lines_agree(make, monkeypatch):
    rows = lined(3, 300)
    for share in (1, 10, 10**9):  # no line is hot; some; all
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        same(line_dedup.drop_frequent_lines(make(rows).repartition(6), min_docs=5).collect(), list(without_frequent(rows, 5)))


def test_line_runs_levels_restart_and_plans(spark, make):
    assert line_dedup.live_runs(0, 2) == [] and line_dedup.live_runs(7, 2) == [(2, 0), (1, 2), (0, 6)] and line_dedup.live_runs(18, 4) == [(2, 0), (0, 16), (0, 17)]
    rows = lined(7, 600)
    first = line_dedup.LineRuns(spark, min_docs=7)
    first.ingest(make(rows[:200]).repartition(3), batches=3)
    first.release()
    # Another instance goes on in the same folder; one more batch with old and new lines.
    runs = line_dedup.LineRuns(spark, first.home, min_docs=7)
    assert runs.batches() == 3
    runs.ingest(make(rows[200:]).repartition(2), batches=1)
    assert runs.batches() == 4
    total = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")} if k)
    often = runs.frequent()
    assert often.count() == sum(n >= 7 for n in total.values())
    # A replayed batch changes nothing, and settled lines leave a new batch.
    before = {tuple(r) for r in runs.run(runs.session, 2, 0).collect()}
    again = runs.session.read.schema(line_dedup.LANDED).parquet(f"{runs.home}/landed")
    counts = again.select(F.explode("lines").alias("l")).groupBy("l.h1", "l.h2").agg(F.count("*").alias("n"))
    left = runs.unsettled(runs.session, counts, 4)
    assert left.count() == sum(1 for *_, n in before if n < 7)
    # Runs meet a batch, and each other, without an exchange of their own.
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    merged = runs.merged([runs.run(runs.session, 1, 0), runs.run(runs.session, 1, 1)])
    assert "Exchange" not in (plan := merged._jdf.queryExecution().executedPlan().toString()) and "Sort " not in plan
    assert len(before) == merged.count() == merged.select("h1", "h2").distinct().count()
    # The last batch again, as after a crash, by a process that knows no table yet: its run and the merges are written over.
    want = sorted(map(tuple, often.collect()))
    later = line_dedup.LineRuns(spark, first.home, min_docs=7)
    text = F.coalesce("text", F.lit(""))
    batch = make(rows[200:]).select("doc_id", F.xxhash64(text).alias("digest"), line_dedup.hashed_lines(text).alias("lines")).where("size(lines) > 0")
    for _ in range(2):
        later._add(batch, 3)
        assert later.batches() == 4 and sorted(map(tuple, later.frequent().collect())) == want
    later.release()
    runs.release()
    assert spark.sql("SHOW TABLES LIKE 'line_runs_*'").count() == 0
    assert line_dedup.drop_frequent_lines(make([])).count() == 0


# --- alignment ---

def brute(rows):
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = {c: i for i, c in token_alignment_letters().items()}

    def ends(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    found = []
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        xs = a.encode(" " + text, add_special_tokens=False) if text else None
        ys = b.encode(text) if text else []
        of_a = [bytes(letters[c] for c in t) for t in xs.tokens] if text else []
        of_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ys)]
        groups = []
        if text and b"".join(of_a) == want == b"".join(of_b):
            ids, ea, eb = xs.ids, ends(of_a), ends(of_b)
            start_a = start_b = 0
            for end in sorted(set(ea) & set(eb)):
                i, j = ea.index(end, start_a) + 1, eb.index(end, start_b) + 1
                groups.append((ids[start_a:i], ys[start_b:j]))
                start_a, start_b = i, j
        found.append((doc_id, groups))
    held = Counter(p for _, groups in found for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for doc_id, groups in found:
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        yield (doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
               sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), sha(text) if text else "")


def token_alignment_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


ALIGNED = [(50, "a ▁ b"), (51, "<|endoftext|> x </s> <unk> <0x41>"), (52, "日本語のテキスト 中文 русский"), (53, "  two  blanks\n\n\ttab "), (54, "\U0001F600\U0001F468‍\U0001F469 é"), (55, " "), (56, "a\x00b\x7f")]


def test_alignment_matches_brute_force(spark, make, odd_rows, sf_dir, tmp_path):
    r = random.Random(5)
    blank_free = [(60, "".join(r.choice("abcdefghijkLMNOP0123456789+/") for _ in range(3000))), (61, "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(2000)))]
    short = [x for x in odd_rows if not x[1] or len(x[1]) < 1000]
    make(short + ALIGNED + blank_free + [(62, "x" * 5000)]).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf_dir, "documents").where("length(text) < 3000").coalesce(2).write.parquet(f"{tmp_path}/more/documents.parquet")
    for folder in (str(tmp_path), f"{tmp_path}/more"):
        rows = [tuple(x) for x in table(spark, folder, "documents").select("doc_id", "text").collect()]
        same(op11_token_alignment(spark, folder).collect(), list(brute(rows)))


def test_alignment_blocks_and_wide_groups_do_not_matter(spark, make, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").where("length(text) < 3000")
    want = sorted(map(repr, token_alignment.align_documents(docs, *PATHS).collect()))
    assert sorted(map(repr, token_alignment.align_documents(docs.repartition(3, "doc_id"), *PATHS, block_bytes=1).collect())) == want
    pair = token_alignment.TokenizerPair.at(*PATHS)
    texts = [r.text for r in docs.limit(40).collect() if r.text]

    def staged():
        block = token_alignment.Block(pair)
        block.add(list(range(len(texts))), texts)
        return [b.to_pydict() for b in block.flush(0)]

    plain = staged()
    monkeypatch.setattr(token_alignment, "WIDE", 1)
    monkeypatch.setattr(token_alignment, "SLICE_LINKS", 7)
    assert staged() == plain
    monkeypatch.setattr(pair, "quick", None)  # the other library
    assert staged() == plain
    found = token_alignment.pair_table(docs, *PATHS)
    assert found.where("best").select("a").distinct().count() == found.select("a").distinct().count()
    assert token_alignment.align_documents(make([]), *PATHS).count() == 0


def test_diagonal_groups_on_random_ends():
    r = random.Random(1)
    for _ in range(500):
        n = r.randint(1, 60)
        a, b = (sorted({*r.sample(range(1, n), r.randint(0, n - 1)), n}) if n > 1 else [1] for _ in range(2))
        both = [0, *sorted(set(a) & set(b))]
        in_a, in_b = token_alignment.diagonal_groups(a, b)
        assert in_a.tolist() == [sum(x <= e for x in a) for e in both[1:]] and in_b.tolist() == [sum(x <= e for x in b) for e in both[1:]]


def test_wide_groups_and_long_texts_are_bounded(make):
    """A text of a megabyte that one token pair fills, and one without blanks."""
    rows = [(1, " " * 500_000), (2, "y" * 1_000_000), (3, "漢字" * 150_000)]
    got = {r.doc_id: r for r in token_alignment.align_documents(make(rows), *PATHS).collect()}
    assert all(got[i].n_links >= got[i].n_groups > 0 for i in got)
