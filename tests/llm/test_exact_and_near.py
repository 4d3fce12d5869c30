import hashlib
import itertools
import random
import re

import corpus_pipeline
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, graph, simhash
from tidewater.llm.common import table

WS = re.compile(r"[\x20\x09-\x0D]")


def expected_groups(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(WS.sub("", text or ""), []).append((len(text or ""), doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[0], m[1] is None, m[1] or 0))[1]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(d, keep, len(members), d == keep, sha) for _, d in members]
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_groups_match_brute_force(spark, make, odd_rows, sf_dir):
    docs = make(odd_rows)
    assert as_rows(exact_dedup.exact_groups(docs)) == expected_groups([r[:2] for r in odd_rows])
    real = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    assert as_rows(exact_dedup.exact_groups(real)) == expected_groups(rows)


def test_equal_digests_of_other_bytes_are_told_apart(make):
    rows = [(1, "aa x"), (2, "aax"), (3, "aay"), (4, "b"), (5, "ccc"), (6, "bb"), (7, "b b")]
    got = exact_dedup.exact_groups(make(rows), digest=lambda norm: F.lpad(F.hex(F.length(norm) % 2), 2, "0"))
    found = {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()}
    assert found == {(d, k, n) for d, k, n, *_ in expected_groups(rows)}


def test_state_carries_over_and_survives_a_restart(spark, make):
    state = exact_dedup.DedupState(spark)
    state.ingest(make([(1, "one two"), (2, "three")]))
    again = exact_dedup.DedupState(spark, home=state.home)  # a new process on the same folder
    again.ingest(make([(3, "onetwo"), (4, "one  two ")]))
    kept = {(r.keep_id, r.n) for r in again.groups().collect()}
    assert kept == {(4, 3), (2, 1)}


def test_the_callers_session_keeps_its_settings(spark, make):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, "unset")
    exact_dedup.exact_groups(make([(1, "a")])).collect()
    assert spark.conf.get(key, "unset") == before


def test_drop_exact_duplicates(make, odd_rows):
    docs = make(odd_rows + [(1, "another under id 1")])
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [WS.sub("", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({WS.sub("", r[1] or "") for r in odd_rows} | {"anotherunderid1"})
    assert exact_dedup.drop_exact_duplicates(make([])).count() == 0


def reference_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(spark, make, odd_rows, sf_dir):
    real = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in real.collect()]
    fps = {d: reference_fingerprint(t) for d, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = components(pairs, fps)
    got = simhash.simhash_components(real).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{fps[d]:016x}", want[d]) for d in fps}
    odd = simhash.simhash_components(make(odd_rows)).collect()
    assert len(odd) == len(odd_rows)
    assert {r.fingerprint for r in odd if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert {r.component_id for r in odd if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.simhash_components(make([])).count() == 0


def test_overlong_postings_give_the_same_components(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = [simhash._signed(v) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    want = components(pairs, signed)
    for most in (256, 2):
        links = simhash.links(fps, max_posting=most)
        assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in links.collect())
        found = {r.node: r.component for r in graph.connected_components(links).collect()}
        assert {v: found.get(v, v) for v in signed} == want


def broadcast_parts(df):
    """What the plan of ``df`` has below each broadcast."""
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"\w", x)]
    depth = [re.search(r"\w", x).start() for x in lines]
    parts = []
    for i in range(len(lines)):
        if "BroadcastExchange" in lines[i]:
            parts.append("\n".join(lines[j] for j in itertools.takewhile(lambda j: depth[j] > depth[i], range(i + 1, len(lines)))))
    return parts


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Spark takes the 56 or 2,081 rows that each of these becomes for one."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(100)}
    signed = sorted(simhash._signed(v) for v in values)
    fps = simhash.stage(spark.createDataFrame([(v,) for v in signed], "fp long"), "test")
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    want = components(pairs, signed)
    monkeypatch.setattr(simhash, "FEW_MEMBERS", 0, raising=False)
    for most in (256, 2):
        links = simhash.links(fps, max_posting=most)
        planned = broadcast_parts(links)
        rows = [tuple(r) for r in links.collect()]
        assert not [x for x in planned + broadcast_parts(links) if "Generate" in x]  # as planned, and as run
        assert components(rows, signed) == want


def test_near_stage_broadcasts_no_rows_of_unknown_number(make, monkeypatch):
    """What the pipeline's near stage writes is planned without a broadcast of exploded rows or of the fingerprints of all rows."""
    seen, stage = [], simhash.stage

    def recorded(df, name):
        seen.extend(broadcast_parts(df))
        return stage(df, name)

    monkeypatch.setattr(simhash, "stage", recorded)
    monkeypatch.setattr(graph, "stage", recorded)
    text = " ".join(f"w{i} x{i * 7 % 13}" for i in range(300))
    docs = make([(3, text), (1, text + " tail"), (2, "other words entirely here " * 3)]).select(corpus_pipeline.COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.near(docs.sparkSession, docs, "").collect()) == [1, 2]
    assert not [x for x in seen if "Generate" in x or re.search(r"parquet \[doc_id#\d+L,fp#\d+L\]", x)]


def test_drop_near_duplicates_keeps_one_of_each_group(make):
    text = " ".join(f"w{i} x{i * 7 % 13}" for i in range(300))
    docs = make([(3, text), (1, text + " tail"), (2, "other words entirely here " * 3), (2, "other words entirely here " * 3)])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 2]


def test_components_of_a_chain_and_no_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.connected_components(chain.where("a < 0")).count() == 0


def test_other_texts_under_one_id_stay(make):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1] + " "), (3, texts[2]), (7, texts[2]), (7, texts[3])]
    got = sorted((r.doc_id, r.text.strip()) for r in simhash.drop_near_duplicates(make(rows)).collect())
    assert got == sorted([(5, texts[0]), (5, texts[1]), (3, texts[2]), (7, texts[3])])


def test_extreme_identifiers(make):
    low, high = -2**63, 2**63 - 1
    got = {r.doc_id: r for r in exact_dedup.exact_groups(make([(low, "a b"), (high, "a b"), (0, "ab"), (5, "x"), (low + 1, "x"), (None, "x y"), (None, "xy"), (3, "xy")])).collect()}
    assert got[0].keep_id == low and got[high].keep_id == low and got[low].kept and got[5].keep_id == low + 1
    assert got[3].keep_id is None


def test_bitmap_keeps_every_hit_and_hot_groups_are_whole(spark, make, monkeypatch):
    digests = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    hits = digests.where("id % 7 = 0")
    kept = {r.id for r in exact_dedup.only_hits(digests, hits.select("digest")).collect()}
    assert {i for i in range(0, 3000, 7)} <= kept and len(kept) < 440
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 64)  # everything passes, and nothing changes
    docs = make([(i, "hot text") for i in range(60)] + [(100 + i, f"text {i // 2}") for i in range(60)])
    want = sorted(map(repr, exact_dedup.exact_groups(docs).collect()))
    assert sum("group_size=60" in r for r in want) == 60 and sum("group_size=2" in r for r in want) == 60
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 1)
    assert sorted(map(repr, exact_dedup.exact_groups(docs).collect())) == want
