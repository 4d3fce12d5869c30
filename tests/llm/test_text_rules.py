import re
import textwrap
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.llm import licenses, mixing, oracles, quality_rules, url_filter
from tidewater.llm.common import let, table, words


def repeated(tokens):
    windows = [tuple(tokens[i:i + 3]) for i in range(len(tokens) - 2)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = repeated(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, n, len(w) < 50 or 100 * n > 50 * len(w))


def test_quality_base_matches_brute_force(spark, make, odd_rows, sf_dir):
    for docs in (table(spark, sf_dir, "documents"), make(odd_rows)):
        rows = docs.select("doc_id", "text").collect()
        got = quality_rules.judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((r.doc_id, *base(r.text))) for r in rows)


@pytest.mark.parametrize("bits", [20, 1])
def test_repeated_words_either_way(spark, monkeypatch, bits):
    """One position bit: the packed sort can't hold the windows and texts decide."""
    monkeypatch.setattr(quality_rules, "POSITION_BITS", bits)
    texts = ["a a a a", "a b c x a b c", "a b", "", "a b c d", "x y z " * 9, "a b c a b d a b c a b d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(let(words(F.col("t")), quality_rules.repeated_words)).collect()]
    assert got == [repeated(t.split()) for t in texts]


def test_quality_verdicts(spark, make, sf_dir):
    docs = table(spark, sf_dir, "documents")
    refs = quality_rules.references(docs)
    shouting = " ".join(w.upper() + "!!" for w in docs.where("lang = 'en'").first().text.split()[:40]) * 1
    junk = make([(1, " ".join(f"{a}{b}{c}X!! $$$%{a}" for a in "ABCDE" for b in "FGHIJ" for c in "KLMNO")), (2, shouting), (3, "word"), (4, None)])
    got = {r.doc_id: r for r in quality_rules.judge_quality(junk, against=refs).collect()}
    assert not got[1].base_failed and not got[1].kept
    assert got[3].base_failed and got[4].base_failed and got[4].n_words == 0
    judged = quality_rules.judge_quality(docs).join(table(spark, sf_dir, "labels"), "doc_id").where("NOT base_failed")
    clean = judged.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean > 0.97
    assert quality_rules.judge_quality(make([])).count() == 0
    # A null lang is judged by the whole corpus: prose stays, junk goes.
    prose = [r.text for r in docs.where("lang = 'en' AND length(text) BETWEEN 800 AND 3000").limit(20).collect()]
    shout = " ".join(f"{a}{b}{c}X!! $$$%{a}" for a in "ABCDE" for b in "FGHIJ" for c in "KLMNO")
    mixed = quality_rules.judge_quality(make([(i, t, None) for i, t in enumerate(prose)] + [(99, shout, None)]), against=refs).collect()
    assert all(r.class_distance is not None for r in mixed) and not [r for r in mixed if r.doc_id == 99][0].kept
    assert sum(r.kept or r.base_failed for r in mixed if r.doc_id < 99) >= 18


def test_common_words_of_any_length(make):
    docs = make([(1, "extraordinarily long words " * 3 + "a", "en"), (2, "kurz kurz sehr", "de"), (3, "long", None)])
    got = {r.of: list(zip(r.common, r.common_shares)) for r in quality_rules.common_words(docs, quality_rules.Limits(n_common=2)).collect()}
    assert got["en"] == [("extraordinarily", 0.3), ("long", 0.3)] and got["de"] == [("kurz", 2 / 3), ("sehr", 1 / 3)]
    assert got[None] == [("long", 4 / 14), ("extraordinarily", 3 / 14)]


def test_every_licence_sentence_has_a_cue():
    for name, text in licenses.SENTENCES:
        assert re.search(licenses.CUE, text), name
    assert {i for _, ids in licenses.RULES for i in ids} <= {n for n, _ in licenses.SENTENCES}


def test_licences(make):
    apache = licenses.SENTENCES[3][1].replace("; you", ";\nyou")
    rows = [(1, "Some prose. Released under the MIT License. More."), (2, None), (3, ""), (4, "no cue at all " * 20),
            (5, f"/* {apache}.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 */"),
            (6, "prose without stop\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
            (7, "See the GNU General Public License for more details."), (8, "our licence is secret. " * 5000),
            (9, "Released under the MIT License.\nReleased under the MIT License.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(make(rows)).collect()}
    assert got[1].licenses == "MIT" and got[1].sentence_ids == "[-][MitReleased][-]"
    assert {got[i].licenses for i in (2, 3, 4, 7, 8)} == {""}
    assert got[5].licenses == "Apache-2.0" and got[5].n_unmatched == 0 and got[5].n_known == 2
    assert got[6].licenses == "GPL-3.0,CC-BY-NC-4.0"
    assert got[7].n_unmatched == 1
    assert got[9].licenses == "MIT" and got[9].n_known == 2
    assert licenses.scan_licenses(make([])).count() == 0


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_every_licence_sentence_alone_and_numbered_lists(make):
    used = {i: licence for licence, ids in reversed(licenses.RULES) if len(ids) == 1 for i in ids}
    alone = list(licenses.SENTENCES)
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed, see it."
    lists = [BSD, BSD.replace("met:\n\n", "met:\n"), " ".join(BSD.split()), "\n".join(f"# {x}" for x in BSD.split("\n")), BSD.replace("1.", "(1)").replace("2.", "2)").replace("3.", "c)")]
    rows = [(i, text) for i, (_, text) in enumerate(alone)] + [(100, mpl), (101, BSD[:BSD.index("3. ")]), *((200 + i, x) for i, x in enumerate(lists))]
    rows += [(300, "This work is licensed under the GNU General Public License, version\n2. It is free.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(make(rows)).collect()}
    for i, (identifier, text) in enumerate(alone):
        assert got[i].n_known == 1 and got[i].licenses == used.get(identifier, ""), text
    assert got[100].licenses == "MPL-2.0" and got[101].licenses == "BSD-2-Clause" and got[300].licenses == "GPL-2.0"
    assert {got[200 + i].licenses for i in range(len(lists))} == {"BSD-3-Clause"}


def test_wrapped_licence_sentences_in_comments(make):
    text = {name: x for name, x in licenses.SENTENCES}
    wrapped = lambda *names: [line for n in names for line in (*textwrap.wrap(text[n] + ".", 60), "")]
    notices = {"GPL-3.0-or-later": wrapped("GplFree", "GplHope", "GplSee"), "MIT": wrapped("MitGrantOnly", "MitNotice", "MitWarranty"),
               "ISC": wrapped("IscGrant"), "LGPL-2.1-or-later": wrapped("LgplFree"), "Apache-2.0": wrapped("ApacheHeader"), "Unlicense": textwrap.wrap(text["Unlicense"], 12)}
    rows, want = [], []
    for licence, lines in notices.items():
        for mark in ("", "# ", " * ", "// ", "! ", "//! ", "REM ", ";; ", "dnl ", "-- "):
            for head in (["Copyright 2020 Someone", ""], ["Copyright 2020 Someone"], ["code();", "Copyright 2020 Someone"]):
                rows.append((len(rows), "\n".join((mark + x).rstrip() for x in head + lines)))
                want.append(licence)
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(make(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == want


MEGABYTE = 1 << 20


def test_licences_in_odd_and_long_texts(make, odd_rows):
    """No pattern nests a call or starts anew for each character."""
    long = ["install " + "许可证文本" * (MEGABYTE // 15), "overall " + "-" * MEGABYTE, "license " + " " * MEGABYTE + "x", "license\n" + "\n" * MEGABYTE, "license " + "." * MEGABYTE,
            "copyright\n" + "1\n" * (MEGABYTE // 2), "copyright\n" + "a) " * (MEGABYTE // 3), "copyright\n" + "# \n" * (MEGABYTE // 3), "license " + "v. " * (MEGABYTE // 3),
            "public " + "rem" * (MEGABYTE // 3), "license " + ". " * (MEGABYTE // 2), "許可 domain " * (MEGABYTE // 20), "license\n" + "\t" * MEGABYTE + "\n", "license;" + " " * MEGABYTE]
    docs = make(odd_rows + [(100 + i, x + "\n\nReleased under the MIT License.") for i, x in enumerate(long)])
    started = time.monotonic()
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    assert time.monotonic() - started < 120
    assert {got[100 + i] for i in range(len(long))} == {"MIT"} and len(got) == len({r[0] for r in odd_rows}) + len(long)


def test_licence_sql_equals_the_operator(spark, make, odd_rows, tmp_path):
    """Numbered lists, versions, wrapped notices in comments, several licences in one text."""
    text = dict(licenses.SENTENCES)
    texts = [x for _, x in licenses.SENTENCES] + [x + "." for _, x in licenses.SENTENCES]
    texts += [BSD, BSD.replace("met:\n\n", "met:\n"), " ".join(BSD.split()), "\n".join(f"# {x}" for x in BSD.split("\n")), BSD.replace("1.", "(1)").replace("2.", "2)").replace("3.", "c)")]
    texts += ["This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy was not distributed, see it.", "see v. 2 and V.\n3! or v.. 4 rev. 5"]
    for names in (("GplFree", "GplHope", "GplSee"), ("MitGrantOnly", "MitNotice", "MitWarranty"), ("IscGrant",), ("Unlicense", "RightsReserved"), ("AgplFree", "GplHope", "AgplSee"), ("Spdx:MIT", "Spdx:ISC")):
        lines = [line for n in names for line in (*textwrap.wrap(text[n] + ".", 50), "")]
        for mark in ("", "# ", " * ", "// ", "REM ", ";; ", "dnl "):
            texts.append("\n".join((mark + x).rstrip() for x in ["code();", "Copyright 2020 Someone", *lines, "more of it"]))
            texts.append("\n".join((mark + x).rstrip() for x in [*lines, *lines, "1.", "a", "iv", *lines]))
    docs = make(odd_rows + [(100 + i, x) for i, x in enumerate(texts)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(oracles.SQL["op1_license_scan"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in licenses.scan_licenses(docs).collect()) == want


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing and resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: cap * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > cap * sizes[s]]
        if not over:
            return target
        full |= set(over)


def test_mix_targets_and_amounts(spark, make, odd_rows, sf_dir):
    skewed = [(i, "w " * (1 + i % 7), "en", "big" if i % 3 else f"s{i % 11}") for i in range(600)] + [(1000, None, "en", "empty"), (1001, "only", "en", None)]
    for docs in (table(spark, sf_dir, "documents"), make(skewed), make(odd_rows)):
        size = {}
        for r in docs.select("source", "text").collect():
            size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want = fill(size)
        got = mixing.mix(docs).collect()
        source = {}
        for r in docs.select("doc_id", "source").collect():
            source.setdefault(r.doc_id, r.source)
        assert len(got) == docs.count()
        taken, largest = Counter(), Counter()
        for r in got:
            s = source[r.doc_id]
            assert r.target == pytest.approx(want[s]) and r.source_size == size[s]
            assert r.taken <= 3 * r.size
            taken[s] += r.taken
            largest[s] = max(largest[s], r.size)
        for s in want:
            assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert mixing.mix(make([])).count() == 0


def test_mix_reruns_agree_and_bins_do_not_matter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    runs = [sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(n, "doc_id"), buckets=b).collect()) for n, b in ((1, 4096), (7, 4096), (3, 1))]
    assert runs[0] == runs[1] == runs[2]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


def test_inclusion_weight_prefers_heavier_documents(make):
    docs = make([(i, "w w w", "en", "a" if i < 400 else "b") for i in range(800)])
    even = mixing.mix(docs, weights=(1, 3)).where("doc_id < 400")
    heavy = mixing.mix(docs, weights=(1, 3), inclusion_weight=F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)).where("doc_id < 400")
    share = lambda df: df.where("doc_id % 2 = 0").agg(F.sum("taken")).first()[0] / df.agg(F.sum("taken")).first()[0]
    assert share(heavy) > share(even) + 0.1


def test_inclusion_probabilities_are_met_and_reach_certainty(make):
    """Long, middling and short documents of one source, of which half the words are wanted."""
    rows = [(i, "w " * (400 if i % 50 == 0 else 25 if i % 2 else 4), "en", "a") for i in range(2000)] + [(10_000 + i, "w " * 30, "en", "b") for i in range(2000)]
    size = {d: len(t.split()) for d, t, *_ in rows if d < 10_000}
    wanted = 0.5 * sum(size.values())
    kinds = {400: [], 25: [], 4: []}
    for seed in "abcdef":
        out = mixing.mix(make(rows), weights=(1, 3), seed=seed).where("doc_id < 10000").collect()
        source, target = out[0].source_size, out[0].target
        extra = {r.doc_id: r.copies - int(target // source) for r in out}
        for kind, seen in kinds.items():
            of = [extra[d] for d, n in size.items() if n == kind]
            seen.append(sum(of) / len(of))
        rest = target - target // source * source
        assert abs(sum(size[d] * e for d, e in extra.items()) - rest) <= 200
    z, n = {400: 20, 25: 5, 4: 2}, {k: sum(x == k for x in size.values()) for k in kinds}
    sure, c = 0, rest / sum(z[k] * k * n[k] for k in kinds)
    if c * 20 >= 1:
        sure, c = 400 * n[400], (rest - 400 * n[400]) / sum(z[k] * k * n[k] for k in (25, 4))
    for kind, seen in kinds.items():
        assert sum(seen) / len(seen) == pytest.approx(min(1, c * z[kind]), abs=0.06), (kind, c, wanted)
    assert kinds[25] != kinds[4] and sum(kinds[25]) > sum(kinds[4]) * 1.5


def page(head):
    return f"<html><head>{head}</head><body>x</body></html>"


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "https://Sub.Example.NET/en/a?q#f", page("")), (2, "http://x.net/de", page("")), (3, "http://example.com/de/x", page("")),
        (4, "http://a.org/fr/x", page("")), (5, "http://a.net", page("")), (6, None, None), (7, "no scheme", page("")),
        (8, "http://alias.test/one", page('<link rel="canonical" href="http://bad.net/x">')),
        (9, "http://alias.test/two", page('<meta http-equiv="refresh" content="0; url=/one">')),
        (10, "http://c.test/", page('<LINK href="http://a.org/fr/x" REL=canonical>')), (11, "http://c.test/in", page('<link rel="canonical" href="http://bad.net/y">')),
        (12, "http://c.test/in2", page('<link rel="canonical" href="in">')), (13, "http://c.test/both", page('<link rel="canonical" href="http://c.test/in"><link rel="canonical" href="http://c.test/">')),
        (14, "http://free.test/", page('<a href="http://bad.net/x">')), (2, "http://x.net/de", page("")), (15, "http://notexample.com/de/x", page("")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    rules = url_filter.rule_table(spark)
    got = {r.page_id: r for r in url_filter.judge_pages(pages, rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("sub.example.net", "/en/a", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/", "block") and got[3].rule == "example.com/de/" and got[4].verdict == "allow"
    assert (got[5].host, got[5].path, got[5].rule, got[5].verdict) == ("a.net", "", None, "allow")
    assert (got[6].host, got[6].path, got[6].verdict) == ("", "", "allow") and got[7].host == ""
    assert got[8].verdict == got[9].verdict == "block" and got[8].rule is None
    assert got[14].verdict == "allow" and got[15].rule is None
    # 10 to 13 are one component with a blocked and an explicitly allowed alias: allow comes first.
    assert {got[i].verdict for i in (10, 11, 12, 13)} == {"allow"}
    assert len(url_filter.judge_pages(pages, rules).collect()) == len(rows)
    moved = spark.createDataFrame([("http://free.test/", "http://bad.net/z")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filter.judge_pages(pages, rules, moved).collect()}[14] == "block"
    assert url_filter.judge_pages(pages.where("page_id < 0"), rules).count() == 0


def test_aliases_by_one_name_whatever_its_spelling(spark, tmp_path):
    """Empty and dotted paths are one node, in the operator and in its SQL."""
    canonical = lambda href: page(f'<link rel="canonical" href="{href}">')
    rows = [
        (1, "http://a.test/", page("")), (2, "http://bad.net/x", canonical("http://a.test")), (3, "http://a.test", page("")),
        (4, "http://b.test/one/two/three", canonical("../../z")), (5, "http://bad.net/q", canonical("http://b.test/z")), (6, "http://b.test/./one/.././z", page("")),
        (7, "http://c.test/up/", canonical("http://worse.net/y")), (8, "http://c.test/up/./", page("")), (9, "http://c.test/up", page("")), (10, "http://c.test/x/../up/.", page("")),
        (11, "http://d.test/../../..", canonical("http://bad.net/r")), (12, "http://d.test?q", page("")), (13, "http://d.test#f", page("")), (14, "http://e.test/a..b/.c/", page("")),
        (15, "http://" + "a." * 40_000 + "net/", page("")), (16, "http://" + "." * 1000, page("")), (17, "http://.net", page(""))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_pages(pages, url_filter.rule_table(spark)).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 13, 15}
    pages.where("page_id <> 15").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(oracles.SQL["op10_url_filter"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in url_filter.judge_pages(pages.where("page_id <> 15"), url_filter.rule_table(spark)).collect()) == want
    assert url_filter.judge_pages(pages, url_filter.rule_table(spark).where("false")).where("verdict = 'block'").count() == 0


def test_slots_leave_out_no_common_word(spark):
    """Counts by slots are those of comparing each word with each common word."""
    from pyspark.sql import functions as F
    from tidewater.llm import quality_rules as Q

    words = [f"w{i * i % 97}" for i in range(3000)] + ["", "\u00e9", "the"]
    df = spark.createDataFrame([(words, [f"w{i}" for i in range(40)] + ["the"]), (words, []), ([], ["w1"])], "t array<string>, c array<string>")
    both = df.select(Q.counts_of(F.col("t"), F.col("c")).alias("plain"), Q.counts_of(F.col("t"), F.col("c"), Q.slots_of(F.col("c"))).alias("slots")).collect()
    assert [r.plain for r in both] == [r.slots for r in both] and sum(both[0].plain) > 0
