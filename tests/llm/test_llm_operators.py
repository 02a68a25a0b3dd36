"""Each operator against a plain version, and on odd rows: nulls, empties, ties, repeats, long texts, clashing columns."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from graphloom.llm import compact_windows, decontam, line_dedup, minhash, mixing, quality_classifier, quality_rules, suffix_tree_lm, url_filters
from graphloom.llm.components import connected_components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPLIT.findall((text or "").translate(LOW))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40), (None, 5)], "u long, v long")
    got = dict(connected_components(edges).collect())
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}
    assert connected_components(edges.limit(0)).count() == 0


# -- near-duplicates ---------------------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    reach = {i: i for i, _ in sets}
    for _ in range(len(sets)):
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    reach[i] = reach[j] = min(reach[i], reach[j])
    return reach


def test_near_duplicates(docs_of, prose):
    base = prose(1, 300).split(" ")
    rows = list(ODD)
    for k in range(25):  # a family in which only some pairs are alike
        w = list(base)
        for j in range(0, 300, 40 if k % 3 else 15):
            w[(j + 7 * k) % len(w)] = f"new{k}x{j}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, rows[-1][1].upper()), (201, prose(9, 4000)), (202, prose(9, 4000) + " tail")]
    got = minhash.near_duplicates(docs_of(rows))
    want = plain_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got.where("doc_id is not null").collect()} == want
    assert got.count() == len(rows) and got.where("doc_id is null").first()["component_id"] is None
    kept = minhash.keep_one(docs_of(rows))
    assert sorted({r["doc_id"] for r in kept.where("doc_id is not null").collect()}) == sorted(i for i, c in want.items() if i == c)
    assert minhash.near_duplicates(docs_of(rows).limit(0)).count() == 0


def test_blocks_find_all_links(docs_of, prose, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 4)
    rows = [(i, prose(1, 200) + f" end{i}") for i in range(30)]
    assert {r["component_id"] for r in minhash.near_duplicates(docs_of(rows)).collect()} == {0}


# -- lines -------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b, most):
    """Whether the distance is at most ``most``: only the cells of the band are filled."""
    beyond = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, beyond) + 1, new.get(j - 1, beyond) + 1, row.get(j - 1, beyond) + (x != b[j - 1]))
        row = new
    return row.get(len(b), beyond) <= most


def test_edit_distance(spark):
    import random

    r, rows = random.Random(5), []
    for _ in range(1500):
        a = [r.choice("abcé") for _ in range(r.randrange(15))]
        b = list(a)
        for _ in range(r.randrange(5)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [r.choice("abé")] * r.randrange(2)
        rows.append(("".join(a), "".join(b)))
    for tau in (1, 2, 3):
        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), tau).alias("d")).collect()
        assert all((x["d"] <= tau) == near(x["a"], x["b"], tau) for x in got)
        assert all(min(x["d"], tau + 1) == min(distance(x["a"], x["b"]), tau + 1) for x in got)


def plain_lines(rows):
    lines = [(i, k, s.strip(" \t\r\x0b\x0c")) for i, t in rows if i is not None for k, s in enumerate((t or "").split("\n"))]
    texts = sorted({s for _, _, s in lines if len(s) >= 20})
    cls = {s: s for s in texts}
    links = Counter()
    for a in texts:
        for b in texts:
            if a < b and near(a, b, 2):
                links[a] += 1
                links[b] += 1
                x, y = cls[a], cls[b]
                cls = {s: (x if c == y else c) for s, c in cls.items()}
    first = {}
    for i, k, s in sorted((i, k, s) for i, k, s in lines if len(s) >= 20):
        first.setdefault(cls[s], (i, k))
    out = {}
    for i, t in rows:
        raw = (t or "").split("\n")
        keep = [s for k, s in enumerate(raw) if len(x := s.strip(" \t\r\x0b\x0c")) < 20 or first[cls[x]] == (i, k)]
        out[i] = "\n".join(keep)
    return out, links


def test_line_dedup(docs_of, prose):
    line = "this is a line of some length, är"
    rows = [
        (10, f"{line}\nshort\nshort\nanother line that is long enough"), (11, f"  {line} \nonly here and nowhere else, no"), (12, line.replace("some", "sume")), (13, line.replace("some", "sme") + "!"),
        (14, "another line that is long enough?\n\nanother line that is long enough"), (15, line[4:]), (16, prose(2, 900)), (17, prose(2, 900).replace("alpha1", "alpha2")), (18, None), (19, ""), (20, "x" * 19), (21, "x" * 19), (22, "y" * 70_000), (23, "y" * 69_998 + "zz"),
    ]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    want, links = plain_lines(rows)
    assert {i: r["text"] or "" for i, r in got.items()} == want
    assert got[18]["text"] is None and sum(links.values()) > 4
    assert got[12]["_n_links"] == links[rows[2][1]] and got[22]["x" if False else "id"] == "x"
    odd = line_dedup.dedup_lines(docs_of(ODD))
    assert odd.count() == len(ODD) and odd.where("_n_dropped > 0").count() == 0
    assert line_dedup.dedup_lines(docs_of(ODD).limit(0)).count() == 0


# -- urls --------------------------------------------------------------------------------------------------------

RULES = [url_filters.PrefixRule(*x) for x in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"))]


def test_url_rules_and_mining(spark):
    urls = [(i, f"http://{'bad-shop' if i % 3 == 0 else 'good'}.example.com/{'offer' if i % 2 else 'news'}/{i}?ref={i}#top") for i in range(200)]
    odd = [(900, None), (901, "no scheme"), (902, "HTTP://A.Example.NET/en/x?y"), (903, "x://example.net"), (904, "x://notexample.net/en/a"), (905, "x://a.org/fr/"), (906, "x://?q#f"), (900, None)]
    pages = spark.createDataFrame([*urls, *odd], "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS tokens", "2 AS _x")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 and i % 2 else 1, 0) for i in range(200)] + [(None, 1, None), (901, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, labels, RULES).collect()}
    assert all((got[i]["verdict"] == "block") == (i % 3 == 0 and i % 2 == 1) for i, _ in urls)  # only the pair of tokens is bad
    assert (got[902]["host"], got[902]["path"], got[902]["rule"], got[902]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[903]["rule"] is None and got[904]["rule"] == "net/" and got[905]["rule"] == "org/fr/" and (got[906]["host"], got[906]["path"]) == ("", "")
    assert (got[900]["host"], got[900]["verdict"], got[901]["path"]) == ("", "allow", "")
    assert url_filters.filter_urls(pages.limit(0), labels, RULES).count() == 0 and url_filters.filter_urls(pages, labels.limit(0), RULES).where("confidence is not null").count() == 0


def test_mined_rules_against_counting(spark):
    rows = [(["a", "b"], True)] * 30 + [(["a"], False)] * 30 + [(["b"], False)] * 30 + [(["c"], True)] * 5
    rules = {r["rule_id"]: (r["confidence"], r["key"]) for r in url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), url_filters.Mining(confidence=0.6)).collect()}
    assert list(rules) == ["a b"] and rules["a b"][0] == 1.0  # c is too rare; a and b alone are not telling


def test_verdicts_against_all_itemsets(spark):
    """Every set of tokens counted: the verdicts of the whole operator, in tables with columns of any name."""
    r = random.Random(4)
    hosts, paths = ["a.example.com", "b.example.org", "m.c.example.com"], ["x", "y", "z/w"]
    urls = [(i, f"http://{r.choice(hosts)}/{r.choice(paths)}/{r.randrange(99)}" + r.choice(["", "?ref=1", "?ref=2&q=3"])) for i in range(400)]
    bad = {i: ("a.ex" in u and "ref" in u) or r.random() < 0.2 for i, u in urls}
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, b in bad.items() if i < 300], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 AS _bad", "2 AS _url", "3 AS _first", "4 AS _label_id", "5 AS key", "6 AS id", "7 AS bad")
    held = {x["page_id"]: frozenset(x["t"]) for x in pages.select("page_id", url_filters.tokens(F.col("url")).alias("t")).collect()}
    seen, hit = Counter(), Counter()
    for i in range(300):
        for k in range(1, len(held[i]) + 1):
            for c in itertools.combinations(sorted(held[i]), k):
                seen[c] += 1
                hit[c] += bad[i]
    mining = url_filters.Mining()
    share = sum(bad[i] for i in range(300)) / 300
    rules = [set(c) for c, n in seen.items() if hit[c] >= mining.least_urls and hit[c] / n >= mining.confidence and hit[c] / n / share >= mining.lift]
    want = {i: "block" if any(c <= held[i] for c in rules) else "allow" for i, _ in urls}
    got = url_filters.filter_urls(pages, labels, []).collect()
    assert {x["page_id"]: x["verdict"] for x in got} == want and set(want.values()) == {"allow", "block"}
    assert all(x["_bad"] == 1 and x["key"] == 5 for x in got)


# -- quality -----------------------------------------------------------------------------------------------------


def plain_base(text):
    w = SPLIT.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [s for s in (text or "").split("\n") if SPLIT.search(s)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_counts(docs_of, prose):
    rows = [*ODD, (50, "a b c d e a b c d e"), (51, "x " * 300), (52, prose(3, 500) + "\n\n" + "same line\nsame line\n"), (53, "|#$ " * 40), (54, "a b c d e f")]
    got = quality_rules.judge(docs_of(rows)).collect()
    told = sorted((r["doc_id"] or -1, r["_n_words"], r["_word_chars"], r["_n_symbols"], r["_n_dup_lines"], r["_n_repeat_words"]) for r in got)
    assert told == sorted((i or -1, *plain_base(t)) for i, t in rows)
    assert all(r["_base_failed"] == (r["_n_words"] < 10 or 100 * r["_n_repeat_words"] > 20 * r["_n_words"]) and not (r["_base_failed"] and r["_kept"]) for r in got)
    assert quality_rules.judge(docs_of(rows).limit(0)).count() == 0


def test_odd_distributions_are_rejected(docs_of, prose):
    common = "the of and to in is it for as with".split()
    rows = [(i, " ".join(w if k % 2 else common[(i + k // 2) % 10] for k, w in enumerate(prose(i, 200).split()))) for i in range(60)]
    rows.append((99, " ".join(f"W{k}%%% X{k}$$$" for k in range(100))))
    got = {r["doc_id"]: r["_kept"] for r in quality_rules.judge(docs_of(rows)).collect()}
    assert not got.pop(99) and all(got.values())


def test_js_distance(spark):
    df = spark.createDataFrame([([1, 0], [0, 1]), ([2, 2], [1, 1]), ([0, 0], [1, 1])], "p array<long>, q array<long>")
    got = df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()
    assert [round(r[0], 9) for r in got] == [1.0, 0.0, round(0.5**0.5, 9)]


def test_classifier_holds_out(docs_of, spark, prose):
    def text(i):
        body = prose(1000 + i, 120)
        return body.upper() if i % 5 == 0 else body.replace("\n", " nasty ", 3) + " nasty" if i % 5 == 1 else body

    rows = [(i, text(i), f"src{i % 4}") for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 1 if i % 5 == 1 else 0) for i in range(200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["_kept"] for r in quality_classifier.score(docs_of(rows), labels).where("doc_id >= 200").collect()}
    right = sum(kept == (i % 5 > 1) for i, kept in got.items())
    assert right >= 0.97 * len(got) and all(kept for i, kept in got.items() if i % 5 > 1)
    odd = quality_classifier.score(docs_of(ODD), labels)
    assert odd.count() == len(ODD) and odd.where("_posterior is null").count() == 0
    assert quality_classifier.score(docs_of(ODD), labels.limit(0)).count() == len(ODD) and quality_classifier.score(docs_of(ODD).limit(0), labels).count() == 0


def test_sparse_hosts_shrink(docs_of, spark, prose):
    rows = [(i, prose(i, 60).upper() if i < 90 else prose(i, 60), "bad" if i < 100 else f"h{i % 7}") for i in range(300)]
    labels = spark.createDataFrame([(i, 0 if i < 90 else 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    prior = {r["source"]: r["_prior"] for r in quality_classifier.score(docs_of(rows), labels).collect()}
    assert prior["bad"] > 0.7 and all(0 < v < 0.3 for k, v in prior.items() if k != "bad")


# -- mixing ------------------------------------------------------------------------------------------------------


def test_mixing(docs_of, prose):
    rows = [(i, prose(i, 5 + i % 90), ["a", "b", "c", None][min(i % 10, 3)]) for i in range(600)] + [(None, "x y"), (7, None, "zero"), (700, "w " * 60_000, "a")]
    got = [r.asDict() for r in mixing.expected(docs_of(rows)).collect()]
    total = sum(r["_size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["_copies"] <= 3 and r["_target"] <= 3 * r["_source_size"] + 1e-6
    assert abs(sum(v[0]["_target"] for v in by.values()) - total) < 1e-3 * total
    for source, v in by.items():
        most = max(r["_size"] for r in v)
        assert abs(sum(r["_copies"] * r["_size"] for r in v) - v[0]["_target"]) <= 2 * most, source
    again = {(r["doc_id"], r["_size"]): r["_copies"] for r in mixing.expected(docs_of(rows[::-1])).collect()}
    assert again == {(r["doc_id"], r["_size"]): r["_copies"] for r in got}
    named = mixing.expected(docs_of(rows).selectExpr("'d' || doc_id AS doc_id", "text", "source", "1 AS _source", "2 AS _rank"))
    assert named.count() == len(rows) and {"_source", "_rank"} <= set(named.columns)
    mixed = mixing.mix_sources(docs_of(rows))
    assert mixed.count() == sum(r["_copies"] for r in got) and mixing.mix_sources(docs_of(rows).limit(0)).count() == 0


@pytest.mark.parametrize(("sizes", "want"), [([100, 100, 100], [50, 100, 150]), ([10, 500, 10], [30.0, 460.0, 30.0]), ([7], [7]), ([0, 10], [0, 10])])
def test_targets(spark, sizes, want):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.cycle_weights(df, "source")).collect()}
    assert [round(got[f"s{i}"], 6) for i in range(len(sizes))] == want


# -- benchmark ---------------------------------------------------------------------------------------------------


def test_decontamination(docs_of, spark, prose):
    item = prose(5, 30)
    bench = spark.createDataFrame([(1, item), (2, "Short, question?"), (3, None), (4, "..."), (5, item)], "item_id long, text string")
    inner = re.findall(r"\w+", item)[4:16]
    rows = [
        (10, "Vor " + "!! ".join(inner).upper().replace("É", "é").replace("Ü", "ü") + " nach"), (11, " ".join(inner[:9])), (12, "a short  QUESTION é"), (13, "ashort question"), (14, "shortquestion"), (15, "x" * 200_000 + " short question"), *ODD,
    ]
    got = {r["doc_id"]: r for r in decontam.find_leaks(docs_of(rows), bench).collect()}
    assert got[10]["hits"]["item_ids"] == [1, 5] and got[10]["hits"]["n_hit"] == 12
    a, b = got[10]["hits"]["spans"][0]
    assert got[10]["text"][a:b].lower().startswith(inner[0]) and got[10]["text"][a:b].lower().endswith(inner[-1])
    assert got[12]["hits"]["item_ids"] == [2] and got[15]["hits"]["n_hit"] == 2
    assert [got[i]["hits"]["n_hit"] for i in (11, 13, 14, 1, 2, 5)] == [0] * 6
    assert decontam.decontaminate(docs_of(rows), bench.limit(0)).count() == len(rows)
    assert decontam.find_leaks(docs_of(rows).limit(0), bench).count() == 0


def test_large_benchmarks_in_blocks(docs_of, spark, prose, monkeypatch):
    bench = spark.createDataFrame([(i, prose(i, 15)) for i in range(8)] + [(None, prose(50, 12)), (None, "ab zz")], "item_id long, text string")
    rows = [(1, prose(3, 15) + " and " + prose(6, 15)), (2, prose(3, 15)), (3, prose(3, 15)), (4, "Ab ZZ; " + prose(50, 12)), *ODD]
    found = lambda: sorted((repr(r["doc_id"]), r["n"], tuple(r["hits"])) for r in decontam.find_leaks(docs_of(rows), bench).collect())
    once = found()
    monkeypatch.setattr(decontam, "PATTERN_BYTES", 1000)
    assert found() == once and len(once) == len(rows)
    hits = {i: h for i, _, h in once}
    assert hits["1"][2] == [3, 6] and hits["2"] == hits["3"] and hits["4"][1:3] == (14, [None]) and hits["1"][1] == 30


# -- passages ----------------------------------------------------------------------------------------------------


def test_passages(docs_of, prose):
    shared, near = prose(77, 80), prose(78, 120).split(" ")
    changed = list(near)
    for k in (30, 75):
        changed[k] = "other"
    rows = [
        (1, prose(1, 150) + " " + shared + " " + prose(2, 40)), (2, shared + " " + prose(3, 90)), (3, prose(4, 300)), (4, prose(4, 300)), (5, prose(5, 60) + " " + " ".join(near)), (6, " ".join(changed) + " " + prose(6, 50)), (7, prose(7, 45)), (8, prose(7, 45)), *[(i + 20 if i else i, t) for i, t in ODD],
    ]
    got = {r["doc_id"]: r for r in compact_windows.repeated_passages(docs_of(rows)).collect()}
    assert got[2]["class_id"] == 1 and got[4]["class_id"] == 3 and got[6]["class_id"] == 5
    assert got[2]["n_dup_words"] >= 79 and got[4]["n_dup_words"] == 300 and got[6]["n_dup_words"] >= 50
    assert got[7]["n_spans"] == got[8]["n_spans"] == 0  # under 50 words
    assert all(r["n_spans"] == 0 for i, r in got.items() if i is None or i > 20)
    assert compact_windows.repeated_passages(docs_of(rows).limit(0)).count() == 0


def test_spans_at_every_offset():
    """Against sets counted window by window: words inserted, deleted and changed, repeats, and stretches equal in place."""

    def plain(a, b, least, similarity):
        n, covered = min(len(a), len(b)), set()
        for i in range(n - least + 1):
            x, y = set(a[i : i + least]), set(b[i : i + least])
            in_place = sum(u == v for u, v in zip(a[i : i + least], b[i : i + least], strict=True))
            if len(x & y) >= similarity * len(x | y) or in_place >= similarity * (2 * least - in_place):
                covered |= set(range(i, i + least))
        return covered

    r = random.Random(5)
    shifted = 0
    for trial in range(400):
        a = [r.randrange(100_000 if trial % 4 else 30) for _ in range(r.randrange(20, 160))]
        b = [*a]
        for _ in range(r.randrange(4)):
            at = r.randrange(len(b))
            b[at : at + r.randrange(3)] = [r.randrange(100_000) for _ in range(r.randrange(6))]
        b += a[: r.randrange(30)]
        want = plain(a, b, 46, 0.8)
        got = {k for i, j in compact_windows.alike_spans(np.array(a, np.uint32), np.array(b, np.uint32)) for k in range(i, j)}
        assert got == want, trial
        shifted += bool(want) and a[: len(b)] != b[: len(a)]
    assert shifted > 50


def test_edited_passages_are_linked(docs_of):
    """Passages of little more than 50 words with one word changed, inserted or deleted, in texts of other words.

    At a similarity of 0.8 all four hash functions miss a pair with probability 0.2 ** 4: 0.4 of these 240.
    """
    r = random.Random(11)
    rows = []
    for k in range(240):
        passage = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(52, 60))]
        other, at = [*passage], r.randrange(20, 32)
        other[at : at + (k % 3 != 1)] = ["edit"] * (k % 3 != 2)
        for i, p in ((2 * k, passage), (2 * k + 1, other)):
            rows.append((i, " ".join([*(f"w{r.randrange(10**6)}" for _ in range(r.randrange(5, 60))), *p, *(f"w{r.randrange(10**6)}" for _ in range(r.randrange(5, 60)))])))
    got = {x["doc_id"]: x["class_id"] for x in compact_windows.repeated_passages(docs_of(rows)).collect()}
    assert sum(c != i - i % 2 for i, c in got.items()) <= 2


def plain_passages(texts, least=46):
    """Words in windows of ``least`` shingles near one of another text, and classes: all pairs of windows of all pairs of texts."""
    grams = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, w in texts.items()}
    cover, reach = {i: set() for i in texts}, {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        shared = {g: k for k, g in enumerate(set(grams[a]) & set(grams[b]))}
        if len(shared) < 0.8 * least:
            continue
        sides = []
        for t in (a, b):
            m = np.zeros((len(grams[t]) - least + 1, len(shared)), np.float32)
            for i in range(len(m)):
                m[i, [shared[g] for g in set(grams[t][i : i + least]) & shared.keys()]] = 1
            sides.append((m, np.array([len(set(grams[t][i : i + least])) for i in range(len(m))])))
        both = sides[0][0] @ sides[1][0].T
        near = both >= 0.8 * (sides[0][1][:, None] + sides[1][1][None, :] - both) - 1e-6
        for t, hit in ((a, near.any(1)), (b, near.any(0))):
            for i in np.flatnonzero(hit):
                cover[t] |= set(range(i, i + least + 4))
        if near.any():
            x, y = reach[a], reach[b]
            reach = {t: (min(x, y) if c in (x, y) else c) for t, c in reach.items()}
    return {t: len(c) for t, c in cover.items()}, reach


def test_shared_passages_against_all_windows(docs_of):
    """Six passages, two of them in each of 60 texts with up to three words changed, inserted or deleted."""
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(75) for _ in range(6)]
    texts = {}
    for i in range(60):
        words_ = fresh(r.randrange(5, 50))
        for p in r.sample(passages, 2):
            p = [*p]
            for _ in range(r.randrange(4)):
                at = r.randrange(len(p))
                p[at : at + r.randrange(2)] = fresh(1)[: r.randrange(2)]
            words_ += p + fresh(r.randrange(5, 50))
        texts[i] = words_
    words_of, classes = plain_passages(texts)
    got = {x["doc_id"]: x for x in compact_windows.repeated_passages(docs_of([(i, " ".join(w)) for i, w in texts.items()])).collect()}
    found, all_ = sum(min(got[i]["n_dup_words"], n) for i, n in words_of.items()), sum(words_of.values())
    assert found >= 0.97 * all_ and sum(got[i]["n_dup_words"] for i in texts) <= 1.01 * all_
    assert sum(got[i]["class_id"] == c for i, c in classes.items()) >= 58


def test_classes_of_one_hash_against_all_passages():
    """Every two classes of a group, passage by passage as sets: edits at both sides of the middle, repeats, short contents, several groups and sides."""
    r, least = random.Random(8), compact_windows.LEAST
    tokens, before, first, last, group, side = [], [], [], [], [], []
    for g in range(12):
        base = [r.randrange(1, 10**6) for _ in range(2 * least - 1)]
        if g % 3 == 2:
            base = [base[i % 30] for i in range(len(base))]
        for _ in range(14):
            own = [*base]
            for _ in range(r.randrange(3)):
                at = r.randrange(len(own))
                own[at : at + r.randrange(6)] = [r.randrange(1, 10**6) for _ in range(r.randrange(6))]
            low = r.randrange(0, 40)
            own = own[low : max(low + least, len(own) - r.randrange(20))][: 2 * least - 1]
            c = min(max(least - 1 - low, len(own) - least, 0), least - 1, len(own) - 1)
            tokens.append(own)
            before.append(c)
            first.append(8 * g + r.randrange(8))
            last.append(first[-1] if r.randrange(3) else first[-1] + r.randrange(3))
            group.append(g)
            side.append(r.randrange(1, 3) if g % 4 == 3 else 0)
    plain, pairs = {}, set()
    for x, y in itertools.permutations(range(len(tokens)), 2):
        if group[x] != group[y] or (side[x] and side[x] == side[y]) or first[x] == last[x] == first[y] == last[y]:
            continue
        sets = [[(i - before[k], set(tokens[k][i : i + least])) for i in range(before[k] - least + 1, before[k] + 1) if 0 <= i <= len(tokens[k]) - least] for k in (x, y)]
        near = [i for i, s in sets[0] if any(len(s & t) >= 0.8 * len(s | t) for _, t in sets[1])]
        if near and first[x] != first[y]:
            pairs.add((group[x], first[x], first[y]))
        if near and first[x] == last[x]:
            low, high = plain.get(x, (99, -99))
            plain[x] = (min(low, near[0]), max(high, near[-1] + least - 1))
    whole = {(a, b) for a, b in zip(first, last, strict=True)}

    def find(links, i):
        seen = {i}
        while more := {v for u, v in links | {(v, u) for u, v in links} if u in seen} - seen:
            seen |= more
        return min(seen)

    row, low, high, other, links = compact_windows.near_classes([np.array(t, np.uint32).tobytes() for t in tokens], *(np.array(v) for v in (before, first, last, group, side)))
    got = {}
    for x, a, b, o in zip(row.tolist(), low.tolist(), high.tolist(), other.tolist(), strict=True):
        assert o != first[x]
        if first[x] == last[x]:
            got[x] = (min(a, got.get(x, (99, -99))[0]), max(b, got.get(x, (99, -99))[1]))
    assert got == plain and len(plain) > 30
    reach = lambda links: {frozenset(i for i in range(99) if find(links, i) == k) for k in {find(links, i) for i in range(99)}}
    assert reach({(u, v) for u, v in links.tolist()} | whole) == reach({(u, v) for _, u, v in pairs} | whole)


def test_passages_near_others_of_their_hash_only(docs_of, monkeypatch):
    """Sixty texts around one line; in pairs they share more of what stands beside it, with one word changed. Each finds the other, at any size of parts."""
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    line, rows = fresh(14), []
    for k in range(30):
        left, right = fresh(25), fresh(25)
        for i in (2 * k, 2 * k + 1):
            words_ = [*left, *line, *right]
            words_[3 if i % 2 else 60] = "edit"
            rows.append((i, " ".join([*fresh(10), *words_, *fresh(10)])))
    truth, classes = plain_passages({i: t.split(" ") for i, t in rows})
    found = lambda: {x["doc_id"]: (x["class_id"], x["n_dup_words"]) for x in compact_windows.repeated_passages(docs_of(rows)).collect()}
    got = found()
    assert got == {i: (c, truth[i]) for i, c in classes.items()} and all(c == i - i % 2 for i, c in classes.items())
    monkeypatch.setattr(compact_windows, "PART", 8)
    assert found() == got


def test_one_word_more_in_whole_texts(docs_of):
    """Two texts of 50 words, one with a word more inside and one less at its end: near as wholes, on no diagonal of 50 words."""
    words_ = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words_)), (2, " ".join([*words_[:4], "more", *words_[4:49]]))]
    assert plain_passages({i: t.split(" ") for i, t in rows})[1] == {1: 1, 2: 1}
    got = {x["doc_id"]: x for x in compact_windows.repeated_passages(docs_of(rows)).collect()}
    assert [got[i]["class_id"] for i in (1, 2)] == [1, 1] and got[2]["n_dup_words"] == 50


# -- language model ----------------------------------------------------------------------------------------------


def test_base_scores_and_tree(docs_of, prose):
    rows = [(i, prose(i % 40, 60)) for i in range(400)] + [(1000, None), (1001, "never seen words"), (None, "the end"), (5, prose(5, 60))]
    got = suffix_tree_lm.score_texts(docs_of(rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(t for i, x in rows if not held(i) for t in [*words(x), None])
    n, v = sum(c.values()), len(c)
    texts = {}
    for i, x in rows:
        texts.setdefault(i, x)
    for r in got:
        tokens = [*words(texts[r["doc_id"]]), None]
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] <= 0
    out = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) * 0.6  # the repeated texts are learnt
    assert suffix_tree_lm.score_texts(docs_of(rows).limit(0)).count() == 0


def plain_tree(rows):
    """Log10 probability of a word (None: the end; any other string: unknown) after a tuple of words, by dictionaries."""
    lm = suffix_tree_lm
    texts = [[*words(x), None] for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    unigrams = Counter(w for t in texts for w in t)
    whole = sum(unigrams.values()) + 0.5 * (len(unigrams) + 1)
    states = {}  # context -> (rest, {word: p})
    candidates = {(w,) for w, n in unigrams.items() if w is not None and n >= lm.LEAST_COUNT}
    counted = {(w,): n for w, n in unigrams.items() if n >= lm.LEAST_COUNT}

    def p(context, w):
        if not context:
            return (unigrams[w] + 0.5) / whole
        if context not in states:
            return p(context[1:], w)
        rest, held = states[context]
        return held[w] if w in held else rest * p(context[1:], w)

    while candidates:
        k = len(next(iter(candidates)))
        runs = Counter(tuple(t[i - k : i + 1]) for t in texts for i in range(k, len(t)))
        runs = {r: n for r, n in runs.items() if n >= lm.LEAST_COUNT and r[:-1] in candidates and r[1:] in counted}
        entries, by = set(), {}
        for r, n in runs.items():
            by.setdefault(r[:-1], {})[r[-1]] = n
        for c, mine in by.items():
            total = counted[c]
            up = {w: p(c[1:], w) for w in mine}
            likelier = {w for w, n in mine.items() if n * math.log(n / (total + lm.SMOOTHING) / up[w]) >= lm.LEAST_ENTRY}
            held = sum(mine[w] for w in likelier)
            rest = (total - held + lm.SMOOTHING) / (total + lm.SMOOTHING)
            new = {w: mine[w] / (total + lm.SMOOTHING) + rest * up[w] for w in likelier}
            gain = sum(mine[w] * math.log(new[w] / up[w]) for w in likelier) + (total - held) * math.log(rest)
            if gain >= lm.LEAST_GAIN and (k == 1 or c[1:] in states):
                states[c] = rest, new
                entries |= {(*c, w) for w in likelier if w is not None}
        candidates, counted = entries, runs
    return p, states, unigrams


def longest(states, before):
    """The longest suffix that is a state."""
    k = 0
    while k < len(before) and tuple(before[len(before) - k - 1 :]) in states:
        k += 1
    return tuple(before[len(before) - k :]) if k else ()


@pytest.mark.parametrize(("cache", "bits"), [(0, 6)])
def test_scores_against_a_plain_tree(docs_of, prose, monkeypatch, cache, bits):
    """Also without a cache and with bitmaps too small to tell anything: neither changes a score."""
    monkeypatch.setattr(suffix_tree_lm, "CACHE", cache)
    monkeypatch.setattr(suffix_tree_lm, "BITS", bits)
    rows = [(i, prose(i % 30, 60) + " " + prose(i, 8)) for i in range(250)] + [(1000, None), (1001, "never seen words"), (1002, prose(1, 60) + " " + prose(2, 6_000)), (None, "the end")]
    p, states, unigrams = plain_tree(rows)
    assert {len(c) for c in states} >= {1, 2}
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score_texts(docs_of(rows)).collect()}
    for i, x in rows:
        tokens = [*words(x), None]
        want = sum(math.log10(p(longest(states, tokens[:k]), w)) for k, w in enumerate(tokens))
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), i
    for c in sorted(states)[:: max(1, len(states) // 40)]:
        assert abs(sum(p(c, w) for w in [*unigrams, "unseen"]) - 1) < 1e-9
