"""Clashing names, very long texts and repeats for the operators, and plain versions of what SQL can't express."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.llm import compact_windows, decontam, line_dedup, minhash, mixing, quality_classifier, quality_rules, suffix_dedup, url_filters

CLASH = ["_ld_id", "_ld_lines", "_ld_dropped", "_all_classes", "_all_commons", "_all_words", "_qr_lang", "_qr_commons", "_dropped", "_guessed", "_host_rate", "_n_path", "_id", "_bad", "_text", "item", "window", "windows", "chunk", "key", "url", "rule_id", "h", "g"]


@pytest.fixture
def clashing(docs_of):
    return lambda rows: docs_of(rows, clash=False).selectExpr("*", *[f"'mine' AS {c}" for c in CLASH])


def test_clashing_names_pass_through(spark, clashing, prose):
    rows = [(i, prose(i % 7, 60), f"s{i % 2}") for i in range(20)] + [(None, None), (30, "")]
    docs = clashing(rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(15)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(3, 12))], "item_id long, text string")
    for out in (line_dedup.dedup_lines(docs), quality_rules.judge(docs), minhash.keep_one(docs), quality_classifier.score(docs, labels), decontam.find_leaks(docs, bench, name="leaks"), decontam.decontaminate(docs, bench), mixing.expected(docs)):
        assert out.where(" and ".join(f"{c} = 'mine'" for c in CLASH)).count() == out.count() > 0


def test_very_long_texts(spark, docs_of, prose):
    """Texts of over a million characters are read whole by every operator."""
    long_ = prose(1, 160_000)
    assert len(long_) > 1_000_000
    rows = [(1, long_), (2, long_ + " tail"), (3, prose(2, 80)), (4, long_[-4000:])]
    docs = docs_of(rows)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    judged = {r["doc_id"]: r["_n_words"] for r in quality_rules.judge(docs).collect()}
    assert judged == {i: len(t.split()) for i, t in rows}
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed[2] == len(long_.encode()) and removed[4] == len(rows[3][1].encode()) and removed[3] == 0
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.score(docs, labels).count() == 4
    windows = {r["doc_id"]: r["n_dup_words"] for r in compact_windows.repeated_passages(docs).collect()}
    assert windows[3] == 0 and windows[4] > 500 and windows[2] >= len(long_.split()) - 1
    url = "http://a.example/" + "x/" * 400_000
    pages = spark.createDataFrame([(1, url), (2, None), (3, None)], "page_id long, url string")
    found = {r["page_id"]: (r["host"], len(r["path"]), r["verdict"]) for r in url_filters.filter_urls(pages, labels, []).collect()}
    assert found == {1: ("a.example", 800_001, "allow"), 2: ("", 0, "allow"), 3: ("", 0, "allow")}


def plain_strength(groups):
    """groups: (n, bad, rate of the group above)."""
    big = [(n, b, p) for n, b, p in groups if n > 1]
    n, nn = sum(g[0] for g in big), sum(g[0] ** 2 for g in big)
    if not big or n * n <= nn:
        return 100.0
    spread, noise = sum(n_ * (b / n_ - p) ** 2 for n_, b, p in big), sum(p * (1 - p) for _, _, p in big)
    between = (spread - noise) / (n - nn / n)
    return min(max(noise / len(big) / between - 1 if between > 0 else 1e6, 1.0), 1e6)


def test_hierarchical_posteriors(spark, docs_of, prose):
    """Rates of corpus, hosts and paths, shrinkage and posteriors, from the evidence of each row on."""
    rows = []
    for i in range(300):
        bad = i % 9 < (6 if i % 5 == 0 else 1)
        rows.append((i, prose(i, 40).upper() if bad else prose(i, 40), f"host{i % 5}", ["en", "de", None][i % 3]))
    rows += [(900, None, "host0", "en"), (901, "", None, None), (902, prose(902, 30), "alone", "fr"), (7, prose(7, 40), "host2", "de")]
    labels = [(i, 0 if i % 9 < (6 if i % 5 == 0 else 1) else 1, 0) for i in range(0, 200)] + [(250, 1, 1), (251, None, None), (None, 0, 0)]
    got = quality_classifier.score(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    bad = {}
    for i, quality, toxic in labels:
        if i is not None:
            bad[i] = max(bad.get(i, 0), int((1 if quality is None else quality) == 0 or (toxic or 0) == 1))
    known = [bad[i] for i, *_ in rows if i in bad]
    base = sum(known) / len(known)
    table = [(r["doc_id"], r["source"] or "", r["lang"] or "", r["_evidence"]) for r in got]
    own = [1 / (1 + math.exp(-max(-30, min(30, e + math.log(base / (1 - base)))))) for *_, e in table]
    counted = [bad.get(i, p) for (i, *_), p in zip(table, own, strict=True)]
    overall = sum(counted) / len(counted)
    hosts, paths = {}, {}
    for (_, h, p, _), c, o in zip(table, counted, own, strict=True):
        hosts.setdefault(h, []).append(c)
        paths.setdefault((h, p), []).append((c, o))
    k = plain_strength([(len(v), sum(v), overall) for v in hosts.values()])
    rate = {h: (sum(v) + k * overall) / (len(v) + k) for h, v in hosts.items()}
    k = plain_strength([(len(v), sum(c for c, _ in v), rate[h]) for (h, _), v in paths.items()])
    for r, (_, h, p, e), o in zip(got, table, own, strict=True):
        v = paths[h, p]
        prior = max(1e-6, min(1 - 1e-6, (sum(x for _, x in v) - o + k * rate[h]) / (len(v) - 1 + k)))
        posterior = 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior)))))
        assert r["_prior"] == pytest.approx(prior, rel=1e-6) and r["_posterior"] == pytest.approx(posterior, rel=1e-6)
        assert r["_kept"] == (r["_posterior"] < 0.5)
    assert len({round(x, 6) for x in rate.values()}) > 3


def test_a_window_of_many_items(spark, docs_of, prose, monkeypatch):
    """A window that many items share stands in several rows and parts; documents get all of them."""
    monkeypatch.setattr(decontam, "ITEMS_A_ROW", 4)
    monkeypatch.setattr(decontam, "PATTERN_BYTES", 2000)
    shared = prose(1, 10)
    bench = spark.createDataFrame([(i, shared + (f" own{i}" if i % 2 else "")) for i in range(60)], "item_id long, text string")
    docs = docs_of([(1, prose(2, 20) + " " + shared + " end"), (2, prose(3, 30)), (3, None)])
    got = {r["doc_id"]: r["hits"] for r in decontam.find_leaks(docs, bench).collect()}
    assert got[1]["item_ids"] == list(range(60)) and got[1]["n_hit"] == 10 and len(got[1]["spans"]) == 1
    assert got[2]["n_hit"] == 0 and got[3]["n_words"] == 0


def test_fixed_support(spark):
    """A token set of as many bad urls is a rule however many other urls there are."""
    bad = [(["host:bad", f"path:p{i}"], True) for i in range(25)]
    for others in (100, 40_000):
        rows = spark.createDataFrame([*bad, *[([f"host:h{i % 500}"], False) for i in range(others)]], "tokens array<string>, bad boolean")
        assert "host:bad" in {r["rule_id"] for r in url_filters.mine(rows).collect()}
