import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.operators import assign, extract, graph, linkage, merge, reports, sessions
from quillon.operators.components import components
from quillon.operators.pairs import grouped_pairs
from quillon.operators.ranking import reciprocal_rank_fusion
from quillon.sources import feeds
from quillon.sources.catalog import Catalog, GateError, evolve


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 9)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)], "a long, b long")
    got = dict(rows(components(e)))
    assert got[3] == 1 and got[5] == 4 and got[7] == 7 and got[159] == 100 and got[240] == 200 and 9 not in got
    assert components(e.limit(0)).count() == 0


def test_grouped_pairs_in_blocks(spark):
    df = spark.createDataFrame([("g", i) for i in range(23)] + [("h", 1), ("i", 50), ("i", 51)], "g string, k long")
    want = {(a, b) for a in range(23) for b in range(a + 1, 23)} | {(50, 51)}
    for block in (2000, 4):
        got = rows(grouped_pairs(df, "g", "k", block=block))
        assert len(got) == len(set(got)) and {*got} == want


def test_rrf_counts_repeats(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "id string, rank int")
    got = dict(rows(reciprocal_rank_fusion([a, a.limit(0)])))
    assert got["x"] == pytest.approx(1 / 61 + 1 / 62) and got["y"] == pytest.approx(1 / 63)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "openAlex", 0.5), ("a", "b", "inspire", None), ("b", "c", "inspire", 1.0), ("c", "a", "inspire", 1.0), ("a", "a", "intra-paper", 1.0), (None, "a", "inspire", 1.0)], "src string, dst string, source string, confidence double")
    start = spark.createDataFrame([("a",)], "p string")
    assert rows(graph.neighbours(e, start, "cites", 2).select("paper", "hop", "source")) == [("b", 1, "inspire"), ("c", 2, "inspire")]
    assert rows(graph.neighbours(e, start, "cited_by", 1).select("paper")) == [("c",)]
    assert ("a", 1, "ref") in rows(graph.neighbours(e, start, "depends_on", 1).select("paper", "hop", "edge_kind"))
    assert graph.neighbours(e.limit(0), start).count() == 0


def test_linkage(spark):
    c = spark.createDataFrame([("s1", "p", "stmt", "l", ["A"]), ("q1", "p", "proof", "l", ["A"]), ("s2", "p", "lemma", None, ["B"]), ("q2", "p", "proof", None, ["B"]), ("q3", "p", "proof", "zz", ["A"]), ("q4", "p", "proof", None, [])], "chunk_id string, paper_id string, kind string, theorem_label string, section_path array<string>")
    assert rows(linkage.by_label(c)) == [("q1", "s1"), ("s1", "q1")]
    assert rows(linkage.by_section(c)) == [("q2", "s2")]
    assert dict((a, b) for a, b, _ in rows(linkage.outcomes(c))) == {"q1": "resolved", "q2": "resolved", "q3": "not-in-corpus", "q4": "unsupported-by-provider"}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "b", 2)], "k long, g string, v long")
    new = spark.createDataFrame([(2, "b", 9), (4, "c", None)], "k long, g string, v long")
    assert {tuple(r) for r in rows(merge.upsert(old, new, ["k"]))} == {(1, "a", None), (2, "b", 9), (3, "b", 2), (4, "c", None)}
    assert {r[0] for r in rows(merge.replace_group(old, new, ["k"], "g").select("k"))} == {1, 2, 4}
    once = merge.upsert(old, new, ["k"])
    assert rows(merge.upsert(once, new, ["k"])) == rows(once)
    assert rows(merge.coalesce_merge(old, new, "k").where("k = 2")) == [(2, "b", 9)]
    assert {r[0] for r in rows(merge.delete(old, "k", new.select("k")))} == {1, 3}


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 4), (3, "b", 9), (4, "a", None), (5, "a", 5)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 9, 3), ("a", None, 7)], "k string, f long, v long")
    assert rows(merge.as_of(left, right, "k", "t", "f", "v").select("id", "v")) == [(1, 3), (2, None), (3, None), (4, None), (5, 2)]


def test_reuse_covers_all(spark):
    new = spark.createDataFrame([("n1", "i"), ("n2", "j"), ("n3", None)], "k string, i string")
    stored = spark.createDataFrame([("b", "i", [1.0]), ("a", "i", [2.0]), ("c", None, [3.0]), ("d", "j", None)], "k string, i string, v array<double>")
    got = {r["k"]: (r["action"], r["source_key"]) for r in merge.reuse_plan(new, stored, "i", "k", "v").collect()}
    assert got == {"n1": ("copy", "a"), "n2": ("re_embed", None), "n3": ("re_embed", None)}


def test_reports(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query long, id string, rank int")
    truth = spark.createDataFrame([(1, "b", 3), (1, "c", 1), (3, "z", 0)], "query long, id string, grade int")
    got = {q: (n, r) for q, n, r in rows(reports.retrieval_metrics(ranked, truth))}
    assert got[2] == (0, 0) and got[3] == (0, 0) and got[1][1] == 1 and 0 < got[1][0] < 1
    b = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 10), ("a", float("inf"), 10), ("b", 1.0, 3)], "t string, le double, count long")
    assert rows(reports.histogram_quantile(b, ["t"], 0.75)) == [("a", 1.5), ("b", None)]
    s = spark.createDataFrame([(1, 0.8), (2, 0.6), (3, 0.9)], "version long, score double")
    assert [r["alert"] for r in reports.regressions(s).orderBy("version").collect()] == [False, True, False]
    d = spark.createDataFrame([("a", 1), ("a", 2)], "g string, x long")
    assert reports.digest(d, ["g"], ["x"]).head()["digest"] == reports.digest(d.orderBy(F.desc("x")).repartition(3), ["g"], ["x"]).head()["digest"]


def test_rate_limit_counts_accepted_calls_only(spark):
    calls = spark.createDataFrame([(1, i, float(t), "s", 1) for i, t in enumerate([0, 10, 20, 3601, 3605])] + [(2, 9, 5.0, "c", 50), (2, 10, 6.0, "c", 60)], "session long, n long, at double, tool string, units long")
    got = {r["order"]: r["accepted"] for r in sessions.rate_limited(calls, "session", "n", "at", "tool", "units", 2, {"c": 100}).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 9: True, 10: False}


def test_packing(spark):
    df = spark.createDataFrame([([3, 4, 5, 20, 1],), ([],)], "n array<bigint>")
    assert [r[0] for r in df.select(sessions.packed(F.col("n"), 8)).collect()] == [[0, 0, 1, 2, 3], []]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    df = spark.range(5)
    assert c.write("t", df) == 1 and c.write("t", df.limit(3), expect=3, based_on=1) == 2
    assert c.scan("t").count() == 3 and c.scan("t", 1).count() == 5
    with pytest.raises(ValueError):
        c.scan("t", 9)
    with pytest.raises(GateError):
        c.write("t", df, expect=99)
    with pytest.raises(GateError):
        c.write("t", df, based_on=1)
    assert c.version("t") == 2 and c.scan_or_previous("t")[1] is False
    c.rollback("t", 1)
    assert c.scan("t").count() == 5 and c.reconcile("t")["diverged"] is False
    assert evolve(df, {"id": "bigint", "x": "string"}).columns == ["id", "x"]


def test_sqlite_source(spark, tmp_path):
    from quillon.sources.sqlite import SqliteSource

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT, x REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, None if i % 3 else str(i), i / 2) for i in range(25)])
        db.execute("CREATE TABLE e (id INTEGER)")
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("table", "t").option("rows", "10").load()
    assert df.count() == 25 and df.where("name IS NULL").count() == 16 and df.dtypes[0] == ("id", "bigint")
    assert spark.read.format("sqlite").option("path", path).option("table", "e").load().count() == 0


def test_feeds(spark, tmp_path):
    bad = spark.createDataFrame([('<OAI-PMH><error code="badArgument">x</error></OAI-PMH>',)], "x string")
    with pytest.raises(Exception, match="OAI error"):
        feeds.oai_records(bad, "x").collect()
    none = spark.createDataFrame([('<OAI-PMH><error code="noRecordsMatch"/></OAI-PMH>',)], "x string")
    assert feeds.oai_records(none, "x").count() == 0
    (tmp_path / "m.txt").write_text("# c\n\n2301.00001\n2301.00002 # y\n2301.00001\n")
    assert rows(feeds.membership(spark, str(tmp_path / "m.txt"))) == [("2301.00001",), ("2301.00002",)]
    files = spark.createDataFrame([("p", "d/a.tex", "x"), ("p", "b.tex", "\\documentclass"), ("p", "a.tex", "")], "paper string, path string, text string")
    assert rows(feeds.main_source(files, "paper")) == [("p", "b.tex")]


def test_bad_document_does_not_end_the_job(spark):
    df = spark.createDataFrame([("a", r"\begin{lemma}x"), ("b", r"\begin{lemma}x\end{lemma}"), ("c", None), (None, "")], "k string, t string")
    got = extract.chunks(df, "k", "t", "tex").collect()
    assert {(r["key"], r["error"] is None) for r in got} == {("a", False), ("b", True)}


def test_mean_counts_failures_as_zero(spark):
    assert assign.mean_score(spark.createDataFrame([(1.0,), (None,)], "s double"), "s").head()[0] == 0.5
