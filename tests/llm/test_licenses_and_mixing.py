from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from marketloom.llm import catalog, licenses, mixing

DIR = "/root/testdata/sf0.001"


def test_nearest_licence_above(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/y.py", "code\n# Licensed under the Apache License, Version 2.0.\nmore"),
        ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/z", None), ("q/r", ""), ("top", "x"),
        ("LICENSE.md", "nothing of the kind, just a license of some sort that nobody knows"), (None, "Licensed under CC BY-NC 4.0."), (None, None), ("a/x.py", "code"), ("ab/x", "code"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "path string, text string, own string, row int")
    got = sorted(((r.path, r.licence, r.via, r.licensed_by) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([
        ("a/LICENSE", "MIT", "own", "a/LICENSE"), ("a/x.py", "MIT", "inherited", "a/LICENSE"), ("a/x.py", "MIT", "inherited", "a/LICENSE"), ("a/b/y.py", "Apache-2.0", "own", "a/b/y.py"),
        ("a/b/COPYING.txt", "GPL-3.0", "own", "a/b/COPYING.txt"), ("a/b/c/d/z", "GPL-3.0", "inherited", "a/b/COPYING.txt"), ("q/r", None, None, None), ("top", None, None, None),
        ("LICENSE.md", None, None, None), (None, "CC-BY-NC-4.0", "own", None), (None, None, None, None), ("ab/x", None, None, None),
    ], key=str)
    assert {"own", "row"} <= set(licenses.scan(df).columns) and licenses.scan(df.limit(0)).count() == 0
    assert "Python" not in licenses.scan(df)._jdf.queryExecution().executedPlan().toString()


def test_too_many_templates_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.template_weights(spark, [(str(i), "x") for i in range(licenses.MAX_TEMPLATES + 1)])


@pytest.mark.parametrize("name", ["op5_warc_revisits", "op6_license_scan", "op7_source_mixture", "op10_quality_rules"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DIR)
    rel = con.execute(catalog.SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def flow(tree, budget, rooms):
    """Shares of nested {name: (weight, subtree or leaf)} by repeated filling."""
    def room(t):
        return rooms[t] if isinstance(t, str) else sum(room(s) for _, s in t.values())

    def fill(t, have):
        if isinstance(t, str):
            return {t: min(have, rooms[t])}
        given, open_, left = {}, dict(t), have
        while open_:
            whole = sum(w for w, _ in open_.values())
            full = {k for k, (w, s) in open_.items() if room(s) * whole <= left * w}
            if not full:
                given |= {k: left * w // whole for k, (w, _) in open_.items()}
                break
            k = min(full, key=lambda k: room(open_[k][1]) / open_[k][0])
            given[k] = room(open_[k][1])
            left -= given[k]
            del open_[k]
        return {leaf: n for k, g in given.items() for leaf, n in fill(t[k][1], g).items()}

    return fill(tree, budget)


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "a", 1000), ("web", "en", "b", 10), ("web", "de", "c", 50), ("books", "en", "d", 5000), ("books", None, "e", 700)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"web": 3, "books": 1}, "lang": {"en": 2}, "source": {"b": 4}}
    for percent, epochs in ((10, 1), (30, 1), (50, 2), (100, 1), (100, 3)):
        got = {r.source: r.given for r in mixing.budgets(df, weights, percent, epochs).collect()}
        tree = {"web": (3, {"en": (2, {"a": (1, "a"), "b": (4, "b")}), "de": (1, {"c": (1, "c")})}), "books": (1, {"en": (2, {"d": (1, "d")}), None: (1, {"e": (1, "e")})})}
        assert got == flow(tree, sum(x[3] for x in leaves) * percent // 100, {x[2]: x[3] * epochs for x in leaves})


@pytest.mark.parametrize("percent,epochs", [(5, 1), (60, 1), (100, 1), (90, 3)])
def test_leaves_take_whole_epochs_and_a_prefix(spark, percent, epochs):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('w', repeat(' x', cast(id % 37 as int))) as text", "if(id % 3 = 0, 'de', 'en') as lang", "if(id < 200, 'hot', concat('s', id % 5)) as source")
    got = mixing.mix(docs, F.lit("one"), {}, percent, epochs, 7).collect()
    tokens, taken, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs.collect():
        tokens[r.lang, r.source] += len(r.text.split())
    for r in got:
        taken[r.lang, r.source] += r.n_tokens
        times[r.doc_id] = max(times[r.doc_id], r.epoch)
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got) and sum(times.values()) == len(got)
    leaves = spark.createDataFrame([("one", *k, v) for k, v in tokens.items()], "domain string, lang string, source string, tokens long")
    for r in mixing.budgets(leaves, {}, percent, epochs).collect():
        assert r.given - 37 < taken[r.lang, r.source] <= r.given


def test_kept_documents_have_their_columns(odd_docs, no_docs):
    out = mixing.keep_mix(odd_docs, F.lit("d"), {}, 100)
    assert out.columns == odd_docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["4", "5", "6", "7", "8", "8", "9", "None", "None"]
    assert mixing.keep_mix(no_docs, F.lit("d"), {}, 100).count() == 0
    assert mixing.mix(odd_docs.drop("domain", "n_tokens", "epoch"), F.lit("d"), {}, 0, 2).count() == 0
