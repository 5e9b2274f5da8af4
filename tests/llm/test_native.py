"""Operators 4, 6 and 10 on small fixtures with results worked out by hand."""
import duckdb
import pytest

from quarry.llm import licenses, mixing, url_filter


def as_duckdb(df, name):
    con = duckdb.connect()
    con.register("t", df.toPandas())
    con.execute(f"CREATE TABLE {name} AS SELECT * FROM t")
    return con


@pytest.fixture(scope="module")
def license_docs(spark):
    mit = licenses.TEMPLATES["mit"].split(" ")
    rows = [(0, "Released UNDER the-MIT license. cc by nc, under the mit license"), (1, None), (2, ""), (3, "under the mit"),
            (4, "x " * 500 + " ".join(mit) + " y" * 500), (5, " ".join(w for i, w in enumerate(mit) if i % 4)),
            (6, " ".join(w for i, w in enumerate(mit) if i % 3)), (None, "Apache License, Version 2.0"), (7, "été cc by nc cc by nc")]
    return spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, labels string")


def test_license_places_and_labels(license_docs):
    got = {r.doc_id: r for r in licenses.license_scan(license_docs).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 1, 8, "cc-by-nc,mit")
    assert (got[1].n_words, got[2].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, 0, None, "", 0.0)
    assert got[3].n_base == 0 and got[3].labels == ""
    assert got[4].labels == "mit" and got[4].base_labels == "" and got[4].score == 1.0
    assert got[6].labels == "" and got[None].base_labels == "apache-2"
    assert (got[7].n_base, got[7].first_word, got[7].last_word, got[7].score) == (2, 1, 4, 1.0)


def test_license_join_equals_brute_force(license_docs):
    df = license_docs.where("doc_id is not null").select("doc_id", "text")
    want = sorted(as_duckdb(df, "documents").execute(licenses.oracle()).fetchall())
    assert sorted(map(tuple, licenses.license_scan(df).collect())) == want


def test_url_base_rules(spark):
    urls = [(1, "https://A.Example.ORG/es/x?q#f"), (2, "http://example.org/en/19"), (3, "x://example.org/en/2"), (4, None),
            (5, "no host/path"), (6, "https://de.com/de/1"), (7, "https://x.com/fr/2/"), (8, "https://xcom/de/"), (9, "s://h?x/de/"),
            (None, "https://org/fr/"), (10, "a://b://example.org/es/"), (11, "https://myexample.org/es/")]
    df = spark.createDataFrame([(*u, "k") for u in urls], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(df).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3] == ("example.org", "/en/2", "org/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("com/de/", "block") and got[7][2:] == ("com/fr/", "allow")
    assert got[8][2] is None and got[9][:2] == ("h", "") and got[None][2] == "org/"
    assert got[10][:2] == ("b:", "//example.org/es/") and got[11][2] == "org/"


def test_url_templates_reject_by_purity(spark):
    rules = (("block", "h.net", "/spam/a"), ("allow", "h.net", "/good/"))
    urls = [(i, f"http://h.net/spam/a{i}") for i in range(60)] + [(100 + i, f"http://h.net/good/b{i}") for i in range(60)] \
        + [(200 + i, f"http://h.net/spam/z{i}") for i in range(20)] + [(300, "http://h.net/else/1"), (301, "http://k.net/spam/z")]
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(urls, "page_id long, url string"), rules=rules).collect()}
    assert got[200].template.startswith("h.net/spam/") and got[200].rule is None and got[200].verdict == "block"
    assert got[300].verdict == "allow" and got[301].verdict == "allow" and got[100].verdict == "allow"
    assert got[5].verdict == "block"


def test_url_tree_equals_sql(spark):
    import random
    rnd = random.Random(3)
    rules = (("block", "h.net", "/spam/a"), ("allow", "h.net", "/good/"), ("block", "net", "/x/1"), ("allow", "k.net", "/x/12"))
    heads = ["spam/a", "spam/z", "good/", "x/1", "x/12", "x/9", "else/", "x/7/deep/er/and/deeper/1", "ab0123456789/", "7.html", "Q" * 70]
    urls = [(i % 700, f"http://{rnd.choice(['h.net', 'k.net', 'A.h.NET', 'o.com'])}/{rnd.choice(heads)}{rnd.randrange(40)}"
             f"{rnd.choice(['', '/', '/p', '?q', '#f', '/1/2'])}") for i in range(900)]
    urls += [(None, None), (1, "nothing"), (2, "s://"), (3, "s://h.net"), (4, "s://h.net?x")] + [urls[0]] * 200
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = url_filter.url_verdicts(df, rules=rules)
    key = lambda r: tuple((x is None, x) for x in r)
    want = as_duckdb(df, "pages").execute(url_filter.oracle(rules).replace("FROM pages", "FROM (SELECT page_id::BIGINT AS page_id, url FROM pages)"))
    assert [c[0] for c in want.description] == got.columns
    rows = sorted((tuple(r) for r in got.collect()), key=key)
    assert rows == sorted(want.fetchall(), key=key)
    # the tree decides: some URLs without a rule are rejected, others not
    assert {r[4] for r in rows if r[3] is None} == {"allow", "block"}


def test_mix_equals_sql(spark):
    rows = [(i, "w " * (1 + i % 7 + 40 * (i % 13 == 0)), "s%d" % (i % 5) if i % 9 else None) for i in range(300)] + [
        (1000, None, "s1"), (1001, "", "zz"), (1002, "big " * 900, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(as_duckdb(df, "documents").execute(mixing.ORACLE).fetchall())
    got = sorted(tuple(r) for r in mixing.mix(df).drop("row").collect())
    assert got == want
    assert sum(r[4] for r in got) == sum(r[1] for r in got) and all(r[4] <= 3 * r[1] for r in got)


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string, size int, key int"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, "a", 1, 1), (2, "", None, 1, 1)], schema)).collect()
    assert [(r.size, r.taken) for r in blank] == [(0, 0), (0, 0)]
    twice = mixing.mix(spark.createDataFrame([(1, "a b", "a", 1, 1), (1, "a b", "a", 1, 1), (None, "c", None, 1, 1)], schema)).collect()
    assert len(twice) == 3 and sum(r.taken for r in twice) == 5


def test_empty_tables(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
