import pytest
from cases import CLASHES
from pyspark.sql import functions as F

from logloom.llm import url_filter as uf
from logloom.llm.url_filter import Rule

RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("com", "/de/", "block"))
PARTS = [
    ("http://WWW.Example.ORG/es/1?x=/#y", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/1", "example.org", "/en/1", "org/", "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://example.org", "example.org", "", None, None),
    ("http://example.org?q=/es/", "example.org", "", None, None),
    ("http://org/x", "org", "/x", "org/", "allow"),
    ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    ("http://a.com:80/de/", "a.com:80", "/de/", None, None),
    ("http://xcom/de/", "xcom", "/de/", None, None),
    ("a.com/de/", "", "", None, None),
    ("http://É.org/é", "É.org", "/é", "org/", "allow"),
    ("x://y://a.com/de/", "y:", "//a.com/de/", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def urls(spark, rows):
    found = spark.createDataFrame(rows, "page_id long, url string")
    return found.withColumns({c: F.lit(f"own {c}") for c in CLASHES if c not in ("host",)})


def test_parts_and_rules(spark):
    table = urls(spark, [(n, p[0]) for n, p in enumerate(PARTS)] + [(None, PARTS[0][0])])
    found = uf.judge(table, RULES, uf.UrlModel(0.0)).collect()
    assert len(found) == len(PARTS) + 1
    for row in found:
        _, host, path, rule, verdict = PARTS[row["page_id"] or 0]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or "allow")
        assert row["_url"] == "own _url"


@pytest.fixture(scope="module")
def labelled(spark):
    def url(n):
        bad = n % 3 == 0
        name = f"x{n * 7919 % 10**6}{n * 31 % 977}-win" if bad else "library"
        return f"http://{name}.site{n % 5}.{'biz' if bad and n % 2 else 'net'}/a/{n}" + ("?a=1&b=2&c=3" if bad else "")

    return urls(spark, [(n, url(n)) for n in range(600)]).withColumn("block", (F.col("page_id") % 3 == 0).cast("int"))


def test_held_out_accuracy(spark, labelled):
    model = uf.train(labelled.where("page_id % 5 <> 1"))
    held = labelled.where("page_id % 5 = 1")
    rows = uf.judge(held, (), model).collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in rows)
    assert len(rows) == 120 and right >= 114
    assert all(0 <= r["block_probability"] <= 1 for r in rows)


def test_models_without_two_labels(spark, labelled):
    some = urls(spark, [(1, "http://a.net/x"), (2, None)])
    assert {r["verdict"] for r in uf.judge(some, (), uf.train(labelled.where("false"))).collect()} == {"allow"}
    assert {r["verdict"] for r in uf.judge(some, (), uf.train(labelled.where("block = 1"))).collect()} == {"block"}


def test_extreme_urls(spark, labelled):
    model = uf.train(labelled)
    long = "http://" + "a" * 3000 + ".net/" + "b/" * 20_000 + "?" + "c=1&" * 5000
    table = urls(spark, [(1, long), (1, long), (2, "://"), (3, "http://///"), (4, None), (None, "")])
    rows = uf.judge(table, RULES, model).collect()
    assert len(rows) == 6 and all(r["verdict"] in ("allow", "block") for r in rows)
    assert uf.judge(urls(spark, []), RULES, model).collect() == []


def test_numbers(spark):
    row = uf.with_features(urls(spark, [(1, "https://a-b.net/x/y1.html?p=1&q=2#z")])).first()["_url"]
    assert (row["depth"], row["parameters"], row["labels"], row["hyphens"]) == (2, 2, 2, 1)
    assert (row["secure"], row["fragment"], row["length"]) == (1, 1, 35)
    assert (row["suffix"], row["domain"], row["folder"], row["extension"]) == ("net", "a-b.net", "x", "html")
    assert abs(row["digit_ratio"] - 3 / 35) < 1e-9 and 3 < row["entropy"] < 5
