"""op3_url_filter and its SQL against the words of the contract's rules, allow or block."""

import duckdb

from tidelode.llm import queries

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: url, the rule that fits, its word.
URLS = [
    ("http://a.com/en/1", "com/en/", "block"), ("http://com/en/", "com/en/", "block"), ("http://a.com/de/1", None, "allow"), ("http://example.com/en/70", "example.com/en/7", "allow"), ("http://w.Example.com/en/7?q", "example.com/en/7", "allow"),
    ("http://example.com/en/8", "com/en/", "block"), ("http://a.net/de/1", "net/de/", "allow"), ("http://b.a.NET/de/", "net/de/", "allow"), ("http://net/de/8", "net/de/", "allow"), ("http://example.net/de/7", "net/de/", "allow"),
    ("http://example.net/de/8", "example.net/de/8", "block"), ("http://w.example.net/de/81#x", "example.net/de/8", "block"), ("http://notexample.net/de/8", "net/de/", "allow"), ("http://a.net/en/1", None, "allow"), ("http://a.org/es/1", "org/es/", "block"),
    ("http://a.org/en/1", None, "allow"), ("a.org/es/1", None, "allow"), (None, None, "allow"),
]


def test_rules_are_the_contracts():
    assert sorted(queries.URL_RULES) == sorted(RULES)


def test_verdicts_of_query_and_sql(spark, tmp_path):
    spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(URLS)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(URLS)}
    got = queries.QUERIES["op3_url_filter"](spark, str(tmp_path)).select("page_id", "rule", "verdict").collect()
    assert len(got) == len(URLS) and {r[0]: (r[1], r[2]) for r in got} == want
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = duck.execute(f"select page_id, rule, verdict from ({queries.ORACLES['op3_url_filter']})").fetchall()
    assert len(got) == len(URLS) and {r[0]: (r[1], r[2]) for r in got} == want
