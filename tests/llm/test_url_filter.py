import re

from pyspark.sql import functions as F

from tessera.llm import url_filter as U

SCHEMA = "page_id long, url string, host string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    "http://a.org/x", "http://org/", "http://org", "http://b.example.org/es/1", "https://example.org/en/1", "https://xexample.org/en/1", "http://m.example.org/en/12?x#y", "http://c.com/fr/", "http://c.com/de/", "http://c.com/en/",
    "http://C.COM/de/2", "http://com/fr/", "ftp://x.net", "x.net/y", None, "", "://", "http://a.org?q=://b.com/de/", "http://É.ORG/ü", "http://a.org:80/x", "http://a\nb.com/de/\n", "http://c.com#/de/", "a://b://c.com/de/",
]


def test_parts_and_rules(spark):
    frame = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], SCHEMA)
    got = {r["page_id"]: r for r in U.judge(frame).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        rule = rule_of(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule.name), url
        if rule:
            assert got[i]["verdict"] == rule.verdict


def test_reputation_shrinks_and_blocks_by_bound(spark):
    rows = [(f"bad{i}.spam.com", 1) for i in range(40) for _ in range(5)] + [(f"good{i}.fine.com", 0) for i in range(40) for _ in range(5)]
    rows += [("new.spam.com", None), ("new.fine.com", None), ("other.net", None), ("once.fine.com", 1)]
    low = {r["host"]: r["low"] for r in U.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert low["bad1.spam.com"] > 0.5 > low["new.fine.com"] and low["new.spam.com"] > low["other.net"] > low["new.fine.com"]
    assert low["once.fine.com"] < 0.5


def test_native_plan_without_python(spark):
    frame = spark.createDataFrame([(1, "http://a.com/en/", None, None)], SCHEMA)
    plan = U.judge(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    frame = spark.createDataFrame([(None, None, None, None)] * 3 + [(1, "http://x.net/" + "a" * 100_000, None, None)] * 2, SCHEMA)
    got = U.judge(frame)
    assert got.count() == 5 and {r["verdict"] for r in got.collect()} == {"allow"}


def test_hot_host_keeps_all_rows(spark):
    frame = spark.range(5000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.lit("http://hot.com/de/x")).otherwise(F.concat(F.lit("http://h"), F.col("id"), F.lit(".com/en/"))).alias("url"))
    got = U.judge(frame)
    assert got.count() == 5000 and got.where("verdict = 'block'").count() >= 1667


def test_suffixes_domains_and_addresses(spark):
    hosts = ["www.bbc.co.uk", "co.uk", "bbc.co.uk", "a.b.example.com", "example.com", "com", "", "10.0.0.1", "[::1]", "x.1", "uk", "notco.uk"]
    frame = spark.createDataFrame([(h,) for h in hosts], "h string")
    suffix, domain = U.suffix_and_domain("h")
    got = {r["h"]: (r["s"], r["d"]) for r in frame.select("h", suffix.alias("s"), domain.alias("d")).collect()}
    want = [("co.uk", "bbc.co.uk"), ("co.uk", "co.uk"), ("co.uk", "bbc.co.uk"), ("com", "example.com"), ("com", "example.com"), ("com", "com"), ("", ""), ("", "10.0.0.1"), ("", "[::1]"), ("1", "x.1"), ("uk", "uk"), ("uk", "notco.uk")]
    assert got == dict(zip(hosts, want))
    suffix, _ = U.suffix_and_domain("h", ())
    assert frame.where("h = 'bbc.co.uk'").select(suffix.alias("s")).first()["s"] == "uk"


def test_sql_agrees_on_all_kinds_of_hosts(spark, tmp_path):
    from oracle import plain

    import duckdb

    from tessera.llm import queries

    urls = [*URLS, *(f"http://{h}/{p}" for h in ("www.bbc.co.uk", "x.co.uk", "10.0.0.1", "10.0.0.2:8", "[::1]", "a.com", "b.a.com", "c.net") for p in ("de/", "fr/1", "other"))]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    result = db.execute(queries.SQL["op5_url_filter"])
    names = [d[0] for d in result.description]
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in queries.QUERIES["op5_url_filter"](spark, str(tmp_path)).collect()) == want


def test_thousands_of_rules_fit_by_a_join(spark):
    many = U.RULES + tuple(U.Rule("block" if i % 2 else "allow", f"h{i}.net", f"/{i % 3}") for i in range(1000))
    frame = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate([*URLS, "http://h5.net/2", "http://x.h5.net/21", "http://h5.net/1", "http://xh5.net/2"])], SCHEMA)
    few = {r["page_id"]: r["rule"] for r in U.judge(frame).collect()}
    got = {r["page_id"]: r for r in U.judge(frame, many).collect()}
    assert all(got[i]["rule"] == few[i] for i in range(len(URLS))) and len(got) == len(URLS) + 4
    assert [got[len(URLS) + i]["rule"] for i in range(4)] == ["h5.net/2", "h5.net/2", None, None] and got[len(URLS)]["verdict"] == "block"


def test_equally_long_rules_in_both_forms(spark):
    rules = (U.Rule("block", "org", "/abc"), U.Rule("allow", "a.org", "/a"), U.Rule("allow", "org", "/abc"), U.Rule("block", "org", "/"))
    rows = spark.createDataFrame([("a.org", "/abc"), ("b.org", "/abc"), ("c.org", "/x")], "host string, path string")
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    want = {"a.org": ("a.org/a", "allow"), "b.org": ("org/abc", "allow"), "c.org": ("org/", "block")}
    for given in (rules, rules[::-1]):
        one = rows.withColumn("found", U.match_rules(F.col("host"), F.col("path"), given))
        assert {r["host"]: tuple(r["found"]) for r in one.collect()} == want
    assert {r["host"]: tuple(r["found"]) for r in U.join_rules(rows, table).collect()} == want
