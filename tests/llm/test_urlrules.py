import random

from shoebox.llm import urlrules as U
from tests.conftest import SMALL, same_rows


def brute(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_query_against_sql(spark, duck):
    assert same_rows(U.op9_url_filters(spark, SMALL).toPandas(), duck.execute(U.ORACLE).df())


def test_nested_rules_against_brute_force(spark):
    rng = random.Random(2)
    labels, paths = ["a", "b", "com", "x-y", "a#"], ["", "/", "/a", "/a/", "/ab", "/a/b", "/ä", "/a?", "/b/c/d"]
    host = lambda n: ".".join(rng.choices(labels[:4], k=n))
    rules = list({(host(rng.randint(1, 3)), rng.choice(paths[:7])): None for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{host(rng.randint(1, 4))}{rng.choice(paths)}{rng.choice(['', 'z', '/q', '#f', '?x=/'])}" for _ in range(400)] + [None, "", "a.com/x", "x://", "http://A.B.COM", "http://a.com:80/a", "://com/a", "http://.com/a", "http://com./a"]
    pages = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, path string, id int").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for size in (U.ROWS_PER_SWEEP, 10):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, table, rows_per_sweep=size).collect()}
        assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_the_plan_does_not_grow_with_the_lengths_of_hosts(spark, tmp_path):
    urls = ["http://a.b.c.d.e.f.com/x", "http://com/y", "http://z.a.b.c.d.e.f.com/x/y", "http://q/", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").write.parquet(f"{tmp_path}/pages")
    pages, scans = spark.read.parquet(f"{tmp_path}/pages"), []
    names = "a.b.c.d.e.f.com".split(".")
    for depth in (1, 2, 6, 7):
        rules = [(".".join(names[-d:]), "/x", "block" if d % 2 else "allow") for d in range(1, depth + 1)]
        found = U.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()} == {i: brute(u, rules) for i, u in enumerate(urls)}
        scans.append(found._jdf.queryExecution().optimizedPlan().toString().count("parquet"))
    assert len(set(scans)) == 1 and scans[0] <= 4, scans
    far = [("a.b.c.d.e.f.g.h", "/", "block")]
    assert {r.rule for r in U.judge_urls(pages, spark.createDataFrame(far, "host string, path string, verdict string")).collect()} == {None}


def test_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None)], "page_id bigint, url string")
    rules = spark.createDataFrame([("COM ", None, "block"), ("com", "", "allow"), (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    assert sorted((repr(r.page_id), r.rule, r.verdict) for r in U.judge_urls(pages, rules).collect()) == [("1", "com", "block"), ("1", "com", "block"), ("None", None, "allow")]
    assert {r.verdict for r in U.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert U.judge_urls(pages.limit(0), rules).count() == 0


def test_no_python_in_the_plan(spark):
    plan = U.op9_url_filters(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
