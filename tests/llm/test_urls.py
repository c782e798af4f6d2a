import random

import duckdb

from quillgraph.llm import urls as U


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [None, "", "no scheme", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x?q#f", "https://example.com/en/", "https://example.com/en", "http://b.example.com/en/1", "x://com/", "x://com", "x://net/es/", "x://a.net/fr/#", "x://a.net?/fr/", "x://ANet/fr/", "a://b://c.net/es/", "x://İ.com/\nline", "x://.com/", "x://a..net/es/", "http://a.com/" + "y" * 5000]


def check(spark, urls, rules):
    df = spark.createDataFrame([(i % 7 if i % 5 else None, u, "z") for i, u in enumerate(urls)], "page_id long, url string, verdict string").repartition(3)
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = [tuple(x) for x in U.judge_urls(df, r).collect()]
    want = [(i % 7 if i % 5 else None, *plain(u, rules)) for i, u in enumerate(urls)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_odd_urls(spark):
    check(spark, URLS * 2, list(U.RULES))
    check(spark, URLS, [])


def test_random_lists(spark, monkeypatch):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(120))}.values())
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(400)]
    check(spark, urls, rules)
    monkeypatch.setattr(U, "BROADCAST_BYTES", 0)
    check(spark, urls, rules)


def test_hot_pairs_without_broadcast(spark, monkeypatch):
    """Half of all pages have one url; the rules found don't fit a broadcast."""
    monkeypatch.setattr(U, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(U, "HOT_SHARE", 10)
    urls = ["http://www.example.com/en/x"] * 40 + ["http://nowhere.org/"] * 30 + [f"http://a{i}.net/fr/{i}" for i in range(30)] + [None, ""]
    check(spark, urls, list(U.RULES))


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).selectExpr("concat('h', id) as rh", "concat('/', id) as rp")
    n = 5000 * U.BITS_A_KEY // 512 + 1
    bloom = U.bloom_filter(keys, n)
    probe = spark.range(20_000).selectExpr("concat('h', id) as kh", "concat('/', id) as kp")
    probe = probe.select("kh", "kp", U._block("kh", "kp", n).alias("kb"), *(U._bit("kh", "kp", w).alias(f"b{w}") for w in range(8)))
    passed = probe.join(bloom, probe.kb == bloom.block).where(" and ".join(f"(shiftrightunsigned(w{w}, b{w}) & 1) = 1" for w in range(8)))
    ids = {int(r.kh[1:]) for r in passed.collect()}
    assert ids >= set(range(5000)) and len(ids) < 5000 + 15_000 * 0.01


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(con.execute(U.ORACLES["op5_url_filter"]).fetchall(), key=str) == sorted((tuple(r) for r in U.op5_url_filter(spark, sf).collect()), key=str)
    con.execute("drop view pages")
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(URLS)))
    assert sorted(con.execute(U.ORACLES["op5_url_filter"]).fetchall(), key=str) == sorted(((i, *plain(u, U.RULES)) for i, u in enumerate(URLS)), key=str)
