from treeloom.llm import url_filter as u

ROWS = [
    (1, "https://WWW.Example.com/en/x?q=1#f"),
    (2, "http://a.example.com/en/y"),
    (3, "http://a.example.com/fr/y"),
    (4, "http://example.com"),
    (5, "http://b.net/es/1"),
    (6, "http://b.net/de/1"),
    (7, None),
    (8, "no scheme"),
    (9, ""),
    (10, "http://spam-x.org/p/?a"),
    (11, "http://xcom/en/"),
    (12, "http://a.b/?://c/"),
    (13, "ftp://É.ORG/p\nq/"),
    (14, "http://m.org/p/"),
    (14, "http://m.org/p/"),
    (None, "https://m.org/p#z"),
]


def brute(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return host, path[:end]


def rule(host, path):
    best = None
    for _, r in u.RULES:
        h, p = r[: r.index("/")], r[r.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(r) > len(best)):
            best = r
    return best


def canonical(url):
    host, path = brute(url)
    rest = url.split("://", 1)[1].split("#")[0] if url and "://" in url else ""
    query = rest.split("?", 1)[1] if "?" in rest else ""
    port = next((p for p in (":80", ":443", ":") if host.endswith(p)), "")
    return host.removesuffix(port) + path.rstrip("/") + ("?" + "&".join(sorted(query.split("&"))) if query else "")


def expected(rows, listed):
    verdicts = {r: v for v, r in u.RULES}
    canon = {canonical(x) for x in listed} - {""}
    out = []
    for i, url in rows:
        h, p = brute(url)
        r = rule(h, p)
        v = verdicts[r] if r else "block" if canonical(url) in canon else "allow"
        out.append((i, h, p, r, v))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, x, "h", "w", 1) for i, x in ROWS], "page_id long, url string, host string, w0 string, block int")
    listed = ["http://m.org/p", None, "", "http://spam-x.org/p", "http://spam-x.org/p/", "http://a.example.com/en/y"]
    list_df = spark.createDataFrame([(x, 1) for x in listed], "url string, canon int")
    for max_blocks in (1, 1 << 10):
        assert got(u.filter_urls(pages, list_df, max_blocks=max_blocks)) == expected(ROWS, listed)


def test_another_query_is_another_url(spark):
    pages = spark.createDataFrame([(1, "http://spam.org/p?id=1"), (2, "http://spam.org/p?id=2"), (3, "https://SPAM.org:443/p/?b=2&id=1"), (4, "http://spam.org/p?id=1&b=2#x"), (5, "http://spam.org/p")], "page_id long, url string")
    one = spark.createDataFrame([("http://spam.org:80/p?id=1",), ("http://spam.org/p?id=1&b=2",)], "url string")
    assert sorted(r.page_id for r in u.filter_urls(pages, one).where("verdict = 'block'").collect()) == [1, 3, 4]


def test_kept_columns_meet_no_other(spark):
    names = ("block", "canon", "hit", "w0", "kept", "listed")
    pages = spark.createDataFrame([(1, "http://m.org/p", *"abcdef"), (2, "http://n.org/", *"ghijkl")], "page_id long, url string, " + ", ".join(f"{n} string" for n in names))
    out = u.filter_urls(pages, pages.limit(1).select("url"), keep=names)
    assert sorted(tuple(r[n] for n in names) for r in out.collect()) == [tuple("abcdef"), tuple("ghijkl")]


def test_empty_sides(spark):
    none = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame(ROWS, "page_id long, url string")
    assert got(u.filter_urls(pages, none)) == expected(ROWS, [])
    assert u.filter_urls(spark.createDataFrame([], "page_id long, url string"), pages).collect() == []


def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(20_000).selectExpr("concat('host', id, '/p') AS canon")
    n = u.blocks_for(20_000)
    bloom = u.bloom_filter(keys, "canon", n)
    from pyspark.sql import functions as F

    asked = spark.range(40_000).selectExpr("id", "concat('host', id, '/p') AS canon").withColumn("block", u.bloom_block(F.col("canon"), n)).join(bloom, "block", "left")
    hit = F.lit(True)
    for k in range(4):
        want = F.expr(u.bloom_word("canon", k))
        hit = hit & (F.col(f"w{k}").bitwiseAND(want) == want)
    hits = asked.where(hit)
    assert hits.where("id < 20000").count() == 20_000
    assert hits.where("id >= 20000").count() < 400


def test_plan_is_native_and_bounded(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string")
    df = u.filter_urls(pages, pages.select("url"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert u.blocks_for(10**12) == u.MAX_BLOCKS
