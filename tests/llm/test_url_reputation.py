import random

from pyspark.sql import functions as F

from palimpsest.llm import url_reputation
from palimpsest.llm.url_reputation import host_of, judge, op4_url_filter, outcomes, path_of, reputation, rule_of


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[k:]
    j = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), path[:j]


def test_host_path_and_rule(spark):
    urls = [None, "", "no url", "://", "http://A.Com/fr/x?y#z", "HTTP://example.org/en/12", "x://www.Example.org/es/?q", "http://badexample.org/es/1", "http://org", "http://org/", "http://a.com?x/fr/", "http://a.com#/fr/", "http://a.com/de/", "http://com/de/1", "http://É.net/a://b/c", "http://a\nb.net/q\nr?s", "http://example.org/en/1", "http://example.org/EN/1", "http:///path", "http://x.y.example.org/fr/", "http://" + "a" * 50_000 + "/" + "b" * 50_000]
    h, p = host_of(F.col("u")), path_of(F.col("u"))
    rule, verdict = rule_of(h, p)
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", h.alias("h"), p.alias("p"), rule.alias("r"), verdict.alias("v")).collect()
    for x in rows:
        assert (x.h, x.p) == split(x.u)
        fit = [(a + b, v) for a, b, v in url_reputation.RULES if (x.h == a or x.h.endswith("." + a)) and x.p.startswith(b)]
        assert (x.r, x.v) == (max(fit, key=lambda f: len(f[0])) if fit else (None, None))


def posterior(hosts):
    """{host: (n, bad)} to {host: (mean, lower)}, level by level."""
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1]

    def level(keys, above):
        per = {}
        for h, (n, b) in hosts.items():
            a, c = per.get(keys(h), (0, 0))
            per[keys(h)] = (a + n, c + b)
        seen = {g: x for g, x in per.items() if x[0]}
        k, total = len(seen), sum(n for n, _ in seen.values())
        x = sum(n * (b / n - above(g)) ** 2 / (above(g) * (1 - above(g))) for g, (n, b) in seen.items())
        rho = min(0.5, max(0.001, (x - k) / (total - k) if k and total > k else 0))
        s = 1 / rho - 1
        return {g: ((b + s * above(g)) / (n + s), n + s + 1) for g, (n, b) in per.items()}

    n, b = (sum(x[i] for x in hosts.values()) for i in (0, 1))
    mean = (b + 0.1) / (n + 1)
    suffixes = level(suffix, lambda g: mean)
    domains = level(domain, lambda g: suffixes[suffix(g)][0])
    return {h: (m, m - 1.645 * (m * (1 - m) / w) ** 0.5) for h, (m, w) in level(lambda h: h, lambda g: domains[domain(g)][0]).items()}


def test_reputation_against_plain_python(spark):
    r = random.Random(8)
    names = [f"{a}.{b}.{c}" for a in ("www", "m", "x") for b in ("good", "bad", "odd") for c in ("net", "com")] + ["localhost", "", "good.net"]
    pages, labels, want = [], [], {}
    for i in range(2000):
        h = names[0] if i % 3 == 0 else r.choice(names)
        pages.append((i, h))
        n, b = want.get(h, (0, 0))
        if r.random() < 0.5:
            bad = r.random() < (0.9 if "bad" in h else 0.05)
            labels.append((i, int(not bad), 0))
            n, b = n + 1, b + bad
        want[h] = (n, b)
    labels += [(5, None, 1), (None, 0, 0), (99_999, 0, 0)]
    got = reputation(spark.createDataFrame(pages, "id long, host string"), outcomes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    exact = posterior(want)
    assert len(got) == len(want)
    for x in got:
        assert (x.n, x.bad) == want[x.host] and abs(x["mean"] - exact[x.host][0]) < 1e-9 and abs(x.lower - exact[x.host][1]) < 1e-9


def test_query(spark, sf_dir):
    pages = [(i, f"http://{'spam' if i % 3 == 0 else 'fine'}.host{i % 5}.net/en/{i}", "clash") for i in range(300)] + [(900, None, ""), (901, "none", ""), (None, "http://spam.host0.net/", ""), (7, "http://example.org/es/1", "")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(pages, "page_id long, url string, host string")
    out = op4_url_filter(spark, sf_dir(pages=frame, labels=labels)).collect()
    assert len(out) == len(pages)
    for x in out:
        assert x.verdict == ("block" if "spam" in x.host or x.rule == "example.org/es/" else "allow")
    assert op4_url_filter(spark, sf_dir(pages=frame.limit(0), labels=labels)).count() == 0
    assert {x.verdict for x in judge(frame, labels.limit(0)).collect() if x.rule is None} == {"allow"}


def test_registered_domains(spark):
    cases = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "www.x.com": ("x.com", "com"), "com": ("com", "com"), "x.com:8080": ("x.com", "com"), "me@x.com:": ("x.com", "com"), "x.com.": ("x.com", "com"), "a.x.com.:80": ("x.com", "com"), "10.0.0.1:80": ("10.0.0.1", "#"), "[::1]": ("[::1]", "#"), "": ("", ""), "www.news.de": ("news.de", "de"), "a.com.de": ("a.com.de", "com.de"), "x.co.uk2": ("co.uk2", "uk2")}
    domain, suffix = url_reputation.domain_and_suffix(F.col("b"))
    bare = url_reputation.bare_host(F.col("h"))
    rows = spark.createDataFrame([(h,) for h in cases], "h string").select("h", bare.alias("b")).select("h", domain.alias("d"), suffix.alias("s")).collect()
    assert {x.h: (x.d, x.s) for x in rows} == cases


def test_sql(spark, sf_dir):
    import duckdb

    r = random.Random(11)
    hosts = ["a.co.uk", "b.co.uk", "x.a.co.uk:80", "me@b.co.uk", "10.0.0.1", "10.0.0.2:8", "good.net", "bad.net.", "www.bad.net", "com", "q.com", "[::1]:9"]
    bad = {h for h in hosts if "a.co" in h or "bad" in h or "10.0" in h}
    pages, labels = [], []
    for i in range(1500):
        h = r.choice(hosts)
        pages.append((i, f"http://{h}/p/{i}"))
        if i % 2:
            labels.append((i, int(r.random() > (0.9 if h in bad else 0.05)), 0))
    path = sf_dir(pages=spark.createDataFrame(pages + [(None, None), (7, "x")], "page_id long, url string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = op4_url_filter(spark, path)
    with duckdb.connect() as db:
        for t in ("pages", "labels"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
        want = db.sql(url_reputation.OP4_SQL).select(*got.columns).fetchall()
    rows = got.collect()
    assert sorted(map(str, (tuple(x) for x in rows))) == sorted(map(str, want))
    assert {x.host for x in rows if x.verdict == "block" and x.host} == bad
