import math

from lumenstep.llm import linkrank

PAGES = [
    (1, "http://a.com/x", '<a href="http://b.com/">l</a> <A HREF="https://C.org/q?x#y">'),
    (2, "https://b.com/en/1?q#f", '<a href="http://c.org/"><a class=k href=\'//D.net/q\'><a href="/local">'),
    (3, "http://c.org/q", None),
    (4, None, "x"),
    (5, "http://x.example.com/en/77", '<a href="http://e.org">'),
    (6, "HTTP://E.org", '<a href="http://a.com/1"><a href="http://a.com/2">'),
    (7, "nohost", "<a href='http://b.com'>"),
    (8, "http://y.net/de/1", '<a href="http://b.com/"><a href="http://y.net/de">'),
    (9, "http://w.example.net/de/81#z", '<a href="http://d.net/">'),
    (9, "http://w.example.net/de/81#z", '<a href="http://d.net/">'),
    (10, "http://d.net", ""),
    (None, "ftp://d.net?p", "<a href="),
]
LINKS = {("a.com", "b.com"): 1, ("a.com", "c.org"): 1, ("b.com", "c.org"): 1, ("b.com", "d.net"): 1, ("x.example.com", "e.org"): 1, ("e.org", "a.com"): 2, ("y.net", "b.com"): 1, ("w.example.net", "d.net"): 2}


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")


def walk(seeds, links, rounds, d=0.85):
    total = sum(seeds.values())
    start = {h: n / total for h, n in seeds.items()}
    now = dict(start)
    out = {}
    for (a, _), n in links.items():
        out[a] = out.get(a, 0) + n
    for _ in range(rounds):
        new = {h: s * (1 - d) for h, s in start.items()}
        for (a, b), n in links.items():
            if a in now:
                new[b] = new.get(b, 0) + d * now[a] * n / out[a]
        now = new
    return now


def test_links(spark):
    got = {(r["src"], r["dst"]): r["n"] for r in linkrank.host_links(pages(spark)).collect()}
    assert got == LINKS


def test_rules_and_scores(spark):
    got = linkrank.judge(pages(spark)).collect()
    by = {r["page_id"]: r for r in got}
    assert (by[2]["host"], by[2]["path"], by[2]["rule"], by[2]["verdict"]) == ("b.com", "/en/1", "com/en/", "block")
    assert (by[5]["rule"], by[5]["verdict"]) == ("example.com/en/7", "allow")
    assert (by[9]["rule"], by[9]["verdict"]) == ("example.net/de/8", "block")
    assert (by[8]["rule"], by[8]["verdict"]) == ("net/de/", "allow")
    assert (by[4]["host"], by[4]["path"], by[4]["verdict"]) == ("", "", "allow")
    assert by[None]["host"] == "d.net" and len(got) == len(PAGES)
    trust = walk({"x.example.com": 1, "y.net": 1}, LINKS, 200)
    distrust = walk({"b.com": 1, "w.example.net": 2}, {(b, a): n for (a, b), n in LINKS.items()}, 200)
    for r in got:
        if r["host"]:
            t, b = trust.get(r["host"], 0.0), distrust.get(r["host"], 0.0)
            assert math.isclose(r["trust"] or 0.0, t, abs_tol=1e-5) and math.isclose(r["distrust"] or 0.0, b, abs_tol=1e-5)
            if r["rule"] is None:
                assert r["verdict"] == ("block" if t + b and b / (t + b) > 0.5 else "allow")


def test_no_links_and_empty(spark):
    assert linkrank.judge(pages(spark, [])).count() == 0
    only = linkrank.judge(pages(spark, [(1, "http://q.com/en/1", None), (2, "http://q.com/fr", None)])).collect()
    assert {r["page_id"]: r["verdict"] for r in only} == {1: "block", 2: "block"}


def test_native(spark):
    plan = linkrank.judge(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_links_of_any_length_and_far_hosts(spark):
    long_host = "h" * 60 + ".net" * 70
    html = f'<a title="{"t" * 5000}" href="//{long_host}/x"> <a class="b"href = \'https://plain.org\'> <a data-href="http://no.org"> <a <a href=http://two.org>'
    got = {r["dst"] for r in linkrank.host_links(pages(spark, [(1, "http://from.org/", html)])).collect()}
    assert got == {long_host, "plain.org", "two.org"}
    chain = [(k, f"http://h{k}.fr/" if k else "http://h0.com/en/1", f'<a href="http://h{k + 1}.fr/">') for k in range(30)]
    by = {r["page_id"]: r for r in linkrank.judge(pages(spark, chain)).collect()}
    assert by[29]["verdict"] == "allow" and by[29]["distrust"] is None  # blocked seeds pass distrust to hosts that link to them
    back = [(0, "http://h0.com/en/1", None)] + [(k, f"http://h{k}.fr/", f'<a href="http://h{k - 1}.{"com" if k == 1 else "fr"}/">') for k in range(1, 31)]
    by = {r["page_id"]: r for r in linkrank.judge(pages(spark, back)).collect()}
    assert by[30]["verdict"] == "block" and math.isclose(by[30]["distrust"], 0.15 * 0.85**30, rel_tol=1e-6)
