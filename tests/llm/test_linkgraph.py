from __future__ import annotations

import random
import re
import time

import pytest

from growthlab.llm import linkgraph, queries, store
from sqlcheck import compare_rows

URLS = [
    "http://A.Org/x", "https://b.example.org/es/1", "https://b.example.org/en/15?x#y", "https://example.org/en/2", "http://c.com/fr/1", "http://c.com/de/1", "http://c.com/en", "http://org",
    "http://org/", "http://notexample.org/es/", "http://xorg/es/", "mailto:x", None, "", "http://", "://h/p", "http://h.net?q=://z.org/", "ftp://U@h.net:80/P%20?#", "http://d.COM/FR/1", "http://e.net\n/p", "x://y://org/z",
]
LINKS = {"http://h.net?q=://z.org/": "http://c.com/x", "http://c.com/en": "//E.net/y", "http://A.Org/x": "https://good.net/"}
SCHEMA = "page_id long, url string, html string, host string, rule string"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in linkgraph.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "r") for r in rows], SCHEMA)


def test_rules(spark):
    rows = [(n, u, f'<a HREF = "{LINKS[u]}">' if u in LINKS else None) for n, u in enumerate(URLS)]
    got = {r["page_id"]: r for r in linkgraph.judge(pages(spark, rows)).collect()}
    verdicts = dict(linkgraph.RULES)
    for n, url in enumerate(URLS):
        host, path, rule = brute(url)
        assert (got[n]["host"], got[n]["path"], got[n]["rule"]) == (host, path, rule), url
        assert got[n]["verdict"] == verdicts[rule] if rule else got[n]["verdict"] in ("allow", "block")


def test_links(spark):
    html = """<a href="/own">x</a><A HREF='https://B.net:8080/p?q'>y</A> <a href=//c.net>z</a> <a href="http://a.net/self"> <link href= "ftp://style.net/"> <a class="c"
        href = "ftp://d.net/"> <a data-href="http://data.net/"> <!-- <a href="http://comment.net/"> --> <a <a href="http://e.net?q"> """
    got = {tuple(r) for r in linkgraph.edges(pages(spark, [(1, None, html), (2, None, None)]).selectExpr("'a.net' AS host", "html")).collect()}
    assert got == {("a.net", "b.net:8080", 1), ("a.net", "c.net", 1), ("a.net", "d.net", 1), ("a.net", "e.net", 1)}


COMMENTS = ["a<!--b-->c", "<!-- a <!-- b --> c --> d", "<!-->abc-->d", "<!--->x-->y", "<!---->z", "-->a<!--", "<!--a", "a --> b <!-- c --> d <!-- e", "", "<!--\n-->\n<!--<!---->", "x<!--y<!-->", "<!-->"]


def test_comments(spark):
    rows = spark.createDataFrame([(c,) for c in [*COMMENTS, None]], "html string")
    got = [r[0] for r in rows.select(linkgraph.without_comments(rows.html)).collect()]
    assert got == [*(re.sub(r"(?s)<!--.*?-->", "", c) for c in COMMENTS), None]


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<a x", "<a href", "<a href=", "<a href=x", "-->", "<!-- -->", "<a \" href= ", "<", "<a href=a:"])
@pytest.mark.parametrize("gap", ["", " " * 2_000_000])
def test_long_html_takes_seconds(spark, piece, gap):
    """5 MB of what is never closed, and runs of white space within."""
    start = time.monotonic()
    html = piece * (5_000_000 // len(piece)) + "<a href=" + gap + "x" * 2_000_000 + "><a href='http://found.net/'>"
    table = spark.createDataFrame([("a.net", html)], "host string, html string")
    assert [r["target"] for r in linkgraph.edges(table).collect() if r["target"] == "found.net"] == ["found.net"]
    assert time.monotonic() - start < 20


def test_repeated_rows_count_again(spark):
    """As links and as seeds."""
    rows = [(1, "http://x.com/de/1", None), (2, "http://a.net/", '<a href="http://x.com/de/1"><a href="http://ok.org/">'), (3, "http://ok.org/", "")]
    assert {tuple(r) for r in linkgraph.edges(pages(spark, [(1, None, '<a href="http://b.net/">')] * 3).selectExpr("'a.net' AS host", "html")).collect()} == {("a.net", "b.net", 3)}
    table = pages(spark, rows + rows[:1] * 20)
    got = linkgraph.judge(table)
    assert got.count() == 23
    compare_rows(spark, got, queries.ORACLE_SQL["op8_link_graph_filter"], pages=table)


def rank(links, seeds, reverse):
    """Personalised PageRank by plain iteration; what reaches a host without links goes back to the seeds."""
    if reverse:
        links = [(b, a, n) for a, b, n in links]
    out = {}
    for a, _, n in links:
        out[a] = out.get(a, 0) + n
    total = sum(seeds.values())
    start = {h: s / total for h, s in seeds.items()} if total else {}
    now = dict(start)
    for _ in range(400):
        stuck = sum(r for h, r in now.items() if h not in out)
        then = {h: (1 - linkgraph.DAMPING + linkgraph.DAMPING * stuck) * s for h, s in start.items()}
        for a, b, n in links:
            then[b] = then.get(b, 0) + linkgraph.DAMPING * now.get(a, 0) * n / out[a]
        now = then
    return {h: r for h, r in now.items() if r > 0}


@pytest.mark.parametrize("hot", [1000, 3])
def test_ranks(spark, monkeypatch, hot):
    monkeypatch.setattr(store, "HOT_ROWS", hot)
    links = [("a", "b", 1), ("b", "c", 2), ("b", "a", 1), ("c", "a", 5), ("d", "bad", 3), ("e", "d", 1), ("bad", "e", 1), ("hub", "a", 1), ("a", "end", 1), *((f"h{n}", "hub", 1) for n in range(30)), *(("hub", f"g{n}", 1) for n in range(30))]
    links += [(f"r{n}", f"r{(n + 1) % 6}", 1) for n in range(6)] + [("a", "r0", 1)]  # a ring
    allowed, blocked = {"a": 3, "b": 1}, {"bad": 2, "b": 1}
    hosts = sorted({h for a, b, _ in links for h in (a, b)})
    seeds = spark.createDataFrame([(h, allowed.get(h, 0), blocked.get(h, 0)) for h in hosts], "host string, allowed long, blocked long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in linkgraph.ranks(spark.createDataFrame(links, "source string, target string, links long"), seeds).collect()}
    trust, distrust = rank(links, allowed, False), rank(links, blocked, True)
    assert got.keys() == trust.keys() | distrust.keys()
    for host, (t, d) in got.items():
        assert (t, d) == (pytest.approx(trust.get(host, 0), abs=1e-9), pytest.approx(distrust.get(host, 0), abs=1e-9))
    assert sum(t for t, _ in got.values()) == pytest.approx(1) and sum(d for _, d in got.values()) == pytest.approx(1)


def test_against_sql(spark):
    """Verdicts end to end over pages with links between hosts, repeated rows and very long html."""
    rng = random.Random(4)
    hosts = [f"h{n}.{rng.choice(['org', 'com', 'net', 'io'])}" for n in range(60)] + ["www.example.org"]
    rows = []
    for n in range(1500):
        host = rng.choice(hosts[: 3 + n % 58])
        html = "".join(f'<p>text <a class="x" href="{rng.choice(["http:", "HTTPS:", ""])}//{rng.choice(hosts).upper()}/p">l</a><a href="/own">' for _ in range(rng.randrange(4)))
        rows.append((n, f"https://{host}/{rng.choice(['fr/1', 'de/x', 'es/2', 'en/1?q', ''])}", html if n % 9 else None))
    rows += [(5000, None, '<a href="http://h1.com/">'), (5001, "http://h2.net/", "word <a " * 50_000 + '<a href="http://x.de">')] + rows[:40]
    table = pages(spark, rows)
    got = linkgraph.judge(table)
    assert got.where("rule is null and verdict = 'block'").count() and got.where("rule is null and verdict = 'allow'").count()
    compare_rows(spark, got, queries.ORACLE_SQL["op8_link_graph_filter"], pages=table)


def test_who_links_to_blocked_hosts_is_blocked(spark):
    rows = [(1, "http://x.com/de/1", None), (2, "http://farm.net/", '<a href="http://x.com/de/1">'), (3, "http://fine.net/", '<a href="http://ok.org/">'), (4, "http://ok.org/", '<a href="http://liked.net/">'), (5, "http://liked.net/", None), (6, "http://far.net/", "")]
    got = {r["page_id"]: r["verdict"] for r in linkgraph.judge(pages(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


def test_nothing(spark):
    assert linkgraph.judge(pages(spark, [])).collect() == []
    assert [r["verdict"] for r in linkgraph.judge(pages(spark, [(1, "http://a.org/", None)]), []).collect()] == ["allow"]
