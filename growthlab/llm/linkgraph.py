"""URL filters by the host graph: trust flows along links from allowed hosts, distrust against them from blocked ones.

Pages give weighted edges between hosts. Personalised PageRank from the hosts that a rule allows is their
trust; the same over reversed links from the hosts that a rule blocks is their distrust: who
links to a blocked host takes some of its blame. Both run at once as one join and one aggregation a round over the
aggregated edges, written to the shared folder. As a change shrinks by the damping each round, what is left
to change is known, and rounds go on until it is below ``TOLERANCE`` of the whole: there is no other limit. What reaches a
host without links is given back to the seeds: ranks are shares of their sum. A rule decides a page where one
fits; other pages follow their host's ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlab.llm.store import dealt_join, hot_parts, lower_ascii, remove, spread_join, written

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING = 0.85
#: Ranks are within so much of their limits, summed over all hosts, where each kind of rank sums to 1.
TOLERANCE = 1e-9
#: Rounds between two tables in the shared folder.
ROUNDS_TOGETHER = 5
#: A host is blocked whose distrust exceeds its trust and this share of what each host would have alike.
LEAST_DISTRUST = 0.1
#: Absolute links of anchors: a relative link stays on its host, and a link within a comment is none. What is repeated never
#: begins what may follow it, or is bounded by the next < or >, and gives nothing back (+): the time grows with the length.
_LINK = r"""(?i)<a\s(?:[^<>]*?[\s"'])?href\s*+=\s*+["']?+\s*+(?:[a-z][a-z0-9+.-]*+:)?+//([^"'\s>/?#]++)"""
_COMMENT = r"(?s)<!--.*?-->"


def host_and_path(url: str) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, from the first ``://`` to ``/``, ``?``, ``#`` or the end, and the path after
    it to ``?``, ``#`` or the end. Both empty for null and for what has no ``://``."""
    rest = F.coalesce(F.expr(f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')"), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits (of equal ones the first by name), or null."""
    fitting = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        fitting = F.when(fits, F.lit(rule)).otherwise(fitting)
    return fitting


def without_comments(html: Column) -> Column:
    """The html without what stands from an opening to the first close after it. What isn't closed stays.

    Up to the last close every opening finds its close, and the search goes on behind it; what follows has no close to look for. So the
    time grows with the length, however many openings there are.
    """
    tail = F.substring_index(html, "-->", -1)
    head = F.left(html, F.length(html) - F.length(tail))
    return F.concat(F.regexp_replace(head, _COMMENT, ""), tail)


def edges(pages: DataFrame) -> DataFrame:
    """source, target, links: absolute links between different hosts. pages: host, html."""
    links = pages.select(F.col("host").alias("source"), F.explode(F.regexp_extract_all(without_comments(F.col("html")), F.lit(_LINK), 1)).alias("target"))
    links = links.withColumn("target", lower_ascii(F.col("target"))).where("source <> '' and target <> '' and source <> target")
    return links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def ranks(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, trust, distrust. links: source, target, links; seeds: host, allowed, blocked (pages of a host).

    Each rank of all hosts sums to 1, or is 0 without seeds of its kind; a host that no seed reaches has neither, and is
    missing. Links of a host that has very many are dealt out over several tasks.
    """
    sums = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    share = lambda c, n: (F.col(c) / F.lit(float(n))) if n else F.lit(0.0)
    node = lambda host, kind: F.concat(F.lit(kind), F.col(host)).alias("node")  # noqa: E731  + or - and the host
    start = seeds.select(F.explode(F.array(*(F.struct(node("host", k), share(c, n).alias("rank")) for k, c, n in (("+", "allowed", sums["a"]), ("-", "blocked", sums["b"]))))).alias("s")).select("s.*")
    start = written(start.where("rank > 0"), "link-seeds")

    def shares(away: str, to: str, kind: str) -> DataFrame:
        out = links.groupBy(away).agg(F.sum("links").alias("all"), F.count(F.lit(1)).alias("n"))
        each = spread_join(links, out.drop("n"), away, to, counts=out)
        return each.select(node(away, kind), node(to, kind).alias("to"), (F.col("links") / F.col("all")).alias("share"))

    steps = written(shares("source", "target", "+").unionByName(shares("target", "source", "-")), "link-steps")
    hot, now, left = hot_parts(steps.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node"), start, None
    while left is None or left > TOLERANCE:
        first = now
        for last in range(ROUNDS_TOGETHER - 1, -1, -1):
            moved = dealt_join(steps, now, "node", "to", hot).select(F.col("to").alias("node"), (DAMPING * F.col("share") * F.col("rank")).alias("rank"))
            both = moved.unionByName(start.select("node", ((1 - DAMPING) * F.col("rank")).alias("rank")))
            if last:
                now = both.groupBy("node").agg(F.sum("rank").alias("rank"))
            else:
                old = now.select("node", F.lit(0.0).alias("rank"), F.col("rank").alias("old"))
                now = both.withColumn("old", F.lit(0.0)).unionByName(old).groupBy("node").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old"))
        now = written(now, "link-ranks", *([] if first is start else [first]))
        change = now.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        left, now = change * DAMPING / (1 - DAMPING), _as_table(now, "node", "rank")
    kind = F.substring("node", 1, 1)
    of = lambda sign, name: F.coalesce(F.sum(F.when(kind == sign, F.col("rank"))), F.lit(0.0)).alias(name)
    whole = now.agg(of("+", "trust"), of("-", "distrust")).first()
    found = now.groupBy(F.expr("substring(node, 2)").alias("host")).agg(of("+", "trust"), of("-", "distrust"))
    found = written(found.select("host", *(share(c, whole[c]).alias(c) for c in ("trust", "distrust"))), "link-ranks", now)
    remove(steps, start)
    return found


def _as_table(table: DataFrame, *columns: str) -> DataFrame:
    out = table.select(*columns)
    out.written_to = table.written_to
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages.

    trust and distrust are multiples of what each host would have alike, to four places. A null url has no host; it
    fits no rule and is allowed. A null html has no links. Repeated rows count again as links and seeds. Columns
    other than page_id, url and html are not read.
    """
    host, path = host_and_path("url")
    verdict = F.element_at(F.create_map(*(F.lit(x) for rule in rules for x in rule)), F.col("rule")) if rules else F.lit(None).cast("string")
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("verdict", verdict)
    seeds = judged.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count(F.lit(1)).alias("n"))
    seeds = written(seeds, "link-hosts")
    links = written(edges(pages.select(host.alias("host"), "html")), "link-edges")
    named = seeds.where("host <> ''")
    hosts = named.select("host").union(links.select("source")).union(links.select("target")).distinct().count()
    graded = ranks(links, named)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * hosts >= LEAST_DISTRUST)
    graded = written(graded.select("host", *(F.round(F.col(c) * hosts, 4).alias(c) for c in ("trust", "distrust")), F.when(bad, "block").otherwise("allow").alias("by_host")), "link-verdicts", graded, links)
    out = spread_join(judged, graded, "host", "page_id", "left", seeds).fillna({"trust": 0.0, "distrust": 0.0})
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_host", F.lit("allow")).alias("verdict"), "trust", "distrust")
