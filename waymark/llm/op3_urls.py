"""Operator 3, URL filters by link-graph propagation; DataFrame functions only.

Rules decide the urls they fit.  For the rest, hosts are scored on a graph of
host edges: links (``href`` of ``a``) found in the pages, plus an edge each way between a host and
the domain above it, between that and the next, and so on down to two labels (a
host of over ``MAX_LABELS`` labels, more than a name in DNS can have, goes to its
last ``MAX_LABELS`` in one step).  Trust is a personalised
PageRank from hosts with allowed pages, distrust the same on reversed edges
from hosts with blocked pages.  A host is blocked if its share of distrust,
distrust / (trust + distrust), exceeds ``max_distrust``; hosts that no score
reaches are allowed.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is allowed; repeated urls are judged row by row; a null page
has no links; an empty table gives an empty result; other columns are ignored.

Both scores run in one loop of ``ROUNDS`` rounds.  A round moves on ``DAMPING`` of
the weight that the last one moved, so at most ``DAMPING ** ROUNDS`` of all weight,
a fifth, has not reached its place (README has why there aren't more).  The edges
of a hub are dealt over as many parts as it needs, and its score is copied to
each; which hosts are hubs follows from their counted edges (at most
``BROADCAST_ROWS`` hosts can be).  Edges never meet by host without that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_lookup, settle, table

#: (host, path, verdict), longest rule first wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LINK = r"""(?i)<a\s(?:[^<>]*?\s)?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
ROUNDS, DAMPING, MAX_DISTRUST, SETTLE_EVERY = 10, 0.85, 0.6, 1
MAX_LABELS = 127
#: Edges of one host that a task may get, unless there are so many edges that more hosts than can be broadcast have them.
HUB_EDGES = 4096
_DOMAIN = r"^[^.]+\..+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return ascii_lower(part(1)), part(2)


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule's text and verdict, null where none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later, longer ones wrap earlier ones
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, F.lit(v)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return rule, verdict


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between hosts, and of hosts and the domains above them, step by step."""
    links = (
        pages.select(host_and_path(F.col("url"))[0].alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), 1))).alias("dst"))
        .select("src", ascii_lower("dst").alias("dst"))
    )
    labels = F.split("host", r"\.")
    last = F.slice(labels, F.greatest(F.size(labels) - (MAX_LABELS - 1), F.lit(1)), MAX_LABELS)
    deep = hosts.select("host", last.alias("l")).where(F.size("l") > 2)
    steps = deep.select("l", F.explode(F.sequence(F.lit(1), F.size("l") - 2)).alias("i"))
    below = lambda k: F.array_join(F.slice("l", F.col("i") + k, F.size("l")), ".")
    up = steps.select(below(0).alias("src"), below(1).alias("dst")).where(F.col("dst").rlike(_DOMAIN))
    up = up.unionByName(hosts.where(F.size(labels) > MAX_LABELS).select(F.col("host").alias("src"), F.array_join(last, ".").alias("dst")))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    every = links.unionByName(up).unionByName(down)
    return every.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score): ``trust`` along the edges, ``distrust`` against them.

    ``seeds`` has (kind, host, share), shares of a kind adding up to 1.
    """
    flow = settle(edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))))
    out = flow.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    out = settle(out)
    many = max(HUB_EDGES, -(-flow.count() // BROADCAST_ROWS))  # no more than BROADCAST_ROWS hosts have that many edges
    parts = F.ceil(F.col("degree") / many).cast("int")
    hubs = out.where(F.col("degree") > many).select("kind", "src", parts.alias("_parts"))
    salt = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("_parts")), F.lit(0)).cast("int")
    flow = settle(flow.join(F.broadcast(hubs), ["kind", "src"], "left").select("kind", "src", "dst", salt.alias("salt")))
    start = seeds.select("kind", "host", (F.col("share") * (1 - damping)).alias("score"))
    scores = start
    for k in range(1, rounds + 1):
        per = scores.withColumnRenamed("host", "src").join(out, ["kind", "src"])
        dealt = per.select("kind", "src", (F.col("score") * damping / F.col("degree")).alias("score"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        moved = flow.join(dealt, ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), "score")
        scores = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % SETTLE_EVERY == 0 and k < rounds:
            scores = settle(scores)
    return scores


def host_scores(pages: DataFrame, rules=RULES) -> tuple[DataFrame, int]:
    """One row a host of the pages: trust, distrust and ``host_verdict``; and their number."""
    host, path = host_and_path(F.col("url"))
    ruled = by_rule(host, path, rules)[1]
    counts = settle(
        pages.select(host.alias("host"), ruled.alias("v")).where("host != ''").groupBy("host")
        .agg(F.sum((F.coalesce(F.col("v") == "allow", F.lit(False))).cast("long")).alias("allowed"), F.sum((F.coalesce(F.col("v") == "block", F.lit(False))).cast("long")).alias("blocked"))
    )
    total = counts.agg(F.count("*").alias("k"), F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    seed = lambda kind, n, of: counts.where(F.col(n) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(n) / F.lit(max(of or 0, 1))).alias("share"))
    seeds = settle(seed("trust", "allowed", total["a"]).unionByName(seed("distrust", "blocked", total["b"])))
    scores = propagate(host_edges(pages, counts.select("host")), seeds)
    pick = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    wide = scores.groupBy("host").agg(pick("trust"), pick("distrust"))
    known = counts.select("host").join(wide, "host", "left").fillna(0.0, ["trust", "distrust"])
    blocked = F.col("distrust") > MAX_DISTRUST * (F.col("trust") + F.col("distrust"))
    return known.withColumn("host_verdict", F.when(blocked, "block").otherwise("allow")), total["k"]


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    pages = pages.select("page_id", "url", "html")
    hosts, k = host_scores(pages, rules)
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    ruled = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("v"))
    joined = join_lookup(ruled, settle(hosts), ["host"], k, F.col("page_id"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("v", "host_verdict", F.lit("allow")).alias("verdict"), "trust", "distrust")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    case = lambda k: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[k]}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))) + " END"
    link, url = LINK.replace("'", "''"), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    parts = [f"""
u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{url}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{url}', 2) AS path FROM pages),
r AS (SELECT *, {case(0)} AS rule, {case(1)} AS v FROM u),
c AS (SELECT host, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS b FROM r WHERE host <> '' GROUP BY host),
up0 AS (SELECT host, len(ks) AS n, ks[greatest(len(ks) - {MAX_LABELS - 1}, 1):] AS k FROM (SELECT host, string_split(host, '.') AS ks FROM c)),
up1 AS (SELECT k, unnest(range(1, len(k) - 1)) AS i FROM up0),
up AS (SELECT host AS src, array_to_string(k, '.') AS dst FROM up0 WHERE n > {MAX_LABELS} UNION ALL SELECT src, dst FROM (SELECT array_to_string(k[i:], '.') AS src, array_to_string(k[i + 1:], '.') AS dst FROM up1) WHERE regexp_matches(dst, '{_DOMAIN}')),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM u WHERE html IS NOT NULL),
e AS (SELECT DISTINCT src, dst FROM (SELECT * FROM l UNION ALL SELECT * FROM up UNION ALL SELECT dst, src FROM up) WHERE src <> '' AND dst <> '' AND src <> dst),
f0 AS (SELECT 'trust' AS kind, src, dst FROM e UNION ALL SELECT 'distrust', dst, src FROM e),
f AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM f0),
s AS (SELECT 'trust' AS kind, host, {1 - DAMPING} * a / greatest((SELECT sum(a) FROM c), 1) AS score FROM c WHERE a > 0 UNION ALL SELECT 'distrust', host, {1 - DAMPING} * b / greatest((SELECT sum(b) FROM c), 1) FROM c WHERE b > 0),
s0 AS (SELECT * FROM s)"""]
    for k in range(1, ROUNDS + 1):
        parts.append(f"s{k} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT f.kind, f.dst AS host, p.score * {DAMPING} / f.degree AS score FROM f JOIN s{k - 1} p ON p.kind = f.kind AND p.host = f.src UNION ALL SELECT * FROM s) GROUP BY kind, host)")
    parts.append(f"w AS (SELECT host, sum(score) FILTER (kind = 'trust') AS t, sum(score) FILTER (kind = 'distrust') AS d FROM s{ROUNDS} GROUP BY host)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN coalesce(d, 0) > {MAX_DISTRUST} * (coalesce(t, 0) + coalesce(d, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN w ON w.host = r.host"""


SQL = _sql()
