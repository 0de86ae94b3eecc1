"""Judging urls by rules and, where none fits, by trust and distrust that spread over the links between hosts.

Trust starts at hosts with allowed pages and follows the links (personalised PageRank); distrust starts at hosts with
blocked pages and follows them backwards, to those who link there. A host whose distrust exceeds its trust by more than
the threshold is blocked. Only DataFrame functions; links are counted once per pair of hosts before anything is joined,
and the arithmetic is in whole numbers, so results don't depend on the order of additions.

Defined results: a null url, or one without ``://``, has an empty host and path, takes part in no link, and is allowed;
null html has no links; links to the own host don't count, and a host without other links keeps its mass; repeated rows
come back repeated and weigh as seeds as often as they occur; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplattice.llm.common import LOWER, UPPER, ascii_lower
from shoplattice.session import materialise

#: Units into which the trust, and the distrust, of all seeds together is divided.
MASS = 10 ** 15
KEEP_PERCENT = 85
ROUNDS = 10
_WRITE_EVERY = 5
LINK = r"""(?i)href\s*=\s*["']([^"']*)["']"""


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, as (rule, verdict); equal lengths by the rule's text. Null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules.items(), key=lambda r: (len(r[0]), r[0])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def link_hosts(html: Column, own: Column) -> Column:
    """Other hosts that the page links to, each once."""
    def target(link: Column) -> Column:
        full = F.when(link.startswith("//"), F.concat(F.lit("x:"), link)).otherwise(link)
        return F.when(F.instr(full, "://") > 0, host_of(full))
    found = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), target)
    return F.array_distinct(F.filter(found, lambda h: h.isNotNull() & (h != "") & (h != own)))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` of every host in edges (src, dst) and seeds (host, allowed, blocked)."""
    edges = materialise(edges.select("src", "dst").where("src <> dst").distinct(), "host-links")
    hosts = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct()
    sums = seeds.agg(F.greatest(F.sum("allowed"), F.lit(1)).alias("all_allowed"), F.greatest(F.sum("blocked"), F.lit(1)).alias("all_blocked")).first()
    started = hosts.join(seeds, "host", "left").select("host", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.coalesce("allowed", F.lit(0)).alias("n"), F.lit(sums["all_allowed"] or 1).alias("of")),
        F.struct(F.lit(1).alias("kind"), F.coalesce("blocked", F.lit(0)).alias("n"), F.lit(sums["all_blocked"] or 1).alias("of")))).alias("s"))
    # n * MASS may pass 64 bits, so the share is taken in two steps of six and nine digits
    share = "(s.n * 1000000 div s.of) * 1000000000 + ((s.n * 1000000 % s.of) * 1000000000 div s.of)"
    base = started.select(F.col("s.kind").alias("kind"), "host", F.expr(share).cast("long").alias("base"))
    ways = edges.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")).union(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")))
    out = ways.groupBy("kind", "host").agg(F.count("*").alias("out"))
    base = materialise(base.join(out, ["kind", "host"], "left"), "host-seeds")
    ways = materialise(ways, "host-ways")
    state = base.select("kind", "host", "out", F.col("base").alias("mass"))
    for nth in range(1, rounds + 1):
        sent = ways.join(state.where("out is not null"), ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.expr("mass div out")).alias("got"))
        kept = state.where("out is null").select("kind", "host", F.col("mass").alias("got"))
        got = sent.union(kept).groupBy("kind", "host").agg(F.sum("got").alias("got"))
        mass = F.expr(f"({100 - KEEP_PERCENT} * base + {KEEP_PERCENT} * coalesce(got, 0)) div 100")
        state = base.join(got, ["kind", "host"], "left").select("kind", "host", "out", mass.alias("mass"))
        if nth % _WRITE_EVERY == 0 or nth == rounds:
            state = materialise(state, "host-state")
    return state.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("mass"))).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("mass"))).alias("distrust"))


def judge(pages: DataFrame, rules: dict[str, str], threshold: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    url = F.col("url").cast("string")
    read = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    ruled = read.withColumn("ruled", rule_for(F.col("host"), F.col("path"), rules))
    known = ruled.where("host <> ''")
    seeds = known.groupBy("host").agg(F.count_if(F.col("ruled.verdict") == "allow").alias("allowed"), F.count_if(F.col("ruled.verdict") == "block").alias("blocked"))
    edges = known.select(F.col("host").alias("src"), F.explode(link_hosts(F.col("html"), F.col("host"))).alias("dst"))
    scores = spread(edges, materialise(seeds, "host-pages"), rounds)
    own = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return ruled.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))


def sql(rules: dict[str, str], rounds: int = ROUNDS) -> str:
    """The same in DuckDB; the rounds are written out."""
    def host(url: str) -> str:
        return f"translate(regexp_extract(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '^[^/?#]*'), '{UPPER}', '{LOWER}')"

    fits = []
    for rule, verdict in sorted(rules.items(), key=lambda r: (-len(r[0]), r[0])):
        of, slash, start = rule.partition("/")
        fits.append(f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{slash + start}') THEN '{rule}'")
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules.items())
    link = LINK.replace("'", "''")
    share = "CAST((n::HUGEINT * 1000000 // total) * 1000000000 + ((n::HUGEINT * 1000000 % total) * 1000000000 // total) AS BIGINT)"
    steps = ["m0 AS (SELECT kind, host, base AS mass FROM nodes)"]
    for nth in range(rounds):
        steps.append(f"""m{nth + 1} AS (SELECT n.kind, n.host, CAST(({100 - KEEP_PERCENT} * n.base + {KEEP_PERCENT} * coalesce(g.got, 0)) // 100 AS BIGINT) AS mass FROM nodes n LEFT JOIN
            (SELECT kind, host, CAST(sum(got) AS BIGINT) AS got FROM (SELECT w.kind, w.dst AS host, m.mass // o.n AS got FROM ways w JOIN m{nth} m ON m.kind = w.kind AND m.host = w.host JOIN outs o ON o.kind = w.kind AND o.host = w.host
              UNION ALL SELECT m.kind, m.host, m.mass FROM m{nth} m WHERE NOT EXISTS (SELECT 1 FROM outs o WHERE o.kind = m.kind AND o.host = m.host)) GROUP BY kind, host) g ON g.kind = n.kind AND g.host = n.host)""")
    return f"""WITH p AS (SELECT page_id, html, {host("coalesce(url, '')")} AS host,
          regexp_extract(CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r AS (SELECT *, CASE {" ".join(fits)} END AS rule FROM p),
        v AS (SELECT *, CASE rule {verdicts} END AS ruled FROM r),
        links AS (SELECT DISTINCT host AS src, {host("l")} AS dst FROM (SELECT host, CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END AS l FROM
          (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM v WHERE host <> ''))),
        edges AS (SELECT * FROM links WHERE dst <> '' AND src <> dst),
        seeds AS (SELECT host, count_if(ruled = 'allow') AS allowed, count_if(ruled = 'block') AS blocked FROM v WHERE host <> '' GROUP BY host),
        hosts AS (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM seeds),
        nodes AS (SELECT kind, host, {share} AS base FROM (
          SELECT 0 AS kind, hosts.host, coalesce(allowed, 0) AS n, greatest((SELECT sum(allowed) FROM seeds), 1) AS total FROM hosts LEFT JOIN seeds USING (host)
          UNION ALL SELECT 1, hosts.host, coalesce(blocked, 0), greatest((SELECT sum(blocked) FROM seeds), 1) FROM hosts LEFT JOIN seeds USING (host))),
        ways AS (SELECT 0 AS kind, src AS host, dst FROM edges UNION ALL SELECT 1, dst, src FROM edges),
        outs AS (SELECT kind, host, count(*) AS n FROM ways GROUP BY kind, host),
        {", ".join(steps)}
        SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.mass, 0) - coalesce(t.mass, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
          coalesce(t.mass, 0) AS trust, coalesce(d.mass, 0) AS distrust
        FROM v LEFT JOIN m{rounds} t ON t.kind = 0 AND t.host = v.host LEFT JOIN m{rounds} d ON d.kind = 1 AND d.host = v.host"""
