"""URL filters by link-graph propagation, with DataFrame functions only.

Rules (host, path, verdict) decide the urls that they fit. What they say of a host's pages makes the
seeds of a host graph: trust flows along links from hosts with allowed pages (personalised PageRank),
distrust flows against the links from hosts with blocked pages (who links to a blocked host is
suspect). Each host is judged by a threshold on what reaches it, and the pages that no rule fits
take their host's verdict.

A seed's weight is the share of its ruled pages that are allowed (blocked, for distrust). Ranks start
as the seeds; a round gives every host ``1 - DAMPING`` of its seed and ``DAMPING`` of what its
neighbours pass on, in proportion to the pages that link. ``ROUNDS`` rounds leave less than 4% of the
mass unspread. What reaches hosts without links is not given back, which scales all ranks alike.
Edges are counted before any is shuffled, links within a host are none.

Rules meet hosts, not pages: the suffixes of the distinct hosts join the rules' hosts, and each page
tests only the paths of the rules on its own host. A host of a third of all pages is one row of the
host tables. Those are broadcast while their number of rows is proven small, and joined beyond that.

Defined cases: null url or none with ``://``: host and path empty, no rule, default verdict; null or
empty html: no links; hosts that nothing reaches: default verdict; of rules that fit, the longest wins
(of equal texts, block); equal rows each keep their row; an empty table gives no rows; other columns
are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.components import written

# The rules of the contract.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link to another host: a quoted or bare href with a scheme or two slashes.
LINK = r"""[hH][rR][eE][fF]\s*=\s*["']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""
#: Share of a rank that is passed on, and rounds.
DAMPING, ROUNDS = 0.85, 20
#: A host is blocked if (trust - distrust) / (trust + distrust) is below this.
THRESHOLD = 0.0
#: The verdict of hosts that neither reaches.
DEFAULT = "allow"
#: Digits of the score that is compared, so that rounding of sums decides nothing.
DIGITS = 6
#: Host tables of so many rows are broadcast (each row a host and a few numbers).
FEW_HOSTS = 50_000


def lower_host(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(lower_host(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def sized(hosts: DataFrame) -> DataFrame:
    """The table with a broadcast hint if its rows, counted, are few."""
    return F.broadcast(hosts) if hosts.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS else hosts


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host that has any, the rules on it and on the domains it is in."""
    parts = F.split("host", r"\.")
    suffixes = hosts.filter("host <> ''").select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("domain"))
    entry = F.struct(F.char_length(F.concat("domain", "prefix")).alias("size"), F.col("says").alias("says"), F.concat("domain", "prefix").alias("rule"), F.col("prefix").alias("prefix"))
    table = rules.select(lower_host(F.col("host")).alias("domain"), F.col("path").alias("prefix"), F.col("verdict").alias("says"))
    return suffixes.join(table, "domain").groupBy("host").agg(F.collect_set(entry).alias("rules"))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host and path) and the longest rule that fits: rule, said."""
    hosts = written(rules_of_hosts(urls.select("host").distinct(), rules), "url-rules")
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["prefix"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["says"], r["rule"])))
    return urls.join(sized(hosts), "host", "left").withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("said", F.col("best.says")).drop("rules", "best")


def host_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(source, target, n): on how many pages a host links to another one."""
    found = pages.select(host_of(F.col(url)).alias("source"), F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)), lower_host)).alias("to"))
    links = found.filter("source <> '' and size(to) > 0").select("source", F.explode("to").alias("target"))
    return links.filter(F.col("source") != F.col("target")).groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of every host that any reaches, from ``links`` (source, target, n) and
    ``seeds`` (host, trust, distrust). Each round is one join on the giving host and one sum by the
    receiving host, combined within tasks first, and is written to the shared folder."""
    start = written(seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("mass")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("mass")))).alias("m")).select("host", "m.*").filter("mass > 0"), "link-seeds")
    ways = links.select(F.col("source").alias("giver"), F.col("target").alias("taker"), F.lit(0).alias("kind"), "n").unionByName(
        links.select(F.col("target").alias("giver"), F.col("source").alias("taker"), F.lit(1).alias("kind"), "n"))
    given = ways.groupBy("giver", "kind").agg(F.sum("n").alias("all"))
    arcs = written(ways.join(given, ["giver", "kind"]).select(F.col("giver").alias("host"), "kind", "taker", (F.col("n") / F.col("all")).alias("share")), "link-arcs")
    rank = start
    if not arcs.isEmpty():
        base = start.select("host", "kind", (F.col("mass") * (1 - damping)).alias("mass"))
        for _ in range(rounds):
            passed = rank.join(arcs, ["host", "kind"]).select(F.col("taker").alias("host"), "kind", (F.col("mass") * F.col("share") * damping).alias("mass"))
            rank = written(passed.unionByName(base).groupBy("host", "kind").agg(F.sum("mass").alias("mass")), "link-ranks")
    amount = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0))
    return rank.groupBy("host").agg(amount(0).alias("trust"), amount(1).alias("distrust"))


def filter_urls(pages: DataFrame, rules: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and its host's trust and distrust
    (null if nothing reaches it) and score."""
    urls = pages.select(F.col(page).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    said = written(ruled(urls, rules), "url-ruled")
    share = lambda what: F.sum(F.when(F.col("said") == what, 1).otherwise(0)) / F.count("*")
    seeds = said.filter("said is not null").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    links = written(host_links(pages, html, url), "host-links")
    ranks = propagate(links, seeds)
    score = F.round((F.col("trust") - F.col("distrust")) / (F.col("trust") + F.col("distrust")), DIGITS)
    judged = written(ranks.select("host", "trust", "distrust", score.alias("score")), "host-verdicts")
    own = F.when(F.col("score") < THRESHOLD, "block").when(F.col("score").isNotNull(), "allow").otherwise(DEFAULT)
    return said.join(sized(judged), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "trust", "distrust", "score")


def op11_link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all pages, by the contract's rules and the links of the pages themselves."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def _oracle() -> str:
    """Rules by CASE on every page, ranks by a recursion over rounds (both kinds at once)."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    link = LINK.replace("'", "''")
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
with recursive r(domain, prefix, says) as (values {rules}),
p as materialized (
  select row_number() over () as row, page_id, html, {lower.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
fit as (select row, max({{'size': length(domain || prefix), 'says': says, 'rule': domain || prefix}}) as best
        from p, r where (host = domain or ends_with(host, '.' || domain)) and starts_with(path, prefix) group by row),
s as materialized (select host, avg((best.says = 'allow')::int) as trust, avg((best.says = 'block')::int) as distrust from p join fit using (row) group by host),
l as (select row, host as source, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: {lower.format('x')}))) as target from p where host <> ''),
e as (select source, target, count(*) as n from l where source <> target group by all),
arc as materialized (
  select giver, kind, taker, n / sum(n) over (partition by giver, kind) as share from (
    select source as giver, target as taker, 0 as kind, n from e union all select target, source, 1, n from e)),
seed as materialized (select host, 0 as kind, trust as mass from s where trust > 0 union all select host, 1, distrust from s where distrust > 0),
{_rounds()}
v as (select host, coalesce(sum(mass) filter (kind = 0), 0) as trust, coalesce(sum(mass) filter (kind = 1), 0) as distrust from rank group by host),
j as (select host, round((trust - distrust) / (trust + distrust), {DIGITS}) as score from v)
select p.page_id, p.host, p.path, fit.best.rule as rule,
       coalesce(fit.best.says, case when score < {THRESHOLD} then 'block' when score is not null then 'allow' else '{DEFAULT}' end) as verdict, score
from p left join fit using (row) left join j on j.host = p.host
"""


def _rounds() -> str:
    steps = ["k0 as (select * from seed)"]
    for k in range(ROUNDS):
        steps.append(f"""k{k + 1} as materialized (select host, kind, sum(mass) as mass from (
  select taker as host, a.kind, {DAMPING} * mass * share as mass from k{k} join arc a on a.giver = k{k}.host and a.kind = k{k}.kind
  union all select host, kind, mass * (1 - {DAMPING}) from seed) group by all)""")
    steps.append(f"rank as (select * from k{ROUNDS} where exists (select 1 from arc) union all select * from seed where not exists (select 1 from arc)),")
    return ",\n".join(steps)


ORACLE = _oracle()
