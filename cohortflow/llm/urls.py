"""URL filters (operator 9): empirical-Bayes host reputation under fixed rules.

Labelled pages give outcomes of hosts. A beta-binomial prior is fitted to public suffixes by moments;
each suffix's rate, shrunk towards it, is the prior of its registered domains, theirs that of their
hosts. A host is blocked when the lower posterior bound of its share of bad pages exceeds a limit.
Hosts never seen take what their domain, suffix or all pages say. All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Hosts with more than this part of all pages are joined by broadcast; there are fewer of them than this.
HOT = 200

#: Public suffixes of two labels: fixed values, common ones under which names are registered. Pass others to
#: judge(); all other hosts end in a suffix of one label.
SUFFIXES = (
    "ac.uk co.uk gov.uk org.uk com.au net.au org.au edu.au co.nz co.jp ne.jp or.jp ac.jp co.kr co.in co.za com.br com.cn com.mx com.tr com.ar com.tw "
    "com.hk com.sg com.my co.id co.il co.th com.ua com.pl com.pt com.es github.io gitlab.io blogspot.com wordpress.com herokuapp.com netlify.app vercel.app pages.dev"
).split()


@dataclass(frozen=True)
class Params:
    limit: float = 0.5
    deviations: float = 1.645
    #: Pseudo-observations that a level lends the one below are kept within these.
    least_strength: float = 2.0
    most_strength: float = 200.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path, empty where there is no url or no ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def levels(host: Column, suffixes: list[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host without its user and port: the longest suffix of `suffixes`
    (two labels), else the last label, and one label more. An IPv4 address is its own domain and suffix."""
    name = F.regexp_replace(host, r"^.*@|:\d*$", "")
    two = F.substring_index(name, ".", -2)
    wide, address = two.isin(*suffixes), name.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    domain = F.when(address, name).when(wide, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(address, name).when(wide, two).otherwise(F.substring_index(name, ".", -1))


def strength(groups: DataFrame, rate: Column, p: Params) -> DataFrame:
    """One row: how many pseudo-observations the spread of the groups' rates around `rate` (their
    prior) speaks for - the beta-binomial's method of moments."""
    noise = rate * (1 - rate)
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - rate, 2))
    # E[sum n (r - m)^2] = sum m (1 - m) (1 + (n - 1) rho), rho = 1 / (strength + 1)
    rho = (spread - F.sum(noise)) / F.nullif(F.sum(noise * (F.col("n") - 1)), F.lit(0.0))
    bounded = F.greatest(F.least(1 / F.greatest(rho, F.lit(1e-9)) - 1, F.lit(p.most_strength)), F.lit(p.least_strength))
    return groups.agg(F.coalesce(bounded, F.lit(p.most_strength)).alias("s"))


def reputation(outcomes: DataFrame, params: Params | None = None, suffixes: list[str] = SUFFIXES) -> dict[str, DataFrame]:
    """outcomes: host, bad (0 or 1; null rows are left out). Frames of name, a, b (the beta posterior)
    for the levels all, suffix, domain, host."""
    p = params or Params()
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = outcomes.where(F.col("bad").isNotNull() & (F.col("host") != "")).groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    frames = {"all": total.select(F.lit("").alias("name"), (F.col("bad") + 1).alias("a"), (F.col("n") - F.col("bad") + 1).alias("b"))}
    above = frames["all"].withColumn("m", F.col("a") / (F.col("a") + F.col("b"))).select(F.lit(1).alias("one"), "m")
    key = "one"
    chain = {"suffix": ["suffix"], "domain": ["domain", "suffix"], "host": ["host", "domain"]}
    for level, (name, *up) in chain.items():
        groups = hosts.groupBy(name, *up).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = groups.withColumn("one", F.lit(1)) if key == "one" else groups
        withm = groups.join(above, key)
        s = strength(withm, F.col("m"), p)
        post = withm.withColumn("one", F.lit(1)).join(F.broadcast(s.withColumn("one", F.lit(1))), "one")  # one row
        frames[level] = post.select(F.col(name).alias("name"), (F.col("bad") + F.col("m") * F.col("s")).alias("a"), (F.col("n") - F.col("bad") + (1 - F.col("m")) * F.col("s")).alias("b"))
        above = frames[level].select(F.col("name").alias(name), (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
        key = name
    return frames


def bound(a: Column, b: Column, deviations: float) -> Column:
    """Lower bound of a beta posterior, by its mean and standard deviation."""
    mean = a / (a + b)
    return mean - deviations * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judge(pages: DataFrame, labels: DataFrame, params: Params | None = None, rules: tuple = RULES, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_bound: one row per row of pages.

    A page is labelled through the label of its own number (labels.doc_id = page_id): bad are quality 0
    and toxic 1. Null urls and urls without :// have empty host and path and no rule; what the labels of
    all pages say decides then. Repeated pages and labels count as often as they come. Extra columns, such as
    own ones named host or verdict, are not read.
    """
    p = params or Params()
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0).alias("bad"))
    frames = reputation(rows.select("page_id", "host").join(marks, "page_id"), p, suffixes)
    domain, suffix = levels(F.col("host"), suffixes)
    names = rows.groupBy("host").agg(F.count("*").alias("pages")).select("host", "pages", domain.alias("domain"), suffix.alias("suffix"), F.lit("").alias("all"))
    for level, frame in frames.items():
        low = frame.select(F.col("name").alias(level), bound(F.col("a"), F.col("b"), p.deviations).alias(f"low_{level}"))
        names = names.join(low, level, "left")
    low = stored(names.select("host", "pages", F.coalesce("low_host", "low_domain", "low_suffix", "low_all").alias("bad_bound")))
    # Fewer than HOT hosts can have more than a share of 1 / HOT of the pages: these are broadcast, the others joined.
    most = F.broadcast(low.agg(F.sum("pages").alias("every")))  # one row
    hot = F.broadcast(low.join(most).where(F.col("pages") * HOT > F.col("every")).select("host", "bad_bound"))
    bounded = rows.join(hot, "host").unionByName(rows.join(hot, "host", "left_anti").join(low.select("host", "bad_bound"), "host"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > p.limit, "block").otherwise("allow")
    return bounded.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("bad_bound", 9).alias("bad_bound"))


def level_sql(level: str, name: str, above: str, up: str) -> str:
    """SQL of one level of the chain; its prior is the posterior mean of `above` by column `up`."""
    return f"""g_{level} AS (SELECT {name} AS name, {up} AS up, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
    m_{level} AS (SELECT g.name, g.n, g.bad, p.a / (p.a + p.b) AS m FROM g_{level} g JOIN {above} p ON p.name = g.up),
    r_{level} AS (SELECT (sum(n * power(bad / n - m, 2)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0) AS rho FROM m_{level}),
    s_{level} AS (SELECT coalesce(greatest(least(1 / greatest(rho, 1e-9) - 1, 200.0), 2.0), 200.0) AS s FROM r_{level}),
    {level} AS (SELECT name, bad + m * s AS a, n - bad + (1 - m) * s AS b FROM m_{level}, s_{level})"""


LOW = "a / (a + b) - 1.645 * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1))"

#: DuckDB SQL of judge() with its defaults, for hosts whose suffix is one label.
ORACLE = f"""WITH after AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    rows AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM after),
    named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM rows),
    split AS (SELECT *, array_to_string(string_split(name, '.')[-2:], '.') AS domain, string_split(name, '.')[-1] AS suffix FROM named),
    marks AS (SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END AS bad FROM labels),
    hosts AS (SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM split JOIN marks ON marks.page_id = split.page_id WHERE bad IS NOT NULL AND host <> '' GROUP BY 1, 2, 3),
    l_all AS (SELECT '' AS name, coalesce(sum(bad), 0) + 1 AS a, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 1 AS b FROM hosts),
    {level_sql("l_suffix", "suffix", "l_all", "''")},
    {level_sql("l_domain", "domain", "l_suffix", "suffix")},
    {level_sql("l_host", "host", "l_domain", "domain")},
    bounds AS (SELECT page_id, host, path, coalesce(h.low, d.low, s.low, e.low) AS bad_bound FROM split
      LEFT JOIN (SELECT name, {LOW} AS low FROM l_host) h ON h.name = host LEFT JOIN (SELECT name, {LOW} AS low FROM l_domain) d ON d.name = domain
      LEFT JOIN (SELECT name, {LOW} AS low FROM l_suffix) s ON s.name = suffix CROSS JOIN (SELECT {LOW} AS low FROM l_all) e),
    ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM bounds)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(bad_bound, 9) AS bad_bound FROM ruled"""
