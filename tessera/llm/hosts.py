"""URL filters: rules, and empirical-Bayes reputation of hosts.

Labelled page outcomes (good or not) are counted by host. Beliefs are shrunk from the top: a suffix's mean towards the
overall mean, a registered domain's towards its suffix's, a host's towards its registered domain's. Each step is a
beta-binomial posterior whose prior weight is estimated by moments from the scatter between groups of that level. A
page is blocked if the upper bound of its host's posterior (mean plus `z` standard deviations) is below `floor`.

A host's suffix is its last label; its registered domain adds the label before. A host of one label is all three.

Defined results: a null url, or one without "://", has an empty host and path, which is a host like any other; outcomes
that are null count nowhere; a host, domain or suffix that no label names takes its parent's belief; with no labels at
all, the belief is `start`; repeated pages are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read, text_of, written

#: (rule, verdict); a rule is a host, which fits its subdomains too, and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
FLOOR = 0.8
Z = 1.64
START = 1.0
#: Bounds of a prior's weight, in labelled pages.
WEIGHTS = (1.0, 1000.0)


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path): what lies between the first :// and the next / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    rest = F.regexp_extract(text_of(url), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. rules: a short list, tried longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, said in sorted(rules, key=lambda r: len(r[0])):
        at, _, start = name.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _parts(host: str) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host column."""
    return F.substring_index(F.col(host), ".", -2), F.substring_index(F.col(host), ".", -1)


def _weight(groups: DataFrame, parent_mean: str) -> float:
    """The prior's weight by moments: how far the groups' shares scatter about their parents' beyond binomial noise."""
    got = groups.where("n > 1").agg(
        F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(parent_mean), 2)).alias("s"),
        F.sum(F.col(parent_mean) * (1 - F.col(parent_mean))).alias("v"), F.sum((F.col("n") - 1) * F.col(parent_mean) * (1 - F.col(parent_mean))).alias("w"),
    ).first()
    if not got["k"] or not got["w"]:
        return WEIGHTS[1]
    rho = (got["s"] - got["v"]) / got["w"]
    return WEIGHTS[1] if rho <= 0 else min(WEIGHTS[1], max(WEIGHTS[0], (1 - rho) / rho))


def reputation(outcomes: DataFrame, start: float = START) -> DataFrame:
    """outcomes (host, good 0/1) -> host, domain, suffix, n, good, mean, sd: one row for each labelled host.

    Only four numbers reach the driver: the overall mean and the prior weights of the three levels.
    """
    domain, suffix = _parts("host")
    hosts = outcomes.where("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good")).withColumn("domain", domain).withColumn("suffix", suffix)
    hosts = written(hosts, "host-counts")
    total = hosts.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    overall = total["g"] / total["n"] if total["n"] else start
    levels = {}
    for key, keys in (("suffix", ["suffix"]), ("domain", ["domain", "suffix"])):
        levels[key] = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    top = levels["suffix"].withColumn("_up", F.lit(overall))
    w = _weight(top, "_up")
    top = top.select("suffix", ((F.col("good") + w * F.col("_up")) / (F.col("n") + w)).alias("suffix_mean"))
    mid = levels["domain"].join(top, "suffix")
    w = _weight(mid, "suffix_mean")
    mid = mid.select("domain", "suffix_mean", ((F.col("good") + w * F.col("suffix_mean")) / (F.col("n") + w)).alias("domain_mean"))
    low = hosts.join(mid, "domain")
    w = _weight(low, "domain_mean")
    mean = (F.col("good") + w * F.col("domain_mean")) / (F.col("n") + w)
    low = low.withColumn("mean", mean).withColumn("sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + w + 1)))
    return low.select("host", "domain", "suffix", "n", "good", "suffix_mean", "domain_mean", "mean", "sd", F.lit(w).alias("weight"), F.lit(overall).alias("overall"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = FLOOR, z: float = Z) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, mean, bound.

    Beliefs are joined to the distinct hosts, one row each; pages then meet their host's row, a join whose large
    partitions Spark's adaptive execution splits.
    """
    host, path = split_url("url")
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reputation(outcomes)
    domain, suffix = _parts("host")
    hosts = seen.select("host").distinct().withColumn("domain", domain).withColumn("suffix", suffix)
    domains = known.groupBy("domain").agg(F.first("domain_mean").alias("domain_mean"))
    suffixes = known.groupBy("suffix").agg(F.first("suffix_mean").alias("suffix_mean"))
    over = known.agg(F.first("overall"), F.first("weight")).first()
    overall, weight = (START, WEIGHTS[1]) if over[0] is None else over
    held = hosts.join(known.select("host", "mean", "sd"), "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    prior = F.coalesce("domain_mean", "suffix_mean", F.lit(overall))
    held = held.select("host", F.coalesce("mean", prior).alias("mean"), F.coalesce("sd", F.sqrt(prior * (1 - prior) / (weight + 1))).alias("sd"))
    met = seen.join(held, "host", "left")
    bound = F.col("mean") + z * F.col("sd")
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    return met.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(bound < floor, "block").otherwise("allow")).alias("verdict"), "mean", bound.alias("bound"))


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good): pages whose path ends in a labelled document's number have that document's quality as their outcome."""
    host, path = split_url("url")
    seen = pages.select(host.alias("host"), F.try_to_number(F.regexp_extract(path, r"/(\d{1,18})(?:\.html)?/?$", 1), F.lit("999999999999999999")).cast("long").alias("_doc"))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    return seen.where("_doc is not null").join(marked, F.col("_doc") == F.col("doc_id")).select("host", "good")


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, outcomes_of(pages, read(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
with page as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages)),
seen as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from page),
cut as (select *, regexp_extract(host, '[^.]*$') as suffix, regexp_extract(host, '([^.]*\.)?[^.]*$') as domain from seen),
marked as (select doc_id, min(quality) as good from labels where doc_id is not null group by 1),
hosts as (
  select host, domain, suffix, count(*) as n, sum(good) as good
  from cut join marked on try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(\.html)?/?$', 1), '') as bigint) = doc_id
  where good is not null group by 1, 2, 3),
overall as (select coalesce(sum(good) / nullif(sum(n), 0), 1.0) as o from hosts),
s0 as (select suffix, sum(n) as n, sum(good) as good, any_value(o) as up from hosts, overall group by 1),
sw as (select WEIGHT as w from s0 where n > 1),
s1 as (select suffix, (good + w * up) / (n + w) as suffix_mean from s0, sw),
d0 as (select domain, any_value(suffix_mean) as up, sum(n) as n, sum(good) as good from hosts join s1 using (suffix) group by 1),
dw as (select WEIGHT as w from d0 where n > 1),
d1 as (select domain, (good + w * up) / (n + w) as domain_mean from d0, dw),
h0 as (select host, domain, n, good, domain_mean as up from hosts join d1 using (domain)),
hw as (select WEIGHT as w from h0 where n > 1),
h1 as (select host, (good + w * up) / (n + w) as mean, n + w + 1 as size from h0, hw),
belief as (
  select page_id, c.host, path, coalesce(mean, domain_mean, suffix_mean, o) as m, coalesce(size, case when (select count(*) from hosts) > 0 then w else 1000.0 end + 1) as k
  from cut c cross join overall cross join hw left join h1 on c.host = h1.host left join d1 on c.domain = d1.domain left join s1 on c.suffix = s1.suffix),
fit as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from belief)
select page_id, host, path, rule, case
    when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when m + 1.64 * sqrt(m * (1 - m) / k) < 0.8 then 'block' else 'allow' end as verdict
from fit
""".replace("WEIGHT", """case when count(*) = 0 or sum((n - 1) * up * (1 - up)) = 0 then 1000.0 else (select case when rho <= 0 then 1000.0 else least(1000.0, greatest(1.0, (1 - rho) / rho)) end
  from (select (sum(n * pow(good / n - up, 2)) - sum(up * (1 - up))) / sum((n - 1) * up * (1 - up)) as rho)) end""").replace("\\\\", "\\")
