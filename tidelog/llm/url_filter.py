r"""URL filter: rules first, and an empirical-Bayes host reputation for what they leave open.

Pages with a known outcome (good or bad) are counted by host, registered domain and
suffix. From the top down each level's rate is shrunk towards the level above: the prior of
a suffix is the mean over all pages, that of a domain its suffix's posterior mean, that of
a host its domain's; the variance above counts by its weight. Each level's prior strength is fitted to the spread of rates at that
level by the beta-binomial moment estimator. A page is blocked where even the upper
posterior bound of its host's rate, the mean and ``Z`` standard deviations, is under
``LEAST_GOOD``; so hosts with little evidence pass.

In the query the outcomes are the rules' own: a page that a rule allows is a good one of
its host, a page that a rule blocks is a bad one.

Counting is a partial sum a task, so a hot host is a row a task. The hosts' table is
written out and joined with hosts on both sides of a plain shuffle, which lets Spark split
a hot host's pages. Only DataFrame functions are used; a row of 6 numbers goes to the driver.

Defined results: a null url or one without ``://`` has empty host and path, which no rule
fits, and the overall reputation. Hosts without a dot, or only of digits and dots, are
their own domain and suffix. Repeated rows give equal rows. Without outcomes everything
that no rule blocks passes. Other columns, whatever their names, are kept by
``judge``, which replaces its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import boxed, staged, table, unboxed

#: (host, path, verdict): fixed by the query's contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Suffixes of two labels under which names are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "com.mx", "co.in", "com.cn", "co.za")
Z, LEAST_GOOD = 1.645, 0.5
#: Prior strength, in pages, where the spread of rates can't be told, and its limits.
STRENGTH, WEAKEST, STRONGEST = 2.0, 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def domain_of(host: Column) -> Column:
    labels = F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), 3).otherwise(2)
    return F.when(host.rlike(r"^[0-9.]*$"), host).when(labels == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^[0-9.]*$"), host).when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def strength(level: DataFrame, mean: float) -> float:
    """Pages that the prior counts as, from the spread of the rates good / n in ``level``."""
    seen = level.where("n > 0")
    total = seen.agg(F.sum("n").alias("n")).first().n
    if not total or not 0 < mean < 1:
        return STRENGTH
    share = F.col("n") / float(total)
    spread, noise, room = seen.agg(F.sum(share * F.pow(F.col("good") / F.col("n") - mean, 2)), F.sum(share * (1 - share) / F.col("n")), F.sum(share * (1 - share))).first()
    if room - noise <= 1e-12:
        return STRENGTH
    within = (spread - mean * (1 - mean) * noise) / (mean * (1 - mean) * (room - noise))
    return min(STRONGEST, max(WEAKEST, 1 / within - 1)) if within > 0 else STRONGEST


def shrunk(level: DataFrame, above: tuple[Column, Column], pages: float) -> DataFrame:
    """Adds the posterior ``rate`` and its variance ``var``, given those of the level above.

    The level above is uncertain too; its variance counts by its weight in the rate.
    """
    rate, var = above
    weight = F.lit(pages) / (F.lit(pages) + F.col("n"))
    own = weight * rate + F.col("good") / (F.lit(pages) + F.col("n"))
    return level.withColumn("rate", own).withColumn("var", F.col("rate") * (1 - F.col("rate")) / (F.lit(pages) + F.col("n") + 1) + weight * weight * var)


def reputation(pages: DataFrame) -> DataFrame:
    """pages: host, and good as 1, 0 or null. A row per host: host, rate and its upper bound."""
    hosts = staged(pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    count = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*count)
    suffixes = domains.groupBy("suffix").agg(*count)
    n, good = hosts.agg(*count).first()
    mean = ((good or 0) + 1) / ((n or 0) + 2)
    over = (F.col("above.rate"), F.col("above.var"))
    as_above = F.struct("rate", "var").alias("above")
    by_suffix = shrunk(suffixes, (F.lit(mean), F.lit(0.0)), strength(suffixes, mean)).select("suffix", as_above)
    by_domain = shrunk(domains.join(by_suffix, "suffix"), over, strength(domains, mean)).select("domain", "suffix", as_above)
    by_host = shrunk(hosts.join(by_domain, ["domain", "suffix"]), over, strength(hosts, mean))
    return by_host.select("host", "rate", (F.col("rate") + Z * F.sqrt("var")).alias("bound"))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict in place of columns so named."""
    url = F.col(url_col).cast("string")
    rows = boxed(pages, host=host_of(url), path=path_of(url))
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    outcome = F.when(F.col("ruled.verdict") == "allow", 1).when(F.col("ruled.verdict") == "block", 0)
    known = staged(reputation(rows.select("host", outcome.alias("good")))).select("host", "bound")
    own = F.when(F.col("bound") < LEAST_GOOD, "block").otherwise("allow")
    judged = rows.join(known, "host", "left")
    return unboxed(judged, "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"), without=("host", "path", "rule", "verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _level(name: str, column: str) -> str:
    """SQL of a level's prior strength."""
    return f"""
{name}_w as (select n, good, n / (sum(n) over ())::double as w, (select m from mean) as m from {column} where n > 0),
{name}_x as (select sum(w * (good / n::double - m) * (good / n::double - m)) as spread, sum(w * (1 - w) / n) as noise, sum(w * (1 - w)) as room, any_value(m) as m from {name}_w),
{name}_r as (select case when room is null or room - noise <= 1e-12 then null else (spread - m * (1 - m) * noise) / (m * (1 - m) * (room - noise)) end as r from {name}_x),
{name}_s as (select case when r is null then {STRENGTH} when r > 0 then least({STRONGEST}, greatest({WEAKEST}, 1 / r - 1)) else {STRONGEST} end as s from {name}_r)"""


_LONG = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
_WHEN = " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then struct_pack(rule := '{h}{p}', verdict := '{v}')" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
SQL = rf"""
with cut as (select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) as h, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
low as (select page_id, translate(h, '{UPPER}', '{LOWER}') as host, path from cut),
ruled as (select *, case {_WHEN} else null end as r from low),
counted as (select host, count(r.verdict) as n, count(*) filter (where r.verdict = 'allow') as good from ruled group by host),
split as (select *, string_split(host, '.') as l, regexp_matches(host, '^[0-9.]*$') as bare from counted),
two as (select *, array_to_string(l[greatest(1, len(l) - 1):], '.') as last_two, array_to_string(l[greatest(1, len(l) - 2):], '.') as last_three from split),
hosts as (select host, n, good, case when bare then host when last_two in ({_LONG}) then last_three else last_two end as domain, case when bare then host when last_two in ({_LONG}) then last_two else l[len(l)] end as suffix from two),
domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(good) as good from domains group by suffix),
mean as (select (sum(good) + 1) / (sum(n) + 2)::double as m from hosts),
{_level("su", "suffixes")}, {_level("do", "domains")}, {_level("ho", "hosts")},
a as (select suffix, s * m / (s + n) + good / (s + n) as r, r * (1 - r) / (s + n + 1) as var from suffixes, su_s, mean),
b as (select domain, suffix, s * a.r / (s + n) + good / (s + n) as rate, rate * (1 - rate) / (s + n + 1) + power(s / (s + n), 2) * a.var as v from domains join a using (suffix), do_s),
c as (select host, s * b.rate / (s + n) + good / (s + n) as rate_h, rate_h * (1 - rate_h) / (s + n + 1) + power(s / (s + n), 2) * b.v as v_h from hosts join b using (domain, suffix), ho_s),
d as (select host, rate_h + {Z} * sqrt(v_h) as bound from c)
select page_id, ruled.host as host, path, r.rule as rule, coalesce(r.verdict, case when bound < {LEAST_GOOD} then 'block' else 'allow' end) as verdict
from ruled left join d on ruled.host = d.host
"""
