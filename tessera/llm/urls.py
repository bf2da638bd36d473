"""URL filters: explicit rules, and host reputation by empirical Bayes.

A page's outcome is good or bad where it is labelled. Reputation shrinks along the levels
all > suffix > registered domain > host: a level's mean is its own counts plus a
beta prior whose mean is the level above and whose strength is estimated from how much the
level's groups differ beyond chance (moments of the beta-binomial). A host's posterior is
a beta distribution, and the host is blocked if the upper bound of its good rate is below
``MIN_GOOD``: only evidence blocks, so hosts without labels are allowed.

Rules are ``(action, "host/path")``; a rule fits its host and all subdomains if the URL's
path starts with the rule's, the longest wins, and rules precede reputation. Rules are part
of the plan, so they are meant to be short lists (``MAX_RULES``).

Everything is DataFrame functions: counts per host combine before their shuffle, levels
above are as small as the hosts, and priors are one row.

Levels come from the host without user name and port; an address (four numbers, or in
brackets) is its own domain and suffix. Suffixes of several labels are a parameter: a few
are built in, callers give the list they trust.

Edge cases: null URLs and URLs without ``://`` have empty host and path, which are a host
like any other; very long URLs are judged whole; ports and user names stay in the host that
is returned; null outcomes and outcomes of unknown pages don't count, repeated ones do;
repeated pages keep their rows; of rules of equal length that fit, the last in code point
order wins; an empty table gives no rows. Extra columns pass through, but for those named
like an output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Hosts whose good rate is below this, by a one-sided bound of so many deviations, are blocked.
MIN_GOOD, DEVIATIONS = 0.5, 1.645
MAX_RULES, MAX_SUFFIXES = 10_000, 20_000
#: Correlation within a group at most: a prior then weighs two labels or more.
MAX_RHO = 0.33
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "com.ar", "co.kr")

#: Hosts that are addresses.
ADDRESS = r"^([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|[\[].*)$"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def named_host(host: Column) -> Column:
    """A host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def levels_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a ``named_host``; the longest of ``suffixes`` that the
    host ends in is its suffix, else its last label."""
    if len(suffixes) > MAX_SUFFIXES:
        raise ValueError(f"{len(suffixes)} suffixes are more than a plan should hold")
    domain, suffix = F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)
    by_labels: dict[int, list[str]] = {}
    for x in suffixes:
        by_labels.setdefault(x.count(".") + 1, []).append(x)
    for n in sorted(by_labels):
        last = F.substring_index(host, ".", -n)
        known = last.isin(*by_labels[n])
        domain, suffix = F.when(known, F.substring_index(host, ".", -n - 1)).otherwise(domain), F.when(known, last).otherwise(suffix)
    address = host.rlike(ADDRESS)
    return F.when(address, host).otherwise(domain), F.when(address, host).otherwise(suffix)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; nulls if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are more than a plan should hold")
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of_host, _, of_path = text.partition("/")
        of_path = "/" + of_path if "/" in text else ""
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def _strength(groups: DataFrame, parents: Sequence[str]) -> DataFrame:
    """One row: the prior strength that fits how groups (n, good) differ beyond chance.
    Kleinman's moments: rho is the correlation within a group, strength (1 - rho) / rho."""
    n, good = F.col("n").cast("double"), F.col("good").cast("double")
    parent = groups.groupBy(*parents).agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(good).alias("good"), F.sum(n * n).alias("nn"), F.sum(F.round(good * good / n, 9)).alias("gg"))
    p = F.col("good") / F.col("n")
    spread = F.sum(F.round(F.col("gg") - F.col("good") * p, 9))
    chance = F.sum(F.round(p * (1 - p) * (F.col("k") - 1), 9))
    scale = F.sum(F.round(p * (1 - p) * (F.col("n") - F.col("nn") / F.col("n") - F.col("k") + 1), 9))
    one = parent.agg(spread.alias("s"), chance.alias("c"), scale.alias("d"))
    rho = F.when(F.col("d") > 0, F.greatest(F.lit(0.001), F.least(F.lit(MAX_RHO), (F.col("s") - F.col("c")) / F.col("d")))).otherwise(F.lit(0.1))
    return one.select(F.round(F.coalesce((1 - rho) / rho, F.lit(9.0)), 6).alias("strength"))


def reputation(hosts: DataFrame, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, good, mean, upper) of (host, n, good): counts of labelled outcomes."""
    domain, suffix = levels_of(F.col("named"), suffixes)
    levels = hosts.withColumn("named", named_host(F.col("host"))).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good")
    domains = levels.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.round((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2), 9).alias("mean"))
    priors = total
    for name, groups, parents in (("suffix", suffixes, []), ("domain", domains, ["suffix"]), ("host", levels, ["domain", "suffix"])):
        priors = priors.crossJoin(_strength(groups.where("n > 0"), parents).withColumnRenamed("strength", f"k_{name}"))  # one row each

    def shrunk(above: str, k: str) -> Column:
        return F.round((F.col("good") + F.col(k) * F.col(above)) / (F.col("n") + F.col(k)), 9)

    s = suffixes.crossJoin(F.broadcast(priors)).select("suffix", "k_domain", "k_host", shrunk("mean", "k_suffix").alias("m_suffix"))
    d = domains.join(s, "suffix").select("domain", "suffix", "k_host", shrunk("m_suffix", "k_domain").alias("m_domain"))
    h = levels.join(d, ["domain", "suffix"])
    a, b = F.col("good") + F.col("k_host") * F.col("m_domain"), F.col("n") - F.col("good") + F.col("k_host") * (1 - F.col("m_domain"))
    mean = a / (a + b)
    upper = mean + F.lit(DEVIATIONS) * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return h.select("host", "n", "good", F.round(mean, 6).alias("mean"), F.round(F.least(F.lit(1.0), upper), 6).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url", min_good: float = MIN_GOOD, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``pages`` with host, path, rule, reputation (upper bound of the good rate) and verdict.
    ``outcomes`` are (page id, good 0/1)."""
    out = ("host", "path", "rule", "action", "reputation", "verdict")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("id"), host.alias("host"))
    known = outcomes.toDF("id", "good").where("id is not null and good is not null")
    labelled = seen.join(known, "id").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    hosts = seen.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("good"))
    counts = written(hosts.unionByName(labelled).groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "url-hosts")  # every level above is read from it
    known_hosts = reputation(counts, suffixes).select("host", F.col("upper").alias("reputation"))
    rows = pages.drop(*[c for c in pages.columns if c.lower() in out and c not in (id_col, url_col)])
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("action", action)
    judged = rows.join(known_hosts, "host")
    verdict = F.coalesce(F.col("action"), F.when(F.col("reputation") < min_good, "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop("action")


def oracle(rules: Sequence[tuple[str, str]], pages: str, outcomes: str, min_good: float = MIN_GOOD) -> str:
    """DuckDB SQL for page_id, host, path, rule, reputation and verdict of ``judge``;
    ``outcomes`` gives (id, good)."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    cases = {"rule": [], "action": []}
    for what, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        of_host, slash, of_path = rule.partition("/")
        fits = f"((host = {text(of_host)} or ends_with(host, {text('.' + of_host)})) and starts_with(path, {text(slash + of_path)}))"
        cases["rule"].append(f"when {fits} then {text(rule)}")
        cases["action"].append(f"when {fits} then {text(what)}")
    twos = ", ".join(map(text, TWO_LABEL_SUFFIXES))
    last = lambda k: f"array_to_string(list_slice(string_split(named, '.'), -{k}, -1), '.')"

    def strength(groups: str, parents: str) -> str:
        by = f"group by {parents}" if parents else ""
        return f"""(select round(coalesce((1 - rho) / rho, 9.0), 6) from (select case when d > 0 then greatest(0.001, least({MAX_RHO}, (s - c) / d)) else 0.1 end as rho from (
          select sum(round(gg - good * good / n, 9)) s, sum(round(good / n * (1 - good / n) * (k - 1), 9)) c, sum(round(good / n * (1 - good / n) * (n - nn / n - k + 1), 9)) d
          from (select count(*) k, sum(n::double) n, sum(good::double) good, sum(n::double * n) nn, sum(round(good::double * good / n, 9)) gg from {groups} where n > 0 {by}))))"""

    return f"""
with urls as (select *, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from {pages}),
parts as (select *, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from urls),
labelled as (select host, count(*) n, sum(good) good from parts join ({outcomes}) o on o.id = parts.page_id group by host),
levels as (select h.host, coalesce(n, 0)::bigint n, coalesce(good, 0)::bigint good,
  case when regexp_matches(named, {text(ADDRESS)}) then named when {last(2)} in ({twos}) then {last(3)} else {last(2)} end as domain,
  case when regexp_matches(named, {text(ADDRESS)}) then named when {last(2)} in ({twos}) then {last(2)} else {last(1)} end as suffix
  from (select host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as named from (select distinct host from parts)) h left join labelled l on l.host = h.host),
domains as (select domain, suffix, sum(n) n, sum(good) good from levels group by all),
suffixes as (select suffix, sum(n) n, sum(good) good from domains group by all),
total as (select round((coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2)::double, 9) as mean from suffixes),
priors as (select {strength('suffixes', '')} k_suffix, {strength('domains', 'suffix')} k_domain, {strength('levels', 'domain, suffix')} k_host),
s as (select suffix, round((good + k_suffix * mean) / (n + k_suffix), 9) m_suffix from suffixes, total, priors),
d as (select domain, domains.suffix, round((good + k_domain * m_suffix) / (n + k_domain), 9) m_domain from domains join s on s.suffix = domains.suffix, priors),
ab as (select host, good + k_host * m_domain a, n - good + k_host * (1 - m_domain) b from levels join d on d.domain = levels.domain and d.suffix = levels.suffix, priors),
reputation as (select host, round(least(1.0, a / (a + b) + {DEVIATIONS} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))), 6) as reputation from ab)
select page_id, parts.host, path, {'case ' + ' '.join(cases['rule']) + ' end' if rules else 'null'} as rule, reputation,
  coalesce({'case ' + ' '.join(cases['action']) + ' end' if rules else 'null'}, case when reputation < {min_good} then 'block' else 'allow' end) as verdict
from (select * from parts) parts join reputation on reputation.host = parts.host
""".replace("when ((host", "when ((parts.host").replace("ends_with(host", "ends_with(parts.host")
