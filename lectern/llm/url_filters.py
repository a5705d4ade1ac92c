"""Verdicts on urls: rules first, then an empirical-Bayes reputation of hosts.

Labelled outcomes are counted by host. From the overall share of bad pages to the suffix, from there
to the registered domain and on to the host, each level's share is shrunk towards the one above it by
a beta prior whose strength comes from how much the counts below one parent differ beyond chance.
A host is blocked when a lower bound of its posterior lies above a multiple of the overall share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import table

#: Suffixes of several labels under which anyone may register a name; elsewhere the last label is the suffix.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: How many deviations below the posterior mean the bound lies, how many times the overall share blocks, and the pseudo-counts between which a prior's strength is kept.
BOUND, WORSE, STRENGTH = 1.645, 1.25, (1.0, 1e6)
#: Hosts of most pages, whose reputation is sent to all tasks: a host not among them has at most one page in HOT + 1.
HOT = 1000


def host(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end, A-Z lower-cased; empty for null and where no :// is."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, its port left out: the suffix and one label more; a bare suffix, an address of numbers and a name of one label are their own domain."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    n = F.when(two.isin(*suffixes), 2).otherwise(1)
    alone = name.rlike(r"^[0-9.]*$") | name.startswith("[") | (F.size(labels) <= n)
    return F.when(alone, name).otherwise(F.array_join(F.slice(labels, -1 - n, n + 1), ".")), F.when(alone, name).otherwise(F.array_join(F.slice(labels, -n, n), "."))


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (host, path, verdict) of rules that fits, as a struct of rule and verdict, or null: hosts fit with all their subdomains, paths as beginnings."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(children: DataFrame, parent: str) -> DataFrame:
    """One row, m: the pseudo-counts of the prior of children (parent, n, bad), from how much their shares differ within parents beyond chance.

    With a share p in a parent, the n-weighted squares of its c children's deviations are
    expected at p (1 - p) (c - 1 + r (N - sum n^2 / N - c + 1)) for an intraclass correlation r; m = 1 / r - 1.
    """
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    by = children.where("n > 0").groupBy(parent).agg(F.count("*").cast("double").alias("c"), F.sum(n).alias("N"), F.sum(n * n).alias("nn"), F.sum(bad).alias("k"), F.sum(bad * bad / n).alias("kk"))
    p = F.col("k") / F.col("N")
    by = by.select((F.col("kk") - F.col("k") * p).alias("s"), (p * (1 - p) * (F.col("c") - 1)).alias("chance"), (p * (1 - p) * (F.col("N") - F.col("nn") / F.col("N") - F.col("c") + 1)).alias("room"))
    r = (F.sum("s") - F.sum("chance")) / F.sum("room")
    low, high = STRENGTH
    m = F.when((F.sum("room") > 0) & (r > 0), F.least(F.greatest(1 / r - 1, F.lit(low)), F.lit(high))).otherwise(high)
    return by.agg(m.alias("m"))


def reputations(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, bound: float = BOUND, worse: float = WORSE) -> DataFrame:
    """host, pages, n, bad, mean, lower and blocked of hosts (host, pages, n, bad): n of a host's pages have outcomes, bad of them are bad."""
    d, s = domain(F.col("host"), suffixes)
    named = hosts.select("host", "pages", "n", "bad", d.alias("domain"), s.alias("suffix"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = named.groupBy("suffix", "domain").agg(*sums)
    ends = domains.groupBy("suffix").agg(*sums)
    whole = ends.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("overall"))
    # One row of four numbers: the overall share and the strength of the prior of each level.
    facts = whole
    for name, children, parent in (("m1", ends.withColumn("one", F.lit(1)), "one"), ("m2", domains, "suffix"), ("m3", named, "domain")):
        facts = facts.crossJoin(F.broadcast(_strength(children, parent).withColumnRenamed("m", name)))
    shrunk = lambda m, prior: (F.col("bad") + F.col(m) * F.col(prior)) / (F.col("n") + F.col(m))
    ends = ends.crossJoin(F.broadcast(facts)).withColumn("share", shrunk("m1", "overall")).drop("n", "bad")
    domains = domains.join(ends, "suffix").withColumn("mean", shrunk("m2", "share")).select("domain", "mean", "m3", "overall")
    a = F.col("bad") + F.col("m3") * F.col("mean")
    of = named.join(domains, "domain").withColumn("size", F.col("n") + F.col("m3")).withColumn("mean", a / F.col("size"))
    lower = F.col("mean") - F.lit(bound) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return of.withColumn("lower", lower).select("host", "pages", "n", "bad", "mean", "lower", (F.col("lower") > worse * F.col("overall")).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], suffixes: tuple[str, ...] = SUFFIXES, bound: float = BOUND, worse: float = WORSE) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url).

    outcomes (page_id, bad): which labelled pages are bad; of several for one id, one bad one makes it bad;
    null ids and null outcomes don't count. rules (host, path, verdict) come before the reputation and bind
    subdomains too; the longest that fits wins. Null urls and urls without :// have empty host and path and
    share the reputation of the empty host. Repeated rows give a row each and count each; empty
    pages give no rows; without outcomes nothing is blocked but by rules. Other columns, whatever their names, are not read.
    """
    url = F.col("url").cast("string")
    mine = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy(F.col("page_id").cast("long").alias("id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counted = mine.join(known, F.col("page_id") == F.col("id"), "left").groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = table(reputations(table(counted, "hosts"), suffixes, bound, worse).select("host", "pages", "blocked"), "hosts")
    # The hosts of most pages go to every task, HOT rows at most; pages of other hosts meet theirs by a shuffle, and no host there holds more than one page in HOT.
    hot = blocked.orderBy(F.col("pages").desc(), "host").limit(HOT).select("host", F.col("blocked").alias("hot"))
    cold = blocked.join(F.broadcast(hot), "host", "left_anti").select(F.col("host").alias("key"), F.col("blocked").alias("cold"))
    both = mine.join(F.broadcast(hot), "host", "left")
    key = F.when(F.col("hot").isNull(), F.col("host")).otherwise(F.concat(F.lit("://"), F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 16)).cast("string")))  # no host holds ://
    both = both.withColumn("key", key).join(cold, "key", "left").withColumn("r", rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.coalesce("hot", "cold"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"))
