"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's good rate is shrunk towards the
level above by a beta-binomial prior whose strength is fitted, over all groups of the level, by the method of moments; the
root is the overall rate. A page passes if the lower posterior bound of its host, mean - z * standard deviation, reaches
the floor. Everything is DataFrame aggregates and joins on keys; a hot host is one row after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_unique

#: (host, path, verdict); a host's rule fits its subdomains, the longest fitting rule wins.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Suffixes of two labels under which anyone may register a name (the common ones; pass a longer list of rules if
#: needed: see suffix_labels).
SUFFIXES = [
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl",
    "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.ve", "com.vn", "edu.au", "edu.br", "edu.cn", "edu.mx", "edu.tr", "edu.tw", "go.jp",
    "go.kr", "gob.mx", "gouv.fr", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.tr", "gov.uk", "govt.nz", "ne.jp", "net.au", "net.br", "net.cn",
    "net.nz", "net.uk", "nhs.uk", "or.at", "or.jp", "or.kr", "org.ar", "org.au", "org.br", "org.cn", "org.hk", "org.il", "org.in", "org.mx",
    "org.nz", "org.tr", "org.tw", "org.uk", "org.za", "sch.uk",
]
#: Prior weight at the root, bounds of a fitted prior weight, z of the bound, least good rate.
ROOT_WEIGHT, LEAST_WEIGHT, MOST_WEIGHT, Z, FLOOR = 2.0, 0.5, 1000.0, 1.0, 0.4


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    after = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def suffix_labels(name: Column, suffixes: list[str]) -> Column:
    """How many labels of a host name, without a port, make its public suffix: by the longest rule that fits, 1 without any.

    Rules are suffixes of any depth (co.uk); `*.` before one stands for any label there, `!` makes an exception from that: its
    suffix is a label shorter. An exception holds before all other rules.
    """
    plain = [r for r in suffixes if r[0] not in "*!"]
    wild = [r.removeprefix("*.") for r in suffixes if r.startswith("*.")]
    exempt = [r[1:] for r in suffixes if r.startswith("!")]
    depth = lambda rules: max((r.count(".") + 1 for r in rules), default=0)
    tail = lambda k: F.substring_index(name, ".", -k)
    size = F.size(F.split(name, r"\."))
    out = F.lit(1)
    for k in range(1, max(depth(plain), depth(wild) + 1) + 1):
        fits = tail(k).isin(*[r for r in plain if r.count(".") + 1 == k]) if plain else F.lit(False)
        if k > 1 and wild:
            fits = fits | tail(k - 1).isin(*[r for r in wild if r.count(".") + 2 == k])
        out = F.when((size >= k) & fits, k).otherwise(out)
    for k in range(2, depth(exempt) + 1):
        out = F.when((size >= k) & tail(k).isin(*[r for r in exempt if r.count(".") + 1 == k]), k - 1).otherwise(out)
    return out


def suffix_of(host: Column, suffixes: list[str]) -> Column:
    """The public suffix of a host name, without its port; `ip` for numeric addresses."""
    name = F.regexp_replace(host, r":\d*$", "")
    return F.when(_numeric(name), "ip").otherwise(_last_labels(name, suffix_labels(name, suffixes)))


def domain_of(host: Column, suffixes: list[str]) -> Column:
    """The registered domain of a host name, without its port: its suffix and one label more; a numeric address is its own."""
    name = F.regexp_replace(host, r":\d*$", "")
    return F.when(_numeric(name), name).otherwise(_last_labels(name, suffix_labels(name, suffixes) + 1))


def _last_labels(name: Column, k: Column) -> Column:
    return F.call_function("substring_index", name, F.lit("."), -k)


def _numeric(name: Column) -> Column:
    return name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\[[0-9a-f:.]*\]$")


def _shrunk(counts: DataFrame, level: str, above: str, prior: DataFrame) -> DataFrame:
    """(level, a, b): the posterior of each group of a level under the prior means of the level above.

    The prior weight w is fitted from all groups: with p the pooled prior mean of a group, Q = sum((good - n p)^2),
    A = sum(n p (1 - p)), B = sum(n (n - 1) p (1 - p)), the intra-group correlation is r = (Q - A) / B and w = 1 / r - 1,
    kept in [LEAST_WEIGHT, MOST_WEIGHT]; where r is not positive or nothing can be told the groups are taken as alike.
    A group's rows are sums already; above one with many of them (a suffix such as com) is broadcast to them.
    """
    groups = materialize(counts.groupBy(level, above).agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "groups")
    size = groups.groupBy(above).agg(F.count("*").alias("rows"))
    means = prior.select(above, (F.col("a") / (F.col("a") + F.col("b"))).alias("p")).join(size, above)
    groups = with_unique(groups, materialize(means, "priors"), above, groups.count())
    spread = F.col("p") * (1 - F.col("p"))
    fit = groups.where("n > 0").agg(
        F.sum((F.col("good") - F.col("n") * F.col("p")) ** 2).alias("q"),
        F.sum(F.col("n") * spread).alias("x"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("y"),
    )
    r = F.when(F.col("y") > 0, (F.col("q") - F.col("x")) / F.col("y"))
    w = F.when(r > 0, F.least(F.greatest(1 / r - 1, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))).otherwise(MOST_WEIGHT)
    fitted = groups.crossJoin(F.broadcast(fit.select(w.alias("w"))))  # one row
    fitted = fitted.select(
        level,
        (F.col("w") * F.col("p") + F.col("good")).alias("a"),
        (F.col("w") * (1 - F.col("p")) + F.col("n") - F.col("good")).alias("b"),
    )
    return materialize(fitted, "level")


def host_reputation(outcomes: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(host, a, b, rows): beta posteriors of the good rate per host, and how many rows of outcomes it has.

    outcomes: host, good (1, 0, or null where a page has no label). Every host is returned, those without labels with
    their domain's posterior mean as prior. Null hosts are left out; an empty table gives an empty result. suffixes: rules
    of suffix_labels; a host's registered domain is the label before its suffix with it.
    """
    counts = outcomes.where("host is not null").groupBy("host").agg(
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("n"), F.count("*").alias("rows")
    )
    named = counts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    counts = materialize(named.withColumn("all", F.lit(1)), "hosts")
    half = ROOT_WEIGHT / 2
    level = counts.groupBy("all").agg((F.sum("good") + half).alias("a"), (F.sum("n") - F.sum("good") + half).alias("b"))
    for name, above in (("suffix", "all"), ("domain", "suffix"), ("host", "domain")):
        level = _shrunk(counts, name, above, level)
    return level.join(counts.select("host", "rows"), "host")


def judged(
    pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, label: str | None = None,
    z: float = Z, floor: float = FLOOR, suffixes: list[str] = SUFFIXES,
) -> DataFrame:
    """pages with _host, _path, _rule, _verdict, _bound (columns of those names are replaced, the others unchanged).

    A page's outcome is its label column (1 good, 0 bad, null unknown) if one is named, else what its rule says (allow 1,
    block 0). The verdict is the rule's, else allow where the host's posterior bound mean - z * sd reaches floor, else
    block. Null urls and urls without :// have an empty host and path, which share one reputation.
    """
    own = [c for c in pages.columns if c not in ("_host", "_path", "_rule", "_verdict", "_bound")]
    page = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page")  # no column of it can clash from here on
    u = F.coalesce(F.col(f"page.`{url}`"), F.lit(""))
    named = pages.select(page).select("page", host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    named = named.select("page", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    good = F.col(f"page.`{label}`") if label else F.when(F.col("by_rule") == "allow", 1).when(F.col("by_rule") == "block", 0)
    seen = host_reputation(named.select("host", good.cast("long").alias("good")), suffixes)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    bounds = materialize(seen.select("host", (mean - z * sd).alias("bound"), "rows"), "bounds")
    size = bounds.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    out = with_unique(named, bounds, "host", size, "left")
    by_host = F.when(F.col("bound") >= floor, "allow").otherwise("block")
    return out.select(
        *[F.col(f"page.`{c}`").alias(c) for c in own], F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("rule").alias("_rule"),
        F.coalesce("by_rule", by_host).alias("_verdict"), F.col("bound").alias("_bound"),
    )
