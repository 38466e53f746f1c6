"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled pages (good or bad) are counted by host, registered domain and
suffix. Each level's rate of bad pages is drawn from a beta prior around the
rate of the level above it, and the strength of that prior (in pages) is
estimated from how far the rates of one parent's children spread beyond what
binomial chance explains; a prior never counts for more pages than the level
above has seen. So a host with many labelled pages speaks for itself, and one
with few or none takes the rate of its domain, its suffix, or all pages. A
host is blocked where the lower bound of its posterior lies above the rate that
is tolerated.

Counting is partial aggregation over the url column alone. The driver sees
three prior strengths and the total; everything else stays in joins on host,
domain and suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import table

# The rules of the registered query (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
# Labels that form a suffix together with a two-letter country.
SECOND_LEVEL = ["ac", "co", "com", "edu", "go", "gov", "gob", "ltd", "mil", "ne", "net", "nom", "or", "org", "sch"]
#: The rate of bad pages that is tolerated, and the standard deviations that a
#: host's posterior mean must lie above it (5 % one-sided).
TOLERATED, DEVIATIONS = 0.5, 1.645
#: Least and greatest strength of a prior, in pages.
STRENGTH = (1.0, 1000.0)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"^[0-9.]+$"


def split_url(url: str) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased, with a port or user if there is one)
    and path of a url; both empty where it is null or has no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.substr(after, F.length(host) + 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, "^[^?#]*", 0)


def match_rule(rules: list[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule (host and path together;
    of equally long ones the longer host, then ``block``) that fits ``host``
    and ``path``: the host or a subdomain of it, and the path's beginning.
    Null where none fits. Rules are configuration, a list of some hundreds."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), reverse=True)
    tests = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path),
            F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for host, path, verdict in ordered
    ]
    return F.coalesce(*tests, none)


def registered_names(host: str) -> tuple[Column, Column]:
    """Registered domain and suffix of a host: the suffix is the last label, or
    the last two where a country's label follows one of ``SECOND_LEVEL``; the
    domain has one label more. An address stands for itself."""
    bare = F.regexp_replace(F.regexp_replace(F.col(host), "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    country = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(SECOND_LEVEL)
    own = F.when(bare.rlike(_ADDRESS), n).when(country, 2).otherwise(1)
    start = F.greatest(F.lit(1), n - own)
    domain = F.array_join(F.slice(labels, start, n - start + 1), ".")
    return domain, F.array_join(F.slice(labels, n - own + 1, own), ".")


def _counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def _strength(rows: DataFrame, limits: tuple[float, float]) -> float:
    """Moment estimate of the pages that a parent's rate counts for, from
    labelled children ``rows(n, k, m)`` with their parent's rate: the excess of
    their squared deviations over binomial variance."""
    m = F.col("m")
    chance = m * (1 - m)
    excess = (F.col("k") - F.col("n") * m) ** 2 - F.col("n") * chance
    sums = rows.agg(F.sum(excess).alias("excess"), F.sum(F.col("n") * (F.col("n") - 1) * chance).alias("scale")).first()
    if not sums["scale"] or sums["excess"] <= 0:
        return limits[1]
    share = sums["excess"] / sums["scale"]  # correlation of two pages of one child
    return min(limits[1], max(limits[0], 1 / share - 1))


def _with_parents(children: DataFrame, parent: str) -> DataFrame:
    """Labelled children with the rate ``m`` of their parent, of parents with
    several of them and both outcomes."""
    labelled = children.where("n > 0")
    parents = labelled.groupBy(parent).agg(
        F.sum("n").alias("pn"), F.sum("k").alias("pk"), F.count(F.lit(1)).alias("children")
    ).where("children > 1 AND pk > 0 AND pk < pn")
    return labelled.join(parents.select(parent, (F.col("pk") / F.col("pn")).alias("m")), parent)


def host_reputation(
    outcomes: DataFrame, tolerated: float = TOLERATED, deviations: float = DEVIATIONS, limits: tuple[float, float] = STRENGTH
) -> DataFrame:
    """``host, n, k, rate, bound, bad`` for every host of ``outcomes(host,
    bad)``: labelled pages and bad ones among them, posterior mean and lower
    bound of the rate of bad pages, and whether the bound is above
    ``tolerated``. ``bad`` is null for pages without a label; hosts without
    labelled pages have the rate of the level above. No labels at all give the
    uniform prior's rate (one half), whose bound blocks nothing."""
    domain, suffix = registered_names("host")
    by_host = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
    hosts = cut_lineage(by_host.withColumn("domain", domain).withColumn("suffix", suffix))
    domains = _counts(hosts, "domain", "suffix")
    suffixes = _counts(domains, "suffix")
    total = suffixes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.count_if(F.col("n") > 0).alias("labelled")
    ).first()
    top = suffixes.where("n > 0").withColumn("m", F.lit(total["k"] / total["n"] if total["n"] else 0.0))
    strengths = [_strength(_with_parents(hosts, "domain"), limits), _strength(_with_parents(domains, "suffix"), limits)]
    strengths.append(_strength(top, limits) if total["labelled"] > 1 else limits[1])

    above = F.col("above")  # rate and weight (in pages) of the level above

    def shrunk(rows: DataFrame, strength: float) -> DataFrame:
        prior = F.least(F.lit(strength), above["weight"])
        return rows.withColumn("rate", (F.col("k") + prior * above["rate"]) / (F.col("n") + prior)).withColumn("weight", F.col("n") + prior)

    level = F.struct("rate", "weight").alias("above")
    root = F.struct(F.lit((total["k"] + 1) / (total["n"] + 2)).alias("rate"), F.lit(float(total["n"] + 2)).alias("weight"))
    suffixes = shrunk(suffixes.withColumn("above", root), strengths[2]).select("suffix", level)
    domains = shrunk(domains.join(suffixes, "suffix"), strengths[1]).select("domain", "suffix", level)
    rated = shrunk(hosts.join(domains, ["domain", "suffix"]), strengths[0])
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    rated = rated.withColumn("bound", F.col("rate") - deviations * spread)
    return rated.select("host", "n", "k", "rate", "bound", (F.col("bound") > tolerated).alias("bad"))


def url_filter(
    df: DataFrame,
    rules: list[tuple[str, str, str]],
    bad: Column | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict`` and the
    host's ``bound``.

    ``verdict`` is that of the longest fitting rule, else ``block`` or
    ``allow`` by the host's reputation. ``bad`` labels pages (true, false, or
    null where unknown); without it the pages that a rule decides are the
    labelled ones. Null urls and urls without ``://`` have an empty host and
    path and are judged as the empty host. Repeated rows and null ids are
    judged and counted like any other; other columns are ignored, so their
    names cannot clash. An empty table gives an empty result.
    """
    host, path = split_url("url")
    label = F.lit(None).cast("boolean") if bad is None else bad.cast("boolean")
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), label.alias("bad"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), "bad").withColumn("found", match_rule(rules))
    if bad is None:
        pages = pages.withColumn("bad", F.col("found.verdict") == "block")
    known = host_reputation(pages.select("host", "bad")).select("host", "bound", F.col("bad").alias("blocked"))
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return pages.drop("bad").join(known, "host").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), by_host).alias("verdict"), "bound",
    )


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES).drop("bound")


# --- SQL ---------------------------------------------------------------------


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_BY_LENGTH = sorted(RULES, key=lambda r: len(r[0] + r[1]), reverse=True)
_RULE = " ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for h, p, _ in _BY_LENGTH)
_VERDICT = " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _BY_LENGTH)
_LIST = ", ".join(f"'{s}'" for s in SECOND_LEVEL)


def _strength_sql(children: str, parent: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(scale, 0) = 0 OR excess <= 0 THEN {STRENGTH[1]}
                  ELSE least({STRENGTH[1]}, greatest({STRENGTH[0]}, scale / excess - 1)) END FROM (
      SELECT sum((k - n * m) ** 2 - n * m * (1 - m)) AS excess, sum(n * (n - 1) * m * (1 - m)) AS scale
      FROM (SELECT c.n, c.k, CAST(p.pk AS DOUBLE) / p.pn AS m FROM {children} c JOIN (
              SELECT {parent} AS parent, sum(n) AS pn, sum(k) AS pk FROM {children} WHERE n > 0
              GROUP BY ALL HAVING count(*) > 1 AND sum(k) > 0 AND sum(k) < sum(n)) p ON c.{parent} = p.parent WHERE c.n > 0)))"""


OP13_SQL = f"""WITH u AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  hp AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
           regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
  judged AS (SELECT *, CASE {_RULE} END AS rule, CASE {_VERDICT} END AS verdict FROM hp),
  labels_of AS (
    SELECT host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l,
           count(verdict) AS n, count(*) FILTER (WHERE verdict = 'block') AS k FROM judged GROUP BY host),
  sized AS (
    SELECT *, CASE WHEN regexp_matches(array_to_string(l, '.'), '{_ADDRESS}') THEN len(l)
                   WHEN len(l) >= 3 AND length(l[len(l)]) = 2 AND l[len(l) - 1] IN ({_LIST}) THEN 2 ELSE 1 END AS own FROM labels_of),
  hosts AS (
    SELECT host, n, k, 0 AS everything, array_to_string(l[greatest(1, len(l) - own):len(l)], '.') AS domain,
           array_to_string(l[len(l) - own + 1:len(l)], '.') AS suffix FROM sized),
  domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
  suffixes AS (SELECT suffix, 0 AS everything, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
  s AS (
    SELECT {_strength_sql('hosts', 'domain')} AS sh, {_strength_sql('domains', 'suffix')} AS sd,
           {_strength_sql('suffixes', 'everything')} AS ss, (SELECT (sum(k) + 1.0) / (sum(n) + 2) FROM suffixes) AS root,
           (SELECT sum(n) + 2 FROM suffixes) AS total),
  rs AS (
    SELECT suffix, (k + p * root) / (n + p) AS rate, n + p AS weight FROM (SELECT *, least(ss, total) AS p FROM suffixes, s)),
  rd AS (
    SELECT domain, suffix, (k + p * above) / (n + p) AS rate, n + p AS weight
    FROM (SELECT d.*, rs.rate AS above, least(sd, rs.weight) AS p FROM domains d JOIN rs USING (suffix), s)),
  rh AS (
    SELECT host, (k + p * above) / (n + p) AS rate, n + p AS weight
    FROM (SELECT h.*, rd.rate AS above, least(sh, rd.weight) AS p FROM hosts h JOIN rd USING (domain, suffix), s))
  SELECT page_id, host, path, rule, coalesce(verdict,
         CASE WHEN rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (weight + 1)) > {TOLERATED} THEN 'block' ELSE 'allow' END) AS verdict
  FROM judged JOIN rh USING (host)"""
