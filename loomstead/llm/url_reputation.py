"""URL filters by empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its path.
Rule = tuple[str, str, str]
#: Suffixes of two labels under which hosts are registered (fixed values); any other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "com.ar", "co.kr")
#: Pseudo-outcomes that a level's mean is worth to the level below; used where the data cannot tell.
STRENGTH = 20.0
#: A host is blocked if its bad share is above this with the bound's certainty.
BAD_SHARE = 0.35
#: Standard deviations from the posterior mean to the lower bound.
BOUND = 1.645
#: Characters of a line that tells about a page, at least.
LEAST_LINE = 20


def host_of(url: str) -> Column:
    after = F.when(F.instr(F.col(url), "://") > 0, F.col(url).substr(F.instr(F.col(url), "://") + F.lit(3), F.length(url)))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    after = F.when(F.instr(F.col(url), "://") > 0, F.col(url).substr(F.instr(F.col(url), "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    long = F.substring_index(host, ".", -2)
    return F.when(long.isin(*LONG_SUFFIXES), long).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    long = F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls without one."""
    rule = verdict = None
    for what, at, under in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        rule = F.when(fits, F.lit(at + under)) if rule is None else rule.when(fits, F.lit(at + under))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _fitted(children: DataFrame, by: str, parent: DataFrame | None) -> DataFrame:
    """(by, mean, strength): posterior mean of each value of `by` and the beta prior's strength for its children, by moments.

    The strength is that of the beta-binomial whose spread of the children's
    shares fits: (m(1-m) - v) / (v - m(1-m)/n~) style moments, held between 2
    and 1000; STRENGTH where fewer than two children have outcomes.
    """
    total = children.groupBy(by, *([f"{by}_parent"] if parent is not None else [])).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("k"),
        F.sum(F.coalesce(F.try_divide(F.col("bad") * F.col("bad"), F.col("n")), F.lit(0.0))).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    if parent is None:
        total = total.withColumn("prior", F.lit(0.5)).withColumn("weight", F.lit(2.0))
    else:
        above = parent.select(F.col("name").alias("at"), F.col("mean").alias("prior"), F.col("strength").alias("weight"))
        total = total.join(above, total[f"{by}_parent"] == above["at"], "left")
    mean = (F.col("bad") + F.col("prior") * F.col("weight")) / (F.col("n") + F.col("weight"))
    n, k, m = F.col("n"), F.col("k"), F.try_divide(F.col("bad"), F.col("n"))
    free = n - F.try_divide(F.col("nn"), F.col("n"))  # outcomes that tell about the spread between children
    between = F.when((k > 1) & (free > 0), F.try_divide((F.col("q") - n * m * m) - (k - 1) * m * (1 - m), free))
    strength = F.when(between.isNull() | (m * (1 - m) <= 0), F.lit(STRENGTH)).when(between <= 0, F.lit(1000.0)).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(2.0), F.try_divide(m * (1 - m), between) - 1)))
    return total.select(F.col(by).alias("name"), mean.alias("mean"), strength.alias("strength"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, share, bound) of every host of outcomes (host, bad: 1, 0 or null where unlabelled).

    Hosts are summed once; their sums give domains, those suffixes, those the
    whole. Each level's posterior mean is the prior mean of the level below.
    share is the posterior mean of the bad share, bound its lower bound.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("domain_parent", suffix_of(F.col("host")))
    domains = hosts.groupBy(F.col("domain").alias("d"), F.col("domain_parent").alias("suffix")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = _fitted(suffixes.withColumn("top", F.lit("")), "top", None)
    by_suffix = _fitted(domains.withColumn("suffix_parent", F.lit("")), "suffix", whole)
    by_domain = _fitted(hosts, "domain", by_suffix)
    prior = by_domain.select(F.col("name").alias("at"), "mean", "strength")
    joined = hosts.join(prior, hosts.domain == prior["at"], "left")
    a = F.col("bad") + F.col("mean") * F.col("strength")
    b = F.col("n") - F.col("bad") + (1 - F.col("mean")) * F.col("strength")
    share = a / (a + b)
    return joined.select("host", "n", "bad", share.alias("share"), (share - BOUND * F.sqrt(share * (1 - share) / (a + b + 1))).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], bad_share: float = BAD_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, bound of every page.

    outcomes (page_id, bad) holds labelled pages; the longest rule that fits
    decides, else the host's posterior: block where its lower bound is above
    bad_share. Null urls and urls without `://` have an empty host and path
    and share a reputation. Null page_ids stay and have no outcome; repeated
    pages count as often as they occur, repeated outcomes once (the worst).
    Other columns are ignored; an empty table gives none. Hosts are summed
    before anything is joined, so a hot host is one row.
    """
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    named = named.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    told = outcomes.groupBy(F.col("page_id").cast("long").alias("of_page")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = named.join(told, named.page_id == told.of_page, "left").select("host", "bad")
    reputation = host_reputation(labelled).select(F.col("host").alias("of_host"), "bound")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    judged = named.withColumns({"rule": rule, "told": verdict}).join(reputation, named.host == F.col("of_host"), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("told", F.when(F.col("bound") > bad_share, "block").otherwise("allow")).alias("verdict"), "bound")


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of the pages of which labelled documents hold paragraphs.

    A paragraph is the text after `<p>` up to the next tag, without white space
    around it, of LEAST_LINE characters or more. It is as bad as the share of
    labelled documents with a line equal to it that are of low quality or
    toxic; a page is bad (1) where its paragraphs are by half or more on
    average, else good (0). Pages without such a paragraph have no outcome.
    Lines meet by hashes of 64 bits, which are made where texts and pages are
    read: neither is dealt out. Null ids, texts and html
    take no part; of rows with one id in labels the worst counts; repeated
    rows of documents and paragraphs count as often as they occur.
    """
    strip = lambda c: F.trim(F.regexp_replace(c, r"[\x09-\x0D]", " "))
    held = lambda lines: F.transform(F.filter(F.transform(lines, strip), lambda x: F.length(x) >= LEAST_LINE), lambda x: F.xxhash64(x))
    worst = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    hashed = docs.select("doc_id", held(F.split("text", "\n")).alias("lines")).where("size(lines) > 0")
    told = hashed.join(worst, F.col("doc_id") == F.col("of"))
    shares = told.select(F.explode("lines").alias("h"), "bad").groupBy("h").agg((F.sum("bad") / F.count(F.lit(1))).alias("share"))
    found = pages.where("page_id is not null").select("page_id", F.explode(held(F.regexp_extract_all("html", F.lit("<p>([^<]*)")))).alias("p"))
    met = found.join(shares, F.col("p") == F.col("h"))
    return met.groupBy("page_id").agg((F.avg("share") >= 0.5 - 1e-9).cast("int").alias("bad"))


def oracle(rules: list[Rule], bad_share: float = BAD_SHARE) -> str:
    """The same in DuckDB SQL, over pages, documents and labels."""
    strip = lambda c: f"trim(regexp_replace({c}, '[\\x09-\\x0D]', ' ', 'g'))"

    def level(name: str, children: str, by: str, prior: str) -> str:
        free = "(sum(n) - sum(n * n)::DOUBLE / nullif(sum(n), 0))"
        m = "(sum(bad)::DOUBLE / nullif(sum(n), 0))"
        between = f"CASE WHEN count(*) FILTER (WHERE n > 0) > 1 AND {free} > 0 THEN ((coalesce(sum(bad * bad::DOUBLE / nullif(n, 0)), 0) - sum(n) * {m} * {m}) - (count(*) FILTER (WHERE n > 0) - 1) * {m} * (1 - {m})) / {free} END"
        return f"""{name} AS (SELECT name, (bad + mean0 * w0) / (n + w0) AS mean, CASE WHEN b IS NULL OR m * (1 - m) <= 0 THEN {STRENGTH} WHEN b <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, m * (1 - m) / b - 1)) END::DOUBLE AS strength
FROM (SELECT {by} AS name, {prior}, sum(n) AS n, sum(bad) AS bad, {m} AS m, {between} AS b FROM {children} GROUP BY ALL))"""

    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" + " '{}'" for _, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = fits.format(*[h + p for _, h, p in ordered])
    told = fits.format(*[v for v, _, _ in ordered])
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    last = lambda k: f"array_to_string(string_split(host, '.')[-{k}:], '.')"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
w AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
ln AS (SELECT line, avg(bad) AS share FROM (SELECT {strip("unnest(string_split(text, chr(10)))")} AS line, bad FROM documents JOIN w USING (doc_id)) WHERE length(line) >= {LEAST_LINE} GROUP BY line),
o AS (SELECT page_id AS doc_id, CASE WHEN avg(share) >= 0.5 - 1e-9 THEN 1 ELSE 0 END AS bad FROM (SELECT page_id, {strip("unnest(regexp_extract_all(html, '<p>([^<]*)', 1))")} AS line FROM pages) JOIN ln USING (line) GROUP BY page_id),
h AS (SELECT host, CASE WHEN {last(2)} IN ({long}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {last(2)} IN ({long}) THEN {last(2)} ELSE {last(1)} END AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM u LEFT JOIN o ON page_id = doc_id GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
{level("l0", "s", "''", "0.5::DOUBLE AS mean0, 2.0::DOUBLE AS w0")},
dp AS (SELECT d.*, l0.mean AS mean0, l0.strength AS w0 FROM d, l0), {level("l1", "dp", "suffix", "mean0, w0")},
hp AS (SELECT h.*, l1.mean AS mean0, l1.strength AS w0 FROM h JOIN l1 ON suffix = name), {level("l2", "hp", "domain", "mean0, w0")},
r AS (SELECT host, (bad + mean * strength) / (n + strength) AS share, n + strength AS weight FROM h JOIN l2 ON domain = name)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {told} END, CASE WHEN share - {BOUND} * sqrt(share * (1 - share) / (weight + 1)) > {bad_share} THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN r USING (host)
"""
