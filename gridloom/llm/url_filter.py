"""URL filter: fixed rules first, then a path-template tree for each host.

The tree is grown from the table's own URLs:

1. Segments that look variable (digits, or long with digits) become ``*``.
2. Level by level, where a node of a host has more than ``WIDE`` different children that are rare (fewer than ``RARE``
   URLs each), these are generalised into one ``*``; frequent ones stay nodes of their own. The tree is as deep as the
   paths.
3. Sibling branches are merged into the branch ``~`` where their labelled URLs don't tell them apart: where a branch's
   share of bad URLs lies within ``Z`` standard deviations of its siblings' without it. A branch without labels is
   merged with none.
4. A template is rejected where it has labelled URLs and its smoothed labelled purity, (bad + STRENGTH * prior) /
   (labelled + STRENGTH) with the table's overall share as the prior, is at least ``PURITY``.

Labels are the verdicts of the rules, or a table of labelled URLs. Everything is grouped by host, template and
segment with sums that Spark combines before the shuffle, so a host with a third of all URLs takes one row per
template and task; templates are joined back by host and segments, where Spark splits skewed hosts.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is in no template: it
is allowed; equal urls have equal verdicts; every row gives a row; an empty table gives none; only page_id and url are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, work_folder

#: (verdict, host, path): a rule fits its host and subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
WIDE, RARE = 20, 5
Z = 1.96
STRENGTH, PURITY = 10.0, 0.75
#: Levels that the SQL of the query spells out; SQL has no loop over levels.
SQL_LEVELS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape(path: Column) -> Column:
    """All segments, with variable ones as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^[0-9._-]+(\.[A-Za-z]{1,5})?$") | ((F.length(x) >= 12) & x.rlike("[0-9]")), F.lit("*")).otherwise(x))


def named(child: DataFrame) -> DataFrame:
    """host, t, s and the name below t of every branch s; ``child``: host, t, s, n, bad, labelled.

    The rare children of a wide node are compared and generalised among themselves, the others merged among
    themselves, and only by labels of their own. The variance is smoothed by a URL of each kind, so a share of 0 or 1
    has one too."""
    rare = (F.col("n") < RARE) & ~F.col("s").isin("", "*")
    wide = child.groupBy("host", "t").agg((F.sum(rare.cast("int")) > WIDE).alias("wide"))
    child = child.join(wide, ["host", "t"]).withColumn("few", F.col("wide") & (rare | (F.col("s") == "*")))
    node = child.groupBy("host", "t", "few").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    child = child.join(node, ["host", "t", "few"])
    m, others = F.col("labelled"), F.col("all_labelled") - F.col("labelled")
    both = (m > 0) & (others > 0)
    p = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
    apart = F.when(both, F.abs(F.col("bad") / m - (F.col("all_bad") - F.col("bad")) / others) > Z * F.sqrt(p * (1 - p) * (1 / m + 1 / others))).otherwise(False)
    name = F.when(F.col("s") == "", "").when((F.col("s") == "*") | F.col("few") & ~apart, "/*").when(both & ~apart, "/~").otherwise(F.concat(F.lit("/"), "s"))
    return child.select("host", "t", "s", name.alias("name"))


def grown(urls: DataFrame, folder: str) -> DataFrame:
    """host, shape of every path, with its template, to any depth; ``urls``: host, shape, bad (1, 0 or null).

    A node whose paths all go on alike is passed at once, so there are as many rounds as branchings in one path."""
    left = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("labelled"))
    left = stored(left.select("*", F.lit("").alias("t"), F.col("shape").alias("rest")), folder, "shapes")
    done = []
    below = F.concat_ws("", F.transform(F.slice("rest", 1, F.col("same")), lambda x: F.concat(F.lit("/"), x)))
    while not left.isEmpty():
        level = f"level{len(done)}"
        # The least and the greatest path of a node have no more in common than all of them.
        node = left.groupBy("host", "t").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        differs = F.array_position(F.zip_with("low", "high", lambda a, b: ~a.eqNullSafe(b)), True)
        same = F.when(differs > 0, differs - 1).otherwise(F.size("low")).cast("int")
        node = node.select("host", "t", same.alias("same"), (F.col("low") == F.col("high")).alias("lone"))
        at = left.join(node, ["host", "t"]).withColumn("t", F.concat("t", below)).withColumn("rest", F.expr("slice(rest, same + 1, size(rest))"))
        at = stored(at.drop("same"), folder, f"{level}-at")
        split = at.where("not lone").withColumn("s", F.coalesce(F.get("rest", F.lit(0)), F.lit("")))
        child = split.groupBy("host", "t", "s").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
        more = split.where("s <> ''").join(named(child), ["host", "t", "s"]).withColumn("t", F.concat("t", "name"))
        done.append(at.where("lone or size(rest) = 0"))
        left = stored(more.select("host", "shape", "n", "bad", "labelled", "t", F.expr("slice(rest, 2, size(rest))").alias("rest")), folder, level)
    out = urls.sparkSession.createDataFrame([], "host string, shape array<string>, template string, n long, bad long, labelled long")
    for part in done:
        out = out.unionByName(part.select("host", "shape", F.col("t").alias("template"), "n", "bad", "labelled"))
    return out


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template of each row. ``labelled``: url, bad (1 or 0); else the rules' own
    verdicts are the labels."""
    folder = work_folder(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))

    def shaped(df: DataFrame, *more: Column | str) -> DataFrame:
        df = df.select(*more, host.alias("host"), path.alias("path"))
        return df.select("*", shape(F.col("path")).alias("shape"), rule_of(F.col("host"), F.col("path"), rules).alias("r"))

    urls = stored(shaped(pages, "page_id"), folder, "urls")
    bad = F.when(F.col("r.verdict") == "block", 1).when(F.col("r.verdict") == "allow", 0)
    given = urls.where("host <> ''").select("host", "shape", (bad if labelled is None else F.lit(None).cast("int")).alias("bad"))
    if labelled is not None:
        given = given.unionByName(shaped(labelled, F.col("bad").cast("int").alias("bad")).where("host <> ''").select("host", "shape", "bad"))
    known = stored(grown(stored(given, folder, "given"), folder), folder, "templates")
    bad, labelled_n = known.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = (bad or 0) / labelled_n if labelled_n else 0.0
    sums = known.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).where("labelled > 0")
    pure = sums.where((F.col("bad") + STRENGTH * prior) / (F.col("labelled") + STRENGTH) >= PURITY).select("host", "template", F.lit("block").alias("rejected"))
    judged = urls.join(known.select("host", "shape", "template").join(pure, ["host", "template"], "left"), ["host", "shape"], "left")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "rejected", F.lit("allow")).alias("verdict"), "template")


def oracle_sql() -> str:
    """The query's rows in DuckDB's SQL, with the rules' verdicts as labels."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN ['{h}{p}', '{v}']"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    levels = ""
    for k in range(SQL_LEVELS):
        levels += f"""
        c{k} AS (SELECT host, t, coalesce(g[{k + 1}], '') AS s, sum(n) AS n, sum(bad) AS bad, sum(m) AS m FROM l{k} GROUP BY ALL),
        r{k} AS (SELECT *, n < {RARE} AND s NOT IN ('', '*') AS rare FROM c{k}),
        w{k} AS (SELECT *, count(*) FILTER (rare) OVER (PARTITION BY host, t) > {WIDE} AND (rare OR s = '*') AS few FROM r{k}),
        d{k} AS (SELECT *, sum(bad) OVER w AS ab, sum(m) OVER w AS am FROM w{k} WINDOW w AS (PARTITION BY host, t, few)),
        a{k} AS (SELECT *, m > 0 AND am > m AS two, (ab + 1) / (am + 2) AS p FROM d{k}),
        b{k} AS (SELECT *, two AND abs(bad / nullif(m, 0) - (ab - bad) / nullif(am - m, 0)) > {Z} * sqrt(p * (1 - p) * (1 / nullif(m, 0) + 1 / nullif(am - m, 0))) AS apart FROM a{k}),
        e{k} AS (SELECT host, t, s, CASE WHEN s = '' THEN '' WHEN s = '*' OR few AND NOT apart THEN '/*' WHEN two AND NOT apart THEN '/~' ELSE '/' || s END AS name FROM b{k}),
        l{k + 1} AS (SELECT host, g, n, bad, m, l{k}.t || name AS t FROM l{k} JOIN e{k} ON l{k}.host = e{k}.host AND l{k}.t = e{k}.t AND coalesce(g[{k + 1}], '') = s),""".replace("SELECT host, g, n", f"SELECT l{k}.host, g, n")
    last = f"l{SQL_LEVELS}"
    return rf"""
        WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        b AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        c AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, CASE {fits} END AS r FROM b),
        u AS (SELECT page_id, host, path, r[1] AS rule, r[2] AS v, list_transform(parts, lambda x:
              CASE WHEN regexp_full_match(x, '[0-9._-]+(\.[A-Za-z]{{1,5}})?') OR length(x) >= 12 AND regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS g FROM c),
        l0 AS (SELECT host, g, count(*) AS n, count(*) FILTER (v = 'block') AS bad, count(v) AS m, '' AS t FROM u WHERE host <> '' GROUP BY ALL),{levels}
        prior AS (SELECT coalesce(sum(bad) / sum(m), 0) AS prior FROM l0),
        pure AS (SELECT host, t, 'block' AS rejected FROM {last}, prior GROUP BY host, t, prior
                 HAVING sum(m) > 0 AND (sum(bad) + {STRENGTH} * prior) / (sum(m) + {STRENGTH}) >= {PURITY})
        SELECT page_id, u.host, path, rule, coalesce(v, rejected, 'allow') AS verdict, x.t AS template
        FROM u LEFT JOIN {last} x ON u.host = x.host AND u.g = x.g LEFT JOIN pure ON x.host = pure.host AND x.t = pure.t
    """
