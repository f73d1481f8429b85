"""URL filtering with a tree of path templates for each host.

Rules of (host, path) decide where one fits. Their verdicts are also the labels
that templates are judged by:

1. Paths become segments; a segment with a digit or of over 24 characters is
   variable in form and becomes a wildcard that keeps its extension. The tree
   is `DEPTH` segments deep, what lies below is one segment.
2. A child of a node is of the side block, allow or none if all of its pages
   have that label or none has one, else it is mixed. From the root down, more
   than `FAN_OUT` children of one side are variable in use: they become one
   wildcard of that side. Mixed children stay. So a segment that a label tells
   apart is never folded into one without it, however many others there are.
3. Children of a node and side are compared by their numbers of blocked, allowed
   and unlabelled pages. Neighbours in the order of these shares are merged
   while a chi-square test finds no difference.
4. A template's purity is the share of blocked pages among its labelled ones,
   smoothed by one page of either kind. From `REJECT` on, its pages are blocked.

So a page without a rule is blocked where its branch has pages that rules block
beside it, such as paths that a prefix misses for a doubled slash, and sections
that are added to a host change no verdict of the others.

All counts are sums by (host, template), made before a shuffle, so a host with
a third of all pages is a few rows. A node has at most `FAN_OUT` children of a
side when they are sorted; mixed ones, which only the paths of rules can have,
are sorted with running sums and no collection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightwater.llm.common import write_shared

# Verdict, host and path of each rule.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DEPTH = 6
FAN_OUT = 20
LONG = 24
REJECT = 0.9
#: Chi-square with two degrees of freedom that is exceeded by chance in 5 of 100 cases.
SAME_BELOW = 5.99

KINDS = ["blocked", "allowed", "unlabelled"]
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty if `url` is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, *_LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict), or null."""
    out = F.lit(None)
    for verdict, of, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(of + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _template(path: Column) -> Column:
    """Segments with those that vary in form as wildcards."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    shaped = F.transform(
        segments,
        lambda s: F.when(s.rlike(r"[0-9]") | (F.length(s) > LONG), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})?$", 1))).otherwise(s),
    )
    deep = F.concat(F.slice(shaped, 1, DEPTH), F.array(F.lit("**")))
    return F.when(F.size(shaped) > DEPTH, deep).otherwise(shaped)


def _side() -> Column:
    """The label that all pages of a row of counts have, `none` if none has one, else `mixed`."""
    blocked, allowed, unlabelled = (F.col(k) > 0 for k in KINDS)
    return (
        F.when(~allowed & ~unlabelled, "block").when(~blocked & ~unlabelled, "allow").when(~blocked & ~allowed, "none").otherwise("mixed")
    )


def _generalised(counts: DataFrame) -> DataFrame:
    """Adds `general`: the template with segments that vary in use as wildcards, from the root down."""
    tree = counts.withColumn("general", F.array().cast("array<string>"))
    for depth in range(DEPTH + 1):
        here = F.size("template") > depth
        tree = tree.withColumn("segment", F.when(here, F.col("template")[depth]))
        children = tree.where(here).groupBy("host", "general", "segment").agg(*[F.sum(k).alias(k) for k in KINDS])
        children = write_shared(children.select("host", "general", "segment", _side().alias("side")), "children")
        wide = (
            children.where("side != 'mixed'")
            .groupBy("host", "general", "side")
            .agg(F.count(F.lit(1)).alias("fan"))
            .where(F.col("fan") > FAN_OUT)
            # no segment holds a slash, so wildcards of a side meet no segment
            .select("host", "general", "side", F.concat(F.lit("*/"), "side").alias("wildcard"))
        )
        folded = children.join(wide, ["host", "general", "side"]).select("host", "general", "segment", "wildcard")
        tree = tree.join(folded, ["host", "general", "segment"], "left").withColumn(
            "general", F.when(here, F.concat("general", F.array(F.coalesce("wildcard", "segment")))).otherwise(F.col("general"))
        )
        tree = write_shared(tree.drop("wildcard", "segment"), "templates")
    return tree


def _merged(templates: DataFrame) -> DataFrame:
    """Adds `branch`, the same number for sibling templates that no test tells apart."""
    parent = F.slice("general", 1, F.greatest(F.size("general") - 1, F.lit(0)))
    siblings = W.partitionBy("host", "parent", "level", "side").orderBy("blocked_share", "allowed_share", "general")
    before = [F.lag(k).over(siblings) for k in KINDS]
    total, total_before = reduce(lambda a, b: a + b, [F.col(k) for k in KINDS]), F.col("n_before")
    chi = reduce(
        lambda a, b: a + b,
        [
            F.coalesce(
                F.try_divide(
                    F.pow(F.col(k) * total_before - F.col(f"{k}_before") * total, F.lit(2)),
                    (F.col(k) + F.col(f"{k}_before")) * total * total_before,
                ),
                F.lit(0.0),
            )
            for k in KINDS
        ],
    )
    return (
        templates.withColumn("parent", parent)
        .withColumn("side", _side())
        .withColumn("level", F.size("general"))
        .withColumn("blocked_share", F.col("blocked") / total)
        .withColumn("allowed_share", F.col("allowed") / total)
        .withColumns({f"{k}_before": b.cast("double") for k, b in zip(KINDS, before)})
        .withColumn("n_before", reduce(lambda a, b: a + b, [F.col(f"{k}_before") for k in KINDS]))
        .withColumn("new", F.coalesce((chi > SAME_BELOW).cast("int"), F.lit(1)))
        .withColumn("branch", F.sum("new").over(siblings))
    )


def judge_templates(pages: DataFrame) -> DataFrame:
    """Columns `host`, `template` (by form), `general`, `purity` and `reject`, from `host`, `path` and `label` of pages."""
    label = lambda verdict: F.count(F.when(F.col("label") == verdict, F.lit(1)))
    counts = pages.groupBy("host", "template").agg(
        label("block").alias("blocked"), label("allow").alias("allowed"), F.count(F.when(F.col("label").isNull(), F.lit(1))).alias("unlabelled")
    )
    tree = _generalised(write_shared(counts, "paths"))
    branch = ["host", "parent", "level", "side", "branch"]
    merged = _merged(tree.groupBy("host", "general").agg(*[F.sum(k).alias(k) for k in KINDS]))
    merged = write_shared(merged.select(*branch, "general", "blocked", "allowed"), "merged")
    purity = merged.groupBy(*branch).agg(((F.sum("blocked") + 1) / (F.sum("blocked") + F.sum("allowed") + 2)).alias("purity"))
    judged = merged.join(purity, branch).select("host", "general", "purity")
    return tree.join(judged, ["host", "general"]).select(
        "host", "template", "general", "purity", (F.col("purity") >= REJECT).alias("reject")
    )


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Columns `page_id`, `host`, `path`, `rule`, `verdict`, `template` and `purity`; one row per row of `pages`.

    The longest fitting rule decides, else the purity of the page's template.
    Null urls and those without `://` have an empty host and path and are a
    template of their own. Very long urls are taken whole; segments below
    `DEPTH` count as one. Of rules that fit with equal length the last listed
    holds. Null ids and repeated rows stay, an empty table gives no rows, other
    columns are not read.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("matched", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("*", _template(F.col("path")).alias("template"), F.col("matched.verdict").alias("label"))
    judged = write_shared(judge_templates(rows), "judged")
    by_method = F.when(F.col("reject"), "block").otherwise("allow")
    return rows.join(judged, ["host", "template"], "left").select(
        "page_id", "host", "path", F.col("matched.rule").alias("rule"), F.coalesce("matched.verdict", by_method).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("general", "/")).alias("template"), "purity",
    )
