"""URL filter: explicit rules first, then a path-template tree learned from what the rules decide.

Per host, path segments form a tree. Segments that start with a digit, and children of a node that
has many of them with few pages each, become the wildcard ``*``. A branch whose share of blocked
labels doesn't differ from its parent's by more than ``Z`` standard errors (or that has no labels)
is merged with its similar siblings into ``~``. Below ``DEPTH`` levels the tree goes on to the ends of the paths
with branches that differ alone; what doesn't is merged into ``**``. A template is rejected when its share of blocked
labels, smoothed towards its host's share, which itself is smoothed towards the share of all hosts,
reaches ``PURITY``. The labels are the urls that a rule decides.

All steps are DataFrame functions on pre-aggregated tables: pages are first counted by host and
segments, so a host with a third of all pages weighs as much as its number of distinct templates.

Defined results
    null url, or one without ``://``: host and path are empty, rule is null, verdict allow. Upper
    case letters of the path count as they are. null page_id: kept. Repeated rows: one result each.
    Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A node with this many children, and no more than PAGES_PER_CHILD pages for each, is a variable.
MANY, PAGES_PER_CHILD = 32, 2
Z, SMOOTH, PURITY, DEPTH = 1.96, 4.0, 0.9, 2

Rule = tuple[str, str]  # verdict, host suffix and path prefix, like ("block", "example.org/es/")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _differs(blocked: Column, labels: Column, share: Column) -> Column:
    """Whether a branch's share of blocked labels differs from its parent's; false without labels."""
    labels = F.nullif(labels, F.lit(0))
    return F.coalesce(F.abs(blocked / labels - share) > Z * F.sqrt(share * (1 - share) / labels), F.lit(False))


def tails(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with tail: the template of the segments in ``rest``, empty where that is null.

    A round moves every node (keys, tail) that has labels of both kinds to the first segment in which its
    rows aren't all the same, and splits it there. No branch can differ in the other nodes, which are ready.
    There are at most as many rounds as places on one path where such a node branches.
    """
    node = [*keys, "tail"]
    now = rows.select("*", F.lit("").alias("tail"), F.coalesce(F.split("rest", "/"), F.array().cast("array<string>")).alias("left"))
    ready = []
    while True:
        nodes = now.groupBy(*node).agg(F.sum("labels").alias("pl"), F.sum("blocked").alias("pb"), F.min("left").alias("low"), F.max("left").alias("high"))
        # the least and the greatest list of segments part where the first two of the node do
        place = F.array_position(F.zip_with("low", "high", lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
        mixed = nodes.where("pb > 0 and pb < pl and low <> high").select(*node, place.alias("place"), (F.col("pb") / F.col("pl")).alias("share"))
        now = staged(now.join(mixed, node, "left"), "tails")
        ready.append(now.where("place is null").drop("place", "share"))
        now = now.where("place is not null")
        if now.isEmpty():
            break
        now = now.withColumn("s", F.coalesce(F.get("left", F.col("place") - 1), F.lit("")))
        child = now.groupBy(*node, "s").agg(_differs(F.sum("blocked"), F.sum("labels"), F.first("share")).alias("differs"))
        now = now.join(child, [*node, "s"])
        name = F.when(F.col("differs"), F.when(F.col("s").rlike("^[0-9]"), "*").otherwise(F.col("s"))).otherwise("~")
        tail = F.concat("tail", F.repeat(F.lit("/~"), F.col("place") - 1), F.lit("/"), name)
        now = now.withColumns({"tail": tail, "left": F.slice("left", F.col("place") + 1, F.size("left"))}).drop("s", "place", "share", "differs")
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    known = F.regexp_replace("tail", "(/~)+$", "")
    whole = (F.size("left") == 0) & (known == F.col("tail"))
    return out.withColumn("tail", F.substring(F.when(whole, known).otherwise(F.concat(known, F.lit("/**"))), 2, 1 << 30)).drop("left")


def templates(counts: DataFrame) -> DataFrame:
    """From (host, s0.., rest, n, labels, blocked) the template and verdict of each row.

    One level after the other: every level works on the branches that the level above has formed.
    """
    names = [f"s{i}" for i in range(DEPTH + 1)]
    rows, keys = counts, ["host"]
    for level in range(DEPTH):
        s, t = names[level], f"t{level}"
        child = rows.groupBy(*keys, s).agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("blocked").alias("blocked"))
        parent = child.groupBy(*keys).agg(
            F.count("*").alias("children"), F.sum("n").alias("pn"), F.sum("labels").alias("pl"), F.sum("blocked").alias("pb")
        )
        child = child.join(parent, keys)
        differs = _differs(F.col("blocked"), F.col("labels"), F.col("pb") / F.nullif(F.col("pl"), F.lit(0)))
        variable = F.col(s).rlike("^[0-9]") | ((F.col("children") >= MANY) & (F.col("pn") <= PAGES_PER_CHILD * F.col("children")))
        name = F.when(F.col(s) == "", "").when(F.coalesce(differs, F.lit(False)), F.when(variable, "*").otherwise(F.col(s)))
        name = F.coalesce(name, F.when(variable, "*").otherwise("~"))
        rows = rows.join(child.select(*keys, s, name.alias(t)), [*keys, s])
        keys = [*keys, t]
    keys, rows = [*keys, "tail"], tails(rows, [*keys, names[-1]])
    total = counts.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum("labels"), F.lit(0)) + 2)).alias("g"))
    host = counts.groupBy("host").agg(F.sum("labels").alias("hl"), F.sum("blocked").alias("hb"))
    host = host.crossJoin(F.broadcast(total))  # a table of one row
    host = host.select("host", ((F.col("hb") + SMOOTH * F.col("g")) / (F.col("hl") + SMOOTH)).alias("h"))
    leaf = rows.groupBy(*keys).agg(F.sum("labels").alias("ll"), F.sum("blocked").alias("lb")).join(host, "host")
    purity = (F.col("lb") + SMOOTH * F.col("h")) / (F.col("ll") + SMOOTH)
    path = F.regexp_replace(F.concat_ws("/", F.lit(""), *[F.nullif(F.col(k), F.lit("")) for k in keys[1:]]), "^$", "/")
    leaf = leaf.select(*keys, path.alias("template"), F.when(purity >= PURITY, "block").otherwise("allow").alias("judged"))
    return rows.join(leaf, keys).select("host", *names, "rest", "template", "judged")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per page: id, host, path, rule, verdict and the template of its path."""
    names = [f"s{i}" for i in range(DEPTH + 1)]
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    # segments that start with a digit are variables whatever their number
    parts = F.transform(F.split(F.regexp_replace("path", "^/", ""), "/"), lambda s: F.when(s.rlike("^[0-9]"), "0").otherwise(s))
    segment = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(names[i]) for i in range(DEPTH)]
    rows = rows.select("*", *segment, F.when(F.size(parts) > DEPTH, "**").otherwise("").alias(names[DEPTH]), F.when(F.size(parts) > DEPTH, F.array_join(F.slice(parts, DEPTH + 1, F.size(parts)), "/")).alias("rest"))
    counts = rows.groupBy("host", *names, "rest").agg(
        F.count("*").alias("n"), F.count("ruled").alias("labels"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")
    )
    tree = staged(templates(staged(counts, "paths")), "templates")
    tree = tree.withColumnRenamed("rest", "_rest")
    out = rows.join(tree, ["host", *names]).where(F.col("rest").eqNullSafe(F.col("_rest")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "template")


def filter_pages(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose url is allowed, all columns kept."""
    key = fresh(pages, "_url")
    bad = judge(pages, rules, id_col, url_col).where("verdict = 'block'")
    bad = bad.select(F.col("host").alias("_h"), F.col("path").alias("_p")).distinct()
    rows = pages.withColumn(key, F.struct(host_of(F.col(url_col)).alias("h"), path_of(F.col(url_col)).alias("p")))
    return rows.join(bad, (rows[key].h == bad["_h"]) & (rows[key].p == bad["_p"]), "left_anti").drop(key)
