"""URL filters: rules first, then a tree of path templates per host, in DataFrame functions only.

The tree.  A path is a list of segments; digits, hexadecimal strings and file
names become wildcards of their kind at once, so a host with millions of pages
has few paths left.  Then the tree of each host is walked down, to its deepest
path.  As in a radix tree, segments that all paths of a node share are passed at
once, and where a node has so few labels that no branch below it could be told
from another, all its levels are settled together in the end; so a round of
joins is a branching of nodes with labels, and not a level of the deepest path.
A child of a node whose labelled purity cannot be
told from that of its siblings is merged into a wildcard branch `*`; those that
can are put in order of purity, and neighbours that cannot be told from each
other are merged into branches `*1`, `*2`, ... by rank.  A template's purity is its
share of blocked labels, smoothed by the host's share, which is itself smoothed
by that of all hosts; templates at or over the threshold are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patternloom.llm.common import UPPER, cut, require

#: Bytes of host, path and template that may be broadcast; a larger tree is joined by a shuffle.
SMALL = 32 << 20
#: Nodes of up to so many labels are looked up in a table of which can be told apart.
FEW = 16

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, else null; among equals the first listed."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def fits(r: tuple[str, str, str]) -> Column:
        return ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])

    value = lambda r: F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, r: F.when(fits(r), value(r)).otherwise(rest), reversed(ordered), none)


def shape(path: Column) -> Column:
    """The segments of a path with variable ones as wildcards of their kind."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def kind(s: Column) -> Column:
        out = F.regexp_replace(s, r"^[0-9]+$", "{n}")
        out = F.regexp_replace(out, r"^(?=[^/]*[0-9])[0-9a-fA-F-]{8,}$", "{x}")
        return F.regexp_replace(out, r"^[^{.][^.]*\.([A-Za-z0-9]{1,5})$", r"{f}.$1")

    return F.transform(segments, kind)


def share(bad: Column | float, k: Column | float) -> Column | float:
    """The share of blocked labels, with one label of either kind added."""
    return (bad + 1) / (k + 2)


def separable(z: float) -> list[bool]:
    """At k * (FEW + 1) + bad: whether any two parts of k labels, bad of them blocked, differ by `z` standard errors."""

    def differ(b1: int, k1: int, b2: int, k2: int) -> bool:
        p = share(b1 + b2, k1 + k2)
        return abs(share(b1, k1) - share(b2, k2)) >= z * (p * (1 - p) * (1 / (k1 + 2) + 1 / (k2 + 2))) ** 0.5

    def any_split(bad: int, good: int) -> bool:
        return any(differ(i, i + j, bad - i, bad + good - i - j) for i in range(bad + 1) for j in range(good + 1))

    return [bad <= k and any_split(bad, k - bad) for k in range(FEW + 1) for bad in range(FEW + 1)]


def _node_facts(level: DataFrame, z: float) -> DataFrame:
    """(host, template, rows, tk, tb, ahead, open): counts of each node, how many segments all its paths share next, and whether its branches might differ."""
    rest = F.slice("shape", F.col("at") + 1, F.greatest(F.size("shape") - F.col("at"), F.lit(0)))
    facts = level.withColumn("rest", rest).groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("k").alias("tk"), F.sum("bad").alias("tb"), F.min("rest").alias("lo"), F.max("rest").alias("hi")
    )
    # all lists between the least and the greatest begin with what those two share
    same = F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
    ahead = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")
    told = F.get(F.array(*map(F.lit, separable(z))), (F.col("tk") * (FEW + 1) + F.col("tb")).cast("int"))
    return facts.select("host", "template", "rows", ahead.alias("ahead"), (F.col("rows") > 1).alias("many"), ((F.col("tk") > FEW) | F.coalesce(told, F.lit(True))).alias("open"))


def _joined(start: Column, segments: Column) -> Column:
    return F.concat(start, F.array_join(F.transform(segments, lambda s: F.concat(F.lit("/"), s)), ""))


def _settled(rows: DataFrame) -> DataFrame:
    """The rest of the templates of nodes whose branches cannot differ: a segment that all their paths that get so far share, else a wildcard.

    One pass over all their segments, whatever the depth.
    """
    ends = F.concat(F.slice("shape", F.col("at") + 1, F.greatest(F.size("shape") - F.col("at"), F.lit(0))), F.array(F.lit("")))
    each = rows.select("host", "template", "shape", F.posexplode(ends).alias("e", "child"))
    level = each.groupBy("host", "template", "e").agg(F.min("child").alias("lo"), F.max("child").alias("hi"))
    named = each.where("child != ''").join(level, ["host", "template", "e"]).withColumn("seg", F.when(F.col("lo") == F.col("hi"), F.col("child")).otherwise("*"))
    whole = named.groupBy("host", "template", "shape").agg(F.sort_array(F.collect_list(F.struct("e", "seg"))).alias("s"))
    whole = whole.select("host", "template", "shape", F.transform("s", lambda x: x["seg"]).alias("segs"))
    out = rows.join(whole, ["host", "template", "shape"], "left")
    return out.select("host", "shape", "k", "bad", F.when(F.col("segs").isNull(), F.col("template")).otherwise(_joined(F.col("template"), F.col("segs"))).alias("template"))


def templates(urls: DataFrame, z: float = 1.96, prior: float = 4.0) -> DataFrame:
    """The template of every (host, shape) of `urls` (host, shape, label): (host, shape, template, purity).

    `label` is 1 for blocked, 0 for allowed, null for unknown.  All counts are
    over whole groups, summed before any shuffle.  Two branches are alike when
    their shares of blocked labels, each with one label of either kind added,
    differ by less than `z` standard errors.
    """
    label = F.col("label").cast("double")
    paths = urls.groupBy("host", "shape").agg(F.count("label").alias("k"), F.coalesce(F.sum(label), F.lit(0.0)).alias("bad"))
    level = cut(paths.select("*", F.lit("").alias("template"), F.lit(0).alias("at")))
    done, settling = [], []
    columns, node = ["host", "shape", "k", "bad", "template"], ["host", "template"]

    def differ(b1: Column, k1: Column, b2: Column, k2: Column) -> Column:
        p = share(b1 + b2, k1 + k2)
        return F.abs(share(b1, k1) - share(b2, k2)) >= z * F.sqrt(p * (1 - p) * (1 / (k1 + 2) + 1 / (k2 + 2)))

    while not level.isEmpty():
        known = cut(level.join(_node_facts(level, z), node))
        rest = F.slice("shape", F.col("at") + 1, F.greatest(F.size("shape") - F.col("at"), F.lit(0)))
        done.append(known.where("rows = 1").withColumn("template", _joined(F.col("template"), rest)).select(columns))
        settling.append(known.where("many AND NOT open").select(*columns, "at"))
        # past what all paths of the node share, to the level where they part
        passed = _joined(F.col("template"), F.slice("shape", F.col("at") + 1, F.col("ahead")))
        level = known.where("many AND open").withColumn("template", passed).withColumn("at", F.col("at") + F.col("ahead"))
        each = cut(level.withColumn("child", F.coalesce(F.get("shape", F.col("at")), F.lit(""))))
        if each.isEmpty():
            break
        sums = each.groupBy(*node, "child").agg(F.sum("k").alias("ck"), F.sum("bad").alias("cb"))
        whole = sums.groupBy(*node).agg(F.sum("ck").alias("tk"), F.sum("cb").alias("tb"))
        apart = differ(F.col("cb"), F.col("ck"), F.col("tb") - F.col("cb"), F.col("tk") - F.col("ck"))
        told = cut(sums.join(whole, node).withColumn("apart", apart & (F.col("child") != "")))
        # children of equal counts are one row, so a window holds as many rows as a node has kinds of counts
        order = W.partitionBy(*node).orderBy(share(F.col("cb"), F.col("ck")), "ck")
        kinds = told.where("apart").groupBy(*node, "ck", "cb").agg(F.count(F.lit(1)).alias("m"))
        first = F.coalesce(differ(F.col("cb"), F.col("ck"), F.lag("cb").over(order), F.lag("ck").over(order)), F.lit(True))
        runs = kinds.withColumn("first", first.cast("int")).withColumn("run", F.sum("first").over(order))
        runs = runs.withColumn("m", F.sum("m").over(W.partitionBy(*node, "run"))).select(*node, "ck", "cb", "run", "m")
        named = told.join(runs, [*node, "ck", "cb"], "left")
        seg = F.when(F.col("child") == "", F.col("child")).when(~F.col("apart"), "*").when(F.col("m") > 1, F.concat(F.lit("*"), "run")).otherwise(F.col("child"))
        names = named.select(*node, "child", seg.alias("seg"))
        done.append(each.where("child = ''").select(columns))
        grown = each.where("child != ''").join(names, [*node, "child"]).withColumn("template", F.concat("template", F.lit("/"), "seg"))
        level = cut(grown.select(*columns, (F.col("at") + 1).alias("at")))
    every = reduce(DataFrame.unionByName, [*done, _settled(cut(reduce(DataFrame.unionByName, settling)))] if settling else [level.select(columns)])
    level = cut(every)
    per = level.groupBy("host", "template").agg(F.sum("k").alias("k"), F.sum("bad").alias("bad"))
    hosts = per.groupBy("host").agg(F.sum("k").alias("hk"), F.sum("bad").alias("hb"))
    base = hosts.agg(((F.sum("hb") + 1) / (F.sum("hk") + 2)).alias("base"))
    host_share = (F.col("hb") + prior * F.col("base")) / (F.col("hk") + prior)
    purity = (F.col("bad") + prior * host_share) / (F.col("k") + prior)
    scored = per.join(hosts, "host").crossJoin(F.broadcast(base)).select("host", "template", purity.alias("purity"))
    return level.select("host", "shape", "template").join(scored, ["host", "template"])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict) of every row.

    The verdicts of the rules are the labels of the templates, which judge
    whatever no rule fits.  A null url, or one without `://`, has an empty host
    and path.  Repeated rows and null ids stay, extra columns are left out, an
    empty table gives an empty one.  A path of any depth is a path.  The tree
    is broadcast if its texts are measured to fit `SMALL` bytes.
    """
    require(pages, id_col, url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("path")))
    label = F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == "block").cast("int"))
    tree = cut(templates(ruled.select("host", "shape", label.alias("label"))))
    size = F.length("host") + F.length("template") + F.aggregate("shape", F.lit(0), lambda n, s: n + F.length(s) + 16) + 64
    if (tree.agg(F.sum(4 * size)).first()[0] or 0) <= SMALL:
        tree = F.broadcast(tree)
    verdict = F.coalesce("fit.verdict", F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.join(tree, ["host", "shape"], "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), "template", "purity", verdict.alias("verdict")
    )
