"""URL filters by a path-template tree for each host.

Paths are cut into segments; a segment that is a number, a hex string or the like becomes a
wildcard. Level by level, as far as levels branch, branches under one node merge if their children and their labels are
distributed like those of its other branches; labels count a host's own URLs that a rule decides
and, with a bounded weight, those of the same branch at other hosts. Every template's labelled URLs give a
smoothed share of allowed ones, with the host's, the same template's at all hosts and the whole
table's share as priors, and templates under a purity are blocked. All tables are counts of
templates, pre-aggregated before each shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: (rule, verdict); a rule is a host and a path's start.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Branches merge if the shares of their children (total variation) differ by less than this from those of all
#: branches of the node, and the share of their allowed URLs from that of the other ones, up to sampling error.
ALIKE = 0.25
#: Weight of a prior, and most weight of other hosts' labels, in labelled URLs, and the purity under which a template is blocked.
PRIOR, PURITY = 4.0, 0.4
#: A variable segment; merged branches.
ANY, MERGED = "*", "{}"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a parent domain and the path's start; else null."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def segments(path: Column) -> Column:
    """The path's segments with variable ones as wildcards; a file ending and a last slash stay."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(
        parts,
        lambda s: F.regexp_replace(
            F.regexp_replace(s, r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,}|[A-Za-z_-]*[0-9][A-Za-z0-9_-]{5,})(?=$|\.)", ANY), r"^([A-Za-z]+[-_])[0-9]+$", r"$1*"
        ),
    )


#: Levels whose finished templates are gathered in one table.
GATHER = 16


def templates(urls: DataFrame, base: float) -> DataFrame:
    """(host, shape) -> template, n, good, bad from rows (host, shape, _label).

    ``shape`` is an array of segments, ``base`` the whole table's share of allowed URLs; the result has one
    row per host and shape. A level has only the nodes that still hold two shapes or more, so long
    paths end where they stand alone; levels at which no node branches and no shape ends are passed in one step, for a
    single branch keeps its name. Each level is written once in the shared folder and read again, so plans stay small.
    """
    count = lambda v: F.count_if(F.col("_label") == v)
    shapes = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), count("allow").alias("good"), count("block").alias("bad"))
    tree = written(shapes.withColumn("template", F.array().cast("array<string>")), "templates")
    done, level = [], 0
    while True:
        ahead = F.slice("shape", level + 1, F.greatest(F.lit(0), F.size("shape") - level))
        # Counts are written before they are joined, here and below, so that a node with very many shapes can be split between tasks.
        size = written(tree.groupBy("host", "template").agg(F.count("*").alias("_size"), F.min(ahead).alias("_low"), F.max(ahead).alias("_high")), "templates")
        # What the first and the last shape in order share, all between them share; shapes of merged branches can be equal from here on.
        unlike = F.array_position(F.zip_with("_low", "_high", lambda a, b: ~a.eqNullSafe(b)), True)
        shared = size.where("_size > 1").agg(F.min(F.when(unlike > 0, (unlike - 1).cast("int")).otherwise(F.size("_low")))).first()[0]
        if shared:
            tree = tree.withColumn("template", F.concat("template", F.slice("shape", level + 1, shared)))
            level += shared
            continue
        split = written(tree.join(size.select("host", "template", "_size"), ["host", "template"]).withColumn("_done", (F.col("_size") == 1) | (F.size("shape") <= level)).drop("_size"), "templates")
        done.append(split.where("_done").withColumn("template", F.concat("template", ahead)).drop("_done"))
        if len(done) == GATHER:
            done = [written(functools.reduce(DataFrame.unionByName, done), "templates")]
        tree = split.where("NOT _done").drop("_done")
        if tree.isEmpty():
            break
        tree = written(_level(tree, level, base), "templates")
        level += 1
    return functools.reduce(DataFrame.unionByName, done)


def _level(tree: DataFrame, level: int, base: float) -> DataFrame:
    """``tree`` with one more label in each template: the segment at ``level``, or MERGED."""
    node, branch = ["host", "template"], ["host", "template", "seg"]
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    tree = tree.withColumn("seg", F.get("shape", F.lit(level)))
    # One row for each node, branch and child of the branch; "" stands for no child.
    kinds = tree.groupBy(*branch, F.coalesce(F.get("shape", F.lit(level + 1)), F.lit("")).alias("child")).agg(*sums)
    kinds = written(kinds, "templates")
    own = kinds.groupBy(*branch).agg(*sums)
    # The same branch at all hosts; a host's own labels are taken off it.
    over_all = written(own.groupBy("template", "seg").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")), "templates")
    g, labelled = F.col("good"), F.col("good") + F.col("bad")
    others, others_n = F.col("all_good") - g, F.col("all_good") + F.col("all_bad") - labelled
    weight = F.least(F.lit(PRIOR), others_n)
    branches = own.join(over_all, ["template", "seg"]).select(
        *branch, "n", (g + weight * F.coalesce(F.try_divide(others, others_n), F.lit(0.0))).alias("allowed"), (labelled + weight).alias("known")
    )
    branches = written(branches, "templates")
    nodes = written(
        branches.groupBy(*node)
        .agg(F.count("*").alias("width"), F.sum("n").alias("node_n"), F.sum("allowed").alias("node_allowed"), F.sum("known").alias("node_known")),
        "templates",
    )
    pooled = kinds.groupBy(*node, "child").agg(F.sum("n").alias("pool_n"))
    of_branch, pool = F.col("child_n") / F.col("n"), F.col("pool_n") / F.col("node_n")
    # Total variation between a branch's children and those of all branches together:
    # children that only the others have count through 1 minus what is subtracted.
    apart = (
        kinds.select(*branch, "child", F.col("n").alias("child_n")).join(branches.select(*branch, "n"), branch)
        .join(pooled, [*node, "child"]).join(nodes.select(*node, "node_n"), node)
        .groupBy(*branch).agg(((1 + F.sum(F.abs(of_branch - pool) - pool)) / 2).alias("distance"))
    )
    same_children = F.col("distance") <= ALIKE + 1 / F.sqrt("n")
    # A branch's labels against those of the node's other branches.
    rest = (F.col("node_allowed") - F.col("allowed") + PRIOR * base) / (F.col("node_known") - F.col("known") + PRIOR)
    share = F.try_divide(F.col("allowed"), F.col("known"))
    same_labels = (F.col("known") == 0) | (F.abs(share - rest) <= ALIKE + F.try_divide(F.lit(1.0), F.sqrt("known")))
    merged = (F.col("width") > 1) & (F.col("seg") != ANY) & same_children & same_labels
    named = written(branches.join(nodes, node).join(apart, branch).select(*branch, F.when(merged, F.lit(MERGED)).otherwise(F.col("seg")).alias("label")), "templates")
    return tree.join(named, branch).select("host", "shape", "n", "good", "bad", F.concat("template", F.array("label")).alias("template"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, purity: float = PURITY) -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule, verdict, template, purity.

    Null urls and urls without "://" have empty host and path, no rule, and the verdict of
    their (empty) template. Repeated rows and null ids are kept.
    """
    decided = F.lit(None).cast("string")
    for rule, verdict in rules:
        decided = F.when(F.col("rule") == rule, verdict).otherwise(decided)
    rows = (
        pages.select(F.col(id_col), F.col(url_col).alias("_url"))
        .select(F.col(id_col), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
        .withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
        .withColumn("_label", decided).withColumn("shape", segments(F.col("path")))
    )
    # One row: the whole table's share of allowed among labelled URLs.
    allowed, known = rows.agg(F.count_if(F.col("_label") == "allow"), F.count("_label")).first()
    base = (allowed + 1) / (known + 2)
    tree = templates(rows.select("host", "shape", "_label"), base)
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    nodes = tree.groupBy("host", "template").agg(*sums)
    hosts = nodes.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    alike = nodes.groupBy("template").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    # Labels of the node's own host are in neither prior twice: first all hosts' template, then the host, then the node.
    smooth = lambda good, bad, prior: (good + PRIOR * prior) / (good + bad + PRIOR)
    of_template = smooth(F.col("all_good") - F.col("good"), F.col("all_bad") - F.col("bad"), F.lit(base))
    of_host = smooth(F.col("host_good") - F.col("good"), F.col("host_bad") - F.col("bad"), of_template)
    scored = nodes.join(written(hosts, "hosts"), "host").join(written(alike, "templates"), "template")
    scored = written(scored.select("host", "template", smooth(F.col("good"), F.col("bad"), of_host).alias("purity")), "purity")
    by_shape = tree.select("host", "shape", "template").join(scored, ["host", "template"])
    verdict = F.coalesce("_label", F.when(F.col("purity") < purity, "block").otherwise("allow"))
    return rows.join(by_shape, ["host", "shape"]).select(
        id_col, "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"
    )
