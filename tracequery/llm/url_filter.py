"""URL filter: explicit rules, and a path-template tree learned per host.

Variable path segments (numbers, hashes, numbered names) become wildcards by their form; further ones
become wildcards where a node of the tree has many rare children. Labelled pages are counted at every node.
Below one parent, branches in the order of their share of bad pages are merged as long as neighbours do not
differ significantly. A template is rejected if its smoothed share of good pages, its merged branch's counts
with a prior from the tree above it, is too low. The prior is the smoothed mean over the parent's other
labelled branches, each counted once, and behind it what the parent's own merged siblings and the levels above say;
no page counts twice. So a template without labels is judged by its parents and its host: many bad branches
without a good one reject it, a large one alone does not.
Only DataFrame functions are used.

The tree is built over distinct templates of a host, not over pages. A node has at most ``MANY_CHILDREN``
children, or the frequent ones (``1 / RARE_SHARE``) and a wildcard, so no window over siblings is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, materialize

#: (rule, verdict): host and path that a url must fit; fixed values.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MAX_RULES = 2000
DEPTH = 4
MANY_CHILDREN = 24
RARE_SHARE = 0.05
PRIOR, PRIOR_WEIGHT = 0.5, 4.0
LEAST_PURITY = 0.3
Z = 1.96
BROADCAST_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (size, verdict, rule) or null; of equal rules a block wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    listed = []
    for rule, verdict in rules:
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        listed.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    if not listed:
        return F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    return F.array_max(F.filter(F.array(*listed), lambda r: r.isNotNull()))


def lexical_template(path: Column) -> Column:
    """Path segments with variable parts replaced by their form; from the ``DEPTH``-th on they are one, whole."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    shaped = F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^(?i)([0-9a-f]{8,}|[0-9a-f-]{32,36})$") & s.rlike("[0-9]"), F.lit("{hash}")).otherwise(F.regexp_replace(s, r"[0-9]+", "#")),
    )
    rest = F.array_join(F.slice(shaped, F.lit(DEPTH), F.greatest(F.size(shaped) - DEPTH + 1, F.lit(0))), "/")
    return F.when(F.size(shaped) > DEPTH, F.concat(F.slice(shaped, 1, DEPTH - 1), F.array(rest))).otherwise(shaped)


def generalise(templates: DataFrame) -> DataFrame:
    """Adds ``node``: ``parts`` with rare children of crowded nodes as ``*``, level by level from the root."""
    out = templates.withColumn("node", F.array().cast("array<string>"))
    for level in range(DEPTH):
        out = out.withColumn("seg", F.get("parts", F.lit(level)))
        children = out.where("seg IS NOT NULL").groupBy("host", "node", "seg").agg(F.sum("n").alias("c"))
        nodes = children.groupBy("host", "node").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > MANY_CHILDREN)
        rare = children.join(nodes, ["host", "node"]).where(F.col("c") < RARE_SHARE * F.col("all"))
        rare = rare.select("host", "node", "seg", F.lit(True).alias("rare"))
        out = out.join(rare, ["host", "node", "seg"], "left")
        step = F.when(F.col("rare"), F.lit("*")).otherwise(F.col("seg"))
        out = out.withColumn("node", F.when(F.col("seg").isNull(), F.col("node")).otherwise(F.concat("node", F.array(step)))).drop("seg", "rare")
    return out


def merged_branches(nodes: DataFrame) -> DataFrame:
    """Labelled nodes below the root with ``mg, mb``, the good and bad pages of all branches they merge with.

    Siblings stand in the order of their share of bad pages; neighbours whose shares do not differ by ``Z``
    standard errors are one branch.
    """
    out = nodes.where("size(node) > 0 AND g + b > 0").withColumn("parent", F.slice("node", F.lit(1), F.size("node") - 1))
    order = Window.partitionBy("host", "parent").orderBy(F.col("b") / (F.col("g") + F.col("b")), "node")
    out = out.withColumns({"pg": F.lag("g").over(order), "pb": F.lag("b").over(order)})
    n, m = F.col("g") + F.col("b"), F.col("pg") + F.col("pb")
    pooled = (F.col("b") + F.col("pb")) / (n + m)
    gap, error = F.abs(F.col("b") / n - F.col("pb") / m), F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    apart = F.coalesce((gap > Z * error).cast("int"), F.lit(0))
    out = out.withColumn("branch", F.sum(apart).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    same = Window.partitionBy("host", "parent", "branch")
    return out.select("host", "node", "parent", F.sum("g").over(same).alias("mg"), F.sum("b").over(same).alias("mb"))


def judged_templates(judged: DataFrame) -> DataFrame:
    """``host, parts, purity, evidence`` of the lexical templates of ``judged(host, parts, good)``, good null if
    unlabelled. ``evidence`` is ``template`` if the node has labelled pages, ``branch`` if only others of its
    host have, else ``none``."""
    good, bad = F.col("good"), ~F.col("good")
    leaves = judged.groupBy("host", "parts").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    leaves = materialize(generalise(materialize(leaves, "templates")), "tree")
    up = leaves.select("host", "good", "bad", "node", F.explode(F.sequence(F.lit(0), F.size("node"))).alias("l"))
    nodes = up.groupBy("host", F.slice("node", F.lit(1), F.col("l")).alias("node")).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    merged = merged_branches(nodes)
    share = F.col("mg") / (F.col("mg") + F.col("mb"))
    kids = merged.groupBy("host", F.col("parent").alias("node")).agg(F.sum(share).alias("s"), F.count(F.lit(1)).alias("k"))
    every = nodes.join(kids, ["host", "node"], "left").join(merged.drop("parent"), ["host", "node"], "left")
    every = materialize(every.na.fill(0, ["s", "k", "mg", "mb"]), "nodes")
    # From the root down: a node's prior from its parent's other branches, its purity, and what its merged siblings
    # alone say, which stands behind the priors of its children.
    known = every.where("size(node) = 0").select("host", "node", "s", "k", F.lit(PRIOR).alias("behind"), (F.col("g") + F.col("b") > 0).alias("host_known"))
    purity = None
    own, merged_n = F.col("g") + F.col("b"), F.col("mg") + F.col("mb")
    own_share = F.when(merged_n > 0, F.col("mg") / merged_n).otherwise(0.0)
    prior = (F.col("ps") - own_share + PRIOR_WEIGHT * F.col("above")) / (F.col("pk") - (own > 0).cast("int") + PRIOR_WEIGHT)
    for level in range(1, DEPTH + 1):
        above = known.select("host", F.col("node").alias("parent"), F.col("s").alias("ps"), F.col("k").alias("pk"), F.col("behind").alias("above"), "host_known")
        here = every.where(F.size("node") == level).withColumn("parent", F.slice("node", F.lit(1), F.lit(level - 1))).join(above, ["host", "parent"])
        here = here.withColumn("prior", prior).withColumn("purity", (F.col("mg") + PRIOR_WEIGHT * F.col("prior")) / (merged_n + PRIOR_WEIGHT))
        found = here.select("host", "node", "purity", F.when(own > 0, "template").when(F.col("host_known"), "branch").otherwise("none").alias("evidence"))
        purity = found if purity is None else purity.unionByName(found)
        behind = (F.col("mg") - F.col("g") + PRIOR_WEIGHT * F.col("prior")) / (merged_n - own + PRIOR_WEIGHT)
        known = here.select("host", "node", "s", "k", behind.alias("behind"), "host_known")
    return materialize(leaves.join(purity, ["host", "node"]).select("host", "parts", "purity", "evidence"), "purity")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, purity, decided_by`` of every row of ``pages(page_id, url)``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest decides. All
    other urls are judged by their host's template tree, learned from the pages that a rule decides
    and from ``labelled(page_id, good)`` if given: blocked if the template's ``purity`` is below
    ``LEAST_PURITY``. ``decided_by`` is ``rule``, or the tree's evidence (see :func:`judged_templates`); a
    template without any has the prior's purity and is allowed. Null urls and those without ``://`` have an
    empty host and path and are judged like any other template; repeated rows come back each; an empty table
    gives an empty result; further columns are ignored.
    """
    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cols = cols.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("parts", lexical_template(F.col("path")))
    judged = cols.select("page_id", "host", "parts", (F.col("best.verdict") == "allow").alias("good"))
    if labelled is not None:
        known = labelled.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.min("good").alias("known"))
        judged = judged.join(known, "page_id", "left").withColumn("good", F.coalesce("good", "known"))
    tree = judged_templates(judged)
    # A row per distinct template; broadcast where their texts are few bytes, else joined by a shuffle.
    size = tree.agg(F.sum(F.length("host") + F.length(F.array_join("parts", "/")) + 64)).first()[0] or 0
    tree = F.broadcast(tree) if size <= BROADCAST_BYTES else tree
    method = F.when(F.col("purity") < LEAST_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    decided = F.when(F.col("best").isNotNull(), "rule").otherwise(F.col("evidence"))
    return cols.join(tree, ["host", "parts"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), "purity", decided.alias("decided_by"))
