"""URL filters: subdomain and path-prefix rules first, then a path-template tree per host judged by smoothed labelled purity.

A host's paths are cut into segments. A place in the tree whose segments vary too much for their number becomes a wildcard;
sibling branches whose children and labels are alike are merged; each resulting template counts the labelled pages under it and is
rejected if its share of bad ones, smoothed towards the branches above it, its host and its domains, is too high. Counting is by grouped
sums, and what was counted for a hot host finds its way back by broadcast, so no task gets a host's paths as one group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.operators.skew import spread_join
from breakwater.plans.lineage import cut

#: (action, host and path prefix) of the filter's rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Levels of a path that are looked at; None for all.
DEPTH = None
VARIED = 0.2
FEW = 8
ALIKE = 0.9
PRIOR = 4.0
REJECT = 0.5


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return F.coalesce(_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action. A rule fits its host and all subdomains if the path starts with the rule's."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in reversed(ordered):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def _shape(segment: Column) -> Column:
    """What kind of segment it is, with digits and hexadecimal runs taken together."""
    return F.regexp_replace(F.regexp_replace(segment, r"[0-9a-fA-F]{8,}", "#"), r"[0-9]+", "#")


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", depth: int | None = DEPTH, varied: float = VARIED, few: int = FEW, alike: float = ALIKE, prior: float = PRIOR, reject: float = REJECT) -> DataFrame:
    """Judge every page: ``page_id, host, path, rule, verdict, template, purity``.

    Paths are followed to their last segment, or to the first ``depth``.
    ``labels`` has ``page_id, bad`` (1 or 0); without it, pages that a rule blocks count as bad and those that one allows as good. At
    each depth a segment stays itself if its branch (host and template so far) has at most ``few`` different segments, or fewer
    than ``varied`` times its pages; otherwise its shape with digits wild (``#``) takes its place, or ``*`` if those vary too.
    Branches of one parent, at every level, are merged when they are alike: all bad (a share over ``reject``), all good or all without
    labels, their share within ``2 * (1 - alike)`` of the pooled one of their kind, and the distributions of what lies below them with
    a cosine of ``alike`` or more with the parent's mean distribution.

    A branch's purity is (bad + prior * p) / (labelled + prior), with p the purity of the branch above it. Above a host's root are its
    domains from the widest on, and above these the share of bad labels over all pages; what comes from above the host counts as
    ``reject`` at most, so a host without bad labels of its own is not rejected. A template is rejected if its purity, rounded to six
    digits, exceeds ``reject``. Null urls have an empty host and path and are allowed. Rows that repeat give equal rows; other columns
    of ``pages`` are left out.
    """
    url = F.col(f"`{url_col}`").cast("string")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("__url")).select("page_id", *(c.alias(n) for c, n in zip(split_url(F.col("__url")), ("host", "path"), strict=True)))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "__action": action})
    if labels is None:
        base = base.withColumn("__bad", F.when(F.col("__action").isNotNull(), (F.col("__action") == "block").cast("int")))
    else:
        base = base.join(labels.groupBy(F.col("page_id").alias("__lid")).agg(F.max("bad").cast("int").alias("__bad")), F.col("page_id") == F.col("__lid"), "left").drop("__lid")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    segments = segments if depth is None else F.slice(segments, 1, depth)
    base = cut(base.withColumn("__segments", segments))
    # Paths meet here first: from now on one row for each host and path prefix, with its pages and labels.
    paths = cut(base.groupBy("host", "__segments").agg(F.count("*").alias("pages"), F.count("__bad").alias("labelled"), F.sum(F.coalesce("__bad", F.lit(0))).alias("bad")))
    tree = cut(_templates(paths, varied, few))
    templates = cut(tree.groupBy("host", "template").agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in ("pages", "labelled", "bad"))))
    merged = cut(_merge_alike(templates.drop("rows"), alike, reject))
    pure = _purities(merged, prior, reject)
    of_template = cut(templates.select("host", "template", "rows").join(merged.select("host", "template", "merged"), ["host", "template"]).join(pure, ["host", "merged"]))
    of_path = spread_join(tree.select("host", "__segments", "template"), of_template, ["host", "template"], "rows")
    of_path = cut(of_path.select("host", "__segments", F.col("merged").alias("template"), "purity").join(paths.select("host", "__segments", "pages"), ["host", "__segments"]))
    out = spread_join(base, of_path, ["host", "__segments"], "pages")
    verdict = F.coalesce("__action", F.when(F.col("purity") > reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def _open(rows: DataFrame, at: list[str], segments: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those of branches (``at``) some level of whose ``segments`` has more than ``most`` different ones, and the others.

    What a level of a branch has bounds what that level has anywhere below the branch, so nothing is left to decide for the others.
    """
    each = rows.select(*at, F.posexplode(segments).alias("__level", "__one"))
    wide = cut(each.groupBy(*at, "__level").agg(F.count_distinct("__one").alias("__n")).where(F.col("__n") > most).select(*at).distinct())
    return rows.join(wide, at, "left_semi"), rows.join(wide, at, "left_anti")


def _closing(level: int) -> bool:
    """Whether branches with nothing left to decide are looked for at this level: at the fourth and at every doubling of it.

    So a path of any length, or a loop that a crawler ran in, costs as many rounds as its tree has real forks, not a round a segment.
    """
    return level >= 4 and level & (level - 1) == 0


def _together(done: list[DataFrame]) -> list[DataFrame]:
    """``done``, written as one table once it has 16 parts, so that the plan stays short."""
    return done if len(done) < 16 else [cut(reduce(DataFrame.unionByName, done))]


def _templates(paths: DataFrame, varied: float, few: int) -> DataFrame:
    """``paths`` with their template, level by level; each level is written, as it is read twice by the next one."""
    columns = ["host", "__segments", "template", "pages", "labelled", "bad"]
    tree, done, level = paths.withColumn("template", F.lit("")).select(columns), [], 0
    while True:
        # Paths that end here have their template; only the others go on.
        done = _together([*done, tree.where(F.size("__segments") <= level)])
        tree = tree.where(F.size("__segments") > level)
        if _closing(level):
            rest = F.slice("__segments", F.lit(level + 1), F.size("__segments"))
            tree, closed = _open(tree, ["host", "template"], rest, few)
            tree, closed = cut(tree.select(columns)), closed.withColumn("template", F.concat_ws("/", "template", rest))
            done.append(cut(closed.select(columns)))
        if tree.isEmpty():
            return reduce(DataFrame.unionByName, done)
        segment = F.get("__segments", F.lit(level))
        tree = tree.withColumn("__segment", segment).withColumn("__kind", _shape(segment))
        branches = tree.groupBy("host", "template", "__kind", "__segment").agg(F.sum("pages").alias("n"), F.count("*").alias("rows"))
        kinds = branches.groupBy("host", "template", "__kind").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.count("*").alias("distinct"))
        nodes = kinds.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.sum("distinct").alias("distinct"), F.count("*").alias("kinds"))
        free = lambda d: (F.col(d) > few) & (F.col(d) > varied * F.col("n"))
        nodes = cut(nodes.select("host", "template", "rows", free("distinct").alias("__vary"), free("kinds").alias("__vary_kinds")))
        tree = spread_join(tree, nodes, ["host", "template"], "rows")
        step = F.when(F.col("__vary") & F.col("__vary_kinds"), F.lit("/*")).when(F.col("__vary"), F.concat(F.lit("/"), "__kind")).otherwise(F.concat(F.lit("/"), "__segment"))
        tree = cut(tree.withColumn("template", F.concat("template", step)).select(columns))
        level += 1


def _merge_alike(templates: DataFrame, alike: float, reject: float) -> DataFrame:
    """Give sibling branches whose children and labels are alike one name (``+bad``, ``+good`` or ``+none``), at every level from the root down.

    Branches that are merged are one parent from then on: their children are pooled, and compared with that parent's mean. A branch
    that is like no sibling keeps its name.
    """
    at, total = ["host", "merged"], lambda *names: (F.sum(c).alias(c) for c in names)
    parts = cut(templates.select("*", F.lit("").alias("merged"), F.expr("slice(split(template, '/'), 2, size(split(template, '/')))").alias("__rest")))
    done, level, columns = [], 0, parts.columns
    while True:
        done = _together([*done, parts.where(F.size("__rest") == 0)])
        parts = parts.where(F.size("__rest") > 0)
        if _closing(level):  # without two branches at any level below there are no siblings to merge
            parts, closed = _open(parts, at, F.col("__rest"), 1)
            parts = cut(parts.select(columns))
            done.append(cut(closed.withColumn("merged", F.concat_ws("/", "merged", "__rest")).select(columns)))
        if parts.isEmpty():
            return reduce(DataFrame.unionByName, done).drop("__rest")
        level += 1
        parts = parts.withColumns({"__own": F.get("__rest", F.lit(0)), "__rest": F.expr("slice(__rest, 2, size(__rest))")})
        branch = parts.groupBy(*at, "__own").agg(*total("bad", "labelled"))
        children = parts.groupBy(*at, "__own", "__rest").agg(*total("pages"))
        mean = children.groupBy(*at, "__rest").agg(F.sum("pages").alias("__all"))
        norm = mean.groupBy(*at).agg(F.sqrt(F.sum(F.col("__all").cast("double") * F.col("__all"))).alias("__norm"))
        dots = children.join(mean, [*at, "__rest"]).groupBy(*at, "__own").agg(F.sum(F.col("pages").cast("double") * F.col("__all")).alias("__dot"), F.sqrt(F.sum(F.col("pages").cast("double") * F.col("pages"))).alias("__size"))
        kind = F.when(F.col("labelled") == 0, F.lit("none")).otherwise(F.when(F.col("bad") > reject * F.col("labelled"), F.lit("bad")).otherwise(F.lit("good")))
        signs = branch.join(dots, [*at, "__own"]).join(norm, at).where(F.col("__dot") >= alike * F.col("__size") * F.col("__norm")).withColumn("__group", kind)
        pooled = signs.groupBy(*at, "__group").agg(F.sum("bad").alias("__bad"), F.sum("labelled").alias("__labelled"))
        near = F.abs(F.col("bad") * F.col("__labelled") - F.col("__bad") * F.col("labelled")) <= 2 * (1 - alike) * F.col("labelled") * F.col("__labelled")
        signs = signs.join(pooled, [*at, "__group"]).where(near).select(*at, "__own", "__group")
        shared = signs.groupBy(*at, "__group").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
        names = signs.join(shared, [*at, "__group"]).select(*at, "__own", F.concat(F.lit("+"), "__group").alias("__name"))
        named = parts.join(names, [*at, "__own"], "left").withColumn("merged", F.concat("merged", F.lit("/"), F.coalesce("__name", "__own")))
        parts = cut(named.select(columns))


def _purities(merged: DataFrame, prior: float, reject: float) -> DataFrame:
    """``host, merged, purity`` of each merged template, smoothed along the branches above it.

    A template's line goes from its widest domain through its host's root down to itself; every branch on it is counted once over all
    pages, and the line's counts are folded into one number. Lines are as long as hosts and paths have parts; branches go by digests of
    their paths, so that a line's size does not grow with the square of its parts.
    """
    leaves = cut(merged.groupBy("host", "merged").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")))
    share = leaves.agg(F.least(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)), F.lit(reject)).alias("b")).first()["b"]
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("at"), F.array_join(F.slice(parts, F.size(parts) - k + 1, k), ".").alias("name")))
    steps = F.split("merged", "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct((F.lit(1_000_000) + k).alias("at"), F.md5(F.concat("host", F.lit("/"), F.array_join(F.slice(steps, 2, k - 1), "/")).cast("binary")).alias("name")))
    line = F.concat(domains, paths)
    lines = leaves.select("host", "merged", "bad", "labelled", F.explode(line).alias("x")).select("host", "merged", "bad", "labelled", "x.at", "x.name")
    lines = cut(lines)
    counts = cut(lines.groupBy("at", "name").agg(F.sum("bad").alias("n_bad"), F.sum("labelled").alias("n_labelled"), F.count("*").alias("rows")))
    known = spread_join(lines.select("host", "merged", "at", "name"), counts, ["at", "name"], "rows")
    # A host is one of the names under its own domain too, but its line goes on from the domain above with its root.
    folded = known.where("NOT (at < 1000000 AND name = host)").groupBy("host", "merged").agg(F.array_sort(F.collect_list(F.struct("at", "n_bad", "n_labelled"))).alias("line"))

    def down(p: Column, x: Column) -> Column:
        above = F.when(x["at"] == 1_000_001, F.least(p, F.lit(reject))).otherwise(p)
        return (x["n_bad"] + prior * above) / (x["n_labelled"] + prior)

    purity = F.aggregate("line", F.lit(float(share)), down)
    return folded.select("host", "merged", F.round(purity, 6).alias("purity"))
