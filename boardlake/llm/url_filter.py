"""URL filters: domain rules, then a per-host tree of path templates judged by labelled purity.

Every URL is split into host and path. Rules settle what they fit. They are also the labels of
the tree: the URLs that a rule settles say how clean a template is, the others get the verdict
of their template.

The tree of a host: segments that are numbers or long codes become ``{n}`` and ``{x}``; a
position whose children are mostly distinct becomes ``*``; first-level branches whose suffix
distribution is close to that of the whole host are merged into one ``*`` branch. A template is
rejected when its smoothed share of blocked labels reaches ``threshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlake.llm.common import ascii_lower, stored

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block")]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _pick(host: Column, path: Column, rules: list[tuple[str, str]], what: int) -> Column:
    """The longest fitting rule; of equally long ones the one with the longer host."""
    out = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit((text, verdict)[what])).otherwise(out)
    return out


def path_shape(path: Column) -> Column:
    """Path with numbers and long codes generalised; empty segments are dropped."""
    tidy = F.regexp_replace(F.concat(F.lit("/"), path, F.lit("/")), "/+", "/")
    return F.regexp_replace(F.regexp_replace(tidy, r"/[0-9]+(?=[/.])", "/{n}"),
                            r"/(?=[0-9a-f-]*[0-9])[0-9a-f-]{8,}(?=[/.])", "/{x}")


def template_tree(shapes: DataFrame, variable: float = 0.5, least: int = 8, near: float = 0.25) -> DataFrame:
    """Add ``template`` to rows (host, shape, n): generalise variable positions, merge like branches.

    ``variable``: a position with at least ``least`` URLs and more than this share of distinct
    children is a wildcard. ``near``: largest L1 distance, besides sampling slack, between the suffix
    distribution of a branch and of its host for a merge. Branches are compared with the pooled
    distribution, never in pairs.
    """
    parts = F.filter(F.split("shape", "/"), lambda s: s != "")
    kinds = F.transform("parts", lambda s: F.when(s.startswith("{"), s).otherwise(F.lit("w")))
    rows = shapes.withColumn("parts", parts).withColumn("kinds", kinds)
    step = rows.select("host", "shape", "n", "parts", "kinds", F.posexplode("parts").alias("depth", "segment"))
    # One node for each place: the kinds of the segments above it and the first segment's text.
    step = step.select("host", "shape", "n", "depth", "segment",
                       F.concat_ws("/", F.when(F.col("depth") > 0, F.element_at("parts", 1)),
                                   F.slice("kinds", 1, F.col("depth"))).alias("above"))
    children = step.groupBy("host", "above", "depth", "segment").agg(F.sum("n").alias("n"))
    nodes = children.groupBy("host", "above", "depth").agg(F.sum("n").alias("n"), F.count("*").alias("children"))
    wild = nodes.where((F.col("n") >= least) & (F.col("children") > F.col("n") * variable)).select(
        "host", "above", "depth", F.lit(True).alias("wild"))
    named = step.join(stored(wild, "url-wild"), ["host", "above", "depth"], "left").select(
        "host", "shape", F.struct("depth", F.when(F.col("wild"), F.lit("*")).otherwise(F.col("segment"))
                                  .alias("segment")).alias("at"))
    # A group is one path: as many rows as it has segments.
    paths = named.groupBy("host", "shape").agg(
        F.transform(F.array_sort(F.collect_list("at")), lambda a: a["segment"]).alias("names"))
    full = shapes.join(paths, ["host", "shape"], "left").withColumn(
        "names", F.coalesce("names", F.array().cast("array<string>")))
    split = full.withColumn("branch", F.coalesce(F.get("names", F.lit(0)), F.lit(""))).withColumn(
        "suffix", F.concat_ws("/", F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0)))))
    split = stored(split.drop("names"), "url-paths")
    cells = split.groupBy("host", "branch", "suffix").agg(F.sum("n").alias("n"))
    pooled = cells.groupBy("host", "suffix").agg(F.sum("n").alias("all_n"))
    hosts = cells.groupBy("host").agg(F.sum("n").alias("host_n"))
    branches = cells.groupBy("host", "branch").agg(F.sum("n").alias("branch_n"), F.count("*").alias("seen"))
    # |p - q| summed over all suffixes = 2 * sum of max(p - q, 0) over the suffixes of the branch.
    gap = F.greatest(F.col("n") / F.col("branch_n") - F.col("all_n") / F.col("host_n"), F.lit(0.0))
    far = (cells.join(branches, ["host", "branch"]).join(pooled, ["host", "suffix"]).join(hosts, "host")
           .groupBy("host", "branch").agg(F.round(2 * F.sum(gap), 9).alias("distance"), F.max("branch_n").alias("branch_n"),
                                          F.max("seen").alias("seen")))
    like = far.where(F.col("distance") <= near + F.sqrt(F.col("seen") / F.col("branch_n"))).select(
        "host", "branch", F.lit(True).alias("like"))
    merged = split.join(stored(like, "url-like"), ["host", "branch"], "left")
    top = F.when(F.col("like"), F.lit("*")).otherwise(F.col("branch"))
    return merged.select("host", "shape", F.concat_ws("/", top, F.col("suffix")).alias("template"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = 0.8,
               strength: float = 10.0, prior: float = 0.5, coverage: float = 0.5, variable: float = 0.5, least: int = 8, near: float = 0.25) -> DataFrame:
    """Return page_id, host, path, rule, verdict, template, purity for every row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path and belongs to the empty
    template. Repeated rows are judged alike and all returned; other columns of ``pages`` are not
    read; an empty table gives an empty result. ``purity`` = (blocked + strength * prior) / (labelled + strength)
    over the URLs of a template that a rule settles. A template is rejected when its purity reaches
    ``threshold`` and at least the share ``coverage`` of its URLs is labelled, so a few labelled URLs
    never reject many unlabelled ones, and a host without labels is allowed.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.select("*", _pick(F.col("host"), F.col("path"), rules, 0).alias("rule"),
                       _pick(F.col("host"), F.col("path"), rules, 1).alias("ruled"),
                       path_shape(F.col("path")).alias("shape"))
    shapes = stored(urls.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("ruled").alias("labelled"),
        F.count_if(F.col("ruled") == "block").alias("blocked")), "url-shapes")
    tree = template_tree(shapes.select("host", "shape", "n"), variable, least, near)
    known = stored(shapes.join(tree, ["host", "shape"]), "url-tree")
    sums = known.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"),
                                                 F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + F.lit(strength * prior)) / (F.col("labelled") + F.lit(strength))
    judged = sums.select("host", "template", purity.alias("purity"),
                         ((purity >= threshold) & (F.col("labelled") >= coverage * F.col("n"))).alias("rejected"))
    verdicts = stored(known.select("host", "shape", "template").join(judged, ["host", "template"]), "url-verdicts")
    return urls.join(verdicts, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        "template", "purity")
