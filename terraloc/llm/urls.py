"""URL filter: a path-template tree for each host, with templates rejected by smoothed labelled purity.

Rules over (host, path) label urls: block or allow. Each path is first reduced to its shape (numbers, hexadecimal
strings and dates become classes), and pages are counted by host and shape; all that follows works on these counts.

Top down, segment by segment until no path has one left: a segment that holds less than KEEP of its parent's pages, or
under LEAST of them, is a variable one and becomes the wildcard; pages below wildcards of one parent are counted
together from then on. Bottom up, from the deepest segment to the host: branches are whole if all labelled templates
below them have merged; whole sibling branches, put in the order of their shares of blocked pages, are merged where
neighbours' shares can't be told apart (a two-sample z under MERGE_Z), and pool their labels. A path that ends where
others go on ends in a branch of its own. Branches without labels can't be told apart either: they all count as one
without any evidence. A template's purity is (blocked + PRIOR * overall share) / (labelled + PRIOR) over the pages it
has merged with; a url that no rule fits is blocked if its template's purity is over LIMIT, and allowed else.

Classes and the wildcard stand in braces ({n}, {*}), and a brace of the url itself is doubled, so that no literal
segment looks like them.

Only DataFrame functions are used. Each level is a job over what is left; paths in nodes of under LEAST pages end at
once, as all below are wildcards, so that levels number as many as the deepest path of which LEAST pages share the node.
Defined cases: null urls and urls without :// have an empty host and path, no rule, and the empty host's template; rows
without a page_id keep their null; repeated rows are judged alike and count each; an empty table gives an empty result;
columns other than page_id and url aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloc.llm.common import discard, hot_join, save, table

#: Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
KEEP = 0.05
LEAST = 3
MERGE_Z = 1.64
PRIOR = 4.0
LIMIT = 0.8
ANY = "{*}"
END = "{end}"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path with a class for each number, date, hexadecimal string and long string of a segment."""
    path = F.replace(path, F.lit("{"), F.lit("{{"))
    for pattern, to in (
        (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "{uuid}"),
        (r"\d{4}-\d{2}-\d{2}", "{date}"),
        (r"(?<![0-9a-zA-Z])(?=[0-9a-f]*\d)[0-9a-f]{16,}(?![0-9a-zA-Z])", "{hex}"),
        (r"\d+", "{n}"),
        (r"[^/]{40,}", "{long}"),
    ):
        path = F.regexp_replace(path, pattern, to)
    return path


def generalized(counts: DataFrame) -> DataFrame:
    """counts: a saved table of host, shape, n, labelled, blocked. Adds template to it."""
    found = []
    after = F.slice(F.split("shape", "/"), 2, 1 << 30)
    live = counts.withColumn("template", F.lit("")).withColumn("rest", after)
    key = ["host", "template"]
    while True:
        live = save(live, "level")
        found.append(live.filter(F.size("rest") == 0).drop("rest"))
        deeper = live.filter(F.size("rest") > 0).withColumn("segment", F.col("rest")[0])
        own = deeper.groupBy(*key, "segment").agg(F.sum("n").alias("own"), F.count("*").alias("rows"))
        nodes = save(own.groupBy(*key).agg(F.sum("own").alias("all"), F.sum("rows").alias("rows"), F.count("*").alias("segments")), "nodes")
        if nodes.isEmpty():
            break
        # The nodes' rows are here the segments below them.
        many = hot_join(own.drop("rows").filter(F.col("own") >= LEAST), nodes.select(*key, "all", F.col("segments").alias("rows")), key)
        literal = many.filter(F.col("own") >= KEEP * F.col("all")).groupBy(*key).agg(F.collect_list("segment").alias("literal"))  # 1 / KEEP at most
        judged = save(nodes.drop("segments").join(literal, key, "left"), "judged")
        step = F.when(F.array_contains("literal", F.col("segment")), F.col("segment")).otherwise(ANY)
        over = F.col("all") < LEAST
        ended = F.concat("template", F.repeat(F.lit("/" + ANY), F.size("rest")))
        rest = F.when(over, F.slice("rest", 1, 0)).otherwise(F.slice("rest", 2, 1 << 30))
        live = hot_join(deeper, judged, key).select("host", "shape", "n", "labelled", "blocked", F.when(over, ended).otherwise(F.concat("template", F.lit("/"), step)).alias("template"), rest.alias("rest"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def pooled(leaves: DataFrame) -> DataFrame:
    """leaves: host, template, labelled, blocked, each template once. host, template, labels, blocks of labelled templates: those of all that they have merged with."""
    units = leaves.filter("labelled > 0").withColumn("path", F.concat(F.slice(F.split("template", "/"), 2, 1 << 30), F.array(F.lit(END))))
    units = save(units.withColumn("unit", F.concat_ws("/", "path")).select("host", "template", "path", "unit", "labelled", "blocked"), "units")
    for depth in range(units.agg(F.max(F.size("path"))).first()[0] or 0, 0, -1):
        node, parent = (F.concat_ws("/", F.slice("path", 1, k)).alias(name) for k, name in ((depth, "node"), (depth - 1, "parent")))
        deep = units.filter(F.size("path") >= depth).withColumn("node", node)
        whole = deep.groupBy("host", "node").agg(F.min(parent).alias("parent"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.min("unit").alias("low"), F.max("unit").alias("high"))
        whole = whole.filter("low = high").withColumn("p", F.col("b") / F.col("l"))
        # Siblings number at most 1 / KEEP, a wildcard and an end, so these windows are short.
        order = Window.partitionBy("host", "parent").orderBy("p", "node")
        p, n = F.lag("p").over(order), F.lag("l").over(order)
        both = (F.col("p") * F.col("l") + p * n) / (F.col("l") + n)
        apart = F.sqrt(F.greatest(both * (1 - both), F.lit(1e-4)) * (1 / F.col("l") + 1 / n))
        cut = F.when(p.isNull() | ((F.col("p") - p) / apart >= MERGE_Z), 1).otherwise(0)
        branch = whole.withColumn("cut", cut).withColumn("branch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # A merged branch is named after its parent and its place there; ends of names can't be segments.
        name = F.concat_ws("/", F.when(F.col("parent") != "", F.col("parent")), F.concat(F.lit("{branch "), F.col("branch"), F.lit("}")))
        named = branch.select("host", "node", name.alias("merged"))
        before, units = units, save(deep.join(named, ["host", "node"], "left").withColumn("unit", F.coalesce("merged", "unit")).drop("merged", "node").unionByName(units.filter(F.size("path") < depth)), "units")
        discard(before)
    sums = units.groupBy("host", "unit").agg(F.sum("labelled").alias("labels"), F.sum("blocked").alias("blocks"))
    return units.select("host", "template", "unit").join(sums, ["host", "unit"]).drop("unit")


def templates(pages: DataFrame) -> DataFrame:
    """pages: host, shape, label (block, allow or null). host, shape, rows, template, purity for each host and shape."""
    counts = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("blocked"))
    counts = save(counts, "shapes")
    blocked, labelled = counts.agg(F.sum("blocked"), F.sum("labelled")).first()
    overall = blocked / labelled if labelled else 0.0
    tree = save(generalized(counts), "tree")
    leaves = save(tree.groupBy("host", "template").agg(F.count("*").alias("rows"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "leaves")
    judged = leaves.select("host", "template", "rows").join(pooled(leaves.drop("rows")), ["host", "template"], "left")
    zero = F.lit(0)
    purity = (F.coalesce("blocks", zero) + PRIOR * overall) / (F.coalesce("labels", zero) + PRIOR)
    judged = save(judged.select("host", "template", "rows", purity.alias("purity")), "judged")
    return hot_join(tree.select("host", "shape", F.col("n"), "template"), judged, ["host", "template"]).withColumnRenamed("n", "rows")


def judge(pages: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages."""
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, label = by_rule(F.col("host"), F.col("path"), rules)
    cut = cut.withColumn("rule", rule).withColumn("label", label).withColumn("shape", shape(F.col("path")))
    found = save(templates(cut), "templates")
    out = hot_join(cut, found, ["host", "shape"])
    verdict = F.coalesce("label", F.when(F.col("purity") > limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
