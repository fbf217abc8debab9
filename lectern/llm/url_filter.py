"""URL filters: rules first, then a path-template tree for each host.

The tree grows level by level from counts of distinct paths. A segment that looks
like a number or a hex string, or that few of its parent's URLs have, becomes a
wildcard. Branches of one shape whose labelled block rates do not differ from the
pooled rate of those before are merged, a template is rejected if the
smoothed share of block labels is high enough.
"""

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import table, written

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A literal segment has at least this many URLs, and this share of its parent's.
LEAST_COUNT, LEAST_SHARE = 5, 0.01
#: Weight of the overall block rate in a template's rate, and the rate from which it is rejected.
SMOOTHING, REJECT = 10.0, 0.8
#: Two block rates differ if they are so many standard errors apart.
DIFFER = 1.96
#: Steps into which a block rate is cut when branches are put in order.
RATES = 1000


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Name (host and path) of the longest rule that fits; null if none does."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(fits(h, p), F.lit(h + p)) for h, p, _ in ordered])


def shape_of(path: Column) -> Column:
    """The path with numbers and hex strings as wildcards; a file ending stays."""
    numbers = F.regexp_replace(path, r"(?<=/)\d+(?=$|/|\.[A-Za-z]{1,5}$)", "{n}")
    return F.regexp_replace(numbers, r"(?<=/)(?=[0-9a-fA-F-]*\d)[0-9a-fA-F-]{8,}(?=$|/|\.[A-Za-z]{1,5}$)", "{x}")


def templates(counts: DataFrame, least_count: int = LEAST_COUNT, least_share: float = LEAST_SHARE) -> DataFrame:
    """counts (host, shape, n, ...) with a column `template`: the shape with rare segments as `*`.

    The tree grows a level at a time, to the longest path. A branch with fewer than least_count URLs can have no literal
    below it, so that its paths are finished at once; there are as many rounds as the deepest branch of more URLs has levels.
    """
    p = written(counts.withColumns({"segments": F.slice(F.split("shape", "/"), 2, 1 << 30), "template": F.lit("")}), "paths")
    done, level = None, 0
    while True:
        here = p.withColumn("segment", F.get("segments", F.lit(level)))
        kids = here.where("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("kid"))
        total = kids.groupBy("host", "template").agg(F.sum("kid").alias("total"))
        kids = kids.join(total, ["host", "template"]).withColumn("literal", (F.col("kid") >= least_count) & (F.col("kid") >= F.col("total") * least_share))
        here = here.join(kids.select("host", "template", "segment", "total", "literal"), ["host", "template", "segment"], "left")
        small = F.col("total") < least_count
        rest = F.concat("template", F.repeat(F.lit("/*"), F.size("segments") - level))
        name = F.concat("template", F.lit("/"), F.when(F.col("literal"), F.col("segment")).otherwise(F.lit("*")))
        ended = F.col("segment").isNull()
        here = here.withColumns({"template": F.when(ended, F.col("template")).when(small, rest).otherwise(name), "open": ~(ended | F.coalesce(small, F.lit(False)))})
        here = written(here.drop("segment", "literal", "total"), "paths")
        closed = here.where("not open").drop("segments", "open")
        done = closed if done is None else done.unionByName(closed)
        p, level = here.where("open").drop("open"), level + 1
        if p.isEmpty():
            return done


def _cuts(rates: Column) -> Column:
    """The rates at which a group begins, from the sorted rates (step, l, b) of the branches of one form.

    In order of rate a branch joins the group before it unless its rate is above the pooled rate of all in that group by
    more than chance; so a ladder of small steps does not end in one group.
    """
    start = F.struct(F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("b"), F.array().cast("array<int>").alias("cuts"))

    def step(s, x):
        pool = (s["b"] + x["b"]) / (s["l"] + x["l"])
        error = F.sqrt(pool * (1 - pool) * (1 / s["l"] + 1 / x["l"]))
        apart = (s["l"] == 0) | (x["b"] / x["l"] - s["b"] / s["l"] > F.lit(DIFFER) * error)
        return F.when(apart, F.struct(x["l"].alias("l"), x["b"].alias("b"), F.concat(s["cuts"], F.array(x["step"])).alias("cuts"))).otherwise(F.struct((s["l"] + x["l"]).alias("l"), (s["b"] + x["b"]).alias("b"), s["cuts"].alias("cuts")))

    return F.aggregate(rates, start, step, lambda s: s["cuts"])


def judged(leaves: DataFrame, smoothing: float = SMOOTHING, reject: float = REJECT) -> DataFrame:
    """(host, template, branch, purity, rejected) from leaves (host, template, labelled, blocked).

    Templates of a host whose literals stand in the same places are branches that can merge: in order of their block
    rate, a branch joins the group before it unless its rate differs from the group's pooled one by more than chance.
    Rates are told apart by steps of 1 / RATES, so that a form has at most RATES + 1 of them. Branches without labels
    merge with each other only, and have the overall rate.
    """
    labelled, blocked = leaves.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    overall = (blocked + 1) / (labelled + 2)
    form = F.regexp_replace("template", r"(?<=/)(?!\*|\{)[^/]+", "_")
    known = F.col("labelled") > 0
    x = leaves.withColumns({"form": form, "step": F.when(known, F.floor(F.col("blocked") * RATES / F.col("labelled"))).otherwise(-1).cast("int")})
    rates = written(x.groupBy("host", "form", "step").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")), "rates")
    # a form without labels has no cuts
    cuts = rates.where("l > 0").groupBy("host", "form").agg(_cuts(F.sort_array(F.collect_list(F.struct("step", "l", "b")))).alias("cuts"))
    groups = rates.join(cuts, ["host", "form"], "left").withColumn("branch", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("step"))), F.lit(0)))
    pooled = groups.groupBy("host", "form", "branch").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.collect_list("step").alias("steps"))
    purity = (F.col("b") + F.lit(smoothing * overall)) / (F.col("l") + F.lit(smoothing))
    pooled = pooled.select("host", "form", "branch", F.explode("steps").alias("step"), purity.alias("purity"), ((F.col("l") > 0) & (purity >= reject)).alias("rejected"))
    return x.join(pooled, ["host", "form", "step"]).select("host", "template", F.concat_ws("#", "form", "branch").alias("branch"), "purity", "rejected")


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, label: str | None = None) -> DataFrame:
    """pages with columns host, path, rule, template, verdict (`allow` or `block`).

    A rule's verdict stands. Other URLs are blocked if their path template is rejected. Labels are the verdicts of the
    rules or, if named, of the column `label` (`allow`, `block` or null). Null URLs, and those without `://`, have an
    empty host and path. Columns of these names in pages are replaced.
    """
    added = ("host", "path", "rule", "template", "verdict")
    x = pages.drop(*[c for c in added if c != url])
    x = x.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_shape", shape_of(F.col("path")))
    by_rule = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("rule") == h + p, F.lit(v)) for h, p, v in rules])
    given = F.col(label) if label else by_rule
    counts = x.groupBy("host", F.col("_shape").alias("shape")).agg(F.count("*").alias("n"), F.count(given).alias("labelled"), F.count(F.when(given == "block", 1)).alias("blocked"))
    named = written(templates(counts), "named")
    leaves = written(named.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "leaves")
    found = written(named.select("host", "shape", "template").join(judged(leaves), ["host", "template"]).select(F.col("host").alias("_host"), F.col("shape").alias("_s"), "template", "rejected"), "judged")
    x = x.join(found, (F.col("host") == F.col("_host")) & (F.col("_shape") == F.col("_s")), "left")
    verdict = F.coalesce(by_rule, F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return x.withColumn("verdict", verdict).drop("_host", "_s", "_shape", "rejected")


def query(spark, sf_dir):
    found = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template")
