"""URL filters: rules for hosts and paths, and a tree of path templates for what no rule fits.

The tree. Under each host, a path's segments are followed one level at a time. Of the segments
that stand at one place, two kinds stay as they are: those whose rows have other labels than the
rest of the place has (more or fewer rejected, or allowed ones, than chance would give in as many
segments, ``CHANCE``; rows without a label count as neither), however few rows they have; and those
that come up too often for a number or a name that varies: ``MIN_ROWS`` rows at least, and
``MIN_SHARE`` of the place's rows or as many as their square root. All others become the wildcard
``*``, so numbers and names that vary make one branch. Branches at the same place whose shares of rejected labels don't differ beyond chance
(``MERGE_Z``) are merged, neighbours in the order of their shares at a time. A template is
rejected if its smoothed purity reaches ``PURITY``: the share of rejected labels among its labelled
rows, drawn towards the share of the place above by ``PRIOR_ROWS`` rows, and so on up to the host
and to all hosts.

Work. Rows are first reduced to distinct paths with counts. Each level is one grouped count and a
join of that table with the segments that stay; it ends with the deepest path. Below ``DEEP``
levels, a path that is alone at its place has nothing to part from, and its rest is one segment;
the others go on.

Nulls, ties, repeats: a null url has an empty host and path, which is a template of its own; each
row gets a verdict, whatever its id; equal shares are ordered by the template's name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import stored

MIN_ROWS = 10
MIN_SHARE = 0.05
CHANCE = 0.05
DEEP = 8
MERGE_Z = 1.96
PRIOR_ROWS = 5.0
PURITY = 0.7

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, host).otherwise(""), F.when(at > 0, path).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null if none does.

    ``rules`` are (verdict, "host/path"): a rule fits its host and all subdomains, if the path
    begins with its path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rule_path}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments of a path."""
    split = F.split(path, "/", -1)  # its first part is what stands before the first slash: nothing
    return F.slice(split, 2, F.size(split))


def _apart(own: Column, n: Column, rest: Column, n_rest: Column, tests: Column) -> Column:
    """Whether ``own`` of ``n`` rows is a share that chance doesn't give, in none of ``tests``
    segments, where the rest has ``rest`` of ``n_rest`` (Chernoff's bound for both tails)."""
    share, expected = own / n, (rest + 0.5) / (n_rest + 1.0)
    more = F.when(own > 0, own * F.log(share / expected)).otherwise(0.0)
    fewer = F.when(own < n, (n - own) * F.log((1 - share) / (1 - expected))).otherwise(0.0)
    return more + fewer > F.log(4 * tests / F.lit(CHANCE))  # two tails, two labels


def templates(labelled: DataFrame) -> DataFrame:
    """``(host, segments, steps, n, n_labelled, n_bad)``: distinct paths with their template's
    steps (literal segments or ``*``). ``labelled`` has host, path and bad (1, 0 or null)."""
    paths = stored(
        labelled.groupBy("host", segments(F.col("path")).alias("segments")).agg(
            F.count("*").alias("n"), F.count("bad").alias("n_labelled"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"),
        )
        # The steps that the path will take; fewer than its segments if its rest is one.
        .withColumn("steps", F.expr("CAST(array() AS array<string>)"))
        .withColumn("depth", F.size("segments")),
        "paths",
    )
    whole = []
    depth = paths.agg(F.max("depth")).first()[0] or 0
    level = 0
    while level < depth:
        level += 1
        below = F.col("depth") >= level
        if level > DEEP:
            whole.append(paths.where(~below))
            paths = paths.where(below)
            alone = paths.groupBy("host", "steps").agg(
                F.count("*").alias("_paths"), F.min("segments").alias("segments")
            ).where("_paths = 1").select("host", "segments", F.lit(level).alias("_alone"))
            paths = stored(
                paths.join(alone, ["host", "segments"], "left")
                .withColumn("depth", F.coalesce("_alone", "depth")).drop("_alone"),
                "paths",
            )
        segment = F.when(
            F.col("depth") == level,
            F.array_join(F.slice("segments", F.lit(level), F.size("segments")), "/"),
        ).otherwise(F.try_element_at("segments", F.lit(level)))
        counts = paths.where(below).groupBy("host", "steps", segment.alias("segment")).agg(
            F.sum("n").alias("n"), F.sum("n_bad").alias("bad"),
            F.sum(F.col("n_labelled") - F.col("n_bad")).alias("good"),
        )
        places = counts.groupBy("host", "steps").agg(
            F.sum("n").alias("_n"), F.sum("bad").alias("_bad"), F.sum("good").alias("_good"),
            F.count("*").alias("_segments"),
        )
        often = (F.col("n") >= MIN_ROWS) & (
            F.col("n") >= F.least(MIN_SHARE * F.col("_n"), F.sqrt("_n"))
        )
        differs = [
            _apart(
                F.col(c), F.col("n"), F.col(f"_{c}") - F.col(c), F.col("_n") - F.col("n"),
                F.col("_segments"),
            )
            for c in ("bad", "good")
        ]
        stays = counts.join(places, ["host", "steps"]).where(often | differs[0] | differs[1]).select(
            "host", "steps", "segment", F.lit(True).alias("_stays")
        )
        paths = stored(
            paths.withColumn("segment", segment)
            .join(stays, ["host", "steps", "segment"], "left")
            .withColumn(
                "steps",
                F.when(
                    below,
                    F.concat("steps", F.array(F.when(F.col("_stays"), F.col("segment")).otherwise("*"))),
                ).otherwise(F.col("steps")),
            )
            .select("host", "segments", "n", "n_labelled", "n_bad", "steps", "depth"),
            "paths",
        )
        if level >= DEEP:
            depth = paths.agg(F.max("depth")).first()[0] or 0
    for part in whole:
        paths = paths.unionByName(part)
    return paths.drop("depth")


def purities(paths: DataFrame) -> DataFrame:
    """``(host, steps, branch, purity)`` of every place of the trees, from the hosts down.

    ``branch`` is the merged branch a place belongs to under the place above it.
    """
    all_places = paths.select(
        "host", F.explode(F.transform(F.sequence(F.lit(0), F.size("steps")), lambda k: F.slice("steps", 1, k))).alias("steps"),
        "n_labelled", "n_bad",
    )
    # Settled first: every level of the tree reads it.
    places = stored(
        all_places.groupBy("host", "steps").agg(
            F.sum("n_labelled").alias("lab"), F.sum("n_bad").alias("bad")
        ),
        "places",
    )
    total = places.where(F.size("steps") == 0).agg(F.sum("lab"), F.sum("bad")).first()
    overall = ((total[1] or 0) + 0.5) / ((total[0] or 0) + 1.0)
    depth = places.agg(F.max(F.size("steps"))).first()[0] or 0

    def smooth(bad, lab, prior):
        return (bad + PRIOR_ROWS * prior) / (lab + PRIOR_ROWS)

    level = places.where(F.size("steps") == 0).select(
        "host", "steps", F.lit(0).alias("branch"),
        smooth(F.col("bad"), F.col("lab"), F.lit(overall)).alias("purity"),
    )
    level = stored(level, "purities")
    out = level
    for k in range(1, depth + 1):
        above = level.select("host", F.col("steps").alias("above"), F.col("purity").alias("prior"))
        children = places.where(F.size("steps") == k).withColumn("above", F.slice("steps", 1, k - 1))
        # Siblings of one share are one, or a window could hold all segments of a host.
        by_share = Window.partitionBy("host", "above").orderBy("share")
        share = F.when(F.col("lab") > 0, F.col("bad") / F.col("lab"))
        pooled = (F.col("bad") + F.lag("bad").over(by_share)) / (F.col("lab") + F.lag("lab").over(by_share))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("lab") + 1 / F.lag("lab").over(by_share)))
        apart = (F.col("share") - F.lag("share").over(by_share)) > MERGE_Z * error
        labelled = children.where("lab > 0").withColumn("share", share)
        shares = labelled.groupBy("host", "above", "share").agg(
            F.sum("lab").alias("lab"), F.sum("bad").alias("bad")
        )
        shares = shares.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
        shares = shares.withColumn("branch", F.sum("_new").over(by_share))
        merged = Window.partitionBy("host", "above", "branch")
        shares = shares.withColumn("lab", F.sum("lab").over(merged)).withColumn(
            "bad", F.sum("bad").over(merged)
        ).drop("_new")
        labelled = labelled.drop("lab", "bad").join(shares, ["host", "above", "share"])
        # Without labels nothing sets a place apart from the one above.
        rest = children.where("lab = 0").withColumn("branch", F.lit(0))
        columns = ["host", "steps", "above", "branch", "lab", "bad"]
        level = stored(
            labelled.select(*columns).unionByName(rest.select(*columns))
            .join(above, ["host", "above"])
            .select(
                "host", "steps", F.col("branch").cast("int").alias("branch"),
                smooth(F.col("bad"), F.col("lab"), F.col("prior")).alias("purity"),
            ),
            "purities",
        )
        out = out.unionByName(level)
    return out


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` of every row.

    Rows that a rule fits have its verdict, and are the labels that the templates of the others
    are judged by.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    bad = F.when(F.col("by_rule") == BLOCK, 1).when(F.col("by_rule") == ALLOW, 0)
    paths = templates(ruled.withColumn("bad", bad))
    judged = paths.join(purities(paths), ["host", "steps"]).select(
        F.col("host").alias("_host"), F.col("segments").alias("_segments"),
        F.concat_ws("/", "host", F.array_join("steps", "/")).alias("template"), "purity",
    )
    return (
        ruled.withColumn("segments", segments(F.col("path")))
        .join(judged, (F.col("host") == F.col("_host")) & (F.col("segments") == F.col("_segments")), "left")
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("by_rule", F.when(F.col("purity") >= PURITY, BLOCK).otherwise(ALLOW)).alias("verdict"),
            "template", "purity",
        )
    )
