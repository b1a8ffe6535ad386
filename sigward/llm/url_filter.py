"""URL filter: given rules first, then a path-template tree for each host, with templates rejected by labelled purity.

A rule fits its host and all subdomains where the path starts with the rule's path; the longest rule wins (ties: the longer
host, then block before allow, then the smaller text). Addresses that a rule judges are the labels of the tree.

The tree takes one path segment a level, DEPTH levels deep; paths that are longer share the template of their first segments, and
a path that has ended goes on with empty segments. In a node:

* a segment that at least one in KEEP_ONE_IN of the node's addresses hold, and two at least, stays as it is; all others are the wildcard;
* these branches, at most KEEP_ONE_IN and the wildcard, are put in order of their smoothed share of blocked labels, and
  neighbours whose shares do not differ by a test of two proportions at SIMILAR standard errors become one branch.

The purity of a branch is its share of blocked labels, smoothed by PRIOR labels of its parent's purity; a host's parent is
the whole table. A template is rejected where its purity is REJECT_AT or more. A host without any label has purity 0: what others do is no evidence.

Only DataFrame functions are used. A host may hold most rows: statistics are combined before the shuffle, and rows meet their
node's table, a row for each literal branch, by a key with a salt. Rows are known by a number that is stored with them.

Defined results: host and path are empty for a null address and one without `://`; such rows share one template. Empty segments are
segments like others. Rows that share a page_id, or have none, are judged each. Without labels no template is rejected. An empty table
gives no rows, an empty table of rules no rule. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import common

DEPTH = 3
KEEP_ONE_IN = 20
PRIOR = 10.0
REJECT_AT = 0.5
SIMILAR = 1.96
SALTS = 16
ADDRESS = r"(?s)://([^/?#]*)([^?#]*)"


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path."""
    part = lambda i: F.coalesce(F.regexp_extract(url, ADDRESS, i), F.lit(""))
    return common.lower_ascii(part(1)), part(2)


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark)))


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_dir, rule_path, rule, verdict) of rules given as host, path and verdict. The directory ends at the path's last slash."""
    rows = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    return rows.select("*", F.regexp_extract("rule_path", "(?s)^(.*/)", 1).alias("rule_dir"), F.concat("rule_host", "rule_path").alias("rule"))


def salted(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join of numbered rows with a table of few rows; rows of one key are spread over SALTS."""
    each = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(each, [*on, "_salt"], how).drop("_salt")


def with_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits. Rules are looked up by a host suffix and a directory."""
    table = rule_table(rules)
    most = table.agg(F.max(count_of(F.col("rule_host"), ".")).alias("dots"), F.max(count_of(F.col("rule_dir"), "/")).alias("slashes")).first()
    if most["dots"] is None:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"))
    # No more suffixes and directories than rules have parts.
    hosts = F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, most["dots"] + 2)]))
    there = count_of(F.col("path"), "/")
    dirs = [F.when(there >= i, F.concat(F.substring_index("path", "/", i), F.lit("/"))) for i in range(1, most["slashes"] + 1)]
    dirs = F.array_compact(F.array(F.lit(""), *dirs))
    asked = rows.select("row", "path", F.explode(hosts).alias("rule_host"), dirs.alias("dirs")).select("row", "path", "rule_host", F.explode("dirs").alias("rule_dir"))
    found = salted(asked, table, ["rule_host", "rule_dir"], "inner").where(F.startswith("path", "rule_path"))
    order = F.struct(F.length("rule"), F.length("rule_host"), (F.col("verdict") == "block").cast("int"), "rule", "verdict")
    best = found.groupBy("row").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    return rows.join(best, "row", "left").select(*rows.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def purity(blocked: Column, labelled: Column, parent: Column) -> Column:
    return (blocked + F.lit(PRIOR) * parent) / (labelled + F.lit(PRIOR))


def branches_of(level: DataFrame, nodes: DataFrame | None, overall: float) -> tuple[DataFrame, DataFrame]:
    """(literal branches, node tables of the next level) of the rows of a level; `nodes` has the purity of each node, at the top none."""
    on = ["host", "node"]
    stats = level.groupBy(*on, "seg").agg(F.count("*").alias("n"), F.count("label").alias("l"), F.coalesce(F.sum("label"), F.lit(0)).alias("b"))
    stats = session.written(stats, "url-segments")
    totals = stats.groupBy(*on).agg(*[F.sum(c).alias(f"{c}_all") for c in "nlb"])
    if nodes is None:
        known = F.when(F.col("l_all") > 0, purity(F.col("b_all"), F.col("l_all"), F.lit(overall))).otherwise(F.lit(0.0))
        totals = totals.select("*", known.alias("p"), F.col("host").alias("template"))
    else:
        totals = totals.join(nodes, on)
    # A node may have most of all segments.
    met = salted(stats.withColumn("row", F.xxhash64("seg")), totals, on, "inner")
    kept = session.written(met.where((F.col("n") >= 2) & (F.col("n") * KEEP_ONE_IN >= F.col("n_all"))).select(*on, "seg", "n", "l", "b"), "url-literals")
    own = kept.groupBy(*on).agg(*[F.sum(c).alias(f"{c}_own") for c in "nlb"])
    others = totals.join(own, on, "left")
    left = lambda c: F.col(f"{c}_all") - F.coalesce(F.col(f"{c}_own"), F.lit(0))
    rest = others.where(left("n") > 0).select(*on, F.lit(None).cast("string").alias("seg"), *[left(c).alias(c) for c in "nlb"])
    both = kept.unionByName(rest).join(totals.select(*on, "p", "template"), on)
    both = both.withColumn("share", purity(F.col("b"), F.col("l"), F.col("p")))
    beside = Window.partitionBy(*on).orderBy("share", F.col("seg").asc_nulls_first())
    m, m0 = F.col("l") + F.lit(PRIOR), F.lag("l").over(beside) + F.lit(PRIOR)
    pooled = (F.col("b") + F.lag("b").over(beside) + F.lit(2 * PRIOR) * F.col("p")) / (m + m0)
    gap = F.col("share") - F.lag("share").over(beside)
    apart = gap * gap > F.lit(SIMILAR * SIMILAR) * pooled * (1 - pooled) * (1 / m + 1 / m0)
    grouped = both.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("group", F.sum("apart").over(beside.rowsBetween(Window.unboundedPreceding, 0)))
    wild = F.max(F.col("seg").isNull()).over(Window.partitionBy(*on, "group"))
    # The branch of the wildcard is number 0 of its node, so rows without a literal branch need no look-up.
    numbered = session.written(grouped.select(*on, "seg", "l", "b", "p", "template", F.when(wild, 0).otherwise(F.col("group") + 1).alias("branch")), "url-branches")
    name = F.concat("template", F.lit("/"), F.when(F.col("branch") == 0, "*").otherwise(F.array_join("segs", "|")))
    merged = numbered.groupBy(*on, "branch", "p", "template").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.sort_array(F.collect_set("seg")).alias("segs"))
    below = merged.select("host", child(F.col("branch")).alias("node"), purity(F.col("b"), F.col("l"), F.col("p")).alias("p"), name.alias("template"))
    return numbered.where("seg IS NOT NULL").select(*on, "seg", "branch"), session.written(below, "url-nodes")


def child(branch: Column) -> Column:
    return F.concat("node", F.lit("."), branch.cast("string"))


def judge(pages: DataFrame, rules: DataFrame, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each page. `rules`: host, path, verdict (allow or block)."""
    host, path = address_parts(F.col("url"))
    rows = session.written(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path")), "url-rows")
    label = F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("int"))
    rows = session.written(with_rule(rows, rules).withColumn("label", label), "url-ruled")
    seen = rows.agg(F.count("label").alias("l"), F.coalesce(F.sum("label"), F.lit(0)).alias("b")).first()
    overall = (seen["b"] + 0.5) / (seen["l"] + 1.0) if seen["l"] else 0.0
    segments = F.slice(F.split("path", "/", depth + 2), 2, depth)
    level = rows.select("row", "host", F.lit("").alias("node"), segments.alias("segs"), "label")
    nodes = None
    for i in range(depth):
        level = level.withColumn("seg", F.coalesce(F.get("segs", F.lit(i)), F.lit("")))
        literals, nodes = branches_of(level, nodes, overall)
        met = salted(level, literals, ["host", "node", "seg"])
        level = session.written(met.select("row", "host", child(F.coalesce("branch", F.lit(0))).alias("node"), "segs", "label"), "url-level")
    judged = salted(level, nodes, ["host", "node"], "inner").select("row", "p", "template")
    verdict = F.coalesce("rule_verdict", F.when(F.col("p") >= REJECT_AT, "block").otherwise("allow"))
    return rows.join(judged, "row").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.col("p").alias("purity"))


def oracle(rules: list[tuple[str, str, str]], depth: int = DEPTH) -> str:
    """The same in SQL, a level of the tree after the other."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    upper = "".join(map(chr, range(65, 91)))
    levels = []
    for i in range(1, depth + 1):
        parents = (
            f"SELECT host, node, sum(n) AS n, sum(l) AS l, sum(b) AS b, CASE WHEN sum(l) > 0 THEN (sum(b) + {PRIOR} * any_value(g)) / (sum(l) + {PRIOR}) ELSE 0.0::DOUBLE END AS p, host AS template FROM stats1, overall GROUP BY host, node"
            if i == 1
            else f"SELECT s.host, s.node, sum(s.n) AS n, sum(s.l) AS l, sum(s.b) AS b, any_value(k.p) AS p, any_value(k.template) AS template FROM stats{i} s JOIN nodes{i - 1} k USING (host, node) GROUP BY s.host, s.node"
        )
        levels.append(f"""
stats{i} AS (SELECT host, node, coalesce(segs[{i}], '') AS seg, count(*) AS n, count(label) AS l, coalesce(sum(label), 0) AS b FROM level{i - 1} GROUP BY ALL),
totals{i} AS ({parents}),
kept{i} AS (SELECT s.* FROM stats{i} s JOIN totals{i} t USING (host, node) WHERE s.n >= 2 AND s.n * {KEEP_ONE_IN} >= t.n),
rest{i} AS (SELECT t.host, t.node, NULL AS seg, t.n - coalesce(sum(k.n), 0) AS n, t.l - coalesce(sum(k.l), 0) AS l, t.b - coalesce(sum(k.b), 0) AS b
  FROM totals{i} t LEFT JOIN kept{i} k USING (host, node) GROUP BY t.host, t.node, t.n, t.l, t.b HAVING t.n > coalesce(sum(k.n), 0)),
both{i} AS (SELECT x.host, x.node, x.seg, x.l::DOUBLE AS l, x.b::DOUBLE AS b, t.p, t.template, (x.b + {PRIOR} * t.p) / (x.l + {PRIOR}) AS share
  FROM (SELECT * FROM kept{i} UNION ALL SELECT * FROM rest{i}) x JOIN totals{i} t USING (host, node)),
near{i} AS (SELECT *, lag(l) OVER w + {PRIOR} AS m0, lag(b) OVER w AS b0, share - lag(share) OVER w AS gap FROM both{i} WINDOW w AS (PARTITION BY host, node ORDER BY share, seg NULLS FIRST)),
apart{i} AS (SELECT *, (b + b0 + {2 * PRIOR} * p) / (l + {PRIOR} + m0) AS pooled FROM near{i}),
runs{i} AS (SELECT *, sum(coalesce((gap * gap > {SIMILAR * SIMILAR!r} * pooled * (1 - pooled) * (1 / (l + {PRIOR}) + 1 / m0))::INT, 0))
  OVER (PARTITION BY host, node ORDER BY share, seg NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run FROM apart{i}),
branches{i} AS (SELECT *, CASE WHEN bool_or(seg IS NULL) OVER (PARTITION BY host, node, run) THEN 0 ELSE run + 1 END AS branch FROM runs{i}),
nodes{i} AS (SELECT host, node || '.' || branch::INT AS node, (sum(b) + {PRIOR} * any_value(p)) / (sum(l) + {PRIOR}) AS p,
  template || '/' || CASE WHEN branch = 0 THEN '*' ELSE array_to_string(list_sort(list(seg)), '|') END AS template FROM branches{i} GROUP BY host, node, branch, template),
level{i} AS (SELECT v.id, v.host, v.node || '.' || coalesce(k.branch, 0)::INT AS node, v.segs, v.label
  FROM level{i - 1} v LEFT JOIN branches{i} k ON v.host = k.host AND v.node = k.node AND coalesce(v.segs[{i}], '') = k.seg)""")
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {values}),
parts AS (SELECT row_number() OVER () AS id, page_id, translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), ''), '{upper}', '{upper.lower()}') AS host,
  coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fits AS (SELECT id, max(struct_pack(a := length(rule_host || rule_path), b := length(rule_host), c := (verdict = 'block')::INT, rule := rule_host || rule_path, verdict := verdict)) AS best
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY id),
ruled AS (SELECT p.*, best.rule AS rule, best.verdict AS rule_verdict, CASE WHEN best IS NOT NULL THEN (best.verdict = 'block')::INT END AS label FROM parts p LEFT JOIN fits USING (id)),
overall AS (SELECT CASE WHEN count(label) > 0 THEN (sum(label) + 0.5::DOUBLE) / (count(label) + 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS g FROM ruled),
level0 AS (SELECT id, host, '' AS node, string_split(path, '/')[2:] AS segs, label FROM ruled),{",".join(levels)}
SELECT page_id, r.host, path, rule, coalesce(rule_verdict, CASE WHEN p >= {REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM ruled r JOIN level{depth} v USING (id) JOIN nodes{depth} k ON v.host = k.host AND v.node = k.node"""
