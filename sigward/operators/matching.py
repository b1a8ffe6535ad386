"""Signature matching: rule strings against file contents, and the rule conditions on top.

Hits belong to a file row and to a rule: two rows may share a path and two rules a name, and each is judged by itself. A
rule is known by `rule_id` where its table has one, else by its name. A file is known by `file_key`: the source's own column of that
name, or a hash of path and content, which is the same whenever and wherever it is computed. Rows that share it are equal, have the
same hits, and come out as often as they came in. Two plans find the same rows:

* a few strings are tested as literals in one narrow pass over the files (no join, no shuffle);
* more are looked up by a token each, an equi-join with the tokens of each file, and verified where the content is. Contents are
  taken in overlapping pieces; those of large files may be spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigward import session
from sigward.functions import fixed
from sigward.functions import scalars as X
from sigward.operators import filters

HIT_COLUMNS = ["path", "file_key", "rule_key", "rule_name", "string_id"]
RULE_KEYS = ["rule_key", "rule_name", "string_id"]
TOKEN = "[A-Za-z0-9_]"
# Bytes that are no part of a token, as the characters they are read as.
BREAKS = "".join(c for c in map(chr, range(256)) if c != " " and not (c.isascii() and c.isalnum()) and c != "_")
# A content is looked up in pieces of this many bytes.
PIECE_BYTES = 1 << 20
GRAMS = [1, 2, 3, 5, 8, 12, 20, 32]
# Modifiers that change nothing for a text that is compared as it stands.
KNOWN_MODIFIERS = ["ascii", "private"]


# ---- string hits


def hex_bytes(pattern) -> Column:
    """Bytes of `{6D 61 ...}`."""
    return F.unhex(F.regexp_replace(X.col(pattern), r"[{}\s]", ""))


def pattern_bytes(kind="kind", pattern="pattern") -> Column:
    return F.when(X.col(kind) == "hex", hex_bytes(pattern)).otherwise(F.encode(X.col(pattern), "UTF-8"))


def content_is_binary(files: DataFrame) -> bool:
    return files.schema["content"].dataType.typeName() == "binary"


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """All rows of a table of at most `limit` rows, or None when it is longer (only limit + 1 rows ever travel)."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def needle_tests(rows, binary: bool, content="content") -> dict[bytes, Column]:
    """One occurrence test per distinct needle: on text where both sides are text, else on bytes."""
    tests = {}
    for needle in {bytes(r["needle"]): None for r in rows}:
        if not binary and is_text(needle):
            tests[needle] = F.contains(X.col(content), F.lit(needle.decode("utf-8")))
        else:
            tests[needle] = F.contains(X.col(content).cast("binary"), F.lit(needle))
    return tests


def is_text(needle: bytes) -> bool:
    try:
        needle.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def with_needle_flags(files: DataFrame, rows) -> tuple[DataFrame, dict[bytes, Column]]:
    """The files with one boolean column per distinct needle, and the column of each needle."""
    tests = needle_tests(rows, content_is_binary(files))
    names = {needle: f"_n{i}" for i, needle in enumerate(tests)}
    flags = files.select("*", *[test.alias(names[needle]) for needle, test in tests.items()])
    return flags, {needle: F.col(name) for needle, name in names.items()}


def rule_key(df: DataFrame) -> Column:
    """What a rule is known by."""
    name = F.col("rule_name")
    return (F.coalesce(F.col("rule_id"), name) if "rule_id" in df.columns else name).alias("rule_key")


def prepared(rule_strings: DataFrame) -> DataFrame:
    """Non-empty rule strings with their bytes; all strings of a string id are kept."""
    known = rule_strings.where(F.col("kind").isin("text", "hex"))
    strings = known.select(rule_key(rule_strings), "rule_name", "string_id", pattern_bytes().alias("needle"))
    return strings.where(F.octet_length("needle") > 0).distinct()


def literal_rows(rule_strings: DataFrame) -> list | None:
    """The prepared strings as rows, or None when there are more than LITERAL_STRINGS."""
    return bounded_rows(prepared(rule_strings), session.LITERAL_STRINGS)


def no_hits(files: DataFrame) -> DataFrame:
    return files.sparkSession.createDataFrame([], "path STRING, file_key STRING, rule_key STRING, rule_name STRING, string_id STRING")


def with_file_key(files: DataFrame) -> DataFrame:
    """The files with `file_key`. The key takes nothing from a row's place in its table, so both sides of a join and a repeated task agree on it."""
    if "file_key" in files.columns:
        return files
    content = F.col("content").cast("binary")
    return files.withColumn("file_key", F.concat(F.hex(F.xxhash64("path", content)), F.lit("-"), F.hex(F.xxhash64(content, F.lit("file"), "path"))))


def hits_of_literals(files: DataFrame, rows) -> DataFrame:
    """Hits of a bounded list of strings on files with a `file_key`: one narrow pass, every needle tested once per file."""
    if not rows:
        return no_hits(files)
    flags, found = with_needle_flags(files, rows)
    named = [
        F.when(found[bytes(r["needle"])], F.struct(*[F.lit(r[c]).alias(c) for c in RULE_KEYS])) for r in rows
    ]
    hits = flags.select("path", "file_key", F.explode(F.array_distinct(F.array_compact(F.array(*named)))).alias("h"))
    return hits.select("path", "file_key", "h.*")


def longest(tokens: Column) -> Column:
    return F.array_max(F.transform(tokens, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def common_tokens(files: DataFrame, fraction: float = 0.01, most: int = 10_000) -> DataFrame:
    """(token, n) of the tokens that come most often in a sample of the files; at most `most` rows. For rule_set: a string with several
    whole tokens is then looked up by the rarest, not the longest, so that fewer files have to be verified. Hits are the same.
    """
    text = F.decode(F.col("content").cast("binary"), "ISO-8859-1")
    tokens = files.sample(fraction, 7).select(F.explode(split_tokens(text)).alias("token")).where("token <> ''")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return session.written(counts.orderBy(F.col("n").desc(), "token").limit(most), "common-tokens")


def split_tokens(text) -> Column:
    """The tokens of a text of bytes, empty ones among them. One character bounds tokens, so they are split without a pattern."""
    return F.split(F.translate(text, BREAKS, " " * len(BREAKS)), " ")


def rarest(rows: DataFrame, common: DataFrame) -> DataFrame:
    """The rows of strings with `inner` reduced to the token that comes least, of those the longest one."""
    ident = ["rule_key", "string_id", "text"]
    tokens = rows.select(*ident, F.explode("inner").alias("token")).join(F.broadcast(common), "token", "left")
    order = F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), F.col("token"))
    best = tokens.groupBy(*ident).agg(F.min_by("token", order).alias("best"))
    return rows.join(best, ident, "left").withColumn("inner", F.when(F.size("inner") > 0, F.array("best")).otherwise(F.col("inner"))).drop("best")


def keyed(strings: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """Adds `text`, one character per byte, and `look_up`: a kind and a token by which files are found that may hold the string.

    A token with other characters on both sides is a whole token of such a file (w); one at the string's end starts a token of
    the file (s), one at its start ends one (e), and a string that is a bare token is inside one (i). A string without
    tokens has no key but its kind (n).
    """
    text = F.decode("needle", "ISO-8859-1")
    rows = strings.withColumn("text", text).withColumn("tokens", F.regexp_extract_all("text", F.lit(f"{TOKEN}+"), F.lit(0)))
    # Parts of tokens are cut to few lengths, so that a token of a file is looked up few times.
    part = lambda c: F.greatest(*[F.when(F.length(c) >= g, g) for g in GRAMS])
    n, opens, closes = F.size("tokens"), F.col("text").rlike(f"^{TOKEN}"), F.col("text").rlike(f"{TOKEN}\\z")
    rows = rows.withColumn("inner", F.slice("tokens", 1 + opens.cast("int"), F.greatest(n - opens.cast("int") - closes.cast("int"), F.lit(0))))
    if common is not None:
        rows = rarest(rows, common)
    inner = F.col("inner")
    first, last = F.get("tokens", F.lit(0)), F.get("tokens", n - 1)
    key = (
        F.when(n == 0, "n")
        .when(F.size(inner) > 0, F.concat(F.lit("w"), longest(inner)))
        .when((n == 1) & opens & closes, F.concat(F.lit("i"), F.left(first, part(first))))
        .when(opens & (~closes | (F.length(first) >= F.length(last))), F.concat(F.lit("e"), F.right(first, part(first))))
        .otherwise(F.concat(F.lit("s"), F.left(last, part(last))))
    )
    return rows.withColumn("look_up", key).drop("tokens", "inner")


def look_ups(t: Column, lengths: dict[str, list[int]]) -> Column:
    """The keys of a file's token: itself, and its ends, starts and insides of the lengths that keys have."""
    size = F.length(t)
    fitting = lambda kind: F.filter(F.array(*map(F.lit, lengths[kind])), lambda n: n <= size)
    parts = []
    if "w" in lengths:
        parts.append(F.array(F.concat(F.lit("w"), t)))
    if "e" in lengths:
        parts.append(F.transform(fitting("e"), lambda n: F.concat(F.lit("e"), F.substring(t, size - n + 1, n))))
    if "s" in lengths:
        parts.append(F.transform(fitting("s"), lambda n: F.concat(F.lit("s"), F.substring(t, F.lit(1), n))))
    if "i" in lengths:
        at = lambda n: F.sequence(F.lit(1), size - n + 1)
        inside = F.transform(fitting("i"), lambda n: F.transform(at(n), lambda i: F.concat(F.lit("i"), F.substring(t, i, n))))
        parts.append(F.array_distinct(F.flatten(inside)))
    return F.concat(*parts)


@dataclass(frozen=True)
class Keyed:
    """Strings with their look-ups, and what a pass over contents needs to know of them."""

    strings: DataFrame
    lengths: dict[str, list[int]]
    longest: int
    bytes: int


def look_up_table(strings: DataFrame, common: DataFrame | None = None) -> Keyed:
    strings = keyed(strings, common)
    measured = strings.groupBy(F.substring("look_up", 1, 1).alias("kind")).agg(
        F.collect_set(F.length("look_up") - 1).alias("lengths"),
        F.max(F.length("text")).alias("longest"),
        session.text_bytes("rule_key", "rule_name", "string_id", "text", "look_up").alias("bytes"),
    ).collect()
    lengths = {r["kind"]: sorted(r["lengths"]) for r in measured}
    return Keyed(strings, lengths, max((r["longest"] for r in measured), default=0), sum(r["bytes"] for r in measured))


def pieces(files: DataFrame, overlap: int, piece_bytes: int = PIECE_BYTES, spread: bool = False) -> DataFrame:
    """path, file_key, piece and its content, one character per byte. A piece goes on for `overlap` bytes into the next one.

    With `spread`, pieces are dealt to all tasks by file and piece.
    """
    raw = files.select("path", "file_key", F.col("content").cast("binary").alias("_bytes"))
    size = F.octet_length("_bytes")
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / piece_bytes).cast("int")),
        lambda i: F.struct(i.alias("piece"), F.substring(F.col("_bytes"), i * piece_bytes + 1, F.lit(piece_bytes + overlap)).alias("_bytes")),
    )
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.col("_bytes")))
    each = raw.select("path", "file_key", F.inline(F.when(size <= piece_bytes, whole).otherwise(cut)))
    if spread:
        each = each.repartition(session.shuffles(files.sparkSession), "file_key", "piece")
    return each.select("path", "file_key", "piece", F.decode("_bytes", "ISO-8859-1").alias("_content"))


def pieces_with_hits(contents: DataFrame, keys: Keyed) -> DataFrame:
    """(path, file_key, piece, rule_key, rule_name, string_id, text), once for each string and piece of a file row; contents are read
    once and stay in their task.

    Strings beyond what a task may hold are looked up in parts, each a pass of its own.
    """
    kinds = set(keys.lengths) - {"n"}
    own = F.array().cast("array<string>")
    if kinds:
        least = min(keys.lengths[k][0] for k in kinds)
        # Short tokens go before anything else is done.
        tokens = F.array_distinct(F.filter(split_tokens("_content"), lambda t: F.length(t) >= least))
        if kinds == {"w"}:
            own = F.transform(tokens, lambda t: F.concat(F.lit("w"), t))
        else:
            own = F.array_distinct(F.flatten(F.transform(tokens, lambda t: look_ups(t, keys.lengths))))
    if "n" in keys.lengths:
        own = F.array_append(own, F.lit("n"))
    rows = contents.select("*", F.explode(own).alias("look_up"))
    parts = max(-(-keys.bytes // session.BROADCAST_BYTES), 1)
    slot = F.pmod(F.xxhash64("rule_key", "string_id", "text"), F.lit(parts))
    found = [rows.join(F.broadcast(keys.strings.where(slot == i)), "look_up").where(F.contains("_content", "text")) for i in range(parts)]
    return reduce(DataFrame.unionByName, found).select("path", "file_key", "piece", *RULE_KEYS, F.xxhash64("text").alias("text"))


def times_found(*found: str) -> Column:
    """Aggregate: how many equal file rows a group of hits is of, as each brings the same (string, piece) pairs."""
    return (F.count(F.lit(1)) / F.size(F.collect_set(F.struct(*found)))).cast("int")


def as_often(df: DataFrame, times: str) -> DataFrame:
    return df.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).drop(times)


def hits_by_token(files: DataFrame, strings: DataFrame, piece_bytes: int = PIECE_BYTES, spread: bool = False) -> DataFrame:
    """Hits of any number of prepared strings on files with a `file_key`."""
    keys = look_up_table(strings)
    if not keys.lengths:
        return no_hits(files)
    found = pieces_with_hits(pieces(files, keys.longest - 1, piece_bytes, spread), keys)
    return as_often(found.groupBy(*HIT_COLUMNS).agg(times_found("text", "piece").alias("_times")), "_times")


def split_by_size(files: DataFrame, large_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(small, large) files by size_bytes, which sources of files filter without reading contents."""
    large = F.coalesce(F.col("size_bytes") > large_bytes, F.lit(False))
    return files.where(~large), files.where(large)


def hits_of(files: DataFrame, rule_strings: DataFrame) -> DataFrame:
    rows = literal_rows(rule_strings)
    return hits_by_token(files, prepared(rule_strings)) if rows is None else hits_of_literals(files, rows)


def match_strings(files: DataFrame, rule_strings: DataFrame, large_bytes: int | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, file_key, rule_key, rule_name, string_id): which rule strings occur in which file row, case kept, overlaps counted.

    Files of more than `large_bytes`, where given, are cut and their pieces spread over all tasks; the hits are the same.
    """
    files = with_file_key(files)
    if large_bytes is None:
        return hits_of(files, rule_strings).select(*HIT_COLUMNS)
    small, large = split_by_size(files, large_bytes)
    return hits_of(small, rule_strings).select(*HIT_COLUMNS).unionByName(hits_by_token(large, prepared(rule_strings), piece_bytes, True))


def match_literals(files: DataFrame, rows) -> DataFrame:
    """Same hits as match_strings, by literal tests of the prepared strings `rows`."""
    return hits_of_literals(with_file_key(files), rows).select(*HIT_COLUMNS)


def match_strings_indexed(files: DataFrame, rule_strings: DataFrame) -> DataFrame:
    """Same hits as match_strings, by look-up of tokens."""
    return hits_by_token(with_file_key(files), prepared(rule_strings)).select(*HIT_COLUMNS)


def match_hex(files: DataFrame, rule_strings: DataFrame) -> DataFrame:
    """Hits of the hex strings only, compared on bytes."""
    return match_strings(files, rule_strings.where("kind = 'hex'"))


# ---- conditions


def condition_met(string_ids, needed, only_id) -> Column:
    """Enough distinct strings, or the one string a `$id` condition names."""
    return F.when(X.col(only_id).isNotNull(), F.array_contains(X.col(string_ids), X.col(only_id))).otherwise(
        F.size(X.col(string_ids)) >= X.col(needed)
    )


def eval_conditions(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_name, path) of the rules whose condition holds, for each file row of the hits of match_strings.

    Hits without file_key are taken as one file for each path, hits without rule_key as of one rule for each name. One shuffle on
    (file, rule); the set per pair is bounded by the number of strings of that rule.
    """
    if "rule_key" not in hits.columns:
        hits = hits.withColumn("rule_key", F.col("rule_name"))
    row = [c for c in ("path", "file_key") if c in hits.columns]
    times = times_found("string_id") if "file_key" in row else F.lit(1)
    per_rule = hits.groupBy(*row, "rule_key").agg(F.collect_set("string_id").alias("ids"), times.alias("_times"))
    return as_often(conditions_met(per_rule, rules), "_times").select("rule_name", "path")


def conditions_met(per_rule: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of found string ids (`ids`) of a file and a rule for which the rule's condition holds, with its name."""
    conditions = rules.select(rule_key(rules), "rule_name", "min_hits", "only_id")
    return per_rule.join(conditions, "rule_key").where(condition_met("ids", "min_hits", "only_id"))


@dataclass(frozen=True)
class RuleSet:
    """Rules ready for scans: as rows where there are few, else as look-ups. Made once, used by any number of scans."""

    rules: DataFrame
    literal: tuple[list, list] | None
    keys: Keyed | None


def rule_set(rules: DataFrame, rule_strings: DataFrame, common: DataFrame | None = None) -> RuleSet:
    """Measures rules and strings (small jobs), so that scans with them need none. `common`: see common_tokens."""
    if ("rule_id" in rules.columns) != ("rule_id" in rule_strings.columns):
        raise ValueError("rules and their strings must both have rule_id, or neither")
    literal = bounded_rules(rules, rule_strings)
    wanted = prepared(rule_strings).join(rules.select(rule_key(rules)).distinct(), "rule_key", "left_semi")
    return RuleSet(rules, literal, look_up_table(wanted, common) if literal is None else None)


def scan(
    files: DataFrame,
    rules: DataFrame | RuleSet,
    rule_strings: DataFrame | None = None,
    excluded_dirs=fixed.EXCLUDED_DIRS,
    excluded_names=fixed.EXCLUDED_NAMES,
    large_bytes: int | None = None,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Full scan: exclude, match, evaluate. One (rule_name, path) row per rule that fires on a file row.

    Deny-listed rules are left to the caller (filters.deny_rules). With few strings the whole scan is one narrow pass
    without a shuffle; otherwise string hits are looked up and grouped per file and rule. Files of more than `large_bytes`, where
    given, are cut into pieces that all tasks share.
    """
    ready = rules if isinstance(rules, RuleSet) else rule_set(rules, rule_strings)
    wanted = filters.exclude_names(filters.exclude_dirs(files, excluded_dirs), excluded_names)
    if large_bytes is not None:
        small, large = split_by_size(wanted, large_bytes)
        by_piece = fired_by_token(with_file_key(large), with_look_ups(ready, rule_strings), piece_bytes, True)
        return scan(small, ready, None, [], []).unionByName(as_often(by_piece, "_times").select("rule_name", "path"))
    if ready.literal is None:
        return as_often(fired_by_token(with_file_key(wanted), ready), "_times").select("rule_name", "path")
    # The outer form keeps the planner from testing all needles a second time in a filter below.
    fired = with_fired_rules(wanted, *ready.literal).select(F.explode_outer("rule_names").alias("rule_name"), "path")
    return fired.where("rule_name IS NOT NULL")


def matched_files(files: DataFrame, rules: DataFrame | RuleSet, rule_strings: DataFrame | None = None) -> DataFrame:
    """Files on which a rule fires, all columns kept, with `rule_names` (sorted). For sinks that need the content.

    With few strings the contents stay where they were read; otherwise the rules found are joined back to the files by file_key.
    """
    ready = rules if isinstance(rules, RuleSet) else rule_set(rules, rule_strings)
    if ready.literal is not None:
        return with_fired_rules(files, *ready.literal).where(F.size("rule_names") > 0)
    known = with_file_key(files)
    fired = fired_by_token(known, ready)
    names = fired.groupBy("file_key").agg(F.sort_array(F.collect_list("rule_name")).alias("rule_names"))
    return known.join(names, "file_key").select(*files.columns, "rule_names")


def bounded_rules(rules: DataFrame, rule_strings: DataFrame) -> tuple[list, list] | None:
    """Rules and their strings as rows, or None when either has more than LITERAL_STRINGS."""
    rule_rows = bounded_rows(rules.select(rule_key(rules), "rule_name", "min_hits", "only_id"), session.LITERAL_STRINGS)
    if rule_rows is None:
        return None
    mine = rule_strings.where(rule_key(rule_strings).isin([r["rule_key"] for r in rule_rows]))
    rows = literal_rows(mine)
    return None if rows is None else (rule_rows, rows)


def with_look_ups(ready: RuleSet, rule_strings: DataFrame | None) -> RuleSet:
    """The same rules with look-ups, also where there are few strings."""
    if ready.keys is not None:
        return ready
    rows = ready.rules.sparkSession.createDataFrame(ready.literal[1], "rule_key STRING, rule_name STRING, string_id STRING, needle BINARY")
    return RuleSet(ready.rules, ready.literal, look_up_table(rows))


def fired_by_token(files: DataFrame, ready: RuleSet, piece_bytes: int = PIECE_BYTES, spread: bool = False) -> DataFrame:
    """(path, file_key, rule_key, rule_name, _times) of the rules that fire on a file, which came `_times` times."""
    if not ready.keys.lengths:
        return no_hits(files).select("path", "file_key", "rule_key", "rule_name", F.lit(1).alias("_times"))
    found = pieces_with_hits(pieces(files, ready.keys.longest - 1, piece_bytes, spread), ready.keys)
    per_rule = found.groupBy("path", "file_key", "rule_key").agg(
        F.collect_set("string_id").alias("ids"), times_found("string_id", "text", "piece").alias("_times")
    )
    return conditions_met(per_rule, ready.rules).select("path", "file_key", "rule_key", "rule_name", "_times")


def with_fired_rules(files: DataFrame, rules, rows) -> DataFrame:
    """Adds `rule_names`: needles are tested once per file, conditions are sums of those tests in the same row."""
    if not rules or not rows:
        return files.withColumn("rule_names", F.array().cast("array<string>"))
    flags, found = with_needle_flags(files, rows)

    def fires(rule) -> Column:
        mine: dict[str, Column] = {}
        for r in rows:
            if r["rule_key"] == rule["rule_key"] and rule["only_id"] in (None, r["string_id"]):
                test = found[bytes(r["needle"])]
                mine[r["string_id"]] = mine[r["string_id"]] | test if r["string_id"] in mine else test
        if not mine or rule["min_hits"] is None:
            return F.lit(False)
        return sum((test.cast("int") for test in mine.values()), F.lit(0)) >= rule["min_hits"]

    ordered = sorted(rules, key=lambda r: r["rule_name"].encode())
    names = F.array_compact(F.array(*[F.when(fires(r), F.lit(r["rule_name"])) for r in ordered]))
    return flags.select(*files.columns, names.alias("rule_names"))


def quick_scan(
    files: DataFrame,
    rules: DataFrame,
    rule_strings: DataFrame,
    root: str,
    depth: int = 3,
    limit: int = 100,
    excluded_dirs=fixed.EXCLUDED_DIRS,
    excluded_names=fixed.EXCLUDED_NAMES,
) -> DataFrame:
    """Scan of the first files (by path) of one root down to a depth. The limit is the feature here."""
    near = filters.max_depth(files, root, depth)
    wanted = filters.exclude_names(filters.exclude_dirs(near, excluded_dirs), excluded_names)
    return scan(wanted.orderBy("path").limit(limit), rules, rule_strings, [], [])


# ---- around the scan


def fleet_scan(hosts: DataFrame, reports: DataFrame, matches: DataFrame) -> DataFrame:
    """(host, status, threats) of every host: failed, not installed, clean or threats.

    `hosts`: host. `reports`: host, installed of the hosts that answered. `matches`: host, one row per threat.
    """
    counts = matches.groupBy("host").agg(F.count(F.lit(1)).alias("threats"))
    answered = reports.groupBy("host").agg(F.bool_or("installed").alias("installed"))
    joined = hosts.join(answered, "host", "left").join(counts, "host", "left")
    threats = F.when(F.col("installed"), F.coalesce("threats", F.lit(0)))
    status = (
        F.when(F.col("installed").isNull(), "failed")
        .when(~F.col("installed"), "not installed")
        .when(F.coalesce("threats", F.lit(0)) > 0, "threats")
        .otherwise("clean")
    )
    return joined.select("host", status.alias("status"), threats.cast("bigint").alias("threats"))


def marker_name(content="content", markers=fixed.CONTENT_MARKERS) -> Column:
    """Name of the first content marker that occurs, else null."""
    out = None
    for text, name in markers:
        test = F.contains(X.col(content), F.lit(text))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def marker_check(files: DataFrame, markers=fixed.CONTENT_MARKERS) -> DataFrame:
    return files.withColumn("marker", marker_name("content", markers)).where("marker IS NOT NULL")


def rule_problem() -> Column:
    """Why a parsed rule cannot run; null for a working one."""
    ids = F.transform("strings", lambda s: s["string_id"])
    return (
        F.when(F.col("rule_name") == "", "no name")
        .when(F.size("strings") == 0, "no strings")
        .when(F.exists("strings", lambda s: ~s["kind"].isin("text", "hex")), "unsupported string")
        .when(F.exists("strings", lambda s: F.exists(s["modifiers"], lambda m: ~m.isin(*KNOWN_MODIFIERS))), "unsupported modifier")
        .when(F.col("condition").isNull(), "no condition")
        .when(F.col("min_hits").isNull(), "unknown condition")
        .when(F.col("only_id").isNotNull() & ~F.array_contains(ids, F.col("only_id")), "undeclared string")
        .when(F.col("min_hits") > F.size("strings"), "too few strings")
    )


def validate_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(working rules, broken rules with the problem found)."""
    checked = rules.withColumn("problem", rule_problem())
    return checked.where("problem IS NULL").drop("problem"), checked.where("problem IS NOT NULL")


def add_rules(rules: DataFrame, rule_strings: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append parsed custom rules and their strings to the corpus."""
    known = ["rule_id"] if "rule_id" in parsed.columns else []
    more = parsed.select(*known, "rule_name", F.inline("strings"))
    return (
        rules.unionByName(parsed.drop("strings"), allowMissingColumns=True),
        rule_strings.unionByName(more, allowMissingColumns=True),
    )


def guard(files: DataFrame, max_bytes: int) -> DataFrame:
    """The files with `oversize`, a mark for reports in place of a time limit per file. Marked files are scanned like all others."""
    return files.withColumn("oversize", F.col("size_bytes") > max_bytes)
