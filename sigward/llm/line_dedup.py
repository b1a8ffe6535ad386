"""Line dedup by a tree of log templates of fixed depth.

A line's words (runs without ASCII white space) are its tokens; a token with a digit is a variable field. The tree's first level is the
number of tokens, the next LEADING levels the leading tokens. Within a leaf, a place where no token holds most of the
leaf's distinct lines is a variable field too. A line that agrees with the leaf in all other places, which are CONSTANT of the
line at least, has the leaf's template; any other line has its own tokens as template. A template that recurs, in
MIN_DOCS documents or more, is dropped from all documents but the one of the smallest doc_id. A template of LONG_TOKENS tokens is a
passage, which no two documents share by chance, so LONG_DOCS documents make it recur.

Lines with fewer than MIN_TOKENS tokens, and blank ones, are never dropped: they are too short to be a passage. Rows are
hashes and counts until a document's dropped places meet its text; a template that most documents hold is one row per task
after the map-side combine.

Defined results: a null text has no lines and stays null. Rows that share a doc_id are one document for counts, and lose
the same templates. Rows without a doc_id keep all lines and count for nothing. An empty table gives no rows. Further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigward import session

LEADING = 3
MIN_DOCS = 3
MIN_TOKENS = 3
LONG_TOKENS, LONG_DOCS = 50, 2
# Generalised places are trusted in lines of GENERAL_TOKENS tokens or more, CONSTANT of which are the leaf's own.
GENERAL_TOKENS, CONSTANT = 8, 0.7
# Lines of such leaves (some 60 bytes each) that every task may hold; more are met by a shuffle.
BROADCAST_LEAVES = 500_000
# Hashes of wide leaves (16 bytes each) that every task may hold.
BROADCAST_WIDE = 1_000_000
# Places to drop (80 bytes each at most) that every task may hold; more meet the texts by a shuffle of these.
BROADCAST_PLACES = 500_000
SPACE = "[\\x20\\x09-\\x0D]+"
FIELD = "<*>"


def masked(line: Column) -> Column:
    """The tokens with variable fields in place of those with a digit, one blank between them."""
    odd = F.lit(False)
    for space in ("\t", "\x0b", "\x0c", "\r", "  "):
        odd = odd | F.contains(line, F.lit(space))
    plain = F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(plain)


def occurrences(text: Column, byte: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(byte), F.lit("")))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, place and masked text of each line long enough to be dropped; its hash and its leaf's."""
    each = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    rows = each.select("doc_id", "place", masked(F.col("line")).alias("masked"))
    rows = rows.withColumn("n", occurrences(F.col("masked"), " ") + 1).where(F.col("n") >= MIN_TOKENS)
    leaf = F.concat_ws(" ", F.col("n").cast("string"), F.substring_index("masked", " ", LEADING))
    return rows.withColumn("leaf", F.unhex(F.md5(leaf.cast("binary")))).withColumn("own", F.unhex(F.md5(F.col("masked").cast("binary"))))


def generalised(texts: DataFrame) -> DataFrame:
    """own, leaf and n of the distinct lines that have their leaf's template."""
    tokens = texts.select("leaf", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    held = tokens.groupBy("leaf", "at", "token").agg(F.count("*").alias("lines"))
    place = held.groupBy("leaf", "at").agg(F.max_by("token", "lines").alias("common"), F.max("lines").alias("most"), F.sum("lines").alias("all"))
    # A leaf's lines have one number of tokens, so its constants are no more than the tokens of a line.
    fixed = place.where(F.col("most") * 2 > F.col("all")).groupBy("leaf").agg(F.collect_list(F.struct("at", "common")).alias("fixed"))
    rows = texts.select("own", "leaf", "n", F.split("masked", " ").alias("tokens")).join(fixed, "leaf").where(F.size("fixed") >= F.lit(CONSTANT) * F.col("n"))
    return rows.where(F.forall("fixed", lambda f: F.get("tokens", f["at"]) == f["common"])).select("own", "leaf", "n")


def lines_of(docs: DataFrame, rows: DataFrame, wide: DataFrame) -> DataFrame:
    """own, leaf, n and masked text of the distinct lines in the wide leaves, each taken from one document that has it."""
    wide = F.broadcast(wide) if wide.count() <= BROADCAST_WIDE else wide
    own = rows.where(F.col("n") >= GENERAL_TOKENS).join(wide, "leaf", "left_semi").groupBy("own", "leaf", "n").agg(F.min("doc_id").alias("of"), F.min_by("place", "doc_id").alias("place"))
    spots = session.written(own.groupBy("of").agg(F.collect_list(F.struct("own", "leaf", "n", "place")).alias("spots")), "spots")
    side = F.broadcast(spots) if spots.agg(F.coalesce(F.sum(F.size("spots")), F.lit(0))).first()[0] <= BROADCAST_LEAVES else spots
    found = docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("of")).select(F.split("text", "\n").alias("lines"), F.explode("spots").alias("s"))
    line = found.select("s.own", "s.leaf", "s.n", masked(F.get("lines", F.col("s.place"))).alias("masked"))
    # Rows that share a doc_id may have another line in that place.
    return session.written(line.where(F.unhex(F.md5(F.col("masked").cast("binary"))) == F.col("own")).dropDuplicates(["own"]), "wide-lines")


def dropped(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id and place of each line to drop."""
    rows = session.written(lines(docs).select("doc_id", "place", "n", "leaf", "own"), "lines")
    pairs = rows.select("own", "leaf", "n", "doc_id").distinct()
    texts = session.written(pairs.groupBy("own", "leaf", "n").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")), "templates")
    # Only leaves of several distinct lines that reach min_docs together can gain from generalisation.
    wide = texts.where(F.col("n") >= GENERAL_TOKENS).groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs"))
    wide = session.written(wide.where((F.col("kinds") > 1) & (F.col("docs") >= min_docs)).select("leaf"), "wide")
    general = session.written(generalised(lines_of(docs, rows, wide)), "generalised")
    needed = F.when(F.col("n") >= LONG_TOKENS, min(LONG_DOCS, min_docs)).otherwise(min_docs)
    alone = texts.where(F.col("docs") >= needed).join(general, "own", "left_anti").select("own", "n", F.lit(None).cast("binary").alias("template"), "first")
    # All lines of either kind of template are met in one pass over the rows.
    chosen = alone.unionByName(general.select("own", "n", F.col("leaf").alias("template"), F.lit(None).cast("long").alias("first")))
    hits = session.written(rows.select("own", "doc_id", "place").join(chosen, "own").drop("own"), "hits")
    # A leaf's template is held by documents of several lines; each document counts once.
    held = hits.where("template IS NOT NULL").select("template", "doc_id").distinct()
    counts = held.groupBy("template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    of_leaves = hits.where("template IS NOT NULL").drop("first").join(counts, "template").where(F.col("docs") >= needed)
    recurring = hits.where("template IS NULL").select("doc_id", "place", "first").unionByName(of_leaves.select("doc_id", "place", "first"))
    return recurring.where(F.col("doc_id") > F.col("first")).select("doc_id", "place").distinct()


def with_kept(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """row (a document with all its columns, as a struct, so no name can clash), kept (the remaining text), lines and dropped (numbers of lines)."""
    places = dropped(docs, min_docs).groupBy("doc_id").agg(F.collect_set("place").alias("places")).withColumnRenamed("doc_id", "of")
    places = session.written(places, "places")
    places = F.broadcast(places) if places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0] <= BROADCAST_PLACES else places
    joined = docs.select(F.struct("*").alias("row")).join(places, F.col("row.doc_id") == F.col("of"), "left")
    text = F.col("row.text")
    left = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.coalesce("places", F.array().cast("array<int>")), i))
    kept = F.when(F.col("of").isNull(), text).otherwise(F.array_join(left, "\n"))
    n = F.when(text.isNull(), 0).otherwise(occurrences(text, "\n") + 1)
    gone = F.when(text.isNull(), 0).otherwise(F.coalesce(F.size("places"), F.lit(0)))
    return joined.select("row", kept.alias("kept"), n.cast("long").alias("lines"), gone.cast("long").alias("dropped"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of the remaining text (null for a null text)."""
    rows = with_kept(docs.select("doc_id", "text"), min_docs)
    return rows.select("row.doc_id", F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle(min_docs: int = MIN_DOCS) -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
split AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM docs WHERE text IS NOT NULL),
each AS (SELECT r, doc_id, ls[i] AS line, i AS place FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
rows AS (SELECT r, doc_id, place, line, regexp_replace(regexp_replace(regexp_replace(line, '{SPACE}', ' ', 'g'), '^ | $', '', 'g'), '[^ ]*[0-9][^ ]*', '{FIELD}', 'g') AS m FROM each),
toks AS (SELECT *, string_split(m, ' ') AS t, len(string_split(m, ' ')) AS n FROM rows),
long AS (SELECT doc_id, place, m, t, n, n || ' ' || array_to_string(t[1:{LEADING}], ' ') AS leaf FROM toks WHERE n >= {MIN_TOKENS} AND doc_id IS NOT NULL),
texts AS (SELECT m, leaf, n, any_value(t) AS t, count(DISTINCT doc_id) AS docs FROM long GROUP BY m, leaf, n),
wide AS (SELECT leaf FROM texts WHERE n >= {GENERAL_TOKENS} GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= {min_docs}),
tokens AS (SELECT m, leaf, n, i AS pos, t[i] AS token FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM texts WHERE n >= {GENERAL_TOKENS} AND leaf IN (FROM wide))),
held AS (SELECT leaf, pos, token, count(*) AS c, sum(count(*)) OVER (PARTITION BY leaf, pos) AS total FROM tokens GROUP BY leaf, pos, token),
constant AS (SELECT leaf, pos, token FROM held WHERE c * 2 > total),
leaves AS (SELECT leaf, count(*) AS constants FROM constant GROUP BY leaf),
agree AS (SELECT m, leaf, n, count(*) AS c FROM tokens JOIN constant USING (leaf, pos, token) GROUP BY m, leaf, n),
general AS (SELECT a.m, 'leaf ' || a.leaf AS template FROM agree a JOIN leaves USING (leaf) WHERE a.c = constants AND constants >= {CONSTANT} * a.n),
named AS (SELECT l.doc_id, l.place, l.n, coalesce(g.template, 'own ' || l.m) AS template FROM long l LEFT JOIN general g USING (m)),
recurring AS (SELECT template, min(doc_id) AS first FROM named GROUP BY template 
  HAVING count(DISTINCT doc_id) >= CASE WHEN min(n) >= {LONG_TOKENS} THEN {min(LONG_DOCS, min_docs)} ELSE {min_docs} END),
gone AS (SELECT DISTINCT doc_id, place FROM named JOIN recurring USING (template) WHERE doc_id > first),
left_ AS (SELECT r, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE g.place IS NULL) AS kept, count(*) AS n, count(g.place) AS gone FROM each e LEFT JOIN gone g USING (doc_id, place) GROUP BY r)
SELECT d.doc_id, coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(l.gone, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(l.kept, '')) END AS kept_sha256
FROM docs d LEFT JOIN left_ l USING (r)"""
