"""Spelling variants, resampling and the URL filter, against brute force and their SQL twins."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigward.llm import resampling, url_filter, variants
from sigward.llm.queries import URL_RULES
from test_operators import make_rows, table, twin

LOWER = {i: i + 32 for i in range(65, 91)}


# ---- spelling variants


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows) -> dict[str, tuple]:
    n: Counter[str] = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], None if form[w] is None else words[form[w]], root)
    return out


def word_rows() -> list[tuple]:
    """Words with neighbours in chains, anagrams, ties, long words and letters beyond ASCII."""
    rnd = random.Random(12)
    base = ["station", "Stations", "statoin", "garçon", "garÇon", "naïvely", "wording", "ÀÉÎÕÜ", "aabbcc" * 40, "listen", "silent", "tinsel"]
    words: list[str] = []
    for w in base:
        words += [w] * rnd.choice([24, 40])
        for _ in range(6):
            at, other = rnd.randrange(len(w)), rnd.choice("abceénst")
            changed = rnd.choice([w[:at] + w[at + 1 :], w[:at] + other + w[at + 1 :], w[:at] + other + w[at:]])
            words += [changed] * rnd.choice([3, 3, 6, 12])
    words += ["cottage"] * 40 + ["cottages"] * 18 + ["cottagess"] * 8 + ["cotttagess"] * 3
    rnd.shuffle(words)
    rows = [(i, rnd.choice([" ", "-", "1", "\n"]).join(words[i * 9 : i * 9 + 9]), "en", "a") for i in range(len(words) // 9)]
    rows += [(None, "station station statione statione statione", "en", "a"), rows[0], rows[0], (7, None, None, None), (8, "", "en", ""), (9, "12 --", "en", "")]
    return rows + [(9000, "longer " * 5000, "en", "b"), (9001, "some x" + "y" * 200_000, "en", "b")]


def test_variants(spark):
    rows = word_rows()
    found = variants.variants(table(spark, rows), variants.one_in_97).collect()
    columns = ["n", "n_near", "form", "form_n", "root"]
    want = brute_variants(rows)
    assert {r["word"]: tuple(r[c] for c in columns) for r in found} == want and len(found) == len(want)
    assert bag(twin(rows[:-1], variants.oracle(), "word, n, n_near, form, form_n, root")) == bag((w, *v) for w, v in want.items())
    assert sum(v[2] is not None and v[4] != v[2] for v in want.values()) >= 2


def test_variants_without_noise(spark):
    found = {r["word"]: r["form"] for r in variants.variants(table(spark, [(1, "colour colour colour color color color color color color", "en", "a")])).collect()}
    assert found == {"colour": "color", "color": None}


def test_signatures_meet():
    rnd = random.Random(2)
    for _ in range(3000):
        w = "".join(rnd.choices("abcdeé", k=rnd.randint(4, 14)))
        at, other = rnd.randrange(len(w)), rnd.choice("abcdeéz")
        x = rnd.choice([w[:at] + w[at + 1 :], w[:at] + other + w[at + 1 :], w[:at] + other + w[at:]])
        assert set(variants.signatures(w)) & set(variants.signatures(x))


def test_long_chain_of_forms(spark):
    """Each word's form is the next one of a chain of thirty."""
    chain = [("a" * i + "b" * (40 - i), 3 << i) for i in range(30)]
    words = spark.createDataFrame(chain, "word string, n long").repartition(3)
    found = {r["word"]: r["root"] for r in variants.forms(words).collect()}
    assert set(found.values()) == {chain[-1][0]}


def bag(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


# ---- resampling


def brute_draw(rows, target, percent=25):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def grams(text):
        w = word.findall((text or "").translate(LOWER))
        return len(w), Counter(zlib.crc32(g.encode()) % 10_000 for g in [*w, *map(" ".join, zip(w, w[1:]))])

    held = [(r[0], *grams(r[1])) for r in rows]
    s, t = Counter(), Counter()
    for _, _, c in held:
        s.update(c)
    for text in target:
        t.update(grams(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in s}
    out = []
    for doc_id, n_words, c in held:
        n = sum(c.values())
        weight = sum(k * gain[b] for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n_words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fits = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3]))
    drawn = {id(r): i + 1 for i, r in enumerate(fits[: percent * len(fits) // 100])}
    return Counter((r[0], r[2], r[3], r[4], drawn.get(id(r))) for r in out)


@pytest.mark.parametrize("with_target", [True, False])
def test_resampling(spark, with_target):
    rows = make_rows(21, 70)
    rows += [(4000, "Word" + "\u0130\u00c9 \u4e2d\u6587\x00x\x7fy" * 9, "en", "a"), (4001, "long" * 500 + " " + "w" * 33 + " " + "v" * 32, "en", "a")]
    rows += [(4100 + i, "river stone cloud " * 12, "en", "a") for i in range(30)]
    target = ["river stone cloud and wind", "the river of stone", None, "", "wörld " + "w" * 33] if with_target else []
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    found = resampling.resample(table(spark, rows), goal)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_draw(rows, target)
    assert bag(found.select(*columns).collect()) == want
    assert sum(r[4] is not None for r in want) > 20
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    con.register("benchmark", pa.table({"text": pa.array(target, pa.string())}))
    assert bag(con.sql(f"SELECT {', '.join(columns)} FROM ({resampling.oracle()})").fetchall()) == want


def test_sample_has_whole_rows(spark):
    docs = table(spark, make_rows(5, 40)).withColumn("_drawn", F.lit("own"))
    goal = spark.createDataFrame([("river stone",)], "text string")
    drawn = {r["doc_id"] for r in resampling.resample(docs, goal).where("rank IS NOT NULL").collect()} - {None}
    taken = resampling.sample(docs, goal)
    assert taken.columns == docs.columns and {r["doc_id"] for r in taken.collect()} == drawn


def test_bit_slices_are_exact():
    rng = np.random.default_rng(5)
    for low, high in ((-3000, 9000), (0, 1), (-1, 0), (-(2**40), 2**40), (5, 6)):
        gains = rng.integers(low, high, resampling.BUCKETS, endpoint=True)
        owner = np.sort(rng.integers(0, 300, 20_000))
        bucket = np.where(rng.random(20_000) < 0.3, 17, rng.integers(0, resampling.BUCKETS, 20_000))
        want = np.zeros(300, dtype=np.int64)
        np.add.at(want, owner, gains[bucket])
        assert (resampling.weight_sums(owner, bucket, 300, resampling.gain_planes(gains)) == want).all()


def test_no_documents(spark):
    empty = table(spark, [])
    assert resampling.resample(empty, empty).count() == 0 and variants.variants(empty).count() == 0
    assert resampling.sample(empty, empty).columns == empty.columns


# ---- URL filter


def page_rows() -> list[tuple]:
    rnd = random.Random(31)
    hosts = ["Big.Example.org", "example.org", "shop.example.com", "a.b.com", "plain.net", "notexample.org", "com"]
    rows = []
    for i in range(900):
        host = rnd.choice([hosts[0], hosts[0], *hosts])
        first = rnd.choice(["en", "es", "fr", "de", "it", "x%d" % rnd.randrange(400)])
        path = rnd.choice([f"/{first}/{rnd.randrange(300)}", f"/{first}/list/{rnd.choice('abc')}/deep/{i}", f"/{first}", "/", "", f"//{first}//"])
        tail = rnd.choice(["", "?q=/de/", "#top", "?a://b"])
        rows.append((i, f"{rnd.choice(['http', 'HTTPS'])}://{host}{path}{tail}"))
    rows += [(None, "http://example.org/es/1"), (5, None), (6, ""), (7, "no scheme/de/"), (8, "://"), (9, "x://?"), (10, "http://h/" + "d/" * 50_000), (11, "http://" + "." * 50_000 + "org/"), (5, rows[5][1]), (5, rows[5][1])]
    return rows


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "n", "v", 0.5, 3) for r in rows], "page_id long, url string, host string, row int, node string, verdict string, p double, label int").repartition(4)


def rule_rows(spark, rules=URL_RULES):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def test_url_filter(spark):
    rows = page_rows()
    columns = ["page_id", "host", "path", "rule", "verdict", "template"]
    found = url_filter.judge(pages(spark, rows), rule_rows(spark)).collect()
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string())}))
    assert bag(tuple(r[c] for c in columns) for r in found) == bag(con.sql(f"SELECT {', '.join(columns)} FROM ({url_filter.oracle(URL_RULES)})").fetchall())

    # Rules by plain Python.
    want = Counter()
    for page_id, url in rows:
        m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[page_id, host, path, *(max(fits)[1:] if fits else (None, None))] += 1
    assert bag((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in found) == want
    methods = Counter(r["verdict"] for r in found if r["rule"] is None)
    assert methods["allow"] and methods["block"]


def test_purity_decides_and_branches_merge(spark):
    """On a host with labels by first segment, unlabelled addresses follow their branch; like branches are one."""
    rows = [(i, f"http://h.com/{seg}/{i}") for i, seg in enumerate(["bad", "worse", "good", "fine"] * 60)]
    rows += [(1000 + i, f"http://h.com/{seg}/{i}/new") for i, seg in enumerate(["bad", "worse", "good", "fine"] * 5)]
    rules = [("h.com", f"/{seg}/{d}", verdict) for seg, verdict in (("bad", "block"), ("worse", "block"), ("good", "allow"), ("fine", "allow")) for d in "5678"]
    found = {r["page_id"]: r for r in url_filter.judge(pages(spark, rows), rule_rows(spark, rules)).collect()}
    for i, url in rows:
        assert found[i]["verdict"] == ("block" if "/bad/" in url or "/worse/" in url else "allow"), url
    assert {found[i]["template"].split("/")[1] for i, _ in rows} == {"bad|worse", "fine|good"}
    assert all(found[i]["template"].split("/")[2] == "*" for i in range(100))


def test_url_filter_without_rows_rules_or_labels(spark):
    assert url_filter.judge(pages(spark, []), rule_rows(spark)).count() == 0
    found = url_filter.judge(pages(spark, page_rows()), rule_rows(spark).limit(0)).collect()
    assert {r["verdict"] for r in found} == {"allow"} and {r["rule"] for r in found} == {None}


def test_longest_rule_wins(spark):
    rules = [("a.com", "/x/", "allow"), ("com", "/x/y/", "block"), ("a.com", "/x/y", "allow"), ("a.com", "/x/y", "block")]
    found = url_filter.judge(pages(spark, [(1, "s://b.a.com/x/y/z"), (2, "s://a.com/x/q"), (3, "s://ba.com/x/y/z"), (4, "s://com/x/q")]), rule_rows(spark, rules)).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in found} == {1: ("a.com/x/y", "block"), 2: ("a.com/x/", "allow"), 3: ("com/x/y/", "block"), 4: (None, "allow")}
