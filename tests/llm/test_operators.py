"""Each operator against brute force, on a small table with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigward.llm import binary_search, fingerprints, language, line_dedup, lm, mixing, ngram_join, packing, suffix_dedup, token_output, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, pass int, key string, rank int, component string, slice long, kind string"
WORDS = "the of and river stone cloud tin a to in 12 x7 über garçon niño que les der und wind".split()


def vocabulary(name: str) -> str:
    return pytest.importorskip("public_tokenizers").path(name)


def make_rows(seed: int = 3, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    line = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k))
    shared = [line(14), "user 17 logged in from host 9 at noon today", line(30)]
    rows: list[tuple[int | None, str | None, str | None, str | None]] = []
    for i in range(n):
        lines = [line(rnd.randint(1, 25)) for _ in range(rnd.randint(1, 6))]
        if rnd.random() < 0.5:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(shared).replace("17", str(i)))
        rows.append((i * 7, "\n".join(lines), rnd.choice(["en", "de", "fr"]), rnd.choice(["a", "a", "a", "b", None])))
    texts = [r[1] for r in rows]
    rows += [(1000 + i, texts[i], "en", "a") for i in range(8)]
    for i in range(8):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((2000 + i, " ".join(words), "en", "b"))
    rows += [(3000, None, None, None), (3001, "", "en", ""), (3002, " \n\t\n ", None, "b"), (3003, "one", "en", "b"), (3004, "one two", "en", "b"), (3005, "één", "fr", "c")]
    rows += [(3006, " ".join(rnd.choice(WORDS) for _ in range(6000)), "en", "a"), (3007, "1234 ### !!", "en", "c"), (None, texts[0], "en", "a"), rows[5], rows[5]]
    rows += [(3100 + i, " ".join(WORDS[: 8 + i]), "en", "d") for i in range(12)]
    rnd.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 5, 1, "k", 2, "c", 3, "later") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def words_of(text: str | None) -> list[str]:
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def twin(rows, sql: str, columns: str) -> list[tuple]:
    import pandas as pd

    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())})
    con = duckdb.connect()
    con.register("documents", documents)
    assert pd is not None
    return con.sql(f"SELECT {columns} FROM ({sql})").fetchall()


def bag(found) -> Counter:
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found)


@pytest.mark.parametrize("make", [
    lambda d: line_dedup.line_dedup(d), lambda d: ngram_join.ngram_join(d), lambda d: fingerprints.fingerprints(d),
    lambda d: token_output.token_files(d, vocabulary("byte_bpe_50k.json")), lambda d: packing.pack(d, vocabulary("word_bpe_49k.json")),
    lambda d: suffix_dedup.suffix_dedup(d), lambda d: lm.score(d, head=50, classes=8, rounds=1), lambda d: mixing.mix(d), lambda d: mixing.repeated(d),
    lambda d: language.identify(language.document_evidence(d)),
])
def test_empty_table(empty, make):
    assert make(empty).count() == 0


def test_line_dedup(docs, rows):
    columns = "doc_id, n_lines, n_dropped, kept_sha256"
    found = line_dedup.line_dedup(docs).select(*columns.split(", ")).collect()
    assert bag(found) == bag(twin(rows, line_dedup.oracle(), columns))
    assert sum(r["n_dropped"] for r in found) > 20


def test_line_dedup_generalises_fields(spark):
    log = [f"job ended by user {name} with status fine after some short while" for name in ("alpha", "beta", "gamma", "delta")]
    rows = [(i, f"{line}\nown words of document number {'x' * (i + 1)}", "en", "a") for i, line in enumerate(log)]
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 1}


def brute_components(rows, gram: int = 3, share: int = 90) -> dict[int, int]:
    sets: dict[int, list] = defaultdict(list)
    for d, text, *_ in rows:
        w = words_of(text)
        grams = {tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)} if len(w) >= gram else {tuple(w)} if w else set()
        if d is not None:
            sets[d].append(grams)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(100 * len(s & t) >= share * len(s | t) for s in sets[a] for t in sets[b] if s and t):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("seed", [3, 4])
def test_ngram_join(spark, seed):
    rnd = random.Random(seed)
    rows = make_rows(seed)
    base = [rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(120)]
    for i in range(60):  # a group of near copies at all distances, of all sizes
        own = base[: rnd.choice([11, 12, 13, 19, 20, 21, 22, 29, 30, 31, 60, 120])]
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(len(own))] = "z" + str(rnd.randint(0, 9))
        rows.append((5000 + i, " ".join(own), "en", "a"))
    want = brute_components(rows)
    found = ngram_join.ngram_join(table(spark, rows)).collect()
    assert len(found) == len(rows)
    assert all(r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in found)
    sizes = Counter()
    for d, text, *_ in rows:
        w = words_of(text)
        sizes[d, len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) > 2 else min(len(w), 1)] += 1
    assert Counter((r["doc_id"], r["n_shingles"]) for r in found) == sizes


def test_ngram_join_blocks_of_a_family(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FAMILY", 7)
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        own = list(base)
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(200)] = f"q{rnd.randint(0, 99)}"
        rows.append((i, " ".join(own), "en", "a"))
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(table(spark, rows)).collect()} == want


def test_boundary_follows_cost():
    assert ngram_join.boundary([(12, 100)]) > 12
    assert ngram_join.boundary([(24, 1000)]) <= 24
    assert ngram_join.subsets_of(18) == 1 + 18 + 153


def test_fingerprints(docs, rows):
    columns = "doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next"
    distinct = [r for r in rows if r[0] is None or sum(x[0] == r[0] for x in rows) == 1]
    found = fingerprints.fingerprints(table(docs.sparkSession, distinct)).select(*columns.split(", ")).collect()
    assert bag(found) == bag(twin(distinct, fingerprints.oracle(), columns))
    assert len(fingerprints.fingerprints(docs).collect()) == len(rows)


def test_fingerprints_sparse_ids(spark):
    rows = [(i, f"text {i}", "en", "a") for i in (-(1 << 62), -5, 0, 3, 1 << 40, (1 << 62) + 7)]
    columns = "doc_id, edited_sha256, near_next"
    found = fingerprints.fingerprints(table(spark, rows)).select(*columns.split(", ")).collect()
    assert bag(found) == bag(twin(rows, fingerprints.oracle(), columns))


def test_fingerprint_is_a_multiset_hash(spark):
    n = fingerprints.numbers
    df = spark.createDataFrame([("a\nb\nc", "c\na\nb", "a\nb", "c")], "x string, y string, z string, p string").select(*[n(F.col(c)).alias(c) for c in "xyzp"])
    v = fingerprints.vector
    more, less = fingerprints.insert(v(F.col("z")), F.col("p")), fingerprints.delete(v(F.col("x")), F.col("p"))
    r = df.select(v(F.col("x")).alias("vx"), v(F.col("y")).alias("vy"), more.alias("more"), less.alias("less"), v(F.col("z")).alias("vz")).first()
    assert r["vx"] == r["vy"] == r["more"] and r["less"] == r["vz"] != r["vx"]


def test_stream_coding_round_trip():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        x = (rnd.integers(0, 1 << 32, n, dtype=np.uint64) >> rnd.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (token_output.unpack(*token_output.pack(x), n) == x).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_texts(name):
    make = tokens.Encoder(vocabulary(name))
    rnd = random.Random(5)
    parts = [*" \n\t'sS.,aé1", "́", "\x00", "Σ", "😀", " ", "\x85", "<|endoftext|>", "don't", "İ", "ﬁ", "\x1c"]
    texts = [None, "", " ", "  x", "x ", *("".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(1500))]
    ids, counts = make.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    whole = [x.ids for x in make.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == whole


def encoded(name: str, text: str | None) -> np.ndarray:
    from tokenizers import Tokenizer

    make = encoded.__dict__.setdefault(name, Tokenizer.from_file(vocabulary(name)))
    return np.array([*make.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_token_files(docs, rows):
    found = token_output.token_files(docs, vocabulary("byte_bpe_50k.json"), partitions=3).collect()
    want = Counter()
    for d, text, *_ in rows:
        ids = encoded("byte_bpe_50k.json", text)
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    order = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order]).tolist()[:-1]]
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_packing(docs, rows):
    found = packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=256, block=30).collect()
    want = Counter()
    for d, text, *_ in rows:
        ids = encoded("word_bpe_49k.json", text)
        for k, at in enumerate(range(0, len(ids), 256)):
            want[d, k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) <= 256
    assert len(bins) <= 1.08 * math.ceil(sum(r["length"] for r in found) / 256) + 1


def test_swaps_improve():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        lengths = rnd.integers(1, 100, 60)
        start = packing.best_fit(lengths, 100)
        end = packing.improve([list(b) for b in start], lengths, 100)
        assert sorted(i for b in end for i in b) == list(range(60)) and all(lengths[b].sum() <= 100 for b in end)
        assert len(end) <= len(start) and sum(lengths[b].sum() ** 2 for b in end) >= sum(lengths[b].sum() ** 2 for b in start)
    # Two for one, and a bin that runs empty.
    assert len(packing.improve([[0, 1], [2], [3]], np.array([30, 30, 95, 5]), 100)) == 2


def brute_suffix(rows) -> Counter:
    first: dict[bytes, int] = {}
    for d, text, *_ in rows:
        b = (text or "").encode()
        for p in range(len(b) - 49 if d is not None else 0):
            w = b[p : p + 50]
            first[w] = min(first.get(w, d), d)
    out = Counter()
    for d, text, *_ in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49 if d is not None else 0):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup(spark, docs, rows):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert bag(suffix_dedup.suffix_dedup(docs, 2000, 4000).select(*columns).collect()) == brute_suffix(rows)
    odd = [(1, "a" * 400, "en", "a"), (2, "b" + "a" * 60 + "c" * 80, "en", "a"), (3, "ab" * 70, "en", "a"), (4, "x" * 49, "en", "a"), (5, "x" * 49, "en", "a"), (6, "ba" * 40 + "é" * 30, "en", "a"), (7, "é" * 26, "en", "a"), (0, "é" * 24, "en", "a")]
    assert bag(suffix_dedup.suffix_dedup(table(spark, odd)).select(*columns).collect()) == brute_suffix(odd)


def test_lm_base_score_and_normalisation(docs, rows):
    found = lm.score(docs, head=12, classes=8, rounds=1).collect()
    held = lambda d: zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2
    texts = [(d, [*words_of(text), None]) for d, text, *_ in rows]
    count = Counter(w for d, ws in texts if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((d, held(d), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in texts)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_lm_learns(spark):
    rnd = random.Random(0)
    follow = {w: rnd.sample(range(30), 3) for w in range(30)}
    rows = []
    for i in range(400):
        w, out = rnd.randrange(30), []
        for _ in range(60):
            out.append(f"w{w}")
            w = rnd.choice(follow[w])
        rows.append((i, " ".join(out), "en", "a"))
    found = [r for r in lm.score(table(spark, rows), rounds=3).collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > 0.95 * sum(r["base_score"] for r in found)


def test_lm_totals_are_normalised(spark):
    p = lm.start_parameters(np.array([0.5, 0.3, 0.2]))
    totals = lm.log_totals(spark, p)
    scores = (p["context"] @ p["near"])[:, None, :] + (p["context"] @ p["far"])[None, :, :]
    logs = scores @ p["target"].T + p["bias"] - totals.T[:, :, None]
    assert np.allclose(np.exp(logs).sum(axis=2), 1, atol=1e-4)


def test_mixing(docs, rows):
    columns = "doc_id, source, pass, n_tokens, position, block"
    found = mixing.mix(docs).select(*columns.split(", ")).collect()
    assert bag(found) == bag(twin(rows, mixing.oracle(), columns))
    whole = Counter((r[0], r[3]) for r in rows)
    first = Counter((r["doc_id"], r["source"]) for r in found if r["pass"] == 0)
    assert first == whole
    again = Counter((r["doc_id"], r["source"]) for r in found)
    assert Counter((r["doc_id"], r["source"]) for r in mixing.repeated(docs).collect()) == again


def test_mixing_goals(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 5 == 0]) for i in range(100)]
    words = mixing.mix(table(spark, rows), max_repeats=1.5)
    assert Counter(r["source"] for r in words.collect())["b"] == 30
    counted = table(spark, rows).select("doc_id", "source", F.lit(10).cast("long").alias("n_tokens"))
    made = mixing.plan(counted, entropy=0.69)
    weights = [r["weight"] for r in made.passes.collect()]
    assert 0.69 <= -sum(w * math.log(w) for w in weights) < 0.6905
    few = mixing.mix(table(spark, rows), entropy=0.69, budget=200).collect()
    assert 150 <= sum(r["n_tokens"] for r in few) <= 200


def test_language(spark):
    rnd = random.Random(1)
    sound = {"en": "the and shon thed ing wh".split(), "de": "der sch ung zu äu keit".split(), "fr": "eau que é ç ou les".split()}
    rows = []
    for i in range(300):
        lang = rnd.choice(list(sound))
        text = " ".join("".join(rnd.choices(sound[lang], k=2)) for _ in range(rnd.randint(3, 40)))
        said = rnd.choice(list(sound)) if rnd.random() < 0.1 else lang
        rows.append((i, text, said, f"host-{lang}" if rnd.random() < 0.9 else None))
    truth = {r[0]: r[3][5:] for r in rows if r[3]}
    rows += [(900, None, "en", "host-en"), (901, "", "en", "host-en"), (902, "123 456 ---", "en", "host-en"), (903, "中文字符" * 40, None, None)]
    found = {r["doc_id"]: r for r in language.identify(language.document_evidence(table(spark, rows))).collect()}
    assert sum(found[d]["lang"] == t for d, t in truth.items()) > 0.97 * len(truth)
    assert all(found[d]["kept"] for d in truth)
    assert [found[d]["lang"] for d in (900, 901, 902, 903)] == ["und"] * 4 and not any(found[d]["kept"] for d in (900, 901, 902, 903))


def test_page_evidence(spark):
    pages = spark.createDataFrame([(1, "https://u@www.Example.de:80/x?y", "<html class=a LANG='fr-CA'><style>p{}</style><p>Bon <b>jour</b>"), (2, None, None), (3, "ftp://x.org", "plain")], "page_id long, url string, html string")
    found = {r["doc_id"]: r for r in language.page_evidence(pages).collect()}
    assert (found[1]["declared"], found[1]["host"], found[1]["suffix"], found[1]["text"].split()) == ("fr", "www.example.de", "de", ["Bon", "jour"])
    assert (found[2]["declared"], found[2]["host"], found[2]["suffix"], found[2]["text"]) == (None, None, None, "")
    assert (found[3]["declared"], found[3]["suffix"]) == (None, "org")


def test_top_k(spark):
    rnd = random.Random(7)
    centres = [[rnd.gauss(0, 1) for _ in range(40)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.6) for x in rnd.choice(centres)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [rows[3], (None, rows[0][1]), (400, None), (401, []), (402, [1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, segments string").repartition(4)
    found = binary_search.top_k(df, F.col("vec_id") % 10 == 0, 12).collect()
    codes = {i: [x > 0 for x in e] for i, e in rows if i is not None and e and len(e) == 40}
    want = []
    for q in codes:
        if q % 10 == 0:
            near = sorted((sum(a != b for a, b in zip(codes[q], c, strict=True)), v) for v, c in codes.items() if v != q)[:12]
            want += [(q, k + 1, v, d) for k, (d, v) in enumerate(near)]
    assert sorted(tuple(r) for r in found) == sorted(want)
    few = binary_search.top_k(df.where("vec_id < 4"), F.col("vec_id") == 0, 12).collect()
    assert len(few) == 3
    assert binary_search.top_k(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("at_once", [0, 10**9])
def test_top_k_steps(spark, monkeypatch, at_once):
    """One segment or all segments a step; vectors of two lengths, an id with two codes, a code that a third of the rows hold."""
    monkeypatch.setattr(binary_search, "STEP_PROBES", at_once)
    rnd = random.Random(11)
    rows = [(i, [rnd.choice([-1.0, 0.0, 1.0, None]) for _ in range(23)]) for i in range(120)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(500, [1.0] * 24), (20, rows[9][1]), (40, rows[40][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    k = 9
    found = sorted(tuple(r) for r in binary_search.top_k(df, F.col("vec_id") % 20 == 0, k).select("query_id", "rank", "vec_id", "distance").collect())
    codes = sorted({(i, tuple(x is not None and x > 0 for x in e)) for i, e in rows if i is not None and len(e) == 23})
    want = []
    for q in sorted({i for i, _ in codes if i % 20 == 0}):
        near = sorted((sum(a != b for a, b in zip(own, c, strict=True)), v) for i, own in codes if i == q for v, c in codes if v != q)[:k]
        want += [(q, n + 1, v, d) for n, (d, v) in enumerate(near)]
    assert found == sorted(want)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}))
    assert sorted(con.sql(f"SELECT query_id, rank, vec_id, distance FROM ({binary_search.oracle(20, k)})").fetchall()) == found


def test_line_dedup_passages(spark):
    """A line of 50 words or more recurs in two documents, a shorter one in three."""
    passage, below = (" ".join(f"word{'x' * (i % 7)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)) for n in (50, 49))
    texts = [f"{passage}\nsome first words", f"an own line here\n{passage}\n{below}", f"{below}\nthe words of the third", "a clean document of its own"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 0}
    columns = "doc_id, n_lines, n_dropped, kept_sha256"
    assert bag(line_dedup.line_dedup(table(spark, rows)).select(*columns.split(", ")).collect()) == bag(twin(rows, line_dedup.oracle(), columns))
