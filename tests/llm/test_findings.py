"""Cases that a review found: scripts without blanks, rare languages, markers of tokenizers, near copies in the pipeline."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sigward.llm import language, ngram_join, suffix_dedup, tokens
from test_operators import WORDS, make_rows, table, vocabulary, words_of


def test_digits_in_scripts_without_blanks(spark):
    rnd = random.Random(4)
    sentences = {"zh": "我们今天在城市里看见了很多人和汽车", "ja": "きょうはとてもよいてんきでしたので", "th": "วันนี้อากาศดีมากและเราไปตลาดกัน"}
    rows = []
    for i in range(60):
        lang = list(sentences)[i % 3]
        letters = rnd.choices(sentences[lang], k=60)
        letters.insert(rnd.randrange(60), str(rnd.randint(0, 2026)))
        rows.append((i, "".join(letters), lang, "host"))
    assert language.plain(pa.array(["他有5本书", "see a5-b/7.x now", "1234"])).to_pylist() == ["他有 本书", "see   now", " "]
    found = {r["doc_id"]: r for r in language.identify(language.document_evidence(table(spark, rows))).collect()}
    assert all(found[i]["kept"] and found[i]["lang"] == lang for i, _, lang, _ in rows)


def test_rare_language_is_a_class(spark):
    rnd = random.Random(6)
    sound = {"en": "the and shon thed ing wh".split(), "cy": "llw ydd wyr ffo chw gwe".split()}
    make = lambda lang: " ".join("".join(rnd.choices(sound[lang], k=2)) for _ in range(40))
    rows = [(i, make("en"), "en", "host") for i in range(600)] + [(1000 + i, make("cy"), "cy", "host") for i in range(6)]
    found = {r["doc_id"]: r["lang"] for r in language.identify(language.document_evidence(table(spark, rows)), 30).collect()}
    assert [found[1000 + i] for i in range(6)] == ["cy"] * 6


def test_sample_of_copies_is_bounded(spark):
    same = [(i, "one text in many documents", "en", "a") for i in range(400)] + [(None, "a text without any id", "en", "a")] * 300
    rows = [*same, *[(1000 + i, f"w{i} and so on", "de", "a") for i in range(20)]]
    docs = language.document_evidence(table(spark, rows)).select("doc_id", "text", "declared")
    names, chosen = language.sample(docs, 100)
    taken = chosen.selectExpr("declared", "1 / copies AS one").groupBy("declared").sum("one").collect()
    n = {r[0]: round(r[1], 6) for r in taken}
    assert names == ["de", "en"] and n["de"] == 20 and 80 <= n["en"] <= 100


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_markers_in_texts(name):
    from tokenizers import Tokenizer

    path = vocabulary(name)
    rnd = random.Random(8)
    parts = [*" \n'sS.a1é", "\x00", "İ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "word"]
    texts = [None, "one <|endoftext|> two", "one <|EndOfText|> two", *("".join(rnd.choices(parts, k=rnd.randint(0, 15))) for _ in range(800))]
    ids, counts = tokens.Encoder(path).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    library = Tokenizer.from_file(path)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def brute_groups(rows, gram: int, share: int) -> dict[int, int]:
    """Smallest doc_id of all that hang together with a document."""
    sets = defaultdict(list)
    for d, text, *_ in rows:
        w = words_of(text)
        if d is not None:
            sets[d].append({tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)} if len(w) >= gram else {tuple(w)} if w else set())
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] != group[b] and any(100 * len(s & t) >= share * len(s | t) for s in sets[a] for t in sets[b] if s and t):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    return group


@pytest.mark.parametrize("gram,share", [(5, 80), (3, 90), (2, 67)])
def test_near_copies_of_any_contract(spark, gram, share):
    rnd = random.Random(11)
    rows = make_rows(11, 30)
    base = [rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(120)]
    for i in range(70):  # near copies at all distances, of all sizes
        own = base[: rnd.choice([5, 6, 8, 9, 10, 11, 12, 19, 24, 31, 49, 53, 60, 120])]
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(len(own))] = "z" + str(rnd.randint(0, 9))
        rows.append((5000 + i, " ".join(own), "en", "a"))
    want = brute_groups(rows, gram, share)
    found = ngram_join.ngram_join(table(spark, rows), gram, share).collect()
    assert len(found) == len(rows)
    assert all(r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in found)


def test_pipeline_keeps_one_of_near_copies_by_five_words(spark):
    rnd = random.Random(12)
    rows = make_rows(12, 20)
    for i in range(20):
        words = [f"v{rnd.randint(0, 10**6)}" for _ in range(55)]
        rows += [(6000 + 2 * i, " ".join(words), "en", "a"), (6001 + 2 * i, " ".join([*words[:25], "changed", *words[26:]]), "en", "a")]
    docs = table(spark, rows)
    groups = brute_groups(rows, 5, 80)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "").select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in kept) == Counter(r[:2] for r in rows if r[0] is None or groups[r[0]] == r[0])
    assert not {r["doc_id"] for r in kept} & set(range(6001, 6040, 2))


def test_groups_of_equal_suffixes():
    """Passes over the bytes find exactly the suffixes that are equal to the depth, in order."""
    rng = np.random.default_rng(3)
    for depth in (8, 9, 20, 50):
        raw = np.concatenate([rng.integers(97, 99, 300), np.tile(rng.integers(97, 123, 70), 5), np.zeros(120)]).astype(np.uint8)
        at = rng.permutation(len(raw) - depth + 1)
        found, group = suffix_dedup.equal_groups(raw, at, depth)
        texts = [raw[p : p + depth].tobytes() for p in at.tolist()]
        n = Counter(texts)
        assert sorted(found.tolist()) == [i for i, t in enumerate(texts) if n[t] > 1]
        in_order = [texts[i] for i in found.tolist()]
        assert in_order == sorted(in_order) and len(set(zip(group.tolist(), in_order))) == len(set(group.tolist())) == len(set(in_order))


def test_a_digit_in_many_documents(spark, monkeypatch):
    """A passage in a third of 3,000 documents, sorted in small turns: all but the first copy go."""
    monkeypatch.setattr(suffix_dedup, "TURN_BYTES", 4000)
    passage = "a passage that very many of the documents of this table hold, word for word. "
    rows = [(i, (passage if i % 3 == 0 else "") + f"own words {i} " + "".join(chr(97 + (i * k) % 26) for k in range(1, 60)), "en", "a") for i in range(3000)]
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(table(spark, rows)).select("doc_id", "n_removed").collect()}
    assert found[0] == 0 and all(found[i] >= len(passage) for i in range(3, 3000, 3))
