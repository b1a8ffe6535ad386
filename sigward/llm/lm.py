"""LM scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

The vectors of the two words before a word, each times a matrix of its place, predict the word's vector: the score of a
word is their sum times the word's vector, plus its bias. Training (`nce_pass`) tells a word of the corpus from words of
the unigram distribution, so no step needs all words; scoring is normalised over all words, by matrix products over all
contexts at once (`log_totals`). Words are in classes: the CLASSES - 1 most frequent words are a class of their own, all others
one class, within which a word has its smoothed share. So every text has a normalised log-probability.

Each Spark task passes over its share of all training texts and the parameters are averaged, weighted by tokens, ROUNDS
times; sums of parameters meet in a bounded number of groups before the driver. Counts are exact for all words: the HEAD
most frequent at most go to all tasks, the rest by a join on the word.

Defined results: a null or empty text is the end token alone. A null doc_id counts as the empty text for the fold. Rows
that share a doc_id are scored each. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigward import session
from sigward.llm import common

FOLDS, HELD_OUT = 7, 2
HEAD = 1 << 17
CLASSES, WIDTH, ROUNDS = 1024, 16, 2
BATCH, NOISE, RATE = 8192, 64, 0.08
RUN_BYTES = 8 << 20
GROUPS = 32
END = ""
PARAMETERS = ("context", "near", "far", "target", "bias")


def token_lists(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts on end, each text closed by the end token; the number of tokens of each text."""
    words, counts = common.words(texts)
    index = words.indices.to_numpy(zero_copy_only=False)
    place = len(words.dictionary)
    out = np.empty(len(index) + len(counts), dtype=np.int32)
    last = np.cumsum(counts + 1) - 1
    inner = np.ones(len(out), dtype=bool)
    inner[last] = False
    out[inner], out[last] = index, place
    return pa.DictionaryArray.from_arrays(pa.array(out), pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([END])])), counts + 1


def count_words(docs: DataFrame) -> DataFrame:
    """word and its count over all texts, the end token included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(iter([batch]), "text", RUN_BYTES):
                words, _ = token_lists(part.column("text"))
                n = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"]).filter(pa.array(n > 0))

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int) -> tuple[pd.DataFrame, int]:
    """Words at or above the smallest count that at most `most` words reach, and that count."""
    # Counts in steps of a 32nd of a doubling: some hundreds of rows.
    step = F.floor(F.log2("n") * 32)
    levels = counts.groupBy(step.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        return pd.DataFrame({"word": pd.Series(dtype=object), "n": pd.Series(dtype=np.int64)}), 1 << 62
    return counts.where(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True]).reset_index(drop=True), least


class Vocabulary:
    """Head words with counts; the first of them have a class of their own, class 0 is all other words."""

    def __init__(self, words: list[str], counts: np.ndarray, classes: int):
        self.place = {w: i for i, w in enumerate(words)}
        self.counts = np.append(counts, 0)
        own = [i for i, w in enumerate(words) if w != END][: classes - 2]
        self.classes = np.zeros(len(words) + 1, dtype=np.int32)
        self.classes[own] = np.arange(len(own)) + 2
        self.end = 1
        if END in self.place:
            self.classes[self.place[END]] = self.end
        self.size = len(own) + 2

    def of(self, words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Head place (the last for others) and class of each token."""
        places = np.fromiter((self.place.get(w, len(self.place)) for w in words.dictionary.to_pylist()), dtype=np.int64, count=len(words.dictionary))
        index = words.indices.to_numpy(zero_copy_only=False)
        classes = self.classes[places]
        classes[np.flatnonzero(np.array(words.dictionary.to_pylist(), dtype=object) == END)] = self.end
        return places[index], classes[index]


def contexts(classes: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the word before and of that two before; the end class where a text begins."""
    near, far = np.roll(classes, 1), np.roll(classes, 2)
    starts = np.cumsum(counts) - counts
    near[starts] = end
    far[starts] = end
    second = starts[counts > 1] + 1
    far[second] = end
    return near, far


def start_parameters(share: np.ndarray) -> dict[str, np.ndarray]:
    rng, n = np.random.default_rng(0), len(share)
    small = lambda: (rng.standard_normal((n, WIDTH)) * 0.1).astype(np.float32)
    eye = np.eye(WIDTH, dtype=np.float32)
    return {"context": small(), "near": eye.copy(), "far": 0.5 * eye, "target": small(), "bias": np.log(share).astype(np.float32)}


def scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows with the same index."""
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    # Classes fit 16 bits, which numpy sorts by radix.
    order = np.argsort(index.astype(np.uint16), kind="stable")
    counts = np.bincount(index, minlength=n)
    there = np.flatnonzero(counts)
    out[there] = np.add.reduceat(rows[order], (np.cumsum(counts) - counts)[there])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, as the largest arrays of a step pass through it."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def nce_step(p: dict[str, np.ndarray], slope: dict[str, np.ndarray], near: np.ndarray, far: np.ndarray, word: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
    """One step of ascent on the noise-contrastive likelihood of a batch, in place; `noise` is shared by the batch."""
    n, size = len(p["bias"]), np.float32(len(word))
    a, b = p["context"][near], p["context"][far]
    guess = a @ p["near"] + b @ p["far"]
    true = p["target"][word]
    g = 1 - sigmoid((guess * true).sum(axis=1) + p["bias"][word] - log_noise[word])
    other = p["target"][noise]
    h = guess @ other.T
    h += p["bias"][noise] - log_noise[noise]
    h = np.negative(sigmoid(h), out=h)
    back = g[:, None] * true + h @ other
    grads = {
        "target": scatter(word, g[:, None] * guess, n) + scatter(noise, h.T @ guess, n),
        "bias": np.bincount(word, g, n) + np.bincount(noise, h.sum(axis=0), n),
        "context": scatter(near, back @ p["near"].T, n) + scatter(far, back @ p["far"].T, n),
        "near": a.T @ back,
        "far": b.T @ back,
    }
    for k, grad in grads.items():
        grad = (grad / size).astype(np.float32)
        slope[k] += grad * grad
        p[k] += np.float32(RATE) * grad / np.sqrt(slope[k])


def nce_pass(docs: DataFrame, vocabulary: Vocabulary, share: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters after one pass over all texts: each task goes on from `p`, their results are averaged by tokens."""
    log_noise = (np.log(share) + np.log(NOISE)).astype(np.float32)
    shapes = {k: p[k].shape for k in PARAMETERS}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rng = np.random.default_rng(task)
        own = {k: v.copy() for k, v in p.items()}
        slope = {k: np.full_like(v, 1e-6) for k, v in p.items()}
        seen = 0
        for batch in batches:
            for part in common.slices(iter([batch]), "text", RUN_BYTES):
                words, counts = token_lists(part.column("text"))
                _, classes = vocabulary.of(words)
                near, far = contexts(classes, counts, vocabulary.end)
                order = rng.permutation(len(classes))
                noises = rng.choice(len(share), size=(-(-len(classes) // BATCH), NOISE), p=share)
                for i, at in enumerate(range(0, len(classes), BATCH)):
                    some = order[at : at + BATCH]
                    nce_step(own, slope, near[some], far[some], classes[some], noises[i], log_noise)
                seen += len(classes)
        if seen:
            flat = np.concatenate([own[k].reshape(-1) for k in PARAMETERS]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([task % GROUPS], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["group", "n", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(sum(int(np.prod(s)) for s in shapes.values()))
        for raw in rows["sums"]:
            total += np.frombuffer(raw)
        return pd.DataFrame({"group": [rows["group"].iloc[0]], "n": [rows["n"].sum()], "sums": [total.tobytes()]})

    schema = "group int, n long, sums binary"
    rows = docs.select("text").mapInArrow(train, schema).groupBy("group").applyInPandas(add, schema).collect()  # GROUPS rows at most
    if not rows:
        return p
    flat = sum(np.frombuffer(r["sums"]) for r in rows) / sum(r["n"] for r in rows)
    out, at = {}, 0
    for k in PARAMETERS:
        size = int(np.prod(shapes[k]))
        out[k] = flat[at : at + size].reshape(shapes[k]).astype(np.float32)
        at += size
    return out


def log_totals(spark: SparkSession, p: dict[str, np.ndarray]) -> np.ndarray:
    """For each word two before and word before: the logarithm of the sum of all classes' exponentiated scores."""
    n = len(p["bias"])
    near, far, target, bias = p["context"] @ p["near"], p["context"] @ p["far"], p["target"], p["bias"]

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch["id"]:
                scores = (near + far[c]) @ target.T + bias
                top = scores.max(axis=1, keepdims=True)
                yield pd.DataFrame({"id": [c], "logs": [(np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]).astype(np.float32).tobytes()]})

    rows = spark.range(0, n, 1, 24).mapInPandas(total, "id long, logs binary").collect()  # classes x classes floats
    out = np.zeros((n, n), dtype=np.float32)
    for r in rows:
        out[r["id"]] = np.frombuffer(r["logs"], dtype=np.float32)
    return out


def score(docs: DataFrame, head: int = HEAD, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    rows = docs.select("doc_id", "text", fold.alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = session.written(count_words(training), "word-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, types = sums["n"] or 0, sums["v"]
    frequent, least = head_words(counts, head)
    vocabulary = Vocabulary(frequent["word"].tolist(), frequent["n"].to_numpy(dtype=np.int64), classes)
    held = np.bincount(vocabulary.classes[:-1], vocabulary.counts[:-1], vocabulary.size)
    held[0] = tokens - held[1:].sum()
    own_types = int((vocabulary.classes[:-1] > 0).sum())
    # Within class 0: its training tokens and types, and one for words never seen.
    rest = float(held[0] + (types - own_types) + 1)
    share = (held + 1) / (held + 1).sum()
    p = start_parameters(share)
    for _ in range(rounds if tokens else 0):
        p = nce_pass(training, vocabulary, share, p)
    totals = log_totals(spark, p)
    near_table = (p["context"] @ p["near"]) @ p["target"].T + p["bias"]
    far_table = (p["context"] @ p["far"]) @ p["target"].T
    base_total, tail = float(tokens + types + 1), len(vocabulary.place)
    ten = np.log(10.0)
    shared = spark.sparkContext.broadcast((vocabulary, near_table, far_table, totals))  # bounded by head and classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, near_table, far_table, totals = shared.value
        row = TaskContext.get().partitionId() << 40
        base_logs = np.log10((vocabulary.counts + 1) / base_total)
        rest_logs = np.where(vocabulary.classes == 0, np.log10((vocabulary.counts + 1) / rest), 0.0)
        base_logs[tail] = rest_logs[tail] = 0.0  # added after the join
        for batch in batches:
            for part in common.slices(iter([batch]), "text", RUN_BYTES):
                words, n = token_lists(part.column("text"))
                places, cls = vocabulary.of(words)
                near, far = contexts(cls, n, vocabulary.end)
                logs = (near_table[near, cls] + far_table[far, cls] - totals[far, near]) / ten + rest_logs[places]
                starts = np.cumsum(n) - n
                doc = np.repeat(np.arange(len(n)), n)
                other = np.flatnonzero(places == tail)
                code = words.indices.to_numpy(zero_copy_only=False)
                pair, times = np.unique(doc[other] * len(words.dictionary) + code[other], return_counts=True)
                of = pair // max(len(words.dictionary), 1)
                offsets = pa.array(np.searchsorted(of, np.arange(len(n) + 1)), pa.int32())
                rare = pa.StructArray.from_arrays([words.dictionary.take(pa.array(pair - of * len(words.dictionary))).cast(pa.string()), pa.array(times, pa.int32())], ["word", "times"])
                columns = [
                    pa.array(row + np.arange(len(n))), part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()),
                    pa.array(np.add.reduceat((places != tail).astype(np.int64), starts) if len(n) else np.zeros(0, np.int64)),
                    pa.array(np.add.reduceat(base_logs[places], starts) if len(n) else np.zeros(0)),
                    pa.array(np.add.reduceat(logs.astype(np.float64), starts) if len(n) else np.zeros(0)), pa.ListArray.from_arrays(offsets, rare),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"])
                row += len(n)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<struct<word:string,times:int>>"
    scored = session.written(rows.mapInArrow(run, schema), "scored")
    words = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    rare = counts.where(F.col("n") < least)
    c = F.coalesce("n", F.lit(0))
    more = words.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(base_total))).alias("more_base"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(rest))).alias("more_model"),
    )
    out = scored.drop("rare").join(more, "row", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    return out.select(
        "doc_id", "held_out", "n_tokens", plus("known", "more_known", 0).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base", 0.0).alias("base_score"), plus("model", "more_model", 0.0).alias("score"),
    )
