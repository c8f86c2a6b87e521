"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every position of a window gets a word vector plus the mean of its character trigrams' vectors; two gated recurrent
passes read the window, attention pools their states, and a logistic unit scores the window. A document scores as the
highest of its overlapping windows, all of them. Training sees whole documents as bags of windows and descends through
the window that scores highest, after a few rounds over windows taken at random.

Training reads at most TRAIN_DOCS labelled documents (those of least hash) and TRAIN_WINDOWS windows of each; scoring
reads everything.

Defined cases: a null or empty text, or one without words, is one empty window; rows without a label teach nothing;
without labels of both classes every score is the share of label 1 (0 without any); repeated rows and null doc_ids
give a row each; further columns are not read.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import slices
from .common import crc_remainder, read_table, released, whole_text

WINDOW, STRIDE = 16, 8
TRAIN_DOCS, TRAIN_WINDOWS = 3_000, 48
#: Words of the vocabulary stand in at least LEAST_DOCS training documents; there are at most MOST_WORDS.
LEAST_DOCS, MOST_WORDS, TRIGRAMS = 4, 20_000, 4_096
EMBED, HIDDEN = 16, 12
BATCH_CHARS = 1_000_000
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of all words, with an end mark on either side, and the word each belongs to."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    mixed = (codes[at] * np.uint64(0x9E3779B1) + codes[at + 1]) * np.uint64(0x85EBCA77) + codes[at + 2]
    mixed = (mixed ^ (mixed >> np.uint64(15))) * np.uint64(0xC2B2AE3D)
    return ((mixed >> np.uint64(13)) % np.uint64(TRIGRAMS)).astype(np.int64), owner


def window_starts(n: int) -> range:
    """Every start of a window over n words; the last one covers the tail."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary  # 0: any other word
        init = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"words": 0.3 * rng.normal(size=(len(vocabulary) + 1, EMBED)).astype(np.float32), "trigrams": 0.3 * rng.normal(size=(TRIGRAMS, EMBED)).astype(np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": init(EMBED, 3 * HIDDEN), f"u{d}": init(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": init(2 * HIDDEN), "o": init(2 * HIDDEN), "c": np.zeros(1, np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids; trigram ids of all words; the word each trigram belongs to."""
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int64), *trigrams(words)

    def vectors(self, inputs) -> np.ndarray:
        """The vector of each distinct word, and a last one of zeros for no word."""
        ids, grams, owner = inputs
        out = np.zeros((len(ids) + 1, EMBED), np.float32)
        if len(ids):
            sums = np.add.reduceat(self.p["trigrams"][grams], np.flatnonzero(np.diff(owner, prepend=-1)))
            out[:-1] = self.p["words"][ids] + sums / np.bincount(owner, minlength=len(ids))[:, None]
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """The logit of each window. x: vectors by distinct word; at: (windows, WINDOW) places in x, the last for none."""
        there = at != len(x) - 1
        n, memo = len(at), {}
        h_all = np.empty((n, WINDOW, 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            u, given = self.p[f"u{d}"], x @ self.p[f"w{d}"] + self.p[f"b{d}"]
            h = np.zeros((n, HIDDEN), np.float32)
            steps = []
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g = given[at[:, t]]
                zr = sigmoid(g[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN] * there[:, t, None], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
                new = h + z * (c - h)
                if keep:
                    steps.append((t, h, z, r, c))
                h = new
                h_all[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h
            memo[d] = steps
        e = np.where(there, h_all @ self.p["a"], -1e9)
        weight = np.exp(e - e.max(1, keepdims=True)) * there
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        pooled = (weight[:, :, None] * h_all).sum(1)
        logit = pooled @ self.p["o"] + self.p["c"]
        return (logit, (there, h_all, weight, pooled, memo)) if keep else logit

    def backward(self, inputs, x, at, kept, d_logit) -> dict[str, np.ndarray]:
        there, h_all, weight, pooled, memo = kept
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["c"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["o"]
        d_weight = (h_all * d_pooled[:, None]).sum(2)
        d_e = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["a"] = (h_all * d_e[:, :, None]).sum((0, 1))
        d_all = weight[:, :, None] * d_pooled[:, None] + d_e[:, :, None] * p["a"]
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p[f"u{d}"]
            d_given = np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(at), HIDDEN), np.float32)
            for t, h, z, r, c in reversed(memo[d]):
                d_h = d_h + d_all[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                d_c = d_h * z * (1 - c * c)
                d_rh = d_c @ u[:, 2 * HIDDEN :].T
                d_zr = np.concatenate([d_h * (c - h) * z * (1 - z) * there[:, t, None], d_rh * h * r * (1 - r)], 1)
                g[f"u{d}"][:, : 2 * HIDDEN] += h.T @ d_zr
                g[f"u{d}"][:, 2 * HIDDEN :] += (r * h).T @ d_c
                np.add.at(d_given, at[:, t], np.concatenate([d_zr, d_c], 1))
                d_h = d_h * (1 - z) + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T
            g[f"b{d}"], g[f"w{d}"] = d_given.sum(0), x.T @ d_given
            d_x += d_given @ p[f"w{d}"].T
        ids, grams, owner = inputs
        np.add.at(g["words"], ids, d_x[:-1])
        np.add.at(g["trigrams"], grams, (d_x[:-1] / np.maximum(1, np.bincount(owner, minlength=len(ids)))[:, None])[owner])
        return g


def laid_out(bags: list[list[list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words; each window's places among them; the bag of each window."""
    place: dict[str, int] = {}
    rows, owner = [], []
    for i, bag in enumerate(bags):
        for window in bag:
            rows.append([place.setdefault(w, len(place)) for w in window])
            owner.append(i)
    at = np.full((len(rows), WINDOW), len(place), np.int64)
    for i, r in enumerate(rows):
        at[i, : len(r)] = r
    return list(place), at, np.array(owner)


def train(bags: list[list[list[str]]], labels: np.ndarray, rounds: int = 10, least_steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """The first three rounds take four windows of each bag at random; every later one the window that scores highest
    and, where the label is 0, a random one. Few bags get more rounds, for least_steps steps."""
    seen: dict[str, int] = {}
    for bag in bags:
        for w in {w for window in bag for w in window}:
            seen[w] = seen.get(w, 0) + 1
    common = sorted((w for w, n in seen.items() if n >= LEAST_DOCS), key=lambda w: (-seen[w], w))[:MOST_WORDS]
    net = Network({w: i + 1 for i, w in enumerate(common)}, seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    rounds = max(rounds, -(-least_steps * batch // max(1, len(bags))))
    for number in range(rounds):
        picked: list[tuple[int, int, float]] = []  # bag, window, weight
        if number < 3:
            for i, bag in enumerate(bags):
                some = rng.choice(len(bag), min(4, len(bag)), replace=False)
                picked += [(i, j, 1 / len(some)) for j in some]
        else:
            for start in range(0, len(bags), 256):
                some = bags[start : start + 256]
                words, at, owner = laid_out(some)
                logit = net.forward(net.vectors(net.inputs(words)), at)
                first = np.concatenate([[0], np.cumsum(np.bincount(owner))])
                picked += [(start + i, int(logit[first[i] : first[i + 1]].argmax()), 1.0) for i in range(len(some))]
            picked += [(i, int(rng.integers(len(bags[i]))), 0.5) for i in np.flatnonzero(labels == 0)]
        now = rate * (1 if number < rounds * 0.7 else 0.25)
        order = rng.permutation(len(picked))
        for some in (order[i : i + 2 * batch] for i in range(0, len(order), 2 * batch)):
            chosen = [picked[i] for i in some]
            words, at, _ = laid_out([[bags[i][j]] for i, j, _ in chosen])
            inputs = net.inputs(words)
            x = net.vectors(inputs)
            logit, kept = net.forward(x, at, True)
            weight = np.array([w for _, _, w in chosen])
            d = ((sigmoid(logit) - labels[[i for i, _, _ in chosen]]) * weight / weight.sum()).astype(np.float32)
            step += 1
            for k, g in net.backward(inputs, x, at, kept, d).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


class Cache:
    """Two generations: the older one goes when the younger one is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        hit = self.young.get(key)
        if hit is None and (hit := self.old.get(key)) is not None:
            self[key] = hit
        return hit

    def __setitem__(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Scorer:
    """Scores whole texts; keeps the vectors of words met before."""

    def __init__(self, net: Network):
        self.net, self.cache = net, Cache(60_000)

    def score(self, texts: list[str]) -> list[float]:
        place: dict[str, int] = {}
        rows = [np.array([place.setdefault(w, len(place)) for w in words_of(t)], np.int32) for t in texts]
        x = np.zeros((len(place) + 1, EMBED), np.float32)
        new = []
        for w, i in place.items():
            if (hit := self.cache.get(w)) is None:
                new.append(w)
            else:
                x[i] = hit
        for w, vector in zip(new, self.net.vectors(self.net.inputs(new))):
            x[place[w]] = self.cache[w] = vector
        at, owner = [], []
        for i, r in enumerate(rows):
            starts = window_starts(len(r))
            padded = np.full(starts[-1] + WINDOW, len(place), np.int32)
            padded[: len(r)] = r
            at.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
            owner.append(np.full(len(starts), i))
        at, owner = np.concatenate(at), np.concatenate(owner)
        best = np.full(len(texts), -np.inf)
        for a in range(0, len(at), 4096):
            np.maximum.at(best, owner[a : a + 4096], self.net.forward(x, at[a : a + 4096]))
        return sigmoid(best).tolist()


_nets: dict[str, Scorer] = {}


def clear_state() -> None:
    _nets.clear()


def scores(docs: DataFrame, net: Network | None, otherwise: float = 0.0) -> DataFrame:
    """doc_id, score."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text().alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(float(otherwise)).alias("score"))
    sent = spark.sparkContext.broadcast(net)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _nets:
            _nets.clear()
            _nets[name] = Scorer(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices([len(t) for t in texts], BATCH_CHARS):
                yield pa.record_batch([batch.column(0)[part], pa.array(_nets[name].score(texts[part]), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(released(run, __name__), "doc_id long, score double")


def training_bags(docs: DataFrame, labels: DataFrame) -> tuple[list[list[list[str]]], np.ndarray]:
    """Windows of the labelled documents of least hash, TRAIN_DOCS at most; labels: doc_id, label."""
    known = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(text)
                starts = list(window_starts(len(words)))
                if len(starts) > TRAIN_WINDOWS:
                    starts = [starts[i] for i in np.random.default_rng(doc_id % (1 << 32)).choice(len(starts), TRAIN_WINDOWS, replace=False)]
                bags.append("\n".join(" ".join(words[a : a + WINDOW]) for a in starts))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bags)], ["doc_id", "label", "bag"])

    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, bag string").collect()
    rows.sort(key=lambda r: (r.doc_id, r.bag))
    rows = rows[:TRAIN_DOCS]
    return [[[sys.intern(w) for w in line.split()] for line in r.bag.split("\n")] for r in rows], np.array([r.label for r in rows], np.float32)


def trained_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score. Rows whose crc32(doc_id as text) mod 4 is 2 are held out."""
    bags, y = training_bags(docs, labels.where(crc_remainder(4) != 2).select("doc_id", F.col("toxic").alias("label")))
    net = train(bags, y) if 0 < y.sum() < len(y) else None
    return scores(docs, net, float(y.mean()) if len(y) else 0.0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trained_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.select("doc_id", (crc_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
