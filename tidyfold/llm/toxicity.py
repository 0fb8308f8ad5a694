"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding beside the mean embedding of its
character trigrams. Windows of WINDOW words, each overlapping half of the next,
run through a forward and a backward gated recurrent layer; attention pools the
states of a window to one vector and a logit. A text's logit is its largest
window's, so every word of a text of any length counts.

Training uses a bounded sample of labelled rows: about SAMPLE of each class,
chosen by a hash of the id; the classes' true shares are put back into the logit
afterwards. A word's embedding starts as its log odds between the classes in the
sample beside a random code, a trigram's as a random code; both are learned with
all other weights. Words of few texts have none of their own, lest the network
learn texts by heart; their trigrams stand for them. Each round picks every
text's strongest window and descends on those. The model is a few MB whatever
the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm.common import LOWER, batches, fold_of, mix, string_bytes, table, words

WINDOW, STEP = 32, 16
#: Codes of trigrams, numbers of an embedding and of a state.
BUCKETS, WIDTH, HIDDEN = 1 << 13, 8, 8
SAMPLE, ROUNDS, PASSES, STEPS, RATE = 800, 4, 2, 60, 0.01
#: Texts of the sample that a word's own embedding needs (rarer words have their trigrams only); standard errors taken off log odds; how little a doubted label weighs.
MIN_TEXTS, SURE, DOUBT = 5, 2.5, 0.5
THRESHOLD = 0.3
#: What each step takes away of embeddings, so that trigrams of few texts are given up; the chance that a word's own embedding is hidden in a step, so that its trigrams have to speak for it.
DECAY, HIDE = 0.003, 0.8


class Texts:
    """Words of a column of texts: distinct ones with their trigrams, and windows over them."""

    def __init__(self, column: pa.Array):
        raw, bounds = string_bytes(column)
        start, end, hashes, self.cuts = words(raw, bounds)
        self.distinct, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        low = np.append(LOWER[raw], np.uint8(0x20))
        a, n = start[first], end[first] - start[first]
        # ^w$ with blanks around: trigram k covers bytes k-1 .. k+1 of the word.
        owner = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = a[owner] + k
        left = np.where(k > 0, low[at - 1], 0x20).astype(np.uint64)
        right = np.where(k < n[owner] - 1, low[at + 1], 0x20).astype(np.uint64)
        gram = left << np.uint64(16) | low[at].astype(np.uint64) << np.uint64(8) | right
        self.gram, self.owner, self.lengths = (mix(gram) % np.uint64(BUCKETS)).astype(np.int64), owner, np.maximum(n, 1)
        self.grams = np.cumsum(n) - n
        count = np.diff(self.cuts)
        self.windows = np.where(count > 0, np.maximum(0, -(-(count - WINDOW) // STEP)) + 1, 0)
        self.text = np.repeat(np.arange(len(count)), self.windows)
        k = np.arange(len(self.text)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        self.begin = self.cuts[self.text] + k * STEP
        self.stop = np.minimum(self.begin + WINDOW, self.cuts[self.text + 1]) if len(self.text) else self.begin

    def rows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct-word places (steps, windows) of some windows, and whether a step has a word."""
        at = self.begin[some] + np.arange(WINDOW)[:, None]
        there = at < self.stop[some]
        return self.word[np.minimum(at, len(self.word) - 1)], there


def summed(rows: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place, n places."""
    return np.stack([np.bincount(place, rows[:, k], n) for k in range(rows.shape[1])], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two directions; gates in the order update, reset, candidate."""

    def __init__(self, known: np.ndarray, odds: np.ndarray, seed: int = 3):
        """`known` are the sorted hashes of the words with an embedding."""
        rng = np.random.default_rng(seed)
        self.known = known
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": f(len(known) + 1, WIDTH, scale=0.05), "gram": f(BUCKETS, WIDTH, scale=0.05), "v": f(2 * HIDDEN, scale=0.3), "A": f(2 * HIDDEN, 2 * HIDDEN, scale=0.3), "u": f(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(2 * WIDTH, 3 * HIDDEN, scale=0.3), f"U{d}": f(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p["word"][:-1, 0], self.p["word"][-1] = odds, 0
        self.shift, self.rate = 0.0, 0.0

    def place(self, words_: np.ndarray) -> np.ndarray:
        """Rows of words' embeddings; the last row is all others'."""
        at = np.minimum(np.searchsorted(self.known, words_), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == words_, at, len(self.known)) if len(self.known) else at

    def inputs(self, texts: Texts) -> np.ndarray:
        """Input vectors of the distinct words."""
        grams = np.add.reduceat(self.p["gram"][texts.gram], texts.grams) if len(texts.lengths) else np.zeros((0, WIDTH), np.float32)
        return np.concatenate([self.p["word"][self.place(texts.distinct)], grams / texts.lengths[:, None].astype(np.float32)], axis=1)

    def layer(self, x: np.ndarray, index: np.ndarray, there: np.ndarray, d: str, keep: bool):
        """States (steps, windows, HIDDEN); x holds the projected inputs of distinct words."""
        steps, n = index.shape
        U, h = self.p[f"U{d}"], np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = x[index[t]]
            zr = sigmoid(g[:, : 2 * HIDDEN] + h @ U[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            rh = r * h
            c = np.tanh(g[:, 2 * HIDDEN :] + rh @ U[:, 2 * HIDDEN :])
            if keep:
                kept.append((t, h, z, r, rh, c))
            h = (h + z * (c - h)) * there[t][:, None]
            out[t] = h
        return out, kept

    def run(self, x: np.ndarray, index: np.ndarray, there: np.ndarray, keep: bool = False):
        """Logits of windows; x are input vectors of distinct words."""
        f, kf = self.layer(x["f"], index, there, "f", keep)
        b, kb = self.layer(x["b"], index, there, "b", keep)
        h = np.concatenate([f, b], axis=2)
        e = np.tanh(h @ self.p["A"])
        a = e @ self.p["v"]
        a = np.where(there, a, -1e9)
        a = np.exp(a - a.max(axis=0))
        a = a / a.sum(axis=0)
        pooled = (a[:, :, None] * h).sum(axis=0)
        return pooled @ self.p["u"] + self.p["b"][0], (h, e, a, pooled, kf, kb)

    def projected(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {d: vectors @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def logits(self, texts: Texts, size: int = 4096) -> np.ndarray:
        """Logits of all windows."""
        x, out = self.projected(self.inputs(texts)), np.zeros(len(texts.begin), np.float32)
        for at in range(0, len(out), size):
            some = np.arange(at, min(at + size, len(out)))
            out[some] = self.run(x, *texts.rows(some))[0]
        return out

    def gradients(self, texts: Texts, vectors: np.ndarray, some: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean generalised cross entropy of some windows."""
        index, there = texts.rows(some)
        met, index = np.unique(index, return_inverse=True)  # the distinct words of these windows
        index, vectors = index.reshape(there.shape), vectors[met]
        logit, (h, e, a, pooled, kf, kb) = self.run(self.projected(vectors), index, there, True)
        chance = sigmoid(logit)
        # Generalised cross entropy: rows whose label the network doubts weigh less, as some labels are noise.
        d = ((chance - labels) * np.where(labels == 1, chance, 1 - chance) ** DOUBT * weights[labels] / len(some)).astype(np.float32)
        g, dx = {k: np.zeros_like(v) for k, v in self.p.items()}, np.zeros(vectors.shape, np.float32)
        g["u"], g["b"][0] = d @ pooled, d.sum()
        dp = d[:, None] * self.p["u"]
        da = (h * dp).sum(axis=2)
        ds = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", ds, e)
        de = ds[:, :, None] * self.p["v"] * (1 - e * e)
        g["A"] = np.einsum("tnj,tnk->jk", h, de)
        dh = a[:, :, None] * dp + de @ self.p["A"].T
        for name, kept, part in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[:, :, HIDDEN:])):
            U, back, gates = self.p[f"U{name}"], np.zeros((len(some), HIDDEN), np.float32), np.zeros((*index.shape, 3 * HIDDEN), np.float32)
            for t, before, z, r, rh, c in reversed(kept):
                grad = (part[t] + back) * there[t][:, None]
                dc = grad * z * (1 - c * c)
                drh = dc @ U[:, 2 * HIDDEN :].T
                dzr = np.concatenate([grad * (c - before) * z * (1 - z), drh * before * r * (1 - r)], axis=1)
                gate = np.concatenate([dzr, dc], axis=1)
                g[f"U{name}"][:, : 2 * HIDDEN] += before.T @ dzr
                g[f"U{name}"][:, 2 * HIDDEN :] += rh.T @ dc
                gates[t] = gate
                back = grad * (1 - z) + drh * r + dzr @ U[:, : 2 * HIDDEN].T
            each = summed(gates.reshape(-1, 3 * HIDDEN), index.reshape(-1), len(met))
            g[f"c{name}"] += each.sum(axis=0)
            g[f"W{name}"] += vectors.T @ each
            dx += each @ self.p[f"W{name}"].T
        # From the inputs back to the embeddings: a word's own, and its trigrams by their share of its mean.
        own = self.place(texts.distinct[met])
        own[~vectors[:, :WIDTH].any(axis=1)] = len(self.known)  # hidden
        g["word"] += summed(dx[:, :WIDTH], own, len(g["word"]))
        g["word"][-1] = 0
        n = texts.lengths[met]
        at = np.arange(n.sum()) + np.repeat(texts.grams[met] - np.cumsum(n) + n, n)
        g["gram"] += summed(np.repeat(dx[:, WIDTH:] / n[:, None], n, axis=0), texts.gram[at], BUCKETS)
        return g


def fit(column: pa.Array, labels: np.ndarray, seed: int = 3) -> Network:
    """A network from texts and 0/1 labels, by Adam on every text's strongest window."""
    texts, rng = Texts(column), np.random.default_rng(seed)
    owner = np.repeat(np.arange(len(labels)), np.diff(texts.cuts))
    pairs = np.unique(owner * len(texts.distinct) + texts.word)
    pair_word, pair_label = pairs % max(1, len(texts.distinct)), labels[pairs // max(1, len(texts.distinct))]
    has = [np.bincount(pair_word[pair_label == k], minlength=len(texts.distinct)) for k in (0, 1)]
    n = [max(1, (labels == k).sum()) for k in (0, 1)]
    odds = np.log((has[1] + 0.5) / (n[1] + 1)) - np.log((has[0] + 0.5) / (n[0] + 1))
    # What is certain of them: SURE standard errors nearer to none.
    error = np.sqrt(1 / (has[1] + 0.5) + 1 / (has[0] + 0.5))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - SURE * error, 0)
    common = np.flatnonzero(has[0] + has[1] >= MIN_TEXTS)
    net = Network(texts.distinct[common], odds[common], seed)
    odds = net.p["word"][net.place(texts.distinct), 0]
    # In the first round the classes weigh alike, so that none is given up before it is learned.
    balance = len(labels) / (2.0 * np.array(n))
    first, slow, step = {}, {}, 0

    def hide(vectors: np.ndarray) -> np.ndarray:
        vectors[rng.random(len(vectors)) < HIDE, :WIDTH] = 0
        return vectors

    for round_ in range(ROUNDS):
        value = net.logits(texts) if round_ else np.array([odds[texts.word[a:b]].max() for a, b in zip(texts.begin, texts.stop)])
        order = np.lexsort((-value, texts.text))
        chosen = order[np.flatnonzero(np.diff(texts.text[order], prepend=-1))]
        for _ in range(max(PASSES, -(-STEPS * 64 // len(chosen)))):
            for some in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 64)):
                step += 1
                for k, g in net.gradients(texts, hide(net.inputs(texts)), some, labels[texts.text[some]], balance if round_ == 0 else np.ones(2)).items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    slow[k] = 0.99 * slow.get(k, 0) + 0.01 * g * g
                    kept = np.float32(1 - DECAY if k in ("word", "gram") else 1)
                    net.p[k] = net.p[k] * kept - (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(slow[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame) -> tuple[Network | None, float]:
    """A network from (doc_id, text) and (doc_id, toxic), and the share of toxic labels; no network if there is one class only.

    The sample is drawn from the labels, so it is bounded before it meets the
    texts: about SAMPLE rows a class are sent to the documents, which stay where
    they are. An id labelled twice counts with each of its labels; labels without
    an id or a text teach nothing.
    """
    labels = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    each = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = each.get(1, 0), each.get(0, 0)
    share = n1 / max(1, n0 + n1)
    if not n0 or not n1:
        return None, share
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    size = F.when(F.col("toxic") == 1, float(n1)).otherwise(float(n0))
    some = F.broadcast(labels.filter(draw * size < SAMPLE))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(some, "doc_id")
    rows = rows.select("doc_id", "text", "toxic").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
    labels = np.asarray(rows.column("toxic")).astype(np.int64)
    if len(set(labels.tolist())) < 2:
        return None, share
    net = fit(rows.column("text").combine_chunks(), labels)
    net.shift = float(np.log(n1 / n0) - np.log(labels.sum() / (1 - labels).sum()))
    net.rate = share
    return net, share


def score_texts(docs: DataFrame, net: Network | None, share: float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for each row of (doc_id, text).

    Null texts and texts without words, and all texts without a network, score
    the share of toxic training rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in batches(parts, 2000):
            scores = np.full(part.num_rows, float(share))
            if own is not None and part.num_rows:
                texts = Texts(part.column(1))
                has = np.flatnonzero(texts.windows)
                if len(has):
                    top = np.maximum.reduceat(own.logits(texts), np.cumsum(texts.windows)[has] - texts.windows[has])
                    scores[has] = sigmoid(top.astype(np.float64) + own.shift)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double, predicted int")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = fold_of(F.col("doc_id"), 4) == 2
    net, share = train(docs, table(spark, folder, "labels").filter(~held))
    return score_texts(docs, net, share).select("doc_id", held.alias("held_out"), "score", "predicted")
