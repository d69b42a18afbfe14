"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word is a run without spaces, without the symbols at its ends, or a run of symbols alone. It enters as the end states of a bidirectional GRU over its characters, beside a vector of its own if it is among the
words of the fit. A bidirectional GRU runs over the words of a window; attention pools its states; a logistic unit scores
the window. A text is scored over all of its overlapping windows (``window`` words, every ``stride``), and its score is
that of its worst window. Texts are scored whole, wherever they lie, without a shuffle; word vectors are computed once for
each distinct word of a part, and kept for the first of a task.

The fit is on a bounded sample of labelled rows (``sample``: at most so many of either label, of at most ``longest``
characters, the first by a hash of doc_id), in ``rounds`` of multiple-instance training: each text stands with its worst
window as the network then sees it, clean texts with a random one besides. Only rows whose crc32(doc_id as text) mod 3 is
not 1 are fitted. Text is the only input. The cut-off of ``predicted`` (0.7) is laid where the fitted rows part best.

Null text is empty, and an empty text is scored as one empty window. Without labelled rows of both kinds there is nothing
to learn and every score is 0. A null doc_id is never held out. Rows with several labels count with each. Repeated rows are
scored alike, an empty table gives no rows, and other columns of either table are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .shingles import parts

CUT = 0.7
#: a run without spaces from a letter or digit to the last one, with all that stands between, or a run of symbols alone; a
#: longer one than 24 characters comes as several words
_WORD = re.compile(r"[^\W_](?:\S{0,22}[^\W_])?|(?<!\S)(?:[^\w\s]|_){1,24}")


@dataclass(frozen=True)
class ToxicParams:
    """sample, longest, vocabulary, letters: bounds of the fit (letters: characters that get a vector of their own, the most
    frequent of the sample; all others share one). The rest are the network's sizes and its training."""

    sample: int = 900
    longest: int = 12_000
    vocabulary: int = 4_000
    letters: int = 2_000
    window: int = 24
    stride: int = 16
    char_dim: int = 12
    char_state: int = 16
    word_dim: int = 8
    state: int = 8
    rounds: int = 5
    steps: int = 60
    batch: int = 128
    rate: float = 0.012
    seed: int = 11


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


# -- gated recurrent units: inputs already projected to (steps, batch, 3 * state) --


def gru(inputs: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States (steps, batch, state); a masked step leaves the state as it is. With ``keep`` also what backward needs."""
    steps, batch, three = inputs.shape
    n = three // 3
    h = np.zeros((batch, n), inputs.dtype)
    out = np.empty((steps, batch, n), inputs.dtype)
    saved = []
    for t in range(steps):
        gates = h @ u
        x = inputs[t]
        zr = _sigmoid(x[:, : 2 * n] + gates[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        hu = gates[:, 2 * n :]
        c = np.tanh(x[:, 2 * n :] + r * hu)
        m = mask[t][:, None]
        if keep:
            saved.append((h, z, r, hu, c))
        h = h + m * (1 - z) * (c - h)
        out[t] = h
    return (out, saved) if keep else out


def gru_back(d_out: np.ndarray, u: np.ndarray, mask: np.ndarray, saved: list):
    """Gradients of inputs and u for gradients ``d_out`` of the states."""
    steps, batch, n = d_out.shape
    d_in = np.empty((steps, batch, 3 * n), d_out.dtype)
    d_u = np.zeros_like(u)
    dh = np.zeros((batch, n), d_out.dtype)
    for t in reversed(range(steps)):
        h, z, r, hu, c = saved[t]
        dh = dh + d_out[t]
        m = mask[t][:, None]
        g = dh * m
        da_c = g * (1 - z) * (1 - c * c)
        da_z = -g * (c - h) * z * (1 - z)
        da_r = da_c * hu * r * (1 - r)
        d_in[t] = np.concatenate((da_z, da_r, da_c), axis=1)
        d_gates = np.concatenate((da_z, da_r, da_c * r), axis=1)
        d_u += h.T @ d_gates
        dh = dh - g * (1 - z) + d_gates @ u.T
    return d_in, d_u


class Memo:
    """Numbers and projected inputs of words; the first ``most`` are kept from text to text."""

    def __init__(self, most: int = 60_000) -> None:
        self.most = most
        self.number: dict[str, int] = {}
        self._held: tuple[np.ndarray, np.ndarray] | None = None

    def tables(self, net: Network) -> tuple[np.ndarray, np.ndarray]:
        """Of all words numbered so far; row 0 stands for no word."""
        known = 0 if self._held is None else len(self._held[0]) - 1
        if len(self.number) > known or self._held is None:
            new = net.word_inputs(list(islice(self.number, known, None)))
            self._held = new if self._held is None else tuple(np.concatenate((a, b[1:])) for a, b in zip(self._held, new, strict=True))
        return self._held

    def room(self) -> None:
        if len(self.number) > self.most:
            self.number = dict(islice(self.number.items(), self.most))
            self._held = tuple(x[: self.most + 1].copy() for x in self._held)


class Network:
    def __init__(self, p: ToxicParams, vocabulary: list[str], letters: list[str]) -> None:
        self.p = p
        self.word_no = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.letter_no = {c: i + 1 for i, c in enumerate(letters)}
        rng = np.random.default_rng(p.seed)

        def init(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        wide = 2 * p.char_state + p.word_dim
        self.w = {
            "letters": init(len(letters) + 2, p.char_dim), "words": 0.1 * init(len(vocabulary) + 1, p.word_dim),
            "cf_w": init(p.char_dim, 3 * p.char_state), "cf_b": np.zeros(3 * p.char_state, np.float32), "cf_u": init(p.char_state, 3 * p.char_state),
            "cb_w": init(p.char_dim, 3 * p.char_state), "cb_b": np.zeros(3 * p.char_state, np.float32), "cb_u": init(p.char_state, 3 * p.char_state),
            "f_w": init(wide, 3 * p.state), "f_b": np.zeros(3 * p.state, np.float32), "f_u": init(p.state, 3 * p.state),
            "b_w": init(wide, 3 * p.state), "b_b": np.zeros(3 * p.state, np.float32), "b_u": init(p.state, 3 * p.state),
            "att": 2 * init(2 * p.state), "out": init(2 * p.state), "bias": np.full(1, -1.0, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0
        self._adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self._n = 0

    # words -> vectors

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters (steps, words), padded with 0, and word numbers."""
        letters = self.letter_no
        rows = [[letters.get(c, len(letters) + 1) for c in w] for w in words]
        out = np.zeros((max(map(len, rows), default=1) or 1, len(rows)), np.int32)
        for i, r in enumerate(rows):
            out[: len(r), i] = r
        return out, np.array([self.word_no.get(w, 0) for w in words], np.int32)

    def _chars(self, letters: np.ndarray, keep: bool = False):
        mask = (letters > 0).astype(np.float32)
        w = self.w
        table_f, table_b = w["letters"] @ w["cf_w"] + w["cf_b"], w["letters"] @ w["cb_w"] + w["cb_b"]
        # the backward pass starts with the padding, which leaves its state at 0
        return (
            gru(table_f[letters], w["cf_u"], mask, keep),
            gru(table_b[letters[::-1]], w["cb_u"], mask[::-1], keep),
            mask,
        )

    def word_inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's projected inputs of the two word-level passes; row 0 stands for no word."""
        out_f = np.zeros((len(words) + 1, 3 * self.p.state), np.float32)
        out_b = np.zeros_like(out_f)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for i in range(0, len(order), 4096):
            some = order[i : i + 4096]
            letters, numbers = self.spell([words[k] for k in some])
            f, b, _ = self._chars(letters)
            x = np.concatenate((f[-1], b[-1], self.w["words"][numbers]), axis=1)
            at = np.array(some) + 1
            out_f[at], out_b[at] = x @ self.w["f_w"] + self.w["f_b"], x @ self.w["b_w"] + self.w["b_b"]
        return out_f, out_b

    def windows(self, table_f: np.ndarray, table_b: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Logits of windows: rows (steps, windows) of places in the tables, 0 where there is no word."""
        mask = (rows > 0).astype(np.float32)
        w = self.w
        f = gru(table_f[rows], w["f_u"], mask)
        b = gru(table_b[rows[::-1]], w["b_u"], mask[::-1])[::-1]
        n = self.p.state
        e = f @ w["att"][:n] + b @ w["att"][n:]
        e = np.where(mask > 0, e, np.float32(-1e9))
        a = np.exp(e - e.max(axis=0)) * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        o = f @ w["out"][:n] + b @ w["out"][n:]
        return (a * o).sum(axis=0) + w["bias"]

    # training

    def step(self, words: list[str], rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """One step of Adam over windows ``rows`` (steps, windows) of places in ``words`` + 1."""
        p, w = self.p, self.w
        letters, numbers = self.spell(words)
        (cf, saved_cf), (cb, saved_cb), cmask = self._chars(letters, keep=True)
        x = np.concatenate((cf[-1], cb[-1], w["words"][numbers]), axis=1)
        none = np.zeros((1, 3 * p.state), np.float32)
        table_f, table_b = np.concatenate((none, x @ w["f_w"] + w["f_b"])), np.concatenate((none, x @ w["b_w"] + w["b_b"]))
        mask = (rows > 0).astype(np.float32)
        f, saved_f = gru(table_f[rows], w["f_u"], mask, keep=True)
        b, saved_b = gru(table_b[rows[::-1]], w["b_u"], mask[::-1], keep=True)
        n = p.state
        both = np.concatenate((f, b[::-1]), axis=2)
        e = np.where(mask > 0, both @ w["att"], np.float32(-1e9))
        a = np.exp(e - e.max(axis=0)) * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = (a[:, :, None] * both).sum(axis=0)
        q = _sigmoid(pooled @ w["out"] + w["bias"])
        loss = float(-(weight * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / weight.sum())
        d = (weight * (q - y) / weight.sum()).astype(np.float32)
        g = {"bias": d.sum(keepdims=True), "out": pooled.T @ d}
        d_pooled = d[:, None] * w["out"]
        d_a = (both * d_pooled).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["att"] = np.tensordot(d_e, both, axes=((0, 1), (0, 1)))
        d_both = a[:, :, None] * d_pooled + d_e[:, :, None] * w["att"]
        d_f, g["f_u"] = gru_back(d_both[:, :, :n], w["f_u"], mask, saved_f)
        d_b, g["b_u"] = gru_back(np.ascontiguousarray(d_both[::-1, :, n:]), w["b_u"], mask[::-1], saved_b)
        d_x = np.zeros_like(x)
        for at, dd, name in ((rows, d_f, "f"), (rows[::-1], d_b, "b")):
            table = np.zeros((len(words) + 1, 3 * n), np.float32)
            np.add.at(table, at.reshape(-1), dd.reshape(-1, 3 * n))
            table = table[1:]
            g[name + "_w"], g[name + "_b"] = x.T @ table, table.sum(axis=0)
            d_x += table @ w[name + "_w"].T
        c = p.char_state
        g["words"] = np.zeros_like(w["words"])
        np.add.at(g["words"], numbers, d_x[:, 2 * c :])
        g["words"][0] = 0
        g["letters"] = np.zeros_like(w["letters"])
        for name, part, saved, order in (("cf", d_x[:, :c], saved_cf, 1), ("cb", d_x[:, c : 2 * c], saved_cb, -1)):
            last = np.zeros((letters.shape[0], len(words), c), np.float32)
            last[-1] = part
            d_in, g[name + "_u"] = gru_back(last, w[name + "_u"], cmask[::order], saved)
            table = np.zeros((len(w["letters"]), 3 * c), np.float32)
            np.add.at(table, letters[::order].reshape(-1), d_in.reshape(-1, 3 * c))
            g[name + "_w"], g[name + "_b"] = w["letters"].T @ table, table.sum(axis=0)
            g["letters"] += table @ w[name + "_w"].T
        self._update(g)
        return loss

    def _update(self, g: dict[str, np.ndarray]) -> None:
        self._n += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        for k, x in g.items():
            x = x * np.float32(clip)
            m, v = self._adam[k]
            m += 0.1 * (x - m)
            v += 0.005 * (x * x - v)
            self.w[k] -= (self.p.rate * (m / (1 - 0.9**self._n)) / (np.sqrt(v / (1 - 0.995**self._n)) + 1e-6)).astype(np.float32)

    # texts

    def logits(self, texts: list[str], pick: bool = False, memo: Memo | None = None):
        """The worst window's logit of each text; with ``pick`` also its words. memo: words met before, of this network."""
        memo = Memo() if memo is None else memo
        number = memo.number
        split = [[number.setdefault(x, len(number) + 1) for x in _WORD.findall(t.lower())] for t in texts]
        tables = memo.tables(self)
        window, stride = self.p.window, self.p.stride
        rows, owner = [], []
        for i, s in enumerate(split):
            start = np.arange(0, max(1, len(s) - window + stride), stride)
            padded = np.zeros(int(start[-1]) + window, np.int32)
            padded[: len(s)] = s
            rows.append(padded[start[:, None] + np.arange(window)])
            owner.append(np.full(len(start), i))
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        out = np.concatenate([self.windows(*tables, rows[i : i + 4096].T) for i in range(0, len(rows), 4096)])
        worst = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(worst, owner, out)
        if not pick:
            return worst
        order = np.lexsort((-out, owner))
        first = order[np.searchsorted(owner[order], np.arange(len(texts)))]
        names = ["", *number]
        return worst, [[names[k] for k in rows[i] if k] for i in first], [[names[k] for k in rows[i] if k] for i in _some(owner, len(texts), self._n)]

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid((logits.astype(np.float64) - self.shift) * self.scale + np.log(CUT / (1 - CUT)))


def _some(owner: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A random window of each text."""
    first = np.searchsorted(owner, np.arange(n))
    count = np.bincount(owner, minlength=n)
    return first + (np.random.default_rng(seed).random(n) * count).astype(np.int64)


def fit(texts: list[str], labels: list[int], p: ToxicParams = ToxicParams()) -> Network | None:
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    count: dict[str, list[int]] = {}
    for t, label in zip(texts, labels, strict=True):
        for x in set(_WORD.findall(t.lower())):
            count.setdefault(x, [0, 0])[label] += 1
    # words that tell the labels apart come first, by smoothed log odds times evidence
    n = [max(1.0, float((y == k).sum())) for k in (0, 1)]
    told = {x: abs(np.log((b + 0.5) / n[1]) - np.log((a + 0.5) / n[0])) * np.sqrt(a + b) for x, (a, b) in count.items() if a + b > 1}
    vocabulary = sorted(told, key=lambda x: (-told[x], x))[: p.vocabulary]
    said = Counter(c for x in count for c in x)
    letters = sorted(sorted(said, key=lambda c: (-said[c], c))[: p.letters])
    net = Network(p, vocabulary, letters)
    rng = np.random.default_rng(p.seed + 1)
    # to begin with, a text's window is the one with the word that most speaks for a label
    odds = {x: np.log((b + 0.5) / n[1]) - np.log((a + 0.5) / n[0]) for x, (a, b) in count.items() if a + b > 1}
    windows, target = [], []
    for t, label in zip(texts, labels, strict=True):
        words = _WORD.findall(t.lower())
        best = max(range(len(words)), key=lambda i: odds.get(words[i], 0.0), default=0)
        start = max(0, min(best - int(rng.integers(0, p.window)), len(words) - p.window))
        windows.append(words[start : start + p.window])
        target.append(label)
    for turn in range(p.rounds):
        if turn:
            _, worst, random = net.logits(texts, pick=True)
            windows, target = list(worst), list(labels)
            for k in np.flatnonzero(y == 0):
                windows.append(random[k])
                target.append(0)
        t = np.array(target, np.float32)
        weight = np.where(t > 0, 0.5 / max(1, (t > 0).sum()), 0.5 / max(1, (t == 0).sum()))
        for _ in range(p.steps):
            some = rng.choice(len(windows), size=min(p.batch, len(windows)), p=weight / weight.sum())
            number: dict[str, int] = {}
            rows = np.zeros((p.window, len(some)), np.int32)
            for j, i in enumerate(some):
                own = [number.setdefault(x, len(number) + 1) for x in windows[i]]
                rows[: len(own), j] = own
            if number:
                net.step(list(number), rows, t[some], np.ones(len(some), np.float32))
    logits = np.concatenate([net.logits(texts[i : i + 200]) for i in range(0, len(texts), 200)]).astype(np.float64)
    net.shift, net.scale = _cut(logits, y)
    return net


def _cut(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The logit that parts the labels with the best F1, in the middle of its gap, and a scale for the scores."""
    order = np.argsort(-logits)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    after = logits[order[k + 1]] if k + 1 < len(y) else logits[order[k]] - 1
    return float((logits[order[k]] + after) / 2), float(2.0 / (np.std(logits) + 1e-6))


def sample(docs: DataFrame, labels: DataFrame, p: ToxicParams) -> tuple[list[str], list[int]]:
    """At most 2 * p.sample labelled rows of at most p.longest characters, brought to the driver."""
    keep = labels.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(toxic AS int) AS toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    texts = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").where(~held_out(F.col("doc_id")) & (F.length("text") <= p.longest))
    known = texts.select("doc_id").join(keep.where(~held_out(F.col("doc_id"))).distinct(), "doc_id")
    few = None
    for label in (0, 1):
        own = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
        few = own if few is None else few.unionByName(own)
    picked = few.collect()
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked], "doc_id bigint, toxic int").distinct()
    rows = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("text")).limit(2 * p.sample).collect()
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def learned(docs: DataFrame, labels: DataFrame, p: ToxicParams = ToxicParams()) -> Network | None:
    return fit(*sample(docs, labels, p), p)


def _bare(net: Network | None) -> Network | None:
    if net is not None:
        net._adam = {}
    return net


def score_batch(net: Network | None, texts: pa.Array, memo: Memo) -> np.ndarray:
    out = np.zeros(len(texts))
    if net is None:
        return out
    for first, part in parts(texts, 1 << 19):
        out[first : first + len(part)] = net.scores(net.logits([t or "" for t in part.to_pylist()], memo=memo))
        memo.room()
    return out


def score(docs: DataFrame, labels: DataFrame, p: ToxicParams = ToxicParams()) -> DataFrame:
    """(doc_id, text), (doc_id, toxic) -> doc_id, held_out, score, predicted; one row for each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(_bare(learned(docs, labels, p)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            s = score_batch(held.value, batch.column("text"), memo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        tidy()

    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(run, SCHEMA)


def remove(docs: DataFrame, labels: DataFrame, p: ToxicParams = ToxicParams()) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; all of their columns."""
    held = docs.sparkSession.sparkContext.broadcast(_bare(learned(docs, labels, p)))
    place = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            yield batch.filter(pa.array(score_batch(held.value, batch.column(place), memo) < CUT))
        tidy()

    return docs.mapInArrow(run, docs.schema)
