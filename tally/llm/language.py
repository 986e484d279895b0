"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes in both directions; at every position the two
states give a distribution over the languages. A document's distribution is the mean over
the positions of letters. The network is trained in numpy by backpropagation through
time, every position carrying its document's language as its label.

Long texts are read in windows of ``WINDOW`` bytes, all of them: windows are the columns of
a matrix, so a step of the network is a few matrix operations for many windows at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import remainder, short_batches

#: State size of each direction, bytes of a window, windows computed at once.
HIDDEN, WINDOW, COLUMNS = 8, 64, 2048
#: Training: documents of each language (a sample chosen by a hash of the id), steps, windows a step.
SAMPLE, STEPS, BATCH = 400, 260, 160
#: Languages that STEPS teach; more take steps in proportion, and fewer windows at once.
LANGUAGES = 64
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_LETTER = np.zeros(256, np.float32)
_IS_LETTER[97:123] = _IS_LETTER[128:] = 1


def _steps(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool):
    """States after each byte of x (time, windows), and what backpropagation needs. Gates: z, r, n."""
    h_size = u.shape[1]
    h = np.zeros((h_size, x.shape[1]), np.float32)
    states = np.empty((len(x), *h.shape), np.float32)
    kept = []
    for t in range(len(x)):
        g = np.take(w, x[t], axis=1)
        v = u @ h
        zr = g[: 2 * h_size]
        zr += v[: 2 * h_size]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        n = g[2 * h_size :]
        n += zr[h_size:] * v[2 * h_size :]
        np.tanh(n, out=n)
        before = h
        h = zr[:h_size] * (before - n)
        h += n
        states[t] = h
        if keep:
            kept.append((before, zr, n, v[2 * h_size :]))
    return states, kept


def _back(x: np.ndarray, u: np.ndarray, kept: list, grad: np.ndarray):
    """Gradients of the input table and the recurrent matrix, from those of the states."""
    h_size = u.shape[1]
    dw, du = np.zeros((256, 3 * h_size), np.float32), np.zeros_like(u)
    dh = np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        before, zr, n, vn = kept[t]
        z, r = zr[:h_size], zr[h_size:]
        dh = dh + grad[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * vn * r * (1 - r)
        gates = np.concatenate([dz, dr, dn])
        np.add.at(dw, x[t], gates.T)
        through = np.concatenate([dz, dr, dn * r])
        du += through @ before.T
        dh = dh * z + u.T @ through
    return dw.T, du


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        n, h = max(1, len(languages)), HIDDEN
        self.languages = languages
        self.p = {
            "wf": r.normal(0, 0.3, (3 * h, 256)), "uf": r.normal(0, 0.3, (3 * h, h)), "wb": r.normal(0, 0.3, (3 * h, 256)), "ub": r.normal(0, 0.3, (3 * h, h)),
            "o": r.normal(0, 0.3, (n, 2 * h)), "c": np.zeros((n, 1)),
        }
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in self.p.items()}

    def positions(self, x: np.ndarray, keep: bool = False):
        """Probabilities (languages, time * windows), and the states behind them."""
        f, kf = _steps(x, self.p["wf"], self.p["uf"], keep)
        b, kb = _steps(x[::-1], self.p["wb"], self.p["ub"], keep)
        both = np.concatenate([f, b[::-1]], axis=1)  # (time, 2h, windows)
        flat = np.ascontiguousarray(both.transpose(1, 0, 2)).reshape(2 * HIDDEN, -1)
        logits = self.p["o"] @ flat + self.p["c"]
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits, flat, kf, kb

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Adam on windows (count, WINDOW) of bytes and their languages' numbers."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = -(-STEPS * max(LANGUAGES, len(self.languages)) // LANGUAGES)
        for step in range(1, steps + 1):
            pick = r.integers(0, len(windows), BATCH)
            x, y = np.ascontiguousarray(windows[pick].T), labels[pick]
            prob, flat, kf, kb = self.positions(x, True)
            weight = _IS_LETTER[x].reshape(-1)
            d = prob
            d[np.tile(y, WINDOW), np.arange(d.shape[1])] -= 1
            d *= weight / max(1.0, weight.sum())
            g = {"o": d @ flat.T, "c": d.sum(1, keepdims=True)}
            back = (self.p["o"].T @ d).reshape(2 * HIDDEN, WINDOW, BATCH).transpose(1, 0, 2)
            g["wf"], g["uf"] = _back(x, self.p["uf"], kf, np.ascontiguousarray(back[:, :HIDDEN]))
            g["wb"], g["ub"] = _back(x[::-1], self.p["ub"], kb, np.ascontiguousarray(back[::-1, HIDDEN:]))
            rate = 0.02 * (1 - step / (steps + 1)) + 0.001
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.005 * (g[k] ** 2 - s[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.995**step)) + 1e-7)).astype(np.float32)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over the letters of each text of data, cut at offsets: (texts, languages)."""
        sizes = np.diff(offsets)
        many = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(sizes)), many)
        first = np.repeat(offsets[:-1] + 0, many) + WINDOW * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        last = np.repeat(offsets[1:], many)
        total, letters = np.zeros((len(sizes), len(self.languages))), np.zeros(len(sizes))
        steps = np.arange(WINDOW)[:, None]
        columns = max(1, COLUMNS * LANGUAGES // max(LANGUAGES, len(self.languages)))
        for at in range(0, len(doc), columns):
            place = first[at : at + columns][None, :] + steps
            inside = place < last[at : at + columns][None, :]
            x = np.where(inside, _FOLD[data[np.minimum(place, len(data) - 1)]], 0).astype(np.uint8)
            prob = self.positions(x)[0].reshape(len(self.languages), WINDOW, -1)
            weight = _IS_LETTER[x]
            here = doc[at : at + columns]
            starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            total[here[starts]] += np.add.reduceat((prob * weight).sum(1), starts, axis=1).T
            letters[here[starts]] += np.add.reduceat(weight.sum(0), starts)
        return total / np.maximum(letters, 1)[:, None]


def fit(docs: DataFrame) -> Network:
    """Trains on about SAMPLE documents of each language, of those whose crc32(doc_id) modulo 4 is not 2.

    Every language of these is learned.
    """
    known = docs.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null and length(text) > 0")
    known = known.filter(remainder(F.col("doc_id"), 4) != 2)
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Network([])
    share = F.broadcast(docs.sparkSession.createDataFrame([(k, min(1.0, SAMPLE / n)) for k, n in counts.items()], "lang string, share double"))
    picked = known.join(share, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    languages = sorted(counts)
    number = {x: i for i, x in enumerate(languages)}
    windows, labels = [], []
    r = np.random.default_rng(5)
    taken = dict.fromkeys(languages, 0)
    for row in picked.select("doc_id", "lang", "text").orderBy("doc_id", "text").toLocalIterator():
        if taken[row.lang] >= 2 * SAMPLE:
            continue
        taken[row.lang] += 1
        data = _FOLD[np.frombuffer(row.text.encode(), np.uint8)]
        for at in r.integers(0, max(1, len(data) - WINDOW + 1), 12):
            windows.append(np.pad(data[at : at + WINDOW], (0, max(0, WINDOW - len(data[at : at + WINDOW])))))
            labels.append(number[row.lang])
    net = Network(languages)
    labels = np.array(labels)
    # Languages count alike, however many documents each has.
    even = np.concatenate([r.choice(np.flatnonzero(labels == i), 12 * SAMPLE) for i in range(len(languages)) if (labels == i).any()])
    net.train(np.array(windows, np.uint8)[even], labels[even])
    return net


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            data, offsets = words.text_buffers(batch.column(1))
            ok = np.array([bool(t and _LETTER.search(t)) for t in batch.column(1).to_pylist()], bool) & bool(net.languages)
            lang, score = [UNKNOWN] * len(ok), np.zeros(len(ok))
            if ok.any():
                prob = net.documents(data, offsets)
                best = prob.argmax(1)
                lang = [net.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), ok.tolist(), strict=True)]
                score = np.where(ok, np.clip(prob.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of ``docs`` (doc_id, text, lang).

    Null texts and texts without a letter are ``und`` with score 0, and all are if nothing can be learned.
    held_out is false for a null doc_id. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    short_batches(spark)
    net = spark.sparkContext.broadcast(fit(docs))
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predicted(net), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
