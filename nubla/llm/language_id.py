"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time: a table turns each byte of the lower-cased text
into gate inputs, one gated recurrent layer reads each segment forwards and one backwards, and a softmax layer labels
every byte. A document's probabilities are the mean over all its bytes. Texts are read whole, in segments of ``SEGMENT``
bytes with a fresh state each, so memory does not grow with a text.

Learning uses at most ``PER_LANG`` documents of each language outside the held-out fold, ``MOST_ROWS`` of all languages and
``MOST_CHARS`` characters, divided among the languages; every language has one document at least.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubla.llm.common import byte_slices, held_out, release, sampled, text_bytes

PER_LANG = 600
MOST_ROWS, MOST_CHARS = 40_000, 64 << 20
SEGMENT = 96
HIDDEN = 8
STEPS = 160
BATCH = 192


@dataclass
class Network:
    """Weights of both directions ``(table, recurrent, recurrent bias)`` and of the output layer."""

    langs: list[str]
    forward: tuple[np.ndarray, np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def _run(weights, x: np.ndarray, keep: bool):
    """States (T, B, H) of one direction over x (T, B); with ``keep`` also what the backward pass needs."""
    table, u, ub = weights
    t, b = x.shape
    h = u.shape[0]
    states, kept = np.empty((t, b, h), np.float32), []
    state = np.zeros((b, h), np.float32)
    for i in range(t):
        g = table[x[i]]
        a = state @ u
        a += ub
        zr = g[:, : 2 * h]
        zr += a[:, : 2 * h]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        n = np.tanh(g[:, 2 * h :] + zr[:, h:] * a[:, 2 * h :])
        new = n + zr[:, :h] * (state - n)
        if keep:
            kept.append((state, zr, n, a[:, 2 * h :]))
        states[i] = state = new
    return states, kept


def _back(weights, x: np.ndarray, kept, grad: np.ndarray):
    """Gradients of one direction's weights, given those of its states (T, B, H)."""
    table, u, ub = weights
    h = u.shape[0]
    d_table, d_u, d_ub = np.zeros_like(table), np.zeros_like(u), np.zeros_like(ub)
    carry = np.zeros(grad.shape[1:], np.float32)
    for i in range(len(x) - 1, -1, -1):
        before, zr, n, a_n = kept[i]
        z, r = zr[:, :h], zr[:, h:]
        d = grad[i] + carry
        d_n = d * (1 - z) * (1 - n * n)
        d_gate = np.concatenate([d * (before - n) * z * (1 - z), d_n * a_n * r * (1 - r)], axis=1)
        d_a = np.concatenate([d_gate, d_n * r], axis=1)
        np.add.at(d_table, x[i], np.concatenate([d_gate, d_n], axis=1))
        d_u += before.T @ d_a
        d_ub += d_a.sum(0)
        carry = d * z + d_a @ u.T
    return d_table, d_u, d_ub


def _segments(data: np.ndarray, offsets: np.ndarray):
    """Byte matrix (segments, SEGMENT), the lengths in it, and the row each segment belongs to."""
    lengths = np.diff(offsets)
    per_row = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), per_row)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = offsets[:-1][owner] + nth * SEGMENT
    size = np.minimum(SEGMENT, offsets[1:][owner] - start)
    return start, size, owner


def _matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(SEGMENT, segments) bytes; 0 after a segment's end."""
    at = np.arange(SEGMENT)[:, None]
    return np.where(at < size, data[np.minimum(start + at, len(data) - 1)], 0).astype(np.uint8)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Network:
    """Fit by Adam on random segments, as many of each language."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    data, offsets = text_bytes(pa.array([t.lower() for t in texts], pa.large_string()))
    start, size, owner = _segments(data, offsets)
    label = np.array([names.index(x) for x in langs])[owner]
    pools = [np.flatnonzero((label == k) & (size >= 8)) for k in range(len(names))]
    pools = [p if len(p) else np.flatnonzero(label == k) for k, p in enumerate(pools)]
    pools = [(k, p) for k, p in enumerate(pools) if len(p)]
    h, k = HIDDEN, len(names)
    new = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    params = [w for _ in range(2) for w in (new(256, 3 * h, by=0.3), new(h, 3 * h, by=h**-0.5), np.zeros(3 * h, np.float32))]
    params += [new(2 * h, k, by=(2 * h) ** -0.5), np.zeros(k, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1 if pools and k > 1 else 1):
        picked = [(j, rng.choice(p, -(-BATCH // len(pools)))) for j, p in pools]
        idx = np.concatenate([p for _, p in picked])
        y = np.concatenate([np.full(len(p), j) for j, p in picked])
        x = _matrix(data, start[idx], size[idx])
        mask = (np.arange(SEGMENT)[:, None] < size[idx]).astype(np.float32)
        hf, keep_f = _run(params[:3], x, True)
        hb, keep_b = _run(params[3:6], x[::-1], True)
        both = np.concatenate([hf, hb[::-1]], axis=2)
        prob = _softmax(both @ params[6] + params[7])
        d = prob
        d[:, np.arange(len(y)), y] -= 1
        d *= (mask / mask.sum())[:, :, None]
        d_both = d @ params[6].T
        grads = [*_back(params[:3], x, keep_f, d_both[:, :, :h]), *_back(params[3:6], x[::-1], keep_b, d_both[::-1, :, h:])]
        grads += [np.einsum("tbi,tbk->ik", both, d), d.sum((0, 1))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - step / (STEPS + 1))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Network(names, tuple(params[:3]), tuple(params[3:6]), params[6], params[7])


def _states(weights, x: np.ndarray) -> np.ndarray:
    """The states of ``_run`` without what training keeps: gates apart, halved for sigmoid(v) = (1 + tanh(v / 2)) / 2."""
    table, u, ub = weights
    h, b = u.shape[0], x.shape[1]
    gates = [slice(0, h), slice(h, 2 * h), slice(2 * h, 3 * h)]
    scale = (0.5, 0.5, 1.0)
    tables = [np.ascontiguousarray((table[:, g] + (ub[g] if i < 2 else 0)) * scale[i]) for i, g in enumerate(gates)]
    us = [np.ascontiguousarray(u[:, g] * np.float32(0.5)) for g in gates]
    half = ub[gates[2]] * np.float32(0.5)
    states = np.empty((len(x) + 1, b, h), np.float32)
    states[0] = 0
    z, r, n, a = (np.empty((b, h), np.float32) for _ in range(4))
    for i in range(len(x)):
        state, new = states[i], states[i + 1]
        np.take(tables[0], x[i], axis=0, out=z, mode="clip")
        np.take(tables[1], x[i], axis=0, out=r, mode="clip")
        np.take(tables[2], x[i], axis=0, out=n, mode="clip")
        z += np.matmul(state, us[0], out=a)
        r += np.matmul(state, us[1], out=a)
        np.tanh(z, out=z)
        np.tanh(r, out=r)
        np.matmul(state, us[2], out=a)
        a += half
        r += 1
        r *= a
        n += r
        np.tanh(n, out=n)
        np.subtract(state, n, out=new)
        new *= 0.5
        z += 1
        new *= z
        new += n
    return states[1:]


def label_positions(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities (T, B, languages) for every byte of x (T, B)."""
    h = net.out.shape[0] // 2
    logits = np.matmul(_states(net.forward, x).reshape(-1, h), net.out[:h])
    logits = logits.reshape(*x.shape, -1)
    logits += np.matmul(_states(net.backward, x[::-1]).reshape(-1, h), net.out[h:]).reshape(logits.shape)[::-1]
    logits += net.bias
    prob = np.exp(logits, out=logits)  # states lie in (-1, 1), so the logits are bounded
    prob /= np.matmul(prob, np.ones((prob.shape[2], 1), np.float32))
    return prob


def pooled(net: Network, text: pa.Array) -> np.ndarray:
    """Mean probabilities (rows, languages) of lower-cased texts without nulls; zeros for empty ones."""
    total = np.zeros((len(text), len(net.langs)))
    for a, b in byte_slices(text, 1 << 22):
        data, offsets = text_bytes(text.slice(a, b - a))
        start, size, owner = _segments(data, offsets)
        for i in range(0, len(start), 1024):
            s, n = start[i : i + 1024], size[i : i + 1024]
            prob = label_positions(net, _matrix(data, s, n))
            prob *= (np.arange(SEGMENT)[:, None] < n)[:, :, None]
            np.add.at(total, a + owner[i : i + 1024], prob.sum(0))
    lengths = pc.binary_length(text).to_numpy(zero_copy_only=False)
    return total / np.maximum(lengths, 1)[:, None]


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Network | None:
    """Learn from a bounded sample outside the held-out fold; None if no document has a language and a text.

    Rows without an id, a language or a text are not learned from; repeated ones count as often as they are drawn.
    """
    rows = docs.filter("lang is not null and text is not null and text <> ''").filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    got = sampled(rows.select("doc_id", "lang", "text"), "lang", "doc_id", per_lang, MOST_ROWS, F.length("text"), MOST_CHARS).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in got], [r["lang"] for r in got]) if got else None


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) for every row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learned. Repeated rows each give a
    row, a null id keeps its own; a very long text is read whole, in slices. Of languages equally likely the first by name
    wins. Other columns are not read; an empty table gives an empty result.
    """
    id_type = docs.schema["doc_id"].dataType

    def predict(batches):
        for batch in batches:
            text = pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
            letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            if net is None:
                prob, names = np.zeros((len(text), 1)), ["und"]
            else:
                prob, names = pooled(net, text), net.langs
            best = prob.argmax(1) if len(prob) else np.zeros(0, int)
            score = np.clip(prob[np.arange(len(prob)), best], 0, 1)
            pred = np.where(letters, np.array(names, object)[best], "und")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(np.where(pred == "und", 0.0, score), pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        release()

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, f"doc_id {id_type.simpleString()}, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
