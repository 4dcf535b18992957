"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows. In each, one recurrent layer reads forward and one
backward; every position gets a probability for each language from both states, and a text's
probability is the mean over all its positions. The unit has an update gate and a candidate
state (no reset gate). Training is backpropagation through time in numpy, on the driver, on a
bounded sample of the labelled rows; prediction runs over whole texts in the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tamarack.llm import _common as c
from tamarack.llm._text import utf8

WINDOW, BATCH = 128, 1024


@dataclass
class Network:
    """x: input table, u: recurrent weights, of each direction (gate rows first); w, b: output."""

    langs: list[str]
    x: np.ndarray  # 2, 2 * hidden, 256
    u: np.ndarray  # 2, 2 * hidden, hidden
    w: np.ndarray  # 2, langs, hidden
    b: np.ndarray  # langs, 1

    @property
    def hidden(self) -> int:
        return self.u.shape[2]


def new_network(langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return Network(langs, draw(2, 2 * hidden, 256), draw(2, 2 * hidden, hidden), draw(2, len(langs), hidden), np.zeros((len(langs), 1), np.float32))


def _step(x: np.ndarray, u: np.ndarray, codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next state, and tanh of the pre-activations (gate rows halved, so a gate is 0.5 + 0.5 tanh)."""
    a = np.take(x, codes, axis=1, mode="clip")
    a += u @ h
    np.tanh(a, out=a)
    k = len(h)
    move = a[k:] - h
    gate = a[:k] * np.float32(0.5)
    gate += np.float32(0.5)
    move *= gate
    move += h
    return move, a


class _Reader:
    """Runs one direction over a batch, in place: new large arrays at each step would cost more than the sums."""

    def __init__(self, x: np.ndarray, u: np.ndarray, n: int):
        self.x, self.u, self.k = x, u, u.shape[1]
        self.a, self.r = np.empty((2 * self.k, n), np.float32), np.empty((2 * self.k, n), np.float32)
        self.move, self.h = np.empty((self.k, n), np.float32), np.zeros((self.k, n), np.float32)

    def step(self, codes: np.ndarray) -> np.ndarray:
        a, h, k = self.a, self.h, self.k
        np.take(self.x, codes, axis=1, mode="clip", out=a)
        np.matmul(self.u, h, out=self.r)
        a += self.r
        np.tanh(a, out=a)
        np.subtract(a[k:], h, out=self.move)
        gate = a[:k]
        gate += np.float32(1)
        gate *= np.float32(0.5)
        self.move *= gate
        h += self.move
        return h


def pooled(net: Network, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum over positions of the languages' probabilities, (langs, windows).

    codes: (WINDOW, windows); windows shorter than that come last, their lengths are in lens.
    """
    steps, n = codes.shape
    codes = codes.astype(np.intp)
    short = n - len(lens)
    forward, backward = _Reader(net.x[0], net.u[0], n), _Reader(net.x[1], net.u[1], n)
    ahead = np.empty((steps, len(net.langs), n), np.float32)  # the forward states' part of the output
    for t in range(steps):
        np.matmul(net.w[0], forward.step(codes[t]), out=ahead[t])
    ahead += net.b
    total, own, norm = np.zeros((len(net.langs), n), np.float32), np.empty((len(net.langs), n), np.float32), np.empty(n, np.float32)
    for t in range(steps - 1, -1, -1):
        h, inside = backward.step(codes[t]), t < lens
        h[:, short:] *= inside
        p = ahead[t]
        p += np.matmul(net.w[1], h, out=own)
        np.minimum(p, np.float32(60), out=p)
        np.exp(p, out=p)
        np.sum(p, axis=0, out=norm)
        norm += np.float32(1e-30)
        p /= norm
        p[:, short:] *= inside
        total += p
    return total


def loss_and_gradients(net: Network, codes: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions of full windows, and its gradients through time."""
    steps, n = codes.shape
    k, states, acts = net.hidden, np.zeros((2, steps + 1, net.hidden, n), np.float32), np.empty((2, steps, 2 * net.hidden, n), np.float32)
    for d in (0, 1):  # states[d, i] is before step i of direction d
        for i in range(steps):
            states[d, i + 1], acts[d, i] = _step(net.x[d], net.u[d], codes[i if d == 0 else steps - 1 - i], states[d, i])
    ahead, back = states[0, 1:], states[1, 1:][::-1]
    logits = np.einsum("ch,thn->tcn", net.w[0], ahead, optimize=True) + np.einsum("ch,thn->tcn", net.w[1], back, optimize=True) + net.b
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(n)
    loss = float(-np.log(np.maximum(p[:, label, at], 1e-9)).mean())
    p[:, label, at] -= 1
    p /= steps * n
    grads = {"w": np.stack([np.einsum("tcn,thn->ch", p, s, optimize=True) for s in (ahead, back)]), "b": p.sum(axis=(0, 2))[:, None], "u": np.zeros_like(net.u), "x": np.zeros_like(net.x)}
    for d in (0, 1):
        out = np.einsum("ch,tcn->thn", net.w[d], p, optimize=True)
        das, dh = np.empty((steps, 2 * k, n), np.float32), np.zeros((k, n), np.float32)
        order = codes if d == 0 else codes[::-1]
        for i in range(steps - 1, -1, -1):
            dh = dh + (out[i] if d == 0 else out[steps - 1 - i])
            g, m, h = acts[d, i, :k], acts[d, i, k:], states[d, i]
            gate = 0.5 + 0.5 * g
            das[i, :k] = dh * (m - h) * 0.5 * (1 - g * g)
            das[i, k:] = dh * gate * (1 - m * m)
            grads["u"][d] += das[i] @ h.T
            dh = dh * (1 - gate) + net.u[d].T @ das[i]
        flat = order.ravel()
        for r in range(2 * k):
            grads["x"][d, r] = np.bincount(flat, das[:, r].ravel(), minlength=256)
    return loss, grads


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = 8, rounds: int = 260, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """windows: (n, WINDOW) bytes. Adam, the rate falling to 0; the same rows give the same network."""
    rng = np.random.default_rng(seed)
    net = new_network(langs, hidden, rng)
    one, two = ({k: np.zeros_like(getattr(net, k)) for k in ("x", "u", "w", "b")} for _ in range(2))
    of = [np.flatnonzero(labels == k) for k in range(len(langs))]
    for i in range(rounds):
        rows = np.concatenate([rng.choice(o, max(1, batch // len(langs))) for o in of])
        _, grads = loss_and_gradients(net, np.ascontiguousarray(windows[rows].T), labels[rows])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g *= min(1.0, 1.0 / max(size, 1e-9))
            one[k] += 0.1 * (g - one[k])
            two[k] += 0.01 * (g * g - two[k])
            step = rate * (1 - i / rounds) * (one[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(two[k] / (1 - 0.99 ** (i + 1))) + 1e-8)
            setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


def text_probabilities(net: Network, texts) -> np.ndarray:
    """(texts, langs): mean probability over all bytes of each text; 0 for empty texts."""
    out, n = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    full, part, owners, tails = [], [], [], []
    held = 0

    def flush() -> None:
        if held:
            rows = np.zeros((held, WINDOW), np.uint8)
            at = sum(len(f) for f in full)
            if full:
                np.concatenate(full, out=rows[:at])
            for r, p in enumerate(part):
                rows[at + r, : len(p)] = p
            who = np.array([i for i, k in owners for _ in range(k)] + [i for i, _ in tails])
            total = pooled(net, np.ascontiguousarray(rows.T), np.array([k for _, k in tails]))
            np.add.at(out, who, total.T)
        for x in (full, part, owners, tails):
            x.clear()

    for i, text in enumerate(texts):
        data = np.frombuffer(utf8(text), np.uint8)
        n[i] = len(data)
        for a in range(0, len(data), BATCH * WINDOW):
            chunk = data[a : a + BATCH * WINDOW]
            k = len(chunk) // WINDOW
            if k:
                full.append(chunk[: k * WINDOW].reshape(k, WINDOW))
                owners.append((i, k))
            if rest := len(chunk) % WINDOW:
                part.append(chunk[k * WINDOW :])
                tails.append((i, rest))
            held += k + (rest > 0)
            if held >= BATCH:
                flush()
                held = 0
    flush()
    return out / np.maximum(n, 1)[:, None]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 384, per_doc: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Network | None:
    """The network, from ``per_doc`` windows each of at most ``per_lang`` rows of a language; None without any.

    The rows with the least hashes are taken among those that aren't held out, whatever their ids,
    which may repeat. In a language of many rows, only hashes below a threshold that lets 8 times as
    many pass are ranked, so no task ranks a language's all.
    """
    rows = c.with_row(docs)
    known = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    first = Window.partitionBy("lang").orderBy("h", "_tmk_row")
    hashed = known.select("_tmk_row", F.col(lang_col).alias("lang"), F.xxhash64("_tmk_row").alias("h"))
    counts = c.maybe_broadcast(c.cut(hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))), 64)
    low = hashed.join(counts, "lang").filter((F.col("h") / 2.0**64 + 0.5) * F.col("n") <= 8 * per_lang)
    chosen = low.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_lang).select("_tmk_row")
    spread = [F.substring(F.col(text_col), (1 + F.floor(F.greatest(F.length(text_col) - WINDOW, F.lit(0)) * (i / max(1, per_doc - 1)))).cast("int"), F.lit(WINDOW)) for i in range(per_doc)]
    own = known.select("_tmk_row", F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.array(*spread).alias("parts"))
    taken = own.join(F.broadcast(chosen), "_tmk_row").select("id", "lang", "parts").collect()  # at most per_lang rows of each language
    windows, labels = [], []
    for r in sorted(taken, key=lambda r: (r.id, r.lang, r.parts)):
        for p in dict.fromkeys(r.parts):
            if any(ch.isalpha() for ch in p):
                data = np.frombuffer(p.encode("utf-8", "replace"), np.uint8)
                windows.append(np.resize(data, WINDOW))  # short ones repeat
                labels.append(r.lang)
    if not windows:
        return None
    langs = sorted(set(labels))
    return train(np.array(windows), np.array([langs.index(x) for x in labels]), langs, **options)


def predict_language(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score.

    score is the language's mean probability over all bytes of the text, however long; of equally
    probable languages the first by name is taken. A text that is null or has no letter, and every
    text if nothing could be learned, gets ``und`` and score 0. Repeated rows have a row each, an
    empty table gives none; other columns, whatever their names, don't matter.
    """
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"), F.col(text_col).alias("text"))
    schema = T.StructType([own.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def kernel(batches):
        for b in batches:
            letter = np.array(b.column(1).to_pylist(), bool)
            langs, score = np.full(len(letter), "und", object), np.zeros(len(letter))
            if net and letter.any():
                texts = [t for t, ok in zip(b.column(2).to_pylist(), letter, strict=True) if ok]
                p = text_probabilities(net, texts)
                langs[letter] = np.array(net.langs, object)[p.argmax(axis=1)]
                score[letter] = np.clip(p.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score)], names=schema.names)

    out = own.mapInArrow(kernel, schema)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """predict_language by a network that is fitted on docs."""
    return predict_language(docs, fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options), id_col, text_col)
