"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is read in windows of ``WINDOW`` bytes; in each, one network runs forward and one backward from an empty state,
and their states at every byte give probabilities of the languages there.  A document's probabilities are the means over
all its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import crc_mod, give_back, sub_batches

WINDOW, HIDDEN, UND = 128, 8, "und"


@dataclass
class Network:
    """Weights of both directions (first axis): what each byte adds to the update, reset and candidate gates, what the
    state adds, and the output layer over both states."""

    langs: list[str]
    byte: np.ndarray  # 2, 3H, 256
    state: np.ndarray  # 2, 3H, H
    out: np.ndarray  # L, 2H
    bias: np.ndarray  # L, 1
    letters: str = ""  # all letters of the texts it learned from

    def weights(self) -> list[np.ndarray]:
        return [self.byte, self.state, self.out, self.bias]


def new_network(langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
    f = lambda s, *shape: (rng.standard_normal(shape) * s).astype(np.float32)
    return Network(langs, f(0.3, 2, 3 * hidden, 256), f(0.5 / np.sqrt(hidden), 2, 3 * hidden, hidden), f(0.3, len(langs), 2 * hidden), np.zeros((len(langs), 1), np.float32))


def _step(net: Network, x: np.ndarray, y: np.ndarray, h: np.ndarray, keep: bool):
    """One byte on in both directions; x and y are the bytes that these read.  h changes in place."""
    hid, lanes = h.shape[1], h.shape[2]
    g = np.empty((2, 3 * hid, lanes), np.float32)
    np.take(net.byte[0], x, axis=1, out=g[0], mode="clip")
    np.take(net.byte[1], y, axis=1, out=g[1], mode="clip")
    u = np.matmul(net.state, h)
    zr, n, un = g[:, : 2 * hid], g[:, 2 * hid :], u[:, 2 * hid :]
    zr += u[:, : 2 * hid]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    before = h.copy() if keep else None
    n += un * zr[:, hid:]
    np.tanh(n, out=n)
    h -= n
    h *= zr[:, :hid]
    h += n
    return (g, un, before) if keep else None


def _probabilities(net: Network, states: np.ndarray) -> np.ndarray:
    """Language probabilities at each position; states: 2H, positions."""
    p = net.out @ states
    p += net.bias
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    return p


def gradients(net: Network, x: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of windows x (steps, lanes), and its gradients by backpropagation through
    time."""
    steps, lanes = x.shape
    hid = net.state.shape[2]
    h, kept = np.zeros((2, hid, lanes), np.float32), []
    states = np.empty((2 * hid, steps, lanes), np.float32)
    for t in range(steps):
        kept.append(_step(net, x[t], x[steps - 1 - t], h, True))
        states[:hid, t], states[hid:, steps - 1 - t] = h[0], h[1]
    flat = states.reshape(2 * hid, -1)
    p = _probabilities(net, flat)
    want = np.tile(target, steps)
    at = np.arange(len(want))
    loss = float(-np.log(np.maximum(p[want, at], 1e-30)).mean())
    p[want, at] -= 1
    p /= len(want)
    d_out, d_bias = p @ flat.T, p.sum(axis=1, keepdims=True)
    d_states = (net.out.T @ p).reshape(2 * hid, steps, lanes)
    d_state, d_byte = np.zeros_like(net.state), np.zeros_like(net.byte)
    d_gates = np.empty((2, 3 * hid, steps, lanes), np.float32)
    dh = np.zeros((2, hid, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        g, un, before = kept[t]
        z, r, n = g[:, :hid], g[:, hid : 2 * hid], g[:, 2 * hid :]
        dh[0] += d_states[:hid, t]
        dh[1] += d_states[hid:, steps - 1 - t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        by_state = np.concatenate([dz, dr, dn * r], axis=1)
        d_gates[:, : 2 * hid, t], d_gates[:, 2 * hid :, t] = by_state[:, : 2 * hid], dn
        d_state += by_state @ before.transpose(0, 2, 1)
        dh = dh * z + net.state.transpose(0, 2, 1) @ by_state
    for d, read in enumerate((x, x[::-1])):
        read = read.reshape(-1)
        for k in range(3 * hid):
            d_byte[d, k] = np.bincount(read, d_gates[d, k].reshape(-1), 256)
    return loss, [d_byte, d_state, d_out, d_bias]


def train(samples: list[tuple[bytes, str]], langs: list[str], hidden: int = HIDDEN, steps: int = 400, lanes: int = 128, length: int = 48, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit a network to pieces of text with their languages (Adam, falling rate); pieces shorter than `length` bytes
    are repeated to that length."""
    rng = np.random.default_rng(seed)
    net = new_network(langs, hidden, rng)
    by = [[t if len(t) >= length else (t * (length // len(t) + 1)) for t, l in samples if l == lang and t] for lang in langs]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    for step in range(steps):
        target = rng.integers(0, len(langs), lanes)
        x = np.empty((length, lanes), np.uint8)
        for i, lang in enumerate(target):
            t = by[lang][rng.integers(len(by[lang]))]
            at = rng.integers(0, len(t) - length + 1)
            x[:, i] = np.frombuffer(t, np.uint8, length, at)
        _, grads = gradients(net, x, target)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * (1 - step / steps) + 1e-4
        for w, g, (m, v) in zip(net.weights(), grads, moments):
            g *= min(1.0, 1.0 / (norm + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6)
    return net


def noise(samples: list[tuple[bytes, str]], seed: int = 11) -> list[tuple[bytes, str]]:
    """Of each text its characters in random order, and in turn ASCII letters and spaces at random: texts of `und`."""
    rng, out = np.random.default_rng(seed), []
    ascii_ = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ         ", np.uint8)
    for i, (t, _) in enumerate(samples):
        out.append((rng.choice(ascii_, max(1, len(t))).tobytes() if i % 2 else "".join(rng.permutation(list(t.decode()))).encode(), UND))
    return out


def window_probabilities(net: Network, x: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums over the bytes of each window (lane) of x (steps, lanes) of the probabilities: L, lanes."""
    steps, lanes = x.shape
    hid = net.state.shape[2]
    h = np.zeros((2, hid, lanes), np.float32)
    states = np.empty((2 * hid, steps, lanes), np.float32)
    whole = bool((lens == steps).all())
    for t in range(steps):
        back = steps - 1 - t
        _step(net, x[t], x[back], h, False)
        if not whole:
            h[1] *= back < lens
        states[:hid, t], states[hid:, back] = h[0], h[1]
    p = _probabilities(net, states.reshape(2 * hid, -1)).reshape(-1, steps, lanes)
    if not whole:
        p *= np.arange(steps)[:, None] < lens
    return p.sum(axis=1)


def document_probabilities(net: Network, texts: list[bytes], window: int = WINDOW, lanes: int = 1024) -> np.ndarray:
    """Mean language probabilities over all bytes of each text; texts may not be empty.  documents, L."""
    data = np.frombuffer(b"".join(texts) + bytes(window), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    n = -(-size // window)
    doc = np.repeat(np.arange(len(texts)), n)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = start[doc] + rank * window
    lens = np.minimum(window, size[doc] - rank * window)
    order = np.argsort(-lens, kind="stable")
    sums = np.empty((len(net.langs), len(doc)), np.float64)
    for k in range(0, len(order), lanes):
        o = order[k : k + lanes]
        steps = int(lens[o[0]])
        if len(o) > 1 and lens[o[-1]] < window == steps:  # whole windows go without a mask
            cut = int(np.count_nonzero(lens[o] == window))
            parts = [o[:cut], o[cut:]]
        else:
            parts = [o]
        for o in parts:
            steps = int(lens[o[0]])
            x = np.ascontiguousarray(data[at[o][:, None] + np.arange(steps)[None, :]].T)
            sums[:, o] = window_probabilities(net, x, lens[o])
    out = np.stack([np.bincount(doc, s, len(texts)) for s in sums], axis=1)
    return out / size[:, None]


def label_positions(net: Network, text: str, window: int = WINDOW) -> np.ndarray:
    """Index of the most probable language at each byte of a text."""
    data, out = np.frombuffer(text.encode(), np.uint8), []
    hid = net.state.shape[2]
    for at in range(0, len(data), window):
        x = data[at : at + window, None]
        h, states = np.zeros((2, hid, 1), np.float32), np.empty((2 * hid, len(x), 1), np.float32)
        for t in range(len(x)):
            _step(net, x[t], x[-1 - t], h, False)
            states[:hid, t], states[hid:, -1 - t] = h[0], h[1]
        out.append(_probabilities(net, states.reshape(2 * hid, -1)).argmax(axis=0))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def learn_languages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fold: tuple[int, int] = (4, 2), sample_docs: int = 600, reject: bool = False, **how) -> Network | None:
    """Train on a bounded sample of df: of each language about sample_docs rows (1.5 times that at most reach the driver,
    by a threshold on a hash of key and text), with their whole texts.

    Rows with a null language or text, and those of which crc32 of the key as text modulo fold[0] is fold[1], are never
    used; a null key counts as the empty text there.  Rows of one key and text are one row.  None if no row is left.  With
    reject the network learns `und` too, from letters in no language's order.
    """
    rows = df.where(F.col(lang).isNotNull() & (F.col(text) != "") & (crc_mod(key, fold[0]) != fold[1]))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    below = F.create_map(*[F.lit(x) for l, n in sorted(counts.items()) for x in (l, int(min(1.0, 1.2 * sample_docs / n) * (1 << 30)))])
    chosen = rows.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(below, F.col("lang")))
    got = chosen.groupBy("lang", "h").agg(F.min("t").alias("t")).limit(int(1.5 * sample_docs * len(counts))).collect()
    samples = [(r["t"].encode(), r["lang"]) for r in sorted(got, key=lambda r: (r["lang"], r["h"]))]
    langs = sorted({l for _, l in samples})
    if not langs:
        return None
    if reject:
        net = train(samples + noise(samples), [*(x for x in langs if x != UND), UND], **how)
    else:
        net = train(samples, langs, **how)
    net.letters = "".join(sorted({c for t, _ in samples for c in t.decode() if c.isalpha()}))
    return net


def language_id(df: DataFrame, net: Network | None, text: str = "text", label: str = "lang_pred", score: str = "score", keep_text: bool = False) -> DataFrame:
    """df without its text (or with it: keep_text), with the most probable language of each whole text and its probability.

    Of equally probable languages the first by name counts.  `und` and 0 where the text is null or has no letter, or no network could be trained.  Columns of these names in df are
    replaced; rows stay as they are, repeated ones and null keys too, none is shuffled.
    """
    kept = [c for c in df.columns if c not in (label, score) and (keep_text or c != text)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    inner = text if keep_text else "__text"
    while inner in kept and not keep_text:
        inner += "_"

    def run(batches):
        for b in sub_batches(batches, inner, 1 << 21):
            texts = [t or "" for t in b.column(inner).to_pylist()]
            told = [i for i, t in enumerate(texts) if net is not None and any(map(str.isalpha, t))]
            names, best = [UND] * len(texts), np.zeros(len(texts))
            if told:
                p = document_probabilities(net, [texts[i].encode() for i in told])
                top = p.argmax(axis=1)
                best[told] = np.minimum(1.0, p[np.arange(len(told)), top])
                for i, k in zip(told, top):
                    names[i] = net.langs[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(names), pa.array(best)], names=[*kept, label, score])
        give_back()

    read = [F.col(f"`{c}`") for c in kept] + ([] if keep_text else [F.col(text).alias(inner)])
    return df.select(*read).mapInArrow(run, schema)
