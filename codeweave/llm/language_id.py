"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in segments of ``SEGMENT`` bytes; within a segment one
GRU runs forwards and one backwards, and every byte gets a softmax over the
learned languages from both states.  A document's probabilities are pooled from
all its positions (mean log probability, normalised again).  All segments of a
batch of documents run side by side, so a step of time is a few matrix products.

Training (``train``) is backpropagation through time in numpy on the driver,
from a bounded, documented sample: at most about ``SAMPLE_PER_LANG`` rows of
each learned language, one window of ``SEGMENT`` bytes each, chosen by hashes.
Prediction reads every byte of every text.

Defined cases: a null text or one without a letter is ``und`` with score 0;
without any labelled row every text is ``und``; equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, column_of, raw_texts, rows_with_text, spread, text_of

by_value(__name__)

SEGMENT, HIDDEN = 64, 8
SAMPLE_PER_LANG = 1200
EPOCHS, RATE, BATCH, SEED = 10, 0.02, 128, 7
#: Segments that run side by side in a task.
SIDE_BY_SIDE = 4096
UNKNOWN = "und"


@dataclass
class Network:
    """Per direction (first axis 2): input tables by byte and gate (reset,
    update, candidate), recurrent weights and the candidate's recurrent bias;
    output weights of both directions and output bias."""

    tables: np.ndarray  # (2, 3, 256, H)
    recurrent: np.ndarray  # (2, 3, H, H)
    bias: np.ndarray  # (2, H)
    out: np.ndarray  # (2, H, L)
    out_bias: np.ndarray  # (L,)
    langs: list[str]


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    np.multiply(x, np.float32(0.5), out=x)
    np.add(x, np.float32(0.5), out=x)
    return x


def states(net: Network, d: int, data: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of direction ``d`` (0 forwards, 1 backwards) over
    ``data`` (T, B) bytes; ``keep`` collects what the backward pass needs."""
    steps, width = data.shape
    h = np.zeros((width, net.bias.shape[1]), np.float32)
    out = np.empty((steps, *h.shape), np.float32)
    (tr, tz, tn), (ur, uz, un), b = net.tables[d], net.recurrent[d], net.bias[d]
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        x = data[t]
        r = sigmoid(tr.take(x, 0) + h @ ur)
        z = sigmoid(tz.take(x, 0) + h @ uz)
        a = h @ un + b
        n = a * r
        n += tn.take(x, 0)
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((t, h, r, z, a, n))
        h = n + z * (h - n)
        out[t] = h
    return out


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def positions(net: Network, data: np.ndarray) -> np.ndarray:
    """Log probabilities (T, B, L) of every position."""
    return log_softmax(states(net, 0, data) @ net.out[0] + states(net, 1, data) @ net.out[1] + net.out_bias)


def gradients(net: Network, data: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Cross entropy of all positions with mask 1, and its gradient, backwards through time."""
    kept: list[list] = [[], []]
    hs = [states(net, d, data, kept[d]) for d in (0, 1)]
    logp = log_softmax(hs[0] @ net.out[0] + hs[1] @ net.out[1] + net.out_bias)
    total = max(1.0, float(mask.sum()))
    right = np.eye(len(net.langs), dtype=np.float32)[labels]
    loss = -float((logp * right * mask[..., None]).sum()) / total
    dlogit = (np.exp(logp) - right) * (mask / np.float32(total))[..., None]
    g = {k: np.zeros_like(getattr(net, k)) for k in ("tables", "recurrent", "bias", "out", "out_bias")}
    g["out_bias"] = dlogit.sum((0, 1))
    for d in (0, 1):
        g["out"][d] = np.einsum("tbh,tbl->hl", hs[d], dlogit)
        dout = dlogit @ net.out[d].T
        ur, uz, un = net.recurrent[d]
        dh = np.zeros_like(dout[0])
        for t, h, r, z, a, n in reversed(kept[d]):
            dh = dh + dout[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            da = dn * r
            for gate, v in enumerate((dr, dz, dn)):
                np.add.at(g["tables"][d, gate], data[t], v)
            for gate, v in enumerate((dr, dz, da)):
                g["recurrent"][d, gate] += h.T @ v
            g["bias"][d] += da.sum(0)
            dh = dh * z + dr @ ur.T + dz @ uz.T + da @ un.T
    return loss, g


def pad(texts: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) bytes and mask of texts of at most ``steps`` bytes; padding is byte 0 at the end."""
    data = np.frombuffer(b"".join(t.ljust(steps, b"\0") for t in texts), np.uint8).reshape(-1, steps)
    mask = np.arange(steps) < np.array([len(t) for t in texts])[:, None]
    return np.ascontiguousarray(data.T), np.ascontiguousarray(mask.T.astype(np.float32))


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN) -> Network:
    """Adam over shuffled batches; the same samples give the same network."""
    rng = np.random.default_rng(SEED)
    samples = sorted(samples)
    langs = sorted({lang for _, lang in samples})
    size = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    net = Network(size(2, 3, 256, hidden), size(2, 3, hidden, hidden), np.zeros((2, hidden), np.float32),
                  size(2, hidden, len(langs)), np.zeros(len(langs), np.float32), langs)
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in ("tables", "recurrent", "bias", "out", "out_bias")}
                     for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            some = [samples[i] for i in order[at:at + BATCH]]
            data, mask = pad([t for t, _ in some], SEGMENT)
            _, g = gradients(net, data, mask, np.array([langs.index(lang) for _, lang in some]))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    return net


def pool(net: Network, texts: list[bytes]) -> np.ndarray:
    """Pooled probabilities (documents, L); every byte of every text is read."""
    sums = np.zeros((len(texts), len(net.langs)))
    parts, owner = [], []
    for i, t in enumerate(texts):
        for at in range(0, len(t), SEGMENT):
            parts.append(t[at:at + SEGMENT])
            owner.append(i)
    for at in range(0, len(parts), SIDE_BY_SIDE):
        data, mask = pad(parts[at:at + SIDE_BY_SIDE], SEGMENT)
        scores = np.einsum("tbl,tb->bl", positions(net, data), mask)
        np.add.at(sums, owner[at:at + SIDE_BY_SIDE], scores)
    sizes = np.maximum(1, np.array([len(t) for t in texts]))
    return np.exp(log_softmax(sums / sizes[:, None])) if len(texts) else sums


def training_rows(docs: DataFrame, usable: Column, text: str, lang: str, id_col: str) -> list[tuple[bytes, str]]:
    """The bounded sample: rows by a hash of the id, one window by another."""
    from functools import reduce

    rows = docs.where(usable & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()) \
        .select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(1)).alias("h"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return []
    # of the hash's upper 63 bits, so that a share is never rounded to nothing
    share = {name: min((1 << 63) - 1, int(1.5 * SAMPLE_PER_LANG / n * (1 << 63))) for name, n in counts.items()}
    chosen = reduce(lambda c, x: c.when(F.col("l") == x[0], F.lit(x[1]).cast("long")), share.items(), F.when(F.lit(False), F.lit(0).cast("long")))
    start = F.lit(1) + F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("t") - SEGMENT)).cast("int")
    window = F.substring(F.col("t"), start, F.lit(SEGMENT))
    some = rows.where(F.shiftrightunsigned("h", 1) <= chosen).select("l", "h", window.alias("t")).where(F.col("t").rlike(r"\p{L}")) \
        .orderBy("h").limit(2 * SAMPLE_PER_LANG * len(counts)).collect()
    taken: dict[str, int] = {}
    out: list[tuple[bytes, str]] = []
    for r in some:
        taken[r["l"]] = taken.get(r["l"], 0) + 1
        if taken[r["l"]] <= SAMPLE_PER_LANG:
            out.append((r["t"].encode()[:SEGMENT], r["l"]))
    return [x for x in out if x[0]]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
             keep: list[str] | None = None) -> DataFrame:
    """Train on the rows where ``usable`` holds and predict every row: ``row``
    (the columns ``keep``, all by default), ``lang_pred``, ``score``."""
    samples = training_rows(docs, usable, text, lang, id_col)
    rows = spread(rows_with_text(docs, text, keep, has_letter(F.col(f"`{text}`")).alias("has_letter")))
    row = rows.schema["row"].dataType.simpleString()
    net = train(samples) if samples else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                has = np.array(column_of(batch, "has_letter").to_pylist(), bool) & (net is not None)
                texts = [t for t, ok in zip(raw_texts(text_of(batch, text)), has, strict=True) if ok]
                names, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
                if texts:
                    p = pool(net, texts)
                    names[has] = np.array(net.langs, object)[p.argmax(1)]
                    scores[has] = p.max(1)
                yield pa.RecordBatch.from_arrays([column_of(batch, "row"), pa.array(names.tolist(), pa.string()),
                                                  pa.array(scores)], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"row {row}, lang_pred string, score double")
