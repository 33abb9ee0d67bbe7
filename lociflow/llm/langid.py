"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers of ``HIDDEN`` units (squashed by x / (1 + |x|), the
gates by its half plus a half) read a window of bytes forwards and backwards; their states give class probabilities at every byte, and a
document's probabilities are the mean over all bytes of its text.  Texts are read
whole, as windows of ``READ_BYTES`` bytes.

The network is trained in numpy by backpropagation through time with Adam, on
``STEPS`` batches of ``BATCH`` windows of ``TRAIN_BYTES`` bytes from at most
``TRAIN_EACH`` documents of each language (``WINDOWS`` windows of each, at
places given by a hash).  With a fixed seed and sample order it is reproducible.

Null texts and texts without a letter get ``und`` and score 0; so do all without
any labelled document.  Repeated rows are each labelled; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sampled_ids, with_texts
from .shared import free_name, without
from .textvec import mixed, slices

HIDDEN, TRAIN_BYTES, READ_BYTES, ROWS = 8, 48, 128, 1024
TRAIN_EACH, WINDOWS, BATCH, STEPS, RATE = 1000, 4, 384, 160, 0.03
UNKNOWN = "und"


def _squashed(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    x /= np.abs(x) + np.float32(1)
    return x


@dataclass
class Network:
    """wx: (2, 256, 3H) input tables; u: (2, H, 3H); v: (2H, L); c: (L,).  Gates in the order z, r, n."""

    labels: list[str]
    wx: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray

    def positions(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(t, probabilities (L, B)) at every position of windows x (T, B).

        States are (H, B), so every gate is a run of whole rows; the backward states
        are kept for all t, and the forward pass then gives the labels.
        """
        steps, b = x.shape
        h = HIDDEN
        wx = [np.ascontiguousarray(self.wx[d].T) for d in (0, 1)]
        ut = [np.ascontiguousarray(self.u[d].T) for d in (0, 1)]
        vt = [np.ascontiguousarray(self.v[d * h : (d + 1) * h].T) for d in (0, 1)]
        behind, half = np.empty((steps, h, b), np.float32), np.float32(0.5)

        def step(d: int, byte: np.ndarray, s: np.ndarray) -> np.ndarray:
            g = wx[d].take(byte, axis=1)
            k = ut[d] @ s
            a = g[: 2 * h]
            a += k[: 2 * h]
            _squashed(a)
            a *= half
            a += half
            n = k[2 * h :]
            n *= a[h:]
            n += g[2 * h :]
            _squashed(n)
            s = s - n
            s *= a[:h]
            s += n
            return s

        s = np.zeros((h, b), np.float32)
        for t in range(steps - 1, -1, -1):
            s = behind[t] = step(1, x[t], s)
        s = np.zeros((h, b), np.float32)
        for t in range(steps):
            s = step(0, x[t], s)
            o = vt[0] @ s
            o += vt[1] @ behind[t]
            o += self.c[:, None]
            np.exp(o, out=o)
            o /= o.sum(axis=0)
            yield t, o

    def pooled(self, column: pa.Array) -> np.ndarray:
        """Mean class probabilities (rows, L) over the bytes of each text; 0 for empty ones."""
        total = np.zeros((len(column), len(self.labels)))
        for at, data, offsets in slices(column):
            n = np.diff(offsets)
            per = -(-n // READ_BYTES)
            row = np.repeat(np.arange(len(n)), per)
            start = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * READ_BYTES
            length = np.minimum(READ_BYTES, offsets[1:][row] - start)
            padded = np.concatenate([data, np.zeros(READ_BYTES, np.uint8)])
            order = np.argsort(-length, kind="stable")
            for k in range(0, len(order), ROWS):
                part = order[k : k + ROWS]
                # backwards states must not start in padding, so windows of different lengths end together
                for size in np.unique(length[part]) if length[part[-1]] < READ_BYTES else [READ_BYTES]:
                    mine = part[length[part] == size]
                    x = padded[start[mine][None, :] + np.arange(size)[:, None]]
                    sums = np.zeros((len(self.labels), len(mine)), np.float32)
                    for _, p in self.positions(x):
                        sums += p
                    np.add.at(total, at + row[mine], sums.T)
            total[at : at + len(n)] /= np.maximum(n, 1)[:, None]
        return total


def _windows_of(docs: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Training windows (N, TRAIN_BYTES), and the label of each, in a fixed order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names = [], []
            for doc_id, text, label in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = (text or "").encode()
                if not data:
                    continue
                data = data * (-(-TRAIN_BYTES // len(data)))
                at = mixed(np.full(WINDOWS, doc_id, np.int64).view(np.uint64) * np.uint64(WINDOWS) + np.arange(WINDOWS, dtype=np.uint64)) % np.uint64(len(data) - TRAIN_BYTES + 1)
                out += [data[int(a) : int(a) + TRAIN_BYTES] for a in at]
                names += [label] * WINDOWS
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(names, pa.string())], names=["w", "label"])

    rows = sorted((r["label"], bytes(r["w"])) for r in docs.select("doc_id", "text", "label").mapInArrow(cut, "w binary, label string").collect())
    return np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(len(rows), TRAIN_BYTES), [label for label, _ in rows]


def fitted(x: np.ndarray, y: np.ndarray, labels: list[str], seed: int = 5) -> Network:
    """Train on windows x (N, T) with class numbers y."""
    rng = np.random.default_rng(seed)
    h, n_labels, steps = HIDDEN, len(labels), x.shape[1]
    p = {
        "wx": rng.normal(0, 0.3, (2, 256, 3 * h)),
        "u": rng.normal(0, 0.3, (2, h, 3 * h)),
        "v": rng.normal(0, 0.3, (2 * h, n_labels)),
        "c": np.zeros(n_labels),
    }
    p = {k: a.astype(np.float32) for k, a in p.items()}
    m1, m2 = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    by_class = [np.flatnonzero(y == k) for k in range(n_labels)]
    for it in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(c, max(1, BATCH // n_labels)) for c in by_class])
        b, target = len(rows), y[rows]
        xs = x[rows].T
        both = np.stack([xs, xs[::-1]])  # (2, T, B): the second layer reads backwards
        s = np.zeros((2, b, h), np.float32)
        seen = []
        for t in range(steps):
            g = np.stack([p["wx"][d][both[d, t]] for d in (0, 1)])
            k = s @ p["u"]
            zr = 0.5 * _squashed(g[..., : 2 * h] + k[..., : 2 * h]) + np.float32(0.5)
            z, r = zr[..., :h], zr[..., h:]
            n = _squashed(g[..., 2 * h :] + r * k[..., 2 * h :])
            new = n + z * (s - n)
            seen.append((s, z, r, n, k[..., 2 * h :]))
            s = new
            seen[-1] += (new,)
        forward = np.stack([q[5][0] for q in seen])
        backward = np.stack([q[5][1] for q in seen])[::-1]
        state = np.concatenate([forward, backward], axis=2)
        o = state @ p["v"] + p["c"]
        o = np.exp(o - o.max(axis=2, keepdims=True))
        o /= o.sum(axis=2, keepdims=True)
        o[:, np.arange(b), target] -= 1
        o /= steps * b
        grad = {"v": np.tensordot(state, o, axes=([0, 1], [0, 1])), "c": o.sum(axis=(0, 1)), "u": np.zeros_like(p["u"]), "wx": np.zeros_like(p["wx"])}
        ds_out = o @ p["v"].T
        ds_each = np.stack([ds_out[..., :h], ds_out[::-1, :, h:]])
        ds = np.zeros((2, b, h), np.float32)
        for t in range(steps - 1, -1, -1):
            s, z, r, n, kn, _ = seen[t]
            ds = ds + ds_each[:, t]
            dn = ds * (1 - z) * (1 - np.abs(n)) ** 2
            dz = ds * (s - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dn * kn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            dg = np.concatenate([dz, dr, dn], axis=2)
            dk = np.concatenate([dz, dr, dn * r], axis=2)
            for d in (0, 1):
                np.add.at(grad["wx"][d], both[d, t], dg[d])
            grad["u"] += s.transpose(0, 2, 1) @ dk
            ds = ds * z + dk @ p["u"].transpose(0, 2, 1)
        norm = np.sqrt(sum(float((a * a).sum()) for a in grad.values()))
        rate = RATE * min(1.0, 2.0 * (1 - (it - 1) / STEPS))
        for key, a in grad.items():
            a = a * min(1.0, 1.0 / max(norm, 1e-9))
            m1[key] = 0.9 * m1[key] + 0.1 * a
            m2[key] = 0.99 * m2[key] + 0.01 * a * a
            p[key] = p[key] - (rate * (m1[key] / (1 - 0.9**it)) / (np.sqrt(m2[key] / (1 - 0.99**it)) + 1e-8)).astype(np.float32)
    return Network(labels, **p)


def trained(docs: DataFrame, learn_from: DataFrame) -> Network | None:
    """A network from docs (doc_id, text) and learn_from (doc_id, lang)."""
    x, names = _windows_of(with_texts(docs, sampled_ids(learn_from, F.col("lang"), TRAIN_EACH)))
    labels = sorted(set(names))
    return fitted(x, np.array([labels.index(n) for n in names]), labels) if labels else None


def labelled(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs with lang_pred and score columns, in the place of columns of these names."""
    docs = without(docs, "lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(network)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.withColumn(free_name(docs, "has_letter"), has_letter)
    at = docs.columns.index("text")
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            known = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            names, best = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if net:
                probabilities = net.pooled(batch.column(at))
                top = probabilities.argmax(axis=1)
                names[known] = np.array(net.labels, object)[top[known]]
                best[known] = np.clip(probabilities.max(axis=1)[known], 0, 1)
            columns = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(label, schema)
