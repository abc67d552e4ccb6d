"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltide.llm.blocks import text_blocks

UNKNOWN = "und"
WINDOW = 96  # bytes that the network reads from a zero state; a text's windows cover all of it
LANES = 1024  # windows read side by side
HIDDEN = 12


class ByteGru:
    """Per direction h' = n + z (h - n), z = s(Wz[x] + Uz h), r = s(Wr[x] + Ur h), n = tanh(Wn[x] + r (Un h)); labels
    are softmax(V [forward h, backward h] + c) at every byte. Sigmoids are written as tanh."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.w = {}
        for d in "fb":
            self.w["W" + d] = draw(256, 3 * hidden, scale=0.3)
            self.w["U" + d] = draw(3 * hidden, hidden, scale=1 / np.sqrt(hidden))
        self.w["V"] = draw(n_labels, 2 * hidden, scale=1 / np.sqrt(2 * hidden))
        self.w["c"] = np.zeros((n_labels, 1), np.float32)

    def states(self, x: np.ndarray, d: str, keep: dict | None = None) -> np.ndarray:
        """Hidden states (steps, hidden, lanes) for bytes x (steps, lanes), in the order read."""
        k, (steps, lanes) = self.hidden, x.shape
        table, u = np.ascontiguousarray(self.w["W" + d].T), self.w["U" + d]
        h = np.zeros((k, lanes), np.float32)
        out = np.empty((steps, k, lanes), np.float32)
        g = np.empty((3 * k, lanes), np.float32)
        for t in range(steps):
            a = table[:, x[t]]
            np.matmul(u, h, out=g)
            zr = a[: 2 * k]
            zr += g[: 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r, n = zr[:k], zr[k:], a[2 * k :]
            n += r * g[2 * k :]
            np.tanh(n, out=n)
            if keep is not None:
                keep["gates"][t], keep["un"][t] = a, g[2 * k :]
            h = n + z * (h - n)
            out[t] = h
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(steps, labels, lanes) for bytes x (steps, lanes), without keeping the states."""
        k, (steps, lanes) = self.hidden, x.shape
        out = np.empty((steps, len(self.w["V"]), lanes), np.float32)
        out[:] = self.w["c"]
        a, g = (np.empty((3 * k, lanes), np.float32) for _ in range(2))
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            half = np.repeat([0.5, 0.5, 1.0], k).astype(np.float32)[:, None]  # sigmoid(v) is (1 + tanh(v / 2)) / 2
            table, u = np.ascontiguousarray(self.w["W" + d].T * half), self.w["U" + d] * half
            v = np.ascontiguousarray(self.w["V"][:, :k] if d == "f" else self.w["V"][:, k:])
            h = np.zeros((k, lanes), np.float32)
            zr, z, r, n = a[: 2 * k], a[:k], a[k : 2 * k], a[2 * k :]
            for t in order:
                np.take(table, x[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=g)
                zr += g[: 2 * k]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                r *= g[2 * k :]
                n += r
                np.tanh(n, out=n)
                h -= n
                h *= z
                h += n
                out[t] += v @ h
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the labels y (lanes) over real bytes (steps, lanes), and its gradients by
        backpropagation through time."""
        k, (steps, lanes) = self.hidden, x.shape
        v = self.w["V"]
        kept, hs = {}, {}
        for d, seq in (("f", x), ("b", x[::-1])):
            kept[d] = {"gates": np.empty((steps, 3 * k, lanes), np.float32), "un": np.empty((steps, k, lanes), np.float32)}
            hs[d] = self.states(seq, d, kept[d])
        h = np.concatenate([hs["f"], hs["b"][::-1]], axis=1)
        o = np.einsum("lk,tkn->tln", v, h) + self.w["c"]
        o -= o.max(axis=1, keepdims=True)
        p = np.exp(o)
        p /= p.sum(axis=1, keepdims=True)
        weight = real / real.sum()
        loss = float(-(np.log(np.take_along_axis(p, np.broadcast_to(y, (steps, 1, lanes)), 1)[:, 0] + 1e-9) * weight).sum())
        np.put_along_axis(p, np.broadcast_to(y, (steps, 1, lanes)), np.take_along_axis(p, np.broadcast_to(y, (steps, 1, lanes)), 1) - 1, 1)
        do = p * weight[:, None]
        g = {"V": np.einsum("tln,tkn->lk", do, h), "c": do.sum(axis=(0, 2))[:, None]}
        dh_all = np.einsum("lk,tln->tkn", v, do)
        for d, seq, outer in (("f", x, dh_all[:, :k]), ("b", x[::-1], dh_all[::-1, k:])):
            u = self.w["U" + d]
            gu = np.zeros_like(u)
            ga = np.empty((steps, 3 * k, lanes), np.float32)
            later = np.zeros((k, lanes), np.float32)
            for t in range(steps - 1, -1, -1):
                z, r, n = (kept[d]["gates"][t, i * k : (i + 1) * k] for i in range(3))
                un = kept[d]["un"][t]
                before = hs[d][t - 1] if t else np.zeros_like(later)
                dh = outer[t] + later
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                ga[t] = np.concatenate([dz, dr, dn])
                through = np.concatenate([dz, dr, dn * r])
                gu += through @ before.T
                later = u.T @ through + dh * z
            gw = np.zeros((256, 3 * k), np.float32)
            np.add.at(gw, seq.reshape(-1), ga.transpose(0, 2, 1).reshape(-1, 3 * k))
            g["W" + d], g["U" + d] = gw, gu
        return loss, g


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts as rows of WINDOW bytes, the last of a text filled with zeros, and each row's text."""
    data = [t.encode() for t in texts]
    n = np.array([-(-len(d) // WINDOW) for d in data], np.int64)
    out = np.zeros((int(n.sum()), WINDOW), np.uint8)
    flat, at = out.reshape(-1), 0
    for d, k in zip(data, n):
        flat[at : at + len(d)] = np.frombuffer(d, np.uint8)
        at += int(k) * WINDOW
    return out, np.repeat(np.arange(len(texts)), n)


def fit(texts: list[str], labels: list[str], steps: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 0) -> tuple[ByteGru, list[str]]:
    """A network for the labels of the texts, by Adam on random windows, as many of each label."""
    names = sorted(set(labels))
    rows, text = windows(texts)
    y = np.array([names.index(x) for x in labels], np.int64)[text]
    net = ByteGru(len(names), seed=seed)
    rng = np.random.default_rng(seed)
    of = [np.flatnonzero(y == k) for k in range(len(names))]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    s = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(o, -(-batch // len(names))) for o in of if len(o)])
        x = rows[pick].T
        _, g = net.gradients(x, y[pick], (x > 0).astype(np.float32))
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 1 / (norm + 1e-9))
            m[k] += 0.1 * (v - m[k])
            s[k] += 0.01 * (v * v - s[k])
            net.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net, names


def pooled(net: ByteGru, texts: list[str]) -> np.ndarray:
    """(texts, labels): softmax of the mean of each text's log probabilities over its bytes, scaled by 8. Every byte of
    every text is labelled; windows without text don't exist, a text without bytes gets equal shares."""
    rows, text = windows(texts)
    total = np.zeros((len(texts), len(net.w["V"])))
    size = np.zeros(len(texts))
    for i in range(0, len(rows), LANES):
        x = np.ascontiguousarray(rows[i : i + LANES].T)
        o = net.logits(x)
        o -= o.max(axis=1, keepdims=True)
        o -= np.log(np.exp(o).sum(axis=1, keepdims=True))
        real = x > 0
        of = text[i : i + LANES]
        o *= real[:, None]
        for k, sums in enumerate(o.sum(axis=0)):
            total[:, k] += np.bincount(of, sums, len(texts))
        size += np.bincount(of, real.sum(axis=0), len(texts))
    mean = 8 * total / np.maximum(size, 1)[:, None]
    e = np.exp(mean - mean.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def position_labels(net: ByteGru, names: list[str], text: str) -> list[str]:
    """The label of each byte of a text."""
    rows, _ = windows([text])
    best = net.logits(np.ascontiguousarray(rows.T)).argmax(axis=1).T.reshape(-1) if len(rows) else []
    return [names[k] for k in best[: len(text.encode())]]


def training_rows(texts: DataFrame, rows_a_language: int = 400, max_chars: int = 20_000) -> list[tuple[str, str]]:
    """(text, lang) of at most rows_a_language different texts of each language, those with the least hashes.

    The bound of the sample is rows_a_language times the languages; of a longer text, a window of max_chars code points
    from a hashed place is learned from. Only text and lang are read. The rows of each language are counted first, and
    only texts with a hash among the first 3 rows_a_language of so many evenly spread ones leave their task; copies of
    a text are folded before the shuffle."""
    d = texts.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * rows_a_language / n))])
    d = d.withColumn("_h", F.xxhash64("text"))
    d = d.where(F.col("_h") / 2.0**64 + 0.5 <= share[F.col("lang")])
    d = d.withColumn("_at", F.when(F.length("text") > max_chars, F.pmod(F.col("_h"), F.length("text") - max_chars)).otherwise(0).cast("int"))
    d = d.select("lang", "_h", F.substr("text", F.col("_at") + 1, F.lit(max_chars)).alias("text"))
    d = d.groupBy("lang", "_h").agg(F.first("text").alias("text"))
    w = Window.partitionBy("lang").orderBy("_h")
    d = d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= rows_a_language)
    return sorted((r["text"], r["lang"]) for r in d.select("text", "lang").collect())


def identify_languages(texts: DataFrame, learn_from: DataFrame, rows_a_language: int = 400, with_text: bool = False) -> DataFrame:
    """Predicted language of whole texts.

    General: the project has no records in languages. texts: text_id, text; learn_from: text, lang. Other columns are
    not read, so that only the text decides. Returns text_id, lang_pred and score, the pooled probability (0 to 1), and the
    text if asked for.

    The network learns on the driver from a bounded sample (training_rows); it labels each byte of each text in tasks,
    and the log probabilities of a text's bytes are pooled. A NULL text or one without letters is `und` with score 0,
    as is everything where nothing can be learned. Repeated rows and equal or NULL ids give a row each; empty in, empty
    out."""
    sample = training_rows(learn_from, rows_a_language)
    net, names = fit([t for t, _ in sample], [x for _, x in sample]) if sample else (None, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, got in text_blocks(batches, "text", 2_000_000):
            lettered = b.column(2).to_pylist()
            use = [k for k, x in enumerate(lettered) if x] if net else []
            label, score = np.full(len(got), UNKNOWN, object), np.zeros(len(got))
            if use:
                p = pooled(net, [got[k] for k in use])
                label[use], score[use] = np.array(names, object)[p.argmax(axis=1)], p.max(axis=1)
            own = [b.column(1)] if with_text else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(label.tolist(), pa.string()), pa.array(score), *own], ["text_id", "lang_pred", "score", *["text"] * with_text])

    d = texts.select("text_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return d.mapInArrow(run, f"text_id {dict(d.dtypes)['text_id']}, lang_pred string, score double" + ", text string" * with_text)
