"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads each word (of a very long one, pieces) in both directions, labels every byte position with a distribution over
languages, and a document's probabilities pool those of all its positions. Equal words of a batch of texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WordHasher, text_slices

#: Bytes of one read; longer words are read in pieces.
PIECE = 24
#: Parts in which a language's least hashes are sought before they meet.
SALTS = 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiGru:
    """Two gated recurrent layers of ``hidden`` units over one-hot bytes and a softmax at every position."""

    def __init__(self, languages: list[str], hidden: int = 16, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        f = lambda *s, scale=0.2: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {f"{n}{d}": v for d in "fb" for n, v in (("x", f(257, 3 * hidden)), ("u", f(hidden, 3 * hidden)), ("c", f(3 * hidden, scale=0.01)))}
        self.p |= {"o": f(2 * hidden, len(languages)), "ob": np.zeros(len(languages), np.float32)}

    def _direction(self, codes: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (T, B, H) of one direction over codes (B, T); code 256 is padding and leaves the state as it is."""
        h_size = self.hidden
        x, u, c = self.p["x" + d], self.p["u" + d], self.p["c" + d]
        b, t_size = codes.shape
        h, out = np.zeros((b, h_size), np.float32), np.zeros((t_size, b, h_size), np.float32)
        for t in range(t_size) if d == "f" else range(t_size - 1, -1, -1):
            a, g = x[codes[:, t]] + c, h @ u
            zr = _sigmoid(a[:, : 2 * h_size] + g[:, : 2 * h_size])
            z, r = zr[:, :h_size], zr[:, h_size:]
            n = np.tanh(a[:, 2 * h_size :] + r * g[:, 2 * h_size :])
            live = (codes[:, t] != 256)[:, None]
            new = np.where(live, n + z * (h - n), h)
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * h_size :], live))
            h = out[t] = new
        return out

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """(T, B, L)"""
        h = self.hidden
        return self._direction(codes, "f", None) @ self.p["o"][:h] + self._direction(codes, "b", None) @ self.p["o"][h:] + self.p["ob"]

    def _backward(self, codes: np.ndarray, d: str, steps: list, d_out: np.ndarray, grad: dict) -> None:
        h_size, u = self.hidden, self.p["u" + d]
        d_h = np.zeros_like(d_out[0])
        for t, h, z, r, n, gn, live in reversed(steps):
            d_new = d_h + d_out[t]
            d_live = np.where(live, d_new, 0)
            d_n = d_live * (1 - z) * (1 - n * n)
            d_z = d_live * (h - n) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_n], axis=1)
            d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
            grad["u" + d] += h.T @ d_g
            grad["c" + d] += d_a.sum(0)
            np.add.at(grad["x" + d], codes[:, t], d_a)
            d_h = np.where(live, d_new * z, d_new) + d_g @ u.T

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean loss over live positions and its gradients, back through time in both directions."""
        h = self.hidden
        steps: dict[str, list] = {"f": [], "b": []}
        states = {d: self._direction(codes, d, steps[d]) for d in "fb"}
        logits = states["f"] @ self.p["o"][:h] + states["b"] @ self.p["o"][h:] + self.p["ob"]
        logits = logits - logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        live = (codes.T != 256)[:, :, None]
        t, b = codes.T.shape
        count = max(1, int(live.sum()))
        picked = prob[np.arange(t)[:, None], np.arange(b)[None, :], labels[None, :]]
        loss = float(-(np.log(np.maximum(picked, 1e-9)) * live[:, :, 0]).sum() / count)
        delta = prob
        delta[np.arange(t)[:, None], np.arange(b)[None, :], labels[None, :]] -= 1
        delta = np.where(live, delta, 0) / count
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = delta.reshape(-1, delta.shape[-1])
        for i, d in enumerate("fb"):
            grad["o"][i * h : (i + 1) * h] = states[d].reshape(-1, h).T @ flat
        grad["ob"] = flat.sum(0)
        for i, d in enumerate("fb"):
            self._backward(codes, d, steps[d], delta @ self.p["o"][i * h : (i + 1) * h].T, grad)
        return loss, grad

    def fit(self, codes: np.ndarray, labels: np.ndarray, steps: int = 350, batch: int = 384, rate: float = 0.01, seed: int = 2) -> None:
        """Adam over random batches of words; every language is drawn alike often."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(g, max(1, batch // len(groups))) for g in groups if len(g)])
            own = codes[rows]
            own = own[:, : max(1, int((own != 256).sum(1).max()))]
            _, grad = self.gradients(own, labels[rows])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, end) of the pieces of at most PIECE bytes."""
    count = -(-(end - start) // PIECE)
    word = np.repeat(np.arange(len(start)), count)
    first = start[word] + (np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)) * PIECE
    return word, first, np.minimum(first + PIECE, end[word])


def codes_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    place = start[:, None] + np.arange(width)[None, :]
    return np.where(place < end[:, None], raw[np.minimum(place, max(0, len(raw) - 1))].astype(np.int64), 256)


def pooled(model: BiGru, raw: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(sums of log probabilities, sums of probabilities) over all positions of each text, and so (n, L) each; the last column counts positions."""
    n, l_size = len(offsets) - 1, len(model.languages)
    rows, hashed, start, end = hasher.words(raw, offsets, lower=False)
    if not len(rows):
        return np.zeros((n, l_size)), np.zeros((n, l_size + 1))
    _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
    word, p_start, p_end = pieces(start[first], end[first])
    logs, probs = np.zeros((len(first), l_size)), np.zeros((len(first), l_size + 1))
    size = p_end - p_start
    for width in np.unique(size):
        own = np.flatnonzero(size == width)
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            z = model.logits(codes_of(raw, p_start[part], p_end[part], int(width)))
            z = z - z.max(-1, keepdims=True)
            e = np.exp(z)
            total = e.sum(-1, keepdims=True)
            np.add.at(logs, word[part], (z - np.log(total)).sum(0))
            np.add.at(probs, word[part], np.concatenate([(e / total).sum(0), np.full((len(part), 1), width)], axis=1))
    key = rows * np.int64(len(first)) + which
    pair, times = np.unique(key, return_counts=True)
    out = []
    for values in (logs, probs):
        each = values[pair % len(first)] * times[:, None]
        out.append(np.stack([np.bincount(pair // len(first), weights=each[:, j], minlength=n) for j in range(each.shape[1])], axis=1))
    return out[0], out[1]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list:
    """(lang, text) of the per_language labelled documents of least hash of each language, none of them held out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    ids = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.pmod(F.hash(id_col), F.lit(SALTS)).alias("salt"))
    for keys in (["lang", "salt"], ["lang"]):  # so a language's last task reads SALTS * per_language rows, whatever the input
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
        ids = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    ids = ids.select(F.col("id").alias(id_col)).distinct()
    chosen = labelled.join(F.broadcast(ids), id_col, "left_semi")  # at most per_language ids a language
    return sorted((r[0], r[1]) for r in chosen.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).collect())


def train(sample: list, words_per_text: int = 60, hidden: int = 16, steps: int = 350, seed: int = 4) -> BiGru | None:
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    rng, hasher = np.random.default_rng(seed), WordHasher()
    codes, labels = [], []
    for lang, text in sample:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        _, _, start, end = hasher.words(raw, np.array([0, len(raw)]), lower=False)
        _, p_start, p_end = pieces(start, end)
        if len(p_start):
            own = rng.choice(len(p_start), min(words_per_text, len(p_start)), replace=False)
            codes.append(codes_of(raw, p_start[own], p_end[own], PIECE))
            labels.append(np.full(len(own), languages.index(lang)))
    model = BiGru(languages, hidden)
    if codes:
        model.fit(np.concatenate(codes), np.concatenate(labels), steps=steps)
    return model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, steps: int = 350) -> DataFrame:
    """(id, held_out, lang_pred, score): the language of each whole text.

    Trained on at most per_language documents of each language whose crc32(id as text) mod 4 is not 2; only bytes of the text are read for
    a prediction. ``und`` with score 0 if the text is null or has no letter, or nothing could be learned. Score is the mean probability
    of the prediction over all positions. Rows come back one for one, repeated ids too; a null id is neither held out nor learned from.
    An empty table gives an empty result; further columns play no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(training_sample(docs, id_col, text_col, lang_col, per_language), steps=steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, hasher = model.value, WordHasher()
        for batch in batches:
            texts = batch.column(1)
            for first, raw, offsets in text_slices(texts, 1 << 20):
                n = len(offsets) - 1
                letters = np.concatenate([[0], np.cumsum((raw | 32) - np.uint8(97) < 26)])
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~has):
                    has[i] = any(c.isalpha() for c in texts[first + int(i)].as_py() or "")
                names, scores = np.full(n, "und", object), np.zeros(n)
                if net is not None and has.any():
                    logs, probs = pooled(net, raw, offsets, hasher)
                    best = logs.argmax(1)
                    names = np.where(has, np.array(net.languages, object)[best], "und")
                    scores = np.where(has, probs[np.arange(n), best] / np.maximum(probs[:, -1], 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(list(names), pa.string()), pa.array(np.clip(scores, 0, 1))], ["id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    return own.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
