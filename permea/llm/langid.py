"""Language of a document from a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in consecutive windows of
``WINDOW`` bytes, each both ways, and gives every byte position a distribution
over the languages; a document's distribution is the mean over all of its
positions.  It is trained here, in numpy, by backpropagation through time and
Adam, on windows drawn from a bounded sample of labelled rows
(``per_language`` distinct texts of every language).
The weights (some thousand numbers) go to the tasks; every whole text is read.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0; a
language value that is NULL teaches nothing; without any labelled text every
prediction is ``und``; a single language is always predicted.  Every row gives
one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permea.llm.common import hash_mod, slices, some_bound, utf8

WINDOW = 128
HIDDEN = 8
LETTER = regex.compile(r"\p{L}")
BATCH = 2048


def init(languages: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def weights(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    out = {}
    for d in "fb":  # forward, backward
        for g in "rzn":  # reset, update, candidate
            out[f"{d}x{g}"] = weights(256, hidden, scale=0.3)
            out[f"{d}u{g}"] = weights(hidden, hidden, scale=hidden**-0.5)
        out[f"{d}o"] = weights(hidden, languages, scale=hidden**-0.5)
    out["o"] = np.zeros(languages, np.float32)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict[str, np.ndarray], d: str, steps: np.ndarray, live: np.ndarray | None, keep: bool = False):
    """Hidden states (T, B, H) of one direction over ``steps`` (T, B) bytes; where
    ``live`` is 0 the state stays."""
    t_max, b = steps.shape
    hidden = p[d + "ur"].shape[0]
    states, kept = np.zeros((t_max, b, hidden), np.float32), []
    h = np.zeros((b, hidden), np.float32)
    order = range(t_max) if d == "f" else range(t_max - 1, -1, -1)
    xr, xz, xn, ur, uz, un = (p[d + k] for k in ("xr", "xz", "xn", "ur", "uz", "un"))
    for t in order:
        x = steps[t]
        r = _sigmoid(xr[x] + h @ ur)
        z = _sigmoid(xz[x] + h @ uz)
        m = h @ un
        n = np.tanh(xn[x] + r * m)
        new = n + z * (h - n)
        if live is not None:
            new = np.where(live[t], new, h)
        if keep:
            kept.append((t, h, r, z, m, n))
        h = new
        states[t] = h
    return states, kept


def backward(p: dict[str, np.ndarray], d: str, steps: np.ndarray, live: np.ndarray, kept: list, dstates: np.ndarray,
             grads: dict[str, np.ndarray]) -> None:
    """Backpropagation through time of one direction."""
    ur, uz, un = (p[d + k] for k in ("ur", "uz", "un"))
    g = {k: np.zeros_like(p[d + k]) for k in ("xr", "xz", "xn", "ur", "uz", "un")}
    dh = np.zeros_like(dstates[0])
    for t, h, r, z, m, n in reversed(kept):
        dh = dh + dstates[t]
        on = live[t]
        dnew = np.where(on, dh, 0)
        dn = dnew * (1 - z) * (1 - n * n)
        dz = dnew * (h - n) * z * (1 - z)
        dr = dn * m * r * (1 - r)
        dm = dn * r
        x = steps[t]
        for k, v in (("xr", dr), ("xz", dz), ("xn", dn)):
            np.add.at(g[k], x, v)
        g["ur"] += h.T @ dr
        g["uz"] += h.T @ dz
        g["un"] += h.T @ dm
        dh = np.where(on, 0, dh) + dnew * z + dr @ ur.T + dz @ uz.T + dm @ un.T
    for k, v in g.items():
        grads[d + k] = v


def read(p: dict[str, np.ndarray], d: str, steps: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    """The states of :func:`forward` without what training keeps, in place."""
    (t_max, b), hidden = steps.shape, p[d + "ur"].shape[0]
    states = np.empty((t_max, b, hidden), np.float32)
    half = np.float32(0.5)
    xr, xz, ur, uz = (p[d + k] * half for k in ("xr", "xz", "ur", "uz"))  # a sigmoid is half a tanh
    xn, un = p[d + "xn"], p[d + "un"]
    h = np.zeros((b, hidden), np.float32)
    r, z, n, m = (np.empty((b, hidden), np.float32) for _ in range(4))
    for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
        x = steps[t]
        np.matmul(h, ur, out=r)
        np.matmul(h, uz, out=z)
        np.matmul(h, un, out=m)
        for gate, table in ((r, xr), (z, xz)):
            np.take(table, x, axis=0, out=n, mode="clip")
            gate += n
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
        np.take(xn, x, axis=0, out=n, mode="clip")
        m *= r
        n += m
        np.tanh(n, out=n)
        new = states[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        if live is not None:
            np.copyto(new, h, where=~live[t])
        h = new
    return states


def position_probabilities(p: dict[str, np.ndarray], steps: np.ndarray, live: np.ndarray | None):
    """Distribution over the languages at each position (T, B, languages)."""
    shape, hidden = steps.shape, p["fo"].shape[0]
    logits = read(p, "f", steps, live).reshape(-1, hidden) @ p["fo"]
    logits += read(p, "b", steps, live).reshape(-1, hidden) @ p["bo"]
    logits += p["o"] - np.abs(p["o"]).max()
    np.clip(logits, -60, 60, out=logits)
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], np.float32))[:, None]
    return logits.reshape(*shape, -1)


def train(windows: list[bytes], labels: np.ndarray, languages: int, hidden: int = HIDDEN, steps: int = 500,
          batch: int = 192, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Fits the network to label every position of the windows."""
    rng = np.random.default_rng(seed)
    p = init(languages, hidden, rng)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    longest = max(map(len, windows))
    data = np.zeros((longest, len(windows)), np.uint8)
    sizes = np.array([len(w) for w in windows])
    for i, w in enumerate(windows):
        data[:len(w), i] = np.frombuffer(w, np.uint8)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        x, y = data[:, pick], labels[pick]
        live = (np.arange(longest)[:, None] < sizes[pick])[:, :, None]
        hf, kf = forward(p, "f", x, live, True)
        hb, kb = forward(p, "b", x, live, True)
        logits = hf @ p["fo"] + hb @ p["bo"] + p["o"]
        logits -= logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        err = prob
        err[:, np.arange(batch), y] -= 1
        err *= live / live.sum()
        grads = {"o": err.sum((0, 1)), "fo": np.einsum("tbh,tbl->hl", hf, err), "bo": np.einsum("tbh,tbl->hl", hb, err)}
        backward(p, "f", x, live, kf, err @ p["fo"].T, grads)
        backward(p, "b", x, live, kb, err @ p["bo"].T, grads)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.01 * (g * g - s[k])
            p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def document_probabilities(p: dict[str, np.ndarray], raw: np.ndarray, off: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mean distribution over all byte positions of each text (n, languages)."""
    sizes = np.diff(off)
    out = np.zeros((len(sizes), len(p["o"])))
    full = sizes // window
    owner = np.repeat(np.arange(len(sizes)), full)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    starts = off[:-1][owner] + nth * window
    for a in range(0, len(owner), BATCH):
        at = starts[a:a + BATCH]
        steps = raw[at + np.arange(window)[:, None]]
        prob = position_probabilities(p, steps, None).sum(0, dtype=np.float64)
        np.add.at(out, owner[a:a + BATCH], prob)
    rest = np.flatnonzero(sizes % window)
    rest = rest[np.argsort(sizes[rest] % window, kind="stable")]  # alike lengths together
    for a in range(0, len(rest), BATCH // 4):
        at = rest[a:a + BATCH // 4]
        n = sizes[at] % window
        begin = off[:-1][at] + full[at] * window
        where = begin + np.arange(n.max())[:, None]
        live = np.arange(n.max())[:, None] < n
        steps = raw[np.where(live, where, begin)]
        prob = position_probabilities(p, steps, live[:, :, None])
        out[at] += np.where(live[:, :, None], prob, 0).sum(0, dtype=np.float64)
    return out / np.maximum(sizes, 1)[:, None]


def sample_windows(docs: DataFrame, learn: F.Column, per_language: int, per_document: int, window: int, max_languages: int | None = None,
                   text_col: str = "text", lang_col: str = "lang", seed: int = 11):
    """Windows (bytes) of a bounded sample: ``per_language`` distinct texts of each language
    value (all, or the ``max_languages`` with most rows), ``per_document`` windows of each."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)) \
        .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text", F.lit(seed)))
    # The hash share is of distinct texts, as copies share one key and count once.
    top = rows.groupBy("lang", "key").count().groupBy("lang").agg(F.sum("count").alias("n"), F.count("*").alias("texts")) \
        .orderBy(F.desc("n"), "lang")
    counts = {r["lang"]: r["texts"] for r in (top.limit(max_languages) if max_languages else top).collect()}
    names = sorted(counts)
    body = F.col("text").cast("binary")
    room = F.greatest(F.lit(1), F.octet_length(body) - window + 2)
    cuts = [F.substring(body, F.pmod(F.xxhash64("key", F.lit(j)), room).cast("int") + (0 if j < 0 else 1), window)
            for j in range(per_document)]
    # A quarter of the windows is short, as the ends of texts are.
    cuts[-1] = F.substring(cuts[-1], F.lit(1), (F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(window)) + 1).cast("int"))
    bounds = docs.sparkSession.createDataFrame([(k, x, some_bound(per_language, counts[x])) for k, x in enumerate(names)],
                                               "label int, lang string, bound long")
    picked = rows.join(F.broadcast(bounds), "lang").filter(F.col("key") <= F.col("bound"))
    # Windows, not texts, are sorted and sent; copies of a text count once.
    drawn = picked.select("label", "key", F.array(*cuts).alias("w")).groupBy("label", "key").agg(F.first("w").alias("w"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("key"))  # of about twice ``per_language`` rows
    windows, labels = [], []
    for row in drawn.withColumn("nth", nth).filter(F.col("nth") <= per_language).orderBy("label", "key").select("label", "w").collect():
        for w in row.w:
            if len(w):
                windows.append(bytes(w))
                labels.append(row.label)
    return names, windows, np.array(labels, np.int64)


def predict_language(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", per_language: int = 1500, per_document: int = 4, max_languages: int | None = None,
                     train_window: int = 64, hidden: int = HIDDEN, steps: int = 500) -> DataFrame:
    """doc_id, lang_pred, score, probs (map of language to probability)."""
    names, windows, labels = sample_windows(docs, learn, per_language, per_document, train_window, max_languages,
                                            text_col, lang_col)
    model = train(windows, labels, len(names), hidden, steps) if windows else None
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                known = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if model is not None:
                    raw, off = utf8(texts)
                    prob = document_probabilities(model, raw, off)
                    best = prob.argmax(1)
                    pred[known] = np.array(names, object)[best[known]]
                    score[known] = np.clip(prob.max(1)[known], 0, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)],
                                                 ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def op7_bigru_langid(spark, sf_dir: str) -> DataFrame:
    from permea.llm.common import table
    docs = table(spark, sf_dir, "documents")
    rest = hash_mod("doc_id")
    out = predict_language(docs, F.coalesce(rest != 0, F.lit(True)))
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
