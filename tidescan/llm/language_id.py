"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows. The weights are fitted by follow-the-regularised-leader with elastic-net
penalties on about `most` training rows of each language, drawn by a hash; a fifth of them sets the temperature that calibrates
the probabilities. A prediction sees the text alone, and all of it.

Edges: `und` with score 0 for a null text or one without a letter, and for all if there is nothing to learn from; null ids count as
training rows of no language if their language is null; repeated rows get equal results; no rows give no rows.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidescan.llm.features import counts, crc, document_frequencies, idf_of, sample, weights

ORDERS, BITS = (1, 2, 3), 15
#: Training rows of each language.
MOST = 600
_LETTER = re.compile(r"[^\W\d_]")


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates for a softmax over k classes."""

    def __init__(self, size: int, k: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001):
        self.z, self.n = np.zeros((size, k)), np.zeros((size, k))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss."""
    best = min(np.exp(np.linspace(-3, 3, 121)), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean())
    return float(best)


def _features(batches):
    """Sparse counts of the sample's texts."""
    for b in batches:
        rows = [(lang, *(x.astype(np.int32).tobytes() for x in counts((t or "").lower(), ORDERS, BITS))) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["lang", "at", "n"])


def train(train_rows: DataFrame, text_col: str, lang_col: str, keys: list[str], most: int = MOST, epochs: int = 4) -> dict | None:
    """The model: languages, idf, weights (with temperature applied); None without a language."""
    rows = train_rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).where("lang IS NOT NULL")
    df, total = document_frequencies(rows.select("text"), ORDERS, BITS, True)
    if not total:
        return None
    idf = idf_of(df, total)
    got = sample(rows, "lang", most, [f"k{i}" for i in range(len(keys))]).select("text", "lang").mapInArrow(_features, "lang string, at binary, n binary").collect()
    data = [(r["lang"], at := np.frombuffer(r["at"], np.int32), weights(at, np.frombuffer(r["n"], np.int32), idf)) for r in got]
    langs = sorted({r[0] for r in data})
    order = np.random.default_rng(3).permutation(len(data))
    fit, held = order[len(data) // 5 :], order[: len(data) // 5]
    model = Ftrl((1 << BITS) + 1, len(langs))
    put = lambda at, x: (np.r_[at, 1 << BITS], np.r_[x, 0.2])  # noqa: E731  the last is the intercept
    for _ in range(epochs):
        for k in fit:
            model.step(*put(*data[k][1:]), langs.index(data[k][0]))
    w = model.weights()
    t = 1.0
    if len(held) and len(langs) > 1:
        logits = np.array([x @ w[at] for at, x in (put(*data[k][1:]) for k in held)])
        t = temperature(logits, np.array([langs.index(data[k][0]) for k in held]))
    return {"langs": langs, "idf": idf.astype(np.float32), "w": (w / t).astype(np.float32)}


def _predict(model, keys: int):
    def run(batches):
        m = model.value
        for b in batches:
            pred, score = [], []
            for t in b.column(b.num_columns - 1):
                t = t.as_py()
                if m is None or not t or not _LETTER.search(t):
                    pred.append("und")
                    score.append(0.0)
                    continue
                at, n = counts(t.lower(), ORDERS, BITS)
                p = softmax(weights(at, n, m["idf"]) @ m["w"][at] + 0.2 * m["w"][-1])
                pred.append(m["langs"][int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns)), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, train_rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST) -> DataFrame:
    """docs with two columns more, lang_pred and score. It learns from train_rows, which may be any part of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(train_rows, text_col, lang_col, [id_col], most))
    names = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    ready = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").cast("string").alias(text_col))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields)
    out = ready.mapInArrow(_predict(model, len(names)), f"{fields}, lang_pred string, score double")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(crc("doc_id") % 3 == 1, F.lit(False))
    out = language_id(docs.select("doc_id", "text"), docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
