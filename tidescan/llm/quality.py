"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are hashed character n-grams and a few shape terms (shares of capitals, signs, repeated words and so on, in steps). Document
frequencies count all rows. The latent space is the truncated SVD of the TF-IDF rows of about `most` labelled documents of each
label, drawn by a hash; these are broadcast (at most 4 * most rows of `rank` numbers), every document is multiplied with all of
them in blocks, and the labels of the `neighbours` most similar vote with a power of their cosine.

Edges: empty and null texts have shape terms, so they vote like others; without labels every score is 0.5; labels that are null or
of unknown ids are ignored; several labels of one id each count; repeated rows get equal results; no rows give no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidescan.llm.features import counts, crc, document_frequencies, idf_of, sample

ORDERS, BITS = (1, 2, 3), 13
MOST, RANK, NEIGHBOURS, POWER = 1000, 48, 15, 4
#: Steps of each shape term, and its weight against all n-grams together.
STEPS, WEIGHT = 10, 0.35
SHAPES = 7


def shape(text: str) -> np.ndarray:
    """Steps of: capitals, signs, digits, repeated words, word length, line length, most frequent word."""
    n = max(1, len(text))
    words = text.split()
    c = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    signs = int(np.count_nonzero(((c > 32) & (c < 48)) | ((c > 57) & (c < 65)) | ((c > 90) & (c < 97)) | ((c > 122) & (c < 127))))
    few = len(set(words)) / max(1, len(words))
    top = max(np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_counts=True)[1]) / len(words) if words else 1.0
    values = (
        min(1.0, np.count_nonzero((c > 64) & (c < 91)) / n * 2), min(1.0, signs / n * 4), min(1.0, np.count_nonzero((c > 47) & (c < 58)) / n * 4),
        1 - few * min(1.0, (len(words) / 300) ** 0.3), min(1.0, n / max(1, len(words)) / 20), min(1.0, np.log1p(n / (1 + text.count("\n"))) / 12), min(1.0, top * 3),
    )
    return np.array([k * STEPS + min(STEPS - 1, int(v * STEPS)) for k, v in enumerate(values)])


def vector(text: str, idf: np.ndarray, out: np.ndarray) -> None:
    """TF-IDF of n-grams and shape terms, written into a row of zeros."""
    at, n = counts(text, ORDERS, BITS)
    v = np.log1p(n) * idf[at]
    norm = np.sqrt((v * v).sum())
    if norm:
        out[at] = v / norm
    s = shape(text) + (1 << BITS)
    out[s] += WEIGHT
    low = (s - (1 << BITS)) % STEPS
    out[s[low > 0] - 1] += WEIGHT / 2
    out[s[low < STEPS - 1] + 1] += WEIGHT / 2


SIZE = (1 << BITS) + SHAPES * STEPS


def _rows(idf):
    def run(batches):
        for b in batches:
            label, at, val = [], [], []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.zeros(SIZE, np.float32)
                vector(t or "", idf.value, x)
                k = np.flatnonzero(x)
                label.append(y)
                at.append(k.astype(np.int16).tobytes())
                val.append(x[k].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(at, pa.binary()), pa.array(val, pa.binary())], names=["label", "at", "val"])

    return run


def latent(x: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors, by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(rank + 12, *x.shape))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(n > 0, n, 1)


def train(labelled: DataFrame, idf_bc, most: int) -> dict | None:
    """labelled: text, label, id."""
    got = sample(labelled, "label", most, ["id"]).select("text", "label").mapInArrow(_rows(idf_bc), "label int, at binary, val binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["at"], r["label"]))
    x = np.zeros((len(got), SIZE), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["val"], np.float16)
    v = latent(x, RANK)
    return {"v": v, "points": unit(x @ v), "labels": np.array([r["label"] for r in got], np.float32)}


def vote(z: np.ndarray, m: dict) -> np.ndarray:
    """Share of label 1 among the nearest, weighted by similarity."""
    sims = z @ m["points"].T
    k = min(NEIGHBOURS, sims.shape[1])
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(sims, near, axis=1), 1e-6).astype(np.float64) ** POWER
    return (w * m["labels"][near]).sum(axis=1) / w.sum(axis=1)


def _score(idf, model):
    def run(batches):
        m = model.value
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            score = np.full(b.num_rows, 0.5)
            for lo in range(0, b.num_rows if m else 0, 128):
                x = np.zeros((min(128, b.num_rows - lo), SIZE), np.float32)
                for k in range(len(x)):
                    vector(texts[lo + k].as_py() or "", idf.value, x[k])
                score[lo : lo + len(x)] = vote(unit(x @ m["v"]), m)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.clip(score, 0, 1), pa.float64())], names=["id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST) -> DataFrame:
    """Per document: its id and score. labels: ids with labels 0 and 1, of documents that may be learnt from."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    df, total = document_frequencies(rows.select("text"), ORDERS, BITS, False)
    sc = docs.sparkSession.sparkContext
    idf = sc.broadcast(idf_of(df, total).astype(np.float32))
    # Labels are drawn before the join: only a bounded number of ids meets the texts.
    drawn = sample(labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)"), "label", most, ["id", "label"])
    model = sc.broadcast(train(rows.join(F.broadcast(drawn), "id").select("text", "label", "id"), idf, most))
    return rows.mapInArrow(_score(idf, model), "id long, score double").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(crc("doc_id") % 5 == 0, F.lit(False))
    out = quality(docs, labels.where(~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
