"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeats merge into maximal removal intervals.

Three steps. Tasks hash all windows of their texts, settle repeats among their own rows, and send each distinct hash once,
as packed arrays, to the bucket that owns it. Each bucket counts its hashes and keeps, for one that occurs again, all but the
earliest place. Places go to the bucket of their document, where they merge into intervals and the words go.

Hot passages: a task sends a window once, however many of its rows hold it, so a bucket gets at most one entry a task and window.
Hashes are 64 bits; among n windows about n*n/2**65 pairs differ and yet agree (0.0005 expected at 140 million windows).

Edges: a null text has no words; a null id is kept, and counts as the smallest; rows that agree in id and text are one document
listed twice, and get the same result; rows that agree in id alone are ordered by a checksum of their text; no rows give no rows.
"""
from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidescan.llm.common import NULL_ID, bucket_count, chunks, columns, id_bucket, pack, rolling, unpack, word_hashes, words

_SENT = "bucket int, local boolean, ids binary, sums binary, counts binary, places binary, hashes binary"
_FLAGS = "bucket int, ids binary, sums binary, counts binary, starts binary"
_OUT = "id long, n_words long, n_removed long, removed array<struct<begin:int,end:int>>, kept_text string"


def _checksum(text: str | None) -> int:
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass"))


def _flag_rows(ids: np.ndarray, sums: np.ndarray, starts: np.ndarray, n: int):
    """Packed flags by the document's bucket: a table of documents, places for each, and the places."""
    if not len(ids):
        return
    own = id_bucket(ids, n)
    order = np.lexsort((starts, sums, ids, own))
    own, ids, sums, starts = own[order], ids[order], sums[order], starts[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (sums[1:] != sums[:-1]) | (own[1:] != own[:-1])]
    at = np.flatnonzero(new)
    counts = np.diff(np.r_[at, len(ids)])
    for k, lo, hi in _runs(own[at]):
        a, b = at[lo], at[hi] if hi < len(at) else len(ids)
        yield int(k), pack(ids[at[lo:hi]], True), pack(sums[at[lo:hi]]), pack(counts[lo:hi].astype(np.uint32)), pack(starts[a:b].astype(np.uint32), True)


def _runs(keys: np.ndarray):
    """(key, first, end) of each run of equal keys."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    yield from zip(keys[at], at, np.r_[at[1:], len(keys)], strict=True)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)


def _send(window: int, n: int):
    names = ["bucket", "local", "ids", "sums", "counts", "places", "hashes"]
    types = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]

    def run(batches):
        for rows in chunks(batches):
            rows.sort(key=lambda r: (r[0], _checksum(r[1])))
            ids, sums, hashes, counts, seen = [], [], [], [], set()
            for i, t in rows:
                key = (i, _checksum(t))
                found = words(t)
                if len(found) < window or key in seen:
                    continue
                seen.add(key)
                w = rolling(word_hashes(found), window)
                ids.append(i)
                sums.append(key[1])
                hashes.append(w)
                counts.append(len(w))
            if not ids:
                continue
            ids, sums, counts, hashes = np.array(ids, np.int64), np.array(sums, np.uint32), np.array(counts, np.uint32), np.concatenate(hashes)
            order = np.argsort(hashes, kind="stable")
            same = np.zeros(len(order), bool)
            same[1:] = hashes[order[1:]] == hashes[order[:-1]]
            again, first = np.sort(order[same]), np.sort(order[~same])
            base = np.r_[0, np.cumsum(counts, dtype=np.int64)]
            out = []
            if len(again):
                doc = np.searchsorted(base, again, "right") - 1
                out += [(k, True, i, s, c, p, b"") for k, i, s, c, p in _flag_rows(ids[doc], sums[doc], again - base[doc], n)]
            own = (hashes[first] % np.uint64(n)).astype(np.int32)
            order = np.argsort(own, kind="stable")
            first, own = first[order], own[order]
            doc = np.searchsorted(base, first, "right") - 1
            starts = (first - base[doc]).astype(np.uint32)
            # A bucket gets only the documents that it has windows of, so what is sent doesn't grow with the number of buckets.
            for k, lo, hi in _runs(own):
                at = lo + np.flatnonzero(np.r_[True, doc[lo + 1 : hi] != doc[lo : hi - 1]])
                held = np.diff(np.r_[at, hi]).astype(np.uint32)
                out.append((int(k), False, pack(ids[doc[at]], True), pack(sums[doc[at]]), pack(held), pack(starts[lo:hi], True), hashes[first[lo:hi]].tobytes()))
            del hashes, order, same, again, first, doc, starts
            for j in range(0, len(out), 64):
                yield _batch(out[j : j + 64], names, types)

    return run


def _count(n: int):
    names, types = ["bucket", "ids", "sums", "counts", "starts"], [pa.int32(), *[pa.binary()] * 4]

    def run(table: pa.Table) -> pa.Table:
        out, hashes, docs, starts, ids, sums, seen = [], [], [], [], [], [], 0
        for r in table.to_pylist():
            if r["local"]:
                out.append((r["bucket"], r["ids"], r["sums"], r["counts"], r["places"]))
                continue
            held = unpack(r["counts"], np.uint32)
            hashes.append(np.frombuffer(r["hashes"], np.uint64))
            docs.append((np.repeat(np.arange(len(held), dtype=np.uint32), held) + np.uint32(seen)).astype(np.uint32))
            starts.append(unpack(r["places"], np.uint32, True))
            ids.append(unpack(r["ids"], np.int64, True))
            sums.append(unpack(r["sums"], np.uint32))
            seen += len(ids[-1])
        if hashes:
            hashes, docs, starts, ids, sums = map(np.concatenate, (hashes, docs, starts, ids, sums))
            rank = np.empty(len(ids), np.int64)
            order = np.lexsort((sums, ids))
            rank[order] = np.cumsum(np.r_[0, (ids[order[1:]] != ids[order[:-1]]) | (sums[order[1:]] != sums[order[:-1]])])
            order = np.argsort(hashes)
            h = hashes[order]
            same = h[1:] == h[:-1]
            del h
            many = np.r_[same, False] | np.r_[False, same]
            pick = order[many]
            if len(pick):
                place = (rank[docs[pick]] << 32) | starts[pick]
                at = np.flatnonzero(np.r_[True, hashes[pick[1:]] != hashes[pick[:-1]]])
                least = np.repeat(np.minimum.reduceat(place, at), np.diff(np.r_[at, len(pick)]))
                pick = pick[place > least]
                out += _flag_rows(ids[docs[pick]], sums[docs[pick]], starts[pick].astype(np.int64), n)
        return pa.Table.from_batches([_batch(out, names, types)])

    return run


def _deal(n: int):
    def run(batches):
        for rows in chunks(batches):
            parts = defaultdict(list)
            own = id_bucket(np.array([i for i, _ in rows], np.int64), n)
            for k, r in zip(own, rows, strict=True):
                parts[int(k)].append(r)
            pressed = zstandard.ZstdCompressor(level=3)
            out = []
            for k, rs in parts.items():
                raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for _, t in rs]
                out.append((k, pack(np.array([i for i, _ in rs], np.int64)), pack(np.array([len(b) for b in raw], np.uint64)), pressed.compress(b"".join(raw))))
            yield _batch(out, ["bucket", "ids", "sizes", "texts"], [pa.int32(), *[pa.binary()] * 3])

    return run


def _remove(window: int):
    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        found = defaultdict(list)
        for r in flags.to_pylist():
            ids, sums, counts = unpack(r["ids"], np.int64, True), unpack(r["sums"], np.uint32), unpack(r["counts"], np.uint32)
            starts = np.split(unpack(r["starts"], np.uint32, True).astype(np.int64), np.cumsum(counts)[:-1])
            for i, s, x in zip(ids.tolist(), sums.tolist(), starts, strict=True):
                found[i, s].append(x)
        cols = [[], [], [], [], []]
        for r in texts.to_pylist():
            raw, at = zstandard.ZstdDecompressor().decompress(r["texts"]), 0
            for i, size in zip(unpack(r["ids"], np.int64).tolist(), unpack(r["sizes"], np.uint64).tolist(), strict=True):
                text = raw[at : at + size]
                at += size
                ws = text.split()
                spans, gone, kept = [], 0, ws
                if places := found.get((i, zlib.crc32(text))) if found else None:
                    edge = np.zeros(len(ws) + 1, np.int32)
                    places = np.unique(np.concatenate(places))
                    edge[places] += 1
                    edge[places + window] -= 1
                    drop = np.cumsum(edge[:-1]) > 0
                    gone = int(drop.sum())
                    turn = np.flatnonzero(np.diff(np.r_[False, drop, False].astype(np.int8)))
                    spans = [{"begin": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                    kept = [w for w, d in zip(ws, drop.tolist(), strict=True) if not d]
                for c, v in zip(cols, (None if i == NULL_ID else i, len(ws), gone, spans, b" ".join(kept).decode("utf-8", "surrogatepass")), strict=True):
                    c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.string()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "n_words", "n_removed", "removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Per document: its id, n_words, n_removed, the removed intervals of word positions, and the text that stays."""
    n, rows = bucket_count(docs), columns(docs, id_col, text_col)
    sent = rows.mapInArrow(_send(window, n), _SENT)
    flags = sent.groupBy("bucket").applyInArrow(_count(n), _FLAGS)
    texts = rows.mapInArrow(_deal(n), "bucket int, ids binary, sizes binary, texts binary")
    out = texts.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(_remove(window), _OUT)
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
