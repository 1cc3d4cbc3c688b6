"""Bounded-space online packing of token sequences.

Each task keeps `windows` open sequences. A document's ids fill whole sequences first; its rest goes to the fullest sequence that
holds it (best fit). When none does, the fullest one is completed with the head of the rest and emitted, and the tail is placed
anew. What is open at a task's end is merged in a tree, `fan_in` tasks at a time, by the same rules, with its ids; the very last
tokens are cut into sequences whose lengths are powers of two, which need no padding.

A document's ids are those of its white-space words, one after another: the tokenizer never joins across white space. Words
and their runs of letters are remembered, so that a worker tokenizes the frequent ones once (two generations of `memo` entries). New
runs of Latin letters go to the tokenizer's model in lower case, without its other steps, if that shows the same ids on probes.

Edges: a null or empty text has the end id alone; rows with equal ids are packed each; no rows give no rows. Memory of a task: open
sequences, one batch of texts, and the remembered words.
"""
from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from itertools import chain, filterfalse
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidescan.llm.common import columns, keep

LENGTH, END_ID = 2048, 1
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "group", "ids"]
_TYPES = [*[pa.int64()] * 8, pa.binary()]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, `group` long, ids binary"
_loaded: dict = {}
#: The letters of Latin-1 beyond ASCII.
_LETTERS = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))


class Memo(dict):
    """Two generations: when the young one is full it becomes the old one, whose entries return when they are used."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def lacks(self, keys) -> list:
        """Those of the keys that aren't remembered; all others are in the young generation then."""
        other, old = list(filterfalse(self.__contains__, keys)), self.old
        self.update((k, old[k]) for k in other if k in old)
        return list(filterfalse(old.__contains__, other))

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Words:
    """Ids of texts by a tokenizer, as little-endian unsigned 32-bit integers."""

    #: Words of ASCII signs and letters of any script, without apostrophes, are tokenized by their runs.
    PLAIN = re.compile(r"(?:[!-&(-~]|[^\W\d_\x00-\x7f])+")
    RUNS = re.compile(r"[^\W\d_]+|\d|(?:[^\w]|_)+")
    #: Letters that no normal form joins and whose lower case is one letter: runs of them go to the tokenizer's model without its other steps.
    LATIN = re.compile(f"[A-Za-z{_LETTERS}]+")
    #: What byte-level models have for those bytes of these letters, in lower case, that aren't printable in Latin-1.
    BYTES = (("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))
    #: The one letter whose lower case has two code points, of which the second is no letter.
    TWO = "\u0130"
    #: Texts by which it shows whether words and runs can be tokenized one by one.
    PROBES = ("Two words, and  more.\nLines\tand tabs", "it's 12,5 (x_y) a-b... --", "Na\u00efve \u6f22\u5b57 \u00bd #tag", "I\u0307 \u0130, \u0130x; a\u0301b!", " lead trail ", " ".join(x + y + "ING" for x, y in zip(_LETTERS, _LETTERS[1:], strict=False)))

    def __init__(self, spec: str, memo: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.lower = all(self._ids(x) == self._ids(x.lower()) for x in ("Abc", "ABC"))
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        right = [self._ids(t) for t in self.PROBES]
        # Another tokenizer may treat letters in another way, join across white space or cut runs elsewhere: then its own steps are
        # taken for all runs, or texts are tokenized whole.
        for self.latin in (not any(map(self.LATIN.fullmatch, added)), False):
            self.words, self.runs, self.whole = Memo(memo), Memo(memo), False
            self.whole = right != self.encode(list(self.PROBES))
            if not self.whole:
                break

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, text: str) -> list[str]:
        if text.isalpha() or self.TWO in text:
            return [text]
        if text[-1] in ",." and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.RUNS.findall(text) if self.PLAIN.fullmatch(text) else [text]

    def _learn(self, new: list[bytes]) -> None:
        """Remembers the ids of words that come for the first time."""
        split = [self._split(w.decode("utf-8", "replace")) for w in new]
        fresh = self.runs.lacks(dict.fromkeys(chain.from_iterable(split)))
        id_of = attrgetter("id")
        latin = list(filter(self.LATIN.fullmatch, fresh)) if self.latin else []
        letters = "\n".join(latin).lower().encode().decode("latin-1")
        for byte, letter in self.BYTES:
            letters = letters.replace(byte, letter)
        for r, found in zip(latin, map(self.model.tokenize, letters.split("\n")), strict=False):
            self.runs[r] = array("I", map(id_of, found)).tobytes()
        known = set(latin)
        other = [r for r in fresh if r not in known]
        for r, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.runs[r] = array("I", e.ids).tobytes()
        get = self.runs.__getitem__
        self.words.update(zip(new, (get(rs[0]) if len(rs) == 1 else b"".join(map(get, rs)) for rs in split), strict=True))
        self.runs.turn()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.whole:
            return [self._ids(t or "") for t in texts]
        self.words.turn()
        split = []
        for t in texts:
            raw = (t or "").encode("utf-8", "replace")
            # Special tokens are found before anything is split or lowered.
            split.append(None if b"<|" in raw else (raw.lower() if self.lower else raw).split())
        here = dict.fromkeys(chain.from_iterable(filter(None, split)))
        self._learn(self.words.lacks(here))
        here.update(zip(here, map(self.words.__getitem__, here), strict=True))
        get = here.__getitem__
        return [self._ids(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


class Packer:
    """Open sequences of one task. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, windows: int, first: int):
        self.length, self.next = length, first
        self.open: list[list] = [[] for _ in range(windows)]
        self.used = [0] * windows
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset, None, None))
            offset += len(ids)
        self.next += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self.emit([(doc, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [u for u in self.used if u + len(ids) <= self.length]
            k = self.used.index(max(fits) if fits else max(self.used))
            head = ids[: self.length - self.used[k]]
            self.open[k].append((doc, start, head, total))
            self.used[k] += len(head)
            if self.used[k] == self.length:
                self.emit(self.open[k])
                self.open[k], self.used[k] = [], 0
            start, ids = start + len(head), ids[len(head) :]

    def rest(self, group: int) -> list[tuple]:
        """What is open, to be packed elsewhere."""
        return [(doc, start, len(ids), None, total, None, None, group, ids.tobytes()) for w in self.open for doc, start, ids, total in w]

    def finish(self) -> None:
        """What is open, cut to full sequences and then to powers of two."""
        left = [list(p) for w in sorted(self.open, key=lambda w: -sum(len(p[2]) for p in w)) for p in w]
        while left:
            total = sum(len(p[2]) for p in left)
            room = min(self.length, 1 << (total.bit_length() - 1))
            pieces = []
            while room:
                doc, start, ids, n = left[0]
                pieces.append((doc, start, ids[:room], n))
                room -= len(pieces[-1][2])
                if len(pieces[-1][2]) == len(ids):
                    left.pop(0)
                else:
                    left[0] = [doc, start + len(pieces[-1][2]), ids[len(pieces[-1][2]) :], n]
            self.emit(pieces)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _pack(spec, length: int, windows: int, memo: int):
    def run(batches):
        key = hash(spec.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Words(spec.value, memo)
        part = TaskContext.get().partitionId()
        packer, end = Packer(length, windows, part << 32), np.array([END_ID], "<u4").tobytes()
        gc.disable()  # nothing here is cyclic, and the collector would walk the remembered words again and again
        try:
            for b in batches:
                at = 0
                while at < b.num_rows:
                    ids, texts, size = [], [], 0
                    while at < b.num_rows and size < 1 << 20:
                        ids.append(b.column(0)[at].as_py())
                        texts.append(b.column(1)[at].as_py())
                        size += len(texts[-1] or "") + 64
                        at += 1
                    for i, raw in zip(ids, _loaded[key].encode(texts), strict=True):
                        found = np.frombuffer(raw + end, "<u4")
                        packer.add(i, 0, found, len(found))
                    if len(packer.out) > 5000:
                        yield _table(packer.out)
                        packer.out = []
        finally:
            gc.enable()
        yield _table(packer.out + packer.rest(part))

    return run


def _merge(length: int, windows: int, level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if not rows:
            return pa.Table.from_batches([_table([])])
        rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"]))
        group = rows[0]["group"]
        packer = Packer(length, windows, (level << 56) | (group << 32))
        for r in sorted(rows, key=lambda r: -r["length"]):
            packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        if last:
            packer.finish()
        return pa.Table.from_batches([_table(packer.out + ([] if last else packer.rest(group)))])

    return run


def packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = 16, fan_in: int = 32, memo: int = 250_000) -> DataFrame:
    """Per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: a path on the driver."""
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())
    done = keep(columns(docs, id_col, text_col).mapInArrow(_pack(spec, length, windows, memo), _SCHEMA))
    parts, level = (done.where(F.col("group").isNotNull()).agg(F.max("group")).first()[0] or 0) + 1, 0
    out = done.where(F.col("group").isNull())
    open_ = done.where(F.col("group").isNotNull())
    while True:
        parts, level = -(-parts // fan_in), level + 1
        done = keep(open_.withColumn("group", F.floor(F.col("group") / fan_in).cast("long")).groupBy("group").applyInArrow(_merge(length, windows, level, parts == 1), _SCHEMA))
        out, open_ = out.unionByName(done.where(F.col("group").isNull())), done.where(F.col("group").isNotNull())
        if parts == 1:
            return out.drop("group", "ids").withColumnRenamed("doc_id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def query(spark, sf_dir: str) -> DataFrame:
    return packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
