"""N-gram Jaccard join by a prefix tree over globally ordered n-gram sets.

1. Tasks hash the n-grams of their texts, fold rows with equal sets into one, and send each set's hashes to the buckets that
   own them, as packed arrays. A bucket counts how many sets hold each n-gram, and returns only those that two or more hold.
   What only one set holds can be in no intersection, so a set with too few shared n-grams for the threshold is done.
2. The rest are ordered by (sets that hold it, hash), rarest first. Two sets that reach the threshold share one of the first
   |S| - ceil(t |S|) + 1 n-grams (those held once come first and never meet), so these are the keys under which sets meet.
3. Sets first meet under two min-hash keys, which links most near copies. Then, under every key, only those sets meet that are
   not yet in one component, so that hot groups of near copies aren't compared again; keys with the same sets count once, and
   sets that keys chain together meet once, as a family, unless it is larger than a block.
   A key with more sets than `block` is cut into blocks: with the commonest component in blocks of its own, every other set
   meets all blocks. Nothing is capped or dropped.
4. Where sets meet they are stored in a trie. A query set walks it, sharing the overlap of common prefixes, and leaves a
   subtree when sizes, the overlap that is still possible, or earlier links make it useless.

Hashes are 48 bits within a bucket. Edges: a null or empty text has no n-grams and links with nothing; a null id is kept, counts
as the smallest id and is returned as null; rows with the same id are one node and each is returned; no rows give no rows.
"""
from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidescan.llm.common import NULL_ID, bucket_count, chunks, columns, connected_components, id_bucket, keep, mix, pack, rolling, unpack, word_hashes

_PART = "bucket int, kind int, ids binary, rows binary, sizes binary, counts binary, tokens binary"
_SETS = "kind int, id long, other long, size long, tokens binary, route array<long>, hint array<long>"
_PART_NAMES, _PART_TYPES = ["bucket", "kind", "ids", "rows", "sizes", "counts", "tokens"], [pa.int32(), pa.int32(), *[pa.binary()] * 5]
#: Kinds of packed rows.
SHARED, EDGES, TABLE = 0, 1, 2
#: Sets of one key that meet in one task.
BLOCK = 4096
#: Sets of a hot key that go to all its blocks when near copies are linked first.
ANCHORS = 32
#: Rows that may be broadcast: at most 24 bytes each.
SMALL_ROWS = 1_000_000
_NONE = pack(np.empty(0, np.int64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words, A-Z in lower case; of the whole text if it is shorter."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    n = min(width, len(found))
    return np.unique(mix(rolling(word_hashes(found), n) ^ np.uint64(n)))


def _table(rows: list[tuple], names, types) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[j : j + 64], strict=True), types, strict=True)], names=names) for j in range(0, len(rows), 64)]


def _send(width: int, n: int):
    def run(batches):
        for rows in chunks(batches):
            rows.sort(key=lambda r: (r[0], xxhash.xxh3_64_intdigest(r[1] or "")))
            ids, marks, sizes, sets, a, b, every, every_n, first = [], [], [], [], [], [], [], [], {}
            for i, t in rows:
                s = shingles(t, width)
                every.append(i)
                every_n.append(len(s))
                if not len(s):
                    continue
                rep = first.setdefault(key := xxhash.xxh3_128_digest(s.tobytes()), i)
                if rep != i:
                    a.append(i)
                    b.append(rep)
                if rep != i or i in marks[-1:] and key == last:
                    continue
                last = key
                ids.append(i)
                marks.append(i)
                sizes.append(len(s))
                sets.append(s)
            out = []
            for kind, x, y in ((EDGES, a, b), (TABLE, every, every_n)):
                if x:
                    own = id_bucket(np.array(x[:1], np.int64), n)
                    out.append((int(own[0]), kind, pack(np.array(x, np.int64), True), _NONE, pack(np.array(y, np.int64), kind == EDGES), _NONE, b""))
            if ids:
                flat, counts = np.concatenate(sets), np.array(sizes)
                doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
                own = (flat % np.uint64(n)).astype(np.int32)
                order = np.argsort(own, kind="stable")
                flat, doc, own = flat[order] >> np.uint64(16), doc[order], own[order]
                ids, counts = np.array(ids, np.int64), counts.astype(np.uint32)
                at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                for lo, hi in zip(at, np.r_[at[1:], len(own)], strict=True):
                    # Only the sets that the bucket has n-grams of, so what is sent doesn't grow with the number of buckets.
                    new = lo + np.flatnonzero(np.r_[True, doc[lo + 1 : hi] != doc[lo : hi - 1]])
                    held, of = np.diff(np.r_[new, hi]).astype(np.uint32), doc[new]
                    out.append((int(own[lo]), SHARED, pack(ids[of], True), _NONE, pack(counts[of]), pack(held), np.ascontiguousarray(flat[lo:hi].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()))
            yield from _table(out, _PART_NAMES, _PART_TYPES)

    return run


def _share(n: int):
    """Of a bucket's hashes, those that two sets hold, dealt to the buckets of the documents with how many hold them."""

    def run(table: pa.Table) -> pa.Table:
        out, ids, sizes, docs, rows, tokens, seen = [], [], [], [], [], [], 0
        for j, r in enumerate(table.to_pylist()):
            if r["kind"] != SHARED:
                out.append(tuple(r[c] for c in _PART_NAMES))
                continue
            held = unpack(r["counts"], np.uint32)
            ids.append(unpack(r["ids"], np.int64, True))
            sizes.append(unpack(r["sizes"], np.uint32))
            docs.append((np.repeat(np.arange(len(held), dtype=np.uint32), held) + seen).astype(np.uint32))
            raw = np.zeros((len(docs[-1]), 8), np.uint8)
            raw[:, :6] = np.frombuffer(r["tokens"], np.uint8).reshape(-1, 6)
            tokens.append(raw.reshape(-1).view(np.uint64))
            seen += len(held)
        if tokens:
            ids, sizes, docs, tokens = map(np.concatenate, (ids, sizes, docs, tokens))
            order = np.argsort(tokens)
            t = tokens[order]
            at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            df = np.repeat(np.diff(np.r_[at, len(t)]), np.diff(np.r_[at, len(t)]))
            many = df > 1
            doc, token = docs[order[many]], t[many] | (np.minimum(df[many], 65535).astype(np.uint64) << np.uint64(48))
            del order, t, tokens, docs
            own = id_bucket(ids, n)
            order = np.lexsort((token, doc, own[doc])) if len(doc) else np.empty(0, int)
            doc, token = doc[order], token[order]
            new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, int)
            counts, heads = np.diff(np.r_[new, len(doc)]).astype(np.uint32), doc[new]
            ends = np.r_[new, len(doc)]
            cut = np.flatnonzero(np.r_[True, own[heads][1:] != own[heads][:-1]]) if len(heads) else []
            for lo, hi in zip(cut, np.r_[cut[1:], len(heads)].astype(int), strict=True) if len(heads) else ():
                d = heads[lo:hi]
                out.append((int(own[d[0]]), SHARED, pack(ids[d]), _NONE, pack(sizes[d]), pack(counts[lo:hi]), pack(token[ends[lo] : ends[hi]])))
        return pa.Table.from_batches(_table(out, _PART_NAMES, _PART_TYPES) or [pa.RecordBatch.from_arrays([pa.array([], t) for t in _PART_TYPES], names=_PART_NAMES)])

    return run


def _gather(percent: int):
    """Whole sets of a document bucket that could reach the threshold, in the global order, with their keys; edges and tables, unpacked."""

    def run(table: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(7)]
        parts: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for r in table.to_pylist():
            if r["kind"] == SHARED:
                counts = unpack(r["counts"], np.uint32)
                token = np.split(unpack(r["tokens"], np.uint64), np.cumsum(counts)[:-1])
                for i, size, t in zip(unpack(r["ids"], np.int64).tolist(), unpack(r["sizes"], np.uint32).tolist(), token, strict=True):
                    parts[i, size].append(t)
            else:
                ids, other = unpack(r["ids"], np.int64, True).tolist(), unpack(r["sizes"], np.int64, r["kind"] == EDGES).tolist()
                for c, v in zip(cols, ([r["kind"]] * len(ids), ids, other, other, [None] * len(ids), [None] * len(ids), [None] * len(ids)), strict=True):
                    c += v
        for (i, size), ts in parts.items():
            t = np.unique(np.concatenate(ts))
            need = -(-percent * size // 100)
            if len(t) < need:
                continue
            bare = t & np.uint64((1 << 48) - 1)
            route = t[: len(t) - need + 1].view(np.int64).tolist()
            hint = [int(mix(bare ^ np.uint64(k)).min().view(np.int64)) ^ k for k in (0x51ED, 0xC0FFEE)]
            for c, v in zip(cols, (SHARED, i, None, size, t.tobytes(), route, hint), strict=True):
                c.append(v)
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "id", "other", "size", "tokens", "route", "hint"])

    return run


class Trie:
    """Sets of ascending numbers, stored by common prefixes; each node has the run of numbers below its parent."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        self.parent, self.depth, self.source, self.docs = [-1], [0], [0], [[]]
        stack, before = [0], None
        for d in sorted(range(len(sets)), key=lambda d: sets[d].astype(">u4").tobytes()):
            s, common = sets[d], 0
            if before is not None:
                k = min(len(s), len(before))
                differ = np.flatnonzero(s[:k] != before[:k])
                common = int(differ[0]) if len(differ) else k
            below = None
            while self.depth[stack[-1]] > common:
                below = stack.pop()
            if self.depth[stack[-1]] < common:
                middle = self._add(stack[-1], common, self.source[below])
                self.parent[below] = middle
                stack.append(middle)
            if len(s) > common:
                stack.append(self._add(stack[-1], len(s), d))
            self.docs[stack[-1]].append(d)
            before = s
        n = len(self.parent)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            self.children[self.parent[v]].append(v)
        self.runs = [sets[self.source[v]][self.depth[self.parent[v]] : self.depth[v]] if v else sets[0][:0] for v in range(n)]
        self.live, self.least, self.most, self.longest = [0] * n, [1 << 62] * n, [0] * n, [0] * n
        self.home = [0] * len(sets)
        for v in sorted(range(n), key=lambda v: -self.depth[v]):
            for d in self.docs[v]:
                self.home[d] = v
                self._widen(v, 1, sizes[d], sizes[d], len(sets[d]))
            if v:
                self._widen(self.parent[v], self.live[v], self.least[v], self.most[v], self.longest[v])

    def _add(self, parent: int, depth: int, source: int) -> int:
        self.parent.append(parent)
        self.depth.append(depth)
        self.source.append(source)
        self.docs.append([])
        return len(self.parent) - 1

    def _widen(self, v: int, live: int, least: int, most: int, longest: int) -> None:
        self.live[v] += live
        self.least[v], self.most[v], self.longest[v] = min(self.least[v], least), max(self.most[v], most), max(self.longest[v], longest)

    def drop(self, d: int) -> None:
        """d is looked for no more."""
        v = self.home[d]
        self.docs[v].remove(d)
        while v >= 0:
            self.live[v] -= 1
            v = self.parent[v]

    def search(self, q: int, mark: np.ndarray, percent: int) -> list[int]:
        """Sets that reach the threshold with set q. Overlap o is enough if (100 + percent) * o >= percent * (both sizes)."""
        s, size, found = self.sets[q], self.sizes[q], []
        mark[s] = True
        todo = [(c, 0) for c in self.children[0]]
        while todo:
            v, shared = todo.pop()
            if not self.live[v] or 100 * self.most[v] < percent * size or percent * self.least[v] > 100 * size:
                continue
            run = self.runs[v]
            shared += int(np.count_nonzero(mark[run]))
            left = min(len(s) - int(np.searchsorted(s, run[-1], "right")), self.longest[v] - self.depth[v])
            if (100 + percent) * (shared + left) < percent * (size + self.least[v]):
                continue
            found += [d for d in self.docs[v] if (100 + percent) * shared >= percent * (size + self.sizes[d])]
            todo += [(c, shared) for c in self.children[v]]
        mark[s] = False
        return found


def trie_links(tokens: list[np.ndarray], sizes: list[int], groups: list, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different groups that suffice to connect all that some chain of links connects."""
    flat, number = np.unique(np.concatenate(tokens), return_inverse=True)
    sets = np.split(number.astype(np.int64), np.cumsum([len(t) for t in tokens])[:-1])
    members = defaultdict(list)
    for d, g in enumerate(groups):
        members[g].append(d)
    if len(members) < 2:
        return []
    trie, mark, links, left = Trie(sets, sizes), np.zeros(len(flat), bool), [], set(members)

    def take(g) -> list[int]:
        left.discard(g)
        for d in members[g]:
            trie.drop(d)
        return list(members[g])

    for g in list(members):
        if g not in left:
            continue
        todo = take(g)
        while todo and left:
            q = todo.pop()
            for d in trie.search(q, mark, percent):
                if groups[d] in left:
                    links.append((q, d))
                    todo += take(groups[d])
    return links


def _meet(percent: int):
    def run(table: pa.Table) -> pa.Table:
        key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
        ids, size, group, tokens = (table.column(c) for c in ("id", "size", "component", "tokens"))
        ids, size, group = ids.to_numpy(), size.to_numpy(), group.to_numpy()
        order = np.lexsort((ids, block, key))
        new = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (block[order][1:] != block[order][:-1])]) if len(order) else []
        out = []
        for lo, hi in zip(new, np.r_[new[1:], len(order)].astype(int), strict=True) if len(order) else ():
            if hi - lo < 2:
                continue
            rows = order[lo:hi]
            sets = [np.frombuffer(tokens[int(r)].as_py(), np.uint64) for r in rows]
            out += [(int(ids[rows[a]]), int(ids[rows[b]])) for a, b in trie_links(sets, size[rows].tolist(), group[rows].tolist(), percent)]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _with_small(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join whose small side is broadcast if its counted rows allow it."""
    return big.join(F.broadcast(small) if small.count() <= SMALL_ROWS else small, on, how)


def _compare(meeting: DataFrame, percent: int, slots: int) -> DataFrame:
    """Links (a, b) within each (key, block). Keys share a slot so that Python is called for many at once."""
    return meeting.withColumn("slot", F.pmod(F.xxhash64("key", "block"), F.lit(slots))).groupBy("slot").applyInArrow(_meet(percent), "a long, b long")


def _first_meeting(sets: DataFrame) -> DataFrame:
    """Under min-hash keys. A hot key's sets go to blocks, a few of them to all, so that what is close becomes one component."""
    posts = sets.select("id", "size", F.col("id").alias("component"), "tokens", F.explode("hint").alias("key"))
    hot = keep(sets.select(F.explode("hint").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK))
    posts = _with_small(posts, hot, ["key"], "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(BLOCK)))
    everywhere = F.col("n").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(7)), F.col("n")) < ANCHORS)
    block = F.explode(F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")))))
    return posts.select("key", block.alias("block"), "id", "size", "component", "tokens")


def _second_meeting(sets: DataFrame, components: DataFrame) -> DataFrame | None:
    """Under every key that holds sets of several components; None if there is none."""
    named = sets.select("id", "size", "route").join(components, sets.id == components.node, "left").select("id", "size", "route", F.coalesce("component", "id").alias("component"))
    posts = named.select("id", "size", "component", F.explode("route").alias("key"))
    keys = posts.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id", "size").cast("decimal(38,0)")).alias("who")).where("lo < hi")
    keys = keep(keys.groupBy("who", "n", "lo", "hi").agg(F.min("key").alias("key")).select("key", "n", "lo"))
    if keys.isEmpty():
        return None
    posts = keep(_with_small(posts, keys, ["key"], "inner"))
    # Components that some key brings together form families. A family of up to BLOCK sets meets once, as a whole; only
    # those of larger families meet key by key.
    families = connected_components(posts.select(F.col("component").alias("a"), F.col("lo").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("family"))
    inside = keep(posts.select("id", "size", "component").distinct().join(families, "component"))
    large = inside.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("family")
    large = keep(families.join(large, "family").select("component"))
    whole = inside.select(F.col("family").alias("key"), F.lit(-1).cast("long").alias("block"), "id", "size", "component")
    if large.isEmpty():
        return whole.join(sets.select("id", "size", "tokens"), ["id", "size"])
    whole = _with_small(whole, large, ["component"], "left_anti").select("key", "block", "id", "size", "component")
    posts = _with_small(posts.drop("lo"), large, ["component"], "left_semi")
    hot = posts.where(F.col("n") > BLOCK)
    if hot.isEmpty():
        posts = posts.select("key", F.lit(0).cast("long").alias("block"), "id", "size", "component")
    else:
        main = hot.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).groupBy("key").agg(F.max_by("component", "c").alias("main"), F.max("c").alias("c"), F.max("n").alias("n"))
        main = keep(main.select("key", "main", F.ceil(F.col("c") / BLOCK).alias("rows"), F.ceil((F.col("n") - F.col("c")) / BLOCK).alias("cols")))
        h, at = _with_small(hot.drop("n"), main, ["key"], "inner"), lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
        span, cell = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda kind, i, j: (F.lit(kind) + i * 3 + j * (F.col("rows") + F.col("cols")) * 3).cast("long")
        # Cells (main block, other block), and (other block, other block) for the rest among themselves.
        one = F.transform(span("cols"), lambda j: cell(0, at("rows", 1), j))
        own = F.array_distinct(F.concat(F.transform(span("rows"), lambda i: cell(0, i, at("cols", 2))), F.transform(span("cols"), lambda j: cell(1, F.least(j, at("cols", 2)), F.greatest(j, at("cols", 2))))))
        h = h.select("key", F.explode(F.when(F.col("component") == F.col("main"), one).otherwise(own)).alias("block"), "id", "size", "component")
        posts = posts.where(F.col("n") <= BLOCK).select("key", F.lit(0).cast("long").alias("block"), "id", "size", "component").unionByName(h)
    return posts.unionByName(whole).join(sets.select("id", "size", "tokens"), ["id", "size"])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per row: its id, n_shingles, and component_id, the smallest id reachable by links of at least `percent` / 100."""
    n, rows = bucket_count(docs), columns(docs, id_col, text_col)
    shared = rows.mapInArrow(_send(width, n), _PART).groupBy("bucket").applyInArrow(_share(n), _PART)
    base = keep(shared.groupBy("bucket").applyInArrow(_gather(percent), _SETS))
    sets = base.where(F.col("kind") == SHARED)
    copies = base.where(F.col("kind") == EDGES).select(F.col("id").alias("a"), F.col("other").alias("b"))
    links = keep(_compare(_first_meeting(sets), percent, n))
    components = keep(connected_components(links.unionByName(copies)))
    meeting = _second_meeting(sets, components)
    if meeting is not None:
        more = keep(_compare(meeting, percent, n))
        if not more.isEmpty():
            components = connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    every = base.where(F.col("kind") == TABLE).select("id", F.col("size").alias("n_shingles"))
    out = every.join(components, every.id == components.node, "left")
    null = lambda c: F.when(c != NULL_ID, c)
    return out.select(null(F.col("id")).alias(id_col), "n_shingles", null(F.coalesce("component", "id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["Trie", "jaccard_join", "query", "shingles", "trie_links"]
