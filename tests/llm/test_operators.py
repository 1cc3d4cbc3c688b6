import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidescan.llm import embedding_dedup, fingerprints, html_extract, jaccard_join, language_id, line_dedup, mixing, packing, quality, substring_dedup
from tidescan.llm.common import bucket_count, connected_components, pack, rolling, unpack, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, id long, size long, key long, label string, a long, n long, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use inside."""
    r = np.random.default_rng(7)
    vocabulary = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary, n))
    a, b, shared = prose(120), prose(4000), prose(30)
    near = a.split()
    near[60] = "changed"
    rows = [(1, a), (2, a), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n"), (7, b), (8, prose(40) + "\n" + shared + ".\n" + prose(25)), (9, shared), (9, shared), (10, "x"), (10, "one two three"), (None, prose(50)), (None, None), (11, "É ü ß"), (12, "x"), (13, prose(3)), (14, a + "\n" + a), (15, "... !!!")]
    full = [(i, t, ["en", "fr", None][k % 3], ["s1", None, "s0", "ß"][k % 4], k, 5, 6, "l", 7, 8, 9) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def key(r):
    return tuple((v is not None, v) for v in r)


def brute_substrings(rows, width=20):
    seen, out = {}, []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                gone[s : s + width] = [True] * width
            seen.setdefault(k, 1)
        out += [(i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())] * rows.count((i, t))
    return out


def test_substring_dedup(docs):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_substrings(texts(docs)), key=key)
    for r in substring_dedup.substring_dedup(docs).collect():
        assert sum(x.end - x.begin for x in r.removed) == r.n_removed


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in linked:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [4096, 2])
def test_jaccard_join(spark, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    sets = defaultdict(list)
    for i, t in texts(docs):
        w = re.sub("[A-Z]+", lambda m: m.group().lower(), t or "").encode().split()
        sets[-1 if i is None else i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    linked = [(x, y) for x in sets for y in sets for s in sets[x] for t in sets[y] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    root = brute_components(list(sets), linked)
    null = lambda i: None if i == -1 else i
    want = [(null(i), len(s), null(root[i])) for i in sets for s in sets[i]]
    assert sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()), key=key) == sorted(want, key=key)


def test_trie_links():
    r = np.random.default_rng(1)
    base = np.sort(r.choice(5000, 60, False)).astype(np.uint64)
    sets = [np.unique(np.where(r.random(60) < p, r.integers(0, 5000, 60), base)).astype(np.uint64) for p in r.choice([0.02, 0.1, 0.2, 0.9], 80)]
    pairs = [(i, j) for i in range(80) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    links = jaccard_join.trie_links(sets, [len(s) for s in sets], list(range(80)), 75)
    assert set(map(frozenset, links)) <= set(map(frozenset, pairs))
    assert brute_components(range(80), links) == brute_components(range(80), pairs)


def test_connected_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_mixing(docs):
    got = mixing.mixing(docs).collect()
    again = mixing.mixing(docs.repartition(3)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect())
    assert all(0 <= r.copies <= 2 for r in got) and sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert mixing.mix_documents(docs).count() == sum(r.copies for r in got) and mixing.mix_documents(docs).columns == docs.columns
    assert mixing.targets([10, 100, 100], 1.5) == pytest.approx([20, 315 - 20 - 95, 95][:1] + [196.66666, 98.33333], rel=1e-4)
    p, s = np.full(500, 0.3), np.random.default_rng(1).integers(1, 900, 500)
    mixing.pivot(-np.sort(-s), p, np.random.default_rng(2).random(500))
    assert (p * -np.sort(-s)).sum() == pytest.approx(0.3 * s.sum()) and ((p == 0) | (p == 1)).sum() >= 499


@pytest.mark.parametrize("block", [1024, 3])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(3)
    centre = r.standard_normal((6, 16))
    vec = [list(map(float, centre[k % 6] + 0.05 * r.standard_normal(16))) for k in range(60)]
    vec += [vec[0]] * 3 + [[2 * x for x in vec[1]], None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, []]
    rows = [(k if k != 5 else None, v, k % 2 if k < 60 else 0) for k, v in enumerate(vec)] + [(900, vec[0], None)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    ok = lambda v, y: y is not None and v and None not in v and np.isfinite(v).all() and np.dot(v, v) > 0
    ids = [-1 if i is None else i for i, _, _ in rows]
    link = lambda a, b: a is not b and ok(*a[1:]) and ok(*b[1:]) and a[2] == b[2] and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98
    pairs = [(ids[x], ids[y]) for x in range(len(rows)) for y in range(len(rows)) if link(rows[x], rows[y])]
    n, root = Counter(a for a, _ in pairs), brute_components(ids, pairs)
    null = lambda i: None if i == -1 else i
    assert sorted(map(tuple, got), key=key) == sorted([(null(i), n[i], null(root[i]), root[i] == i) for i in ids], key=key)
    assert len(pairs) > 100


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(50, "It's THE end, the.End's x <|endoftext|> a<|startoftext|>b ’twas naïvé №5 ½ 12,5 Ünï_code### --"), (51, "İstanbul\x1cΣΑΣ 漢字 ​ é")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    found = packing.packing(every, path, length=256, windows=3, fan_in=2).collect()
    want = Counter((i, (*own.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in texts(every))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, rs in pieces.items():
        left = Counter((r.start, r.length, r.ids_crc32) for r in rs)
        for (j, ids), times in want.items():
            if j == i and times == 1 and sum(k == i for k, _ in want) == 1:
                at = 0
                for start, length, crc in sorted(left):
                    assert start == at and zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()) == crc
                    at += length
                assert at == len(ids) == rs[0].doc_tokens
    assert sum(r.length for r in found) == sum(len(ids) * n for (_, ids), n in want.items())
    for rs in seqs.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:k]) for k in range(len(rs))]
        n = sum(r.length for r in rs)
        assert n == 256 or n & (n - 1) == 0


def test_language_id(spark):
    got = language_id.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(docs):
    got = language_id.language_id(docs, docs.where("lang IS NOT NULL"))
    assert got.columns == [*docs.columns, "lang_pred", "score"] and got.count() == docs.count()
    for r in got.collect():
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and (r.lang_pred != "und" or r.score == 0)
    assert {r.lang_pred for r in language_id.language_id(docs, docs.where("lang = 'xx'")).collect()} == {"und"}


def test_quality(spark, docs):
    sf = SF.replace("0.001", "0.01")  # the smallest tables have too few labels to learn from
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    labels = spark.createDataFrame([(1, 1), (7, 0), (9, 1), (None, 1), (8, None), (999, 0)], "doc_id long, quality int")
    for y in (labels, labels.where("doc_id = 999")):
        out = quality.quality(docs, y).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)


def test_html(spark):
    model = html_extract.trained()
    pages = [html_extract.training_page(k) for k in range(50_000, 50_060)]
    assert np.mean([a == b for a, (_, b) in zip(html_extract.extract([p for p, _ in pages], model), pages, strict=True)]) > 0.93
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "no markup"), (4, None, "<p>a &amp;  b<p>c<"), (5, "u", "<div><div " * 400), (None, "u", pages[0][0])]
    got = html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and all(r.text is not None for r in got) and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    nodes = html_extract.parse(pages[0][0])
    kept = html_extract.decode(nodes, np.random.default_rng(1).standard_normal(len(nodes)))
    at = {id(v): k for k, v in enumerate(nodes)}
    assert all(kept[at[id(v.parent)]] for v, k in zip(nodes, kept, strict=True) if k and v.parent)




def test_line_dedup(spark, docs):
    long = "the quick brown fox jumps over the lazy dog while seven other foxes look on from behind the old stone wall near the river"
    rows = [(1, f"{long}\nunique one\n\n***"), (2, f"{long.upper()}!!\nother\n***"), (3, long.replace("quick", "quik")), (4, None), (5, ""), (5, ""), (6, "unique  one\nnew"), (None, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1))
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "***" and got[6].text == "new" and got[None].text == "other" and got[4].text is None and got[5].text == ""
    sims = {r.a: r.sim for r in line_dedup.simhashes(df.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.lit(0).cast("long").alias("h"), "text")).collect()}
    assert len(sims) == 5
    near = got[3].text == ""
    values = list(sims.values())
    assert not near or any(bin(x ^ y).count("1") <= 2 for x in values for y in values if x != y)
    assert line_dedup.line_dedup(docs).count() == docs.count()


def test_line_dedup_links(spark):
    """Against all pairs: SimHash distance, length and edit distance."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")
    seen = line_dedup.simhashes(docs)
    rows = {r.a: (r.sim, r.len, r.line) for r in seen.join(line_dedup.lines_of(docs), ["id", "h", "pos"]).collect()}
    ids = list(rows)
    sim, size = np.array([rows[i][0] for i in ids]), np.array([rows[i][1] for i in ids])
    pairs = [(i, j) for i in range(len(ids)) for j in np.flatnonzero((np.bitwise_count(sim ^ sim[i]) <= 2) & (np.minimum(size, size[i]) >= 0.9 * np.maximum(size, size[i]))) if i < j]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for k, x in enumerate(a, 1):
            before, row[0] = row[0], k
            for m, y in enumerate(b, 1):
                before, row[m] = row[m], min(row[m] + 1, row[m - 1] + 1, before + (x != y))
        return row[-1]

    linked = [(ids[i], ids[j]) for i, j in pairs if distance(rows[ids[i]][2], rows[ids[j]][2]) <= min(max(size[i], size[j]) // 10, 200)]
    want = brute_components(ids, linked)
    got = {r.node: r.component for r in line_dedup.links(docs, seen, 0.1, 200).collect()}
    assert got == {a: c for a, c in want.items() if any(a in p for p in linked)}


def test_fingerprints(docs):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    cut = lambda t: {x.strip(" ") for x in re.findall(r"[^.!?\n]{1,%d}[.!?\s]*|[.!?\n]+" % fingerprints.PIECE, t)}
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    rows = dict((i, t or "") for i, t in texts(docs))
    for i, after in ((1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (8, 9), (11, 12), (13, 14), (14, 15)):
        t, n = rows[i], rows[after]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = by[i][0]
        assert r.n_chars == len(t) and r.edited == edited
        assert r.near_edited == pytest.approx(share(cut(t), cut(edited))) and r.near_next == pytest.approx(share(cut(t), cut(n)))
    assert by[1][0].fingerprint == by[2][0].fingerprint != by[3][0].fingerprint and by[9][0] == by[9][1]


def test_no_rows(docs, spark):
    none = docs.where("doc_id > 1000")
    outs = [substring_dedup.substring_dedup(none), jaccard_join.jaccard_join(none), mixing.mixing(none), mixing.mix_documents(none), language_id.language_id(none, none), packing.packing(none, packing.default_tokenizer()), line_dedup.line_dedup(none), fingerprints.fingerprints(none)]
    outs += [quality.quality(none, spark.createDataFrame([], "doc_id long, quality int")), html_extract.html_extract(spark.createDataFrame([], "page_id long, html string")), embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))]
    for k, out in enumerate(outs):
        assert out.count() == 0, k


def test_hash_digest(spark):
    text = spark.read.parquet(f"{SF}/documents.parquet").first().text
    out = substring_dedup.query(spark, SF).where("n_removed = 0").limit(1).collect()
    assert text and (not out or re.fullmatch("[0-9a-f]{64}", out[0].kept_sha256)) and hashlib.sha256(b"").hexdigest()
    h = word_hashes(b"a b c a b c".split())
    assert rolling(h, 3)[0] == rolling(h, 3)[3] != rolling(h, 3)[1]
    x = np.array([5, 9, 9, 2**40], np.int64)
    assert (unpack(pack(x, True), np.int64, True) == x).all() and bucket_count(spark.read.parquet(f"{SF}/documents.parquet")) >= 4


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "packing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() and {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert not any((out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048")).collect())


def test_line_dedup_word_changed(spark, docs):
    """A word changed, put in or left out in a line of ordinary length; a letter in a short one."""
    r = np.random.default_rng(11)
    word = lambda: "".join(r.choice(list("abcdefghijkl"), int(r.integers(3, 8))))
    rows = []
    for k in range(60):
        w = [word() for _ in range((9, 20, 50)[k % 3])]
        at, most = int(r.integers(len(w))), len(" ".join(w)) // 10
        other = [w[:at] + ["z" * min(len(w[at]), most) + w[at][most:]] + w[at + 1 :], w[:at] + ["z" * min(4, most - 1)] + w[at:], w[:at] + w[at + 1 :] if len(w[at]) < most else w[:at] + ["zz"] + w[at:]][k % 7 % 3]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    rows += [(200, "abcdefghij"), (201, "abcdefghi"), (202, "mnopqrstuvwxyz"), (203, "mnopqrstuvwxy0")]
    got = {x.doc_id: x.n_removed for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in got if got[i] != i % 2] == [] and line_dedup.line_dedup(docs).count() == docs.count()


def test_line_dedup_long(spark):
    """One passage of 250 characters, and a tenth in scattered words, in lines of 20,000 and 12,000 characters."""
    r = np.random.default_rng(13)
    word = lambda: "".join(r.choice(list("abcdefghijkl"), 5))
    a, b = [word() for _ in range(3333)], [word() for _ in range(2000)]
    passage = a[:1500] + [word() for _ in range(42)] + a[1542:]
    spread = [word() if k % 12 == 5 else w for k, w in enumerate(b)]
    other = [word() if k % 3 else w for k, w in enumerate(b)]
    rows = [(k, " ".join(w)) for k, w in enumerate((a, passage, b, spread, other))]
    got = {x.doc_id: x.n_removed for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0}
