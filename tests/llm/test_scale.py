"""Bounds that a larger input, longer texts or odd names would break."""
import random
import re
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidescan.llm import fingerprints, html_extract, jaccard_join, line_dedup, mixing, packing, substring_dedup
from tidescan.llm.common import own_names, shared_folder

SF = "/root/testdata/sf0.001"
#: Names that operators and stages use inside, or give to their own columns.
NAMES = "_id _h _text _drop _whole _n _copy _source _size _gone _k _c n_lines n_removed row nth copies".split()


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice("stone river lamp window garden morning letter quiet bridge winter".split()) + str(r.randrange(50)) for _ in range(n))
    line, text = prose(12), prose(30)
    rows = [(1, f"{line}\n{prose(9)}", "en", "s", 0), (2, f"{line}\n{prose(8)}", "en", "s", 0), (3, None, None, None, None), (4, "", "fr", "s", 0), (None, prose(20), "en", None, 0), (None, prose(20), "en", None, 0), (5, text, "en", "t", 0), (6, text, "en", "t", 0)]
    return spark.createDataFrame([(*x, *range(len(NAMES))) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES))


def test_clashing_names(spark, clashing):
    kept = lambda df: {tuple(r[n] for n in NAMES) for r in df.select(*NAMES).collect()}
    for out in (line_dedup.line_dedup(clashing).select(*clashing.columns), mixing.mix_documents(clashing), corpus_pipeline.dedup_lines(spark, clashing, SF), corpus_pipeline.dedup_documents(spark, clashing, SF), corpus_pipeline.mix(spark, clashing, SF)):
        assert out.columns == clashing.columns and kept(out) == {tuple(range(len(NAMES)))}
    lines = line_dedup.line_dedup(clashing)
    assert lines.columns[-2:] == ["_n_lines", "_n_removed"] and sum(r["_n_removed"] for r in lines.collect()) == 2
    assert corpus_pipeline.dedup_documents(spark, clashing, SF).where("doc_id IS NULL").count() == 2
    assert own_names(clashing, "_ID", "new") == ["__ID", "new"]


def test_identify_keeps_rows_with_letters(spark, clashing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.identify(spark, docs, SF)
    assert out.columns == docs.columns and out.where("text IS NULL").isEmpty() and out.count() > 0.8 * docs.count()


def test_packing_stage(spark, clashing):
    assert corpus_pipeline.pack(spark, clashing, SF).select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()


@pytest.mark.parametrize("send", [lambda n: substring_dedup._send(20, n), lambda n: jaccard_join._send(5, n)])
def test_sent_bytes_do_not_grow_with_buckets(send):
    r = np.random.default_rng(5)
    vocabulary = np.array(["".join(r.choice(list("abcdefghij"), 6)) for _ in range(5000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array([" ".join(r.choice(vocabulary, 300)) for _ in range(1500)])], names=["id", "text"])
    size = lambda n: sum(len(v or b"") for b in send(n)([batch]) for c in b.columns if pa.types.is_binary(c.type) for v in c.to_pylist())
    few, many = size(64), size(16_384)
    assert many < 2 * few  # a table of all documents for each bucket took 35 times as much
    for b in send(4096)([batch]):
        assert b.num_rows <= 64


def test_tokenizer_fuzz():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own, words = Tokenizer.from_file(path), packing.Words(open(path, encoding="utf-8").read(), 10_000)
    assert not words.whole
    r = random.Random(1)
    alphabet = [*"aAbBzZ09 .,;:!?'\"|/-_()#<>\n\t", "İ", "ı", "ß", "é", "é", "̇", "Σ", "漢", " ", " ", "​", "½", "№", "١", "\x1c", "\U0001f600"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 14))) for _ in range(10_000)] + ["İ,", "İ:", "aİ;b", "İ\"", "İ|", "İ/"]
    for t, raw in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_html_time_and_bare_prose():
    model = html_extract.trained()
    words = " ".join(["some plain words, in a row."] * 8)
    assert html_extract.extract([f"<p>{words}</p>", words, f"<article><p>{words} <math><mi>x</mi></math></p></article>"], model) == [words, words, f"{words} x"]
    text = html_extract.extract(["<article>" + "<p>one two three</p>" * 80_000 + "</article>"], model)[0]
    assert len(text) == 80_000 * 14 - 1 and len(html_extract.parse("<div>" * 20_000 + "x</b>" * 20_000)) == 20_001


def test_pages_of_the_table(spark):
    """Articles without anything but blocks of text: what a plain reading of the element gives, blocks joined by one space."""
    import html

    model, pages, want = html_extract.trained(), [], []
    for (page,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        found = re.findall(r"<article\b[^>]*>(.*?)</article>", page, re.S)
        if len(found) == 1 and not re.search(r"<(aside|nav|form|script|style|div|section|ul|button)\b", found[0]):
            spaced = re.sub(r"</?(p|h[1-6]|li|blockquote|br|pre|table|tr|td)\b[^>]*>", " ", found[0])
            pages.append(page)
            want.append(" ".join(html.unescape(re.sub(r"<[^>]+>", "", spaced)).split()))
    assert pages and html_extract.extract(pages, model) == want


def test_fingerprint_digests(spark):
    r = random.Random(2)
    sentence = lambda: " ".join(r.choice("ab bc cd de ef fg gh hi".split()) for _ in range(9)) + "."
    rows = [(k, " ".join(sentence() for _ in range(n))) for k, n in enumerate((1, 5, 60, 200, 3))]
    docs = spark.createDataFrame([*rows, (9, None), (10, "")], "doc_id long, text string")
    usual = {x.doc_id: x for x in fingerprints.fingerprints(docs, digests=True).collect()}
    forced = {x.doc_id: x for x in fingerprints.fingerprints(docs, digests=True, tries=1).collect()}
    plain = {x.doc_id: x for x in fingerprints.fingerprints(docs).collect()}
    cut = lambda t: {x.strip(" ") for x in re.findall(r"[^.!?\n]{1,%d}[.!?\s]*|[.!?\n]+" % fingerprints.PIECE, t)}
    texts = dict(rows)
    for i in (0, 1, 2, 3):
        own, other = cut(texts[i]), cut(texts[i + 1])
        for x in (usual[i], forced[i]):
            sides = defaultdict(set)
            for d in x.differs_next:
                sides[d.side].add(d.digest)
            assert (len(sides[1]), len(sides[-1])) == (len(own - other), len(other - own)) and len(x.differs_next) == len(own ^ other)
        assert plain[i].near_next == usual[i].near_next == forced[i].near_next == pytest.approx(len(own & other) / len(own | other))


def test_fingerprints_of_a_long_text(spark):
    r = np.random.default_rng(4)
    long = ["".join(chr(97 + c) if c < 26 else "." if c == 26 else " " for c in r.integers(0, 30, 1_000_000)) for _ in range(2)]
    got = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).select("n_chars", "near_next").collect()
    assert [x.n_chars for x in got] == [1_000_000] * 2 and all(x.near_next < 0.2 for x in got)


def test_simhash_by_brute_force(spark):
    """Majority of the bits of the words' hashes, in lines of few words, of 256 and more, and of repeated words."""
    from pyspark.sql import functions as F

    r = random.Random(6)
    lines = [" ".join("w%d" % r.randrange(40) for _ in range(n)) for n in (1, 2, 9, 120, 255, 256, 300, 2000)]
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(lines)], "id long, h long, text string")
    hashes = {x.w: x.v for x in rows.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("v")).collect()}
    for x in line_dedup.simhashes(rows).collect():
        ws = lines[x.id].split(" ")
        want = sum(1 << k for k in range(60) if 2 * sum((hashes[w] >> k) & 1 for w in ws) > len(ws))
        assert x.sim == want, len(ws)


def test_mixing_of_several_cells(spark):
    """Whatever the cells, a source takes its target but for less than one of its documents."""
    r = random.Random(8)
    rows = [(k, " ".join(["w"] * r.choice((0, 1, 5, 40, 300))), r.choice(("a", "b", "c", None))) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for cells in ({"cell_rows": 4096}, {"cell_rows": 16, "fan_in": 3}):
        taken, most, target = defaultdict(int), defaultdict(int), {}
        for x in mixing.mixing(docs, **cells).collect():
            taken[x.source] += x.copies * x.size
            most[x.source] = max(most[x.source], x.size)
            target[x.source] = x.target
        assert all(abs(taken[s] - target[s]) < most[s] for s in target)


def test_line_dedup_many_lines_and_texts(spark):
    """60,000 equal lines in one document; what stays is what is left of each text, line by line."""
    rows = [(1, "same line here\n" * 60_000), (2, "first one\nsame line here\n!!\nother"), (3, "First, one\n\nlast")]
    got = {x.doc_id: x for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].text for k in (1, 2, 3)] == ["same line here\n", "first one\n!!\nother", "\nlast"] and [got[k].n_removed for k in (1, 2, 3)] == [59_999, 1, 1]


def test_shared_folder_needs_a_name_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_folder(far)
