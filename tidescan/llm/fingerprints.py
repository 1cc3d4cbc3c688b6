"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions alone.

A text is cut into paragraphs (at line breaks and sentence ends, and at `piece` code points where there are none); its digests are
the distinct 64-bit hashes of these. A sketch has three rows of `width` cells; a digest enters one cell of each row, and a cell
keeps the count, the XOR of its digests and the XOR of their checksums. Sketches of two versions subtract cell by cell, and peeling
takes out, again and again, the digests that are alone in a cell, until all cells are empty: then it has found every digest that
only one version has. The fingerprint is the smallest sketch. Where it can't be peeled, larger ones are built: digests are dealt by
their hash to parts of about twelve, and a part that fails is retried with twice the width and other hashes, `tries` times; should it
still fail, the digests of that part are compared as sets. `digests=True` returns what was peeled: every digest that only one of the
two texts has, with side 1 if it is the document's own and -1 if it is the other's.

Likeness is the share of digests that two texts have in common, from the sizes of both sets and of their difference; 1 if neither
has any. The next document is found by a range partitioning of narrow rows; texts are shuffled once and halves once.

Edges: a null text is empty; a null id counts as the smallest and is returned as null; rows that agree in id and text are one
document listed as often as it is there; rows that agree in id alone are ordered by a hash of their text; a single document is its
own next; no rows give no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidescan.llm.common import NULL_ID, keep

WIDTH, ROWS, PIECE, PER_PART, TRIES, ROUNDS = 4, 3, 120, 12, 12, 24
_CELL = "named_struct('c', {c}, 'k', {k}, 'x', {x})"


def digests_of(text: str, piece: int) -> str:
    pattern = rf"[^.!?\\n]{{1,{piece}}}[.!?\\s]*|[.!?\\n]+"
    return f"sort_array(array_distinct(transform(regexp_extract_all({text}, '{pattern}', 0), p -> xxhash64(trim(p)))))"


def entries(keys: str, seed: str, width: str, sign: int = 1) -> str:
    """Digests with their checksum and their cell in each row."""
    places = ", ".join(f"{r} * {width} + pmod(shiftrightunsigned(xxhash64(d, {seed}), {20 * r}), {width})" for r in range(ROWS))
    return f"transform({keys}, d -> named_struct('c', {sign}, 'k', d, 'x', xxhash64(d, 99), 'at', array({places})))"


def cells(keys: str, seed: str, width: str) -> str:
    """The sketch of a set of digests. Cell i of row r looks at the entries that name it."""
    zero = _CELL.format(c="0", k="0L", x="0L")
    add = _CELL.format(c="z.c + e.c", k="z.k ^ e.k", x="z.x ^ e.x")
    one = f"aggregate(filter(es, e -> e.at[i div {width}] = i), {zero}, (z, e) -> {add})"
    return f"transform(array({entries(keys, seed, width)}), es -> transform(sequence(0, {ROWS} * {width} - 1), i -> {one}))[0]"


#: What is gathered while peeling, as a number of digests, or as the digests themselves, each with the side that has it (1 or -1).
COUNT = {"none": "0", "more": "size(us)", "add": "{x} + {y}", "rest": "size(array_except({a}, {b})) + size(array_except({b}, {a}))"}
_SIDE = "named_struct('digest', {k}, 'side', {c})"
_ONLY = "transform(array_except({{x}}, {{y}}), d -> {side})"
KEYS = {
    "none": "CAST(array() AS ARRAY<STRUCT<digest: BIGINT, side: INT>>)", "more": f"transform(us, u -> {_SIDE.format(k='u.k', c='u.c')})", "add": "concat({x}, {y})",
    "rest": "concat(" + ", ".join(_ONLY.format(side=_SIDE.format(k="d", c=c)).format(x=x, y=y) for x, y, c in (("{a}", "{b}", 1), ("{b}", "{a}", -1))) + ")",
}


def peel(difference: str, seed: str, width: str, what: dict = COUNT) -> str:
    """struct(ok, n): whether the difference of two sketches could be emptied, and the digests that it held."""
    alone = f"transform(filter(s.cells, q -> abs(q.c) = 1 AND xxhash64(q.k, 99) = q.x), q -> named_struct('k', q.k, 'c', q.c))"
    places = ", ".join(f"{r} * {width} + pmod(shiftrightunsigned(xxhash64(u.k, {seed}), {20 * r}), {width})" for r in range(ROWS))
    pure = f"transform(array_distinct({alone}), u -> named_struct('c', u.c, 'k', u.k, 'x', xxhash64(u.k, 99), 'at', array({places})))"
    out = f"aggregate(filter(us, u -> u.at[i div {width}] = i), q, (z, u) -> {_CELL.format(c='z.c - u.c', k='z.k ^ u.k', x='z.x ^ u.x')})"
    step = f"transform(array({pure}), us -> IF(size(us) = 0, named_struct('cells', s.cells, 'n', s.n, 'live', false), named_struct('cells', transform(s.cells, (q, i) -> {out}), 'n', {what['add'].format(x='s.n', y=what['more'])}, 'live', true)))[0]"
    end = "named_struct('ok', forall(s.cells, q -> q.c = 0 AND q.k = 0 AND q.x = 0), 'n', s.n)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {difference}, 'n', {what['none']}, 'live', true), (s, r) -> IF(s.live, {step}, s), s -> {end})"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> {_CELL.format(c='p.c - q.c', k='p.k ^ q.k', x='p.x ^ q.x')})"


def part_difference(a: str, b: str, what: dict, tries: int) -> str:
    """Digests that one of two small sets has alone; each retry doubles the width and changes the hashes. After the last, the sets are compared."""
    width = f"({WIDTH} * CAST(power(2, i) AS INT))"
    attempt = f"transform(array(named_struct('w', {width}, 'i', i)), v -> {peel(subtract(cells(a, 'v.i', 'v.w'), cells(b, 'v.i', 'v.w')), 'v.i', 'v.w', what)})[0]"
    return f"aggregate(sequence(1, {tries}), named_struct('ok', false, 'n', {what['none']}), (t, i) -> IF(t.ok, t, {attempt}), t -> IF(t.ok, t.n, {what['rest'].format(a=a, b=b)}))"


def difference(a: str, b: str, a_cells: str, b_cells: str, what: dict = COUNT, tries: int = TRIES) -> str:
    """Digests that only one of two texts has: from the fingerprints if these can be peeled, else part by part.

    Digests are dealt to about the root of the number of parts first, and these to the parts, so that none is looked at for each part.
    """
    depth = f"greatest(0, CAST(ceil(log2((size({a}) + size({b})) / {PER_PART})) AS INT))"
    sizes = f"transform(array({depth}), x -> named_struct('m', CAST(power(2, x) AS INT), 'g', CAST(power(2, x div 2) AS INT)))"
    own = lambda keys, n, j: f"filter({keys}, d -> pmod(shiftrightunsigned(d, 17), {n}) = {j})"
    halves = f"transform(array(named_struct('a', {own('o.a', 'z.m', 'j + z.g * p')}, 'b', {own('o.b', 'z.m', 'j + z.g * p')})), h -> {part_difference('h.a', 'h.b', what, tries)})[0]"
    inner = f"aggregate(sequence(0, CAST(z.m div z.g AS INT) - 1), {what['none']}, (n2, p) -> {what['add'].format(x='n2', y=halves)})"
    outer = f"transform(array(named_struct('a', {own(a, 'z.g', 'j')}, 'b', {own(b, 'z.g', 'j')})), o -> {inner})[0]"
    larger = f"transform({sizes}, z -> aggregate(sequence(0, z.g - 1), {what['none']}, (n, j) -> {what['add'].format(x='n', y=outer)}))[0]"
    return f"transform(array({peel(subtract(a_cells, b_cells), '0', str(WIDTH), what)}), f -> IF(f.ok, f.n, {larger}))[0]"


def likeness(a: str, b: str, n: str) -> str:
    return f"IF(size({a}) + size({b}) = 0, 1D, CAST(size({a}) + size({b}) - {n} AS DOUBLE) / (size({a}) + size({b}) + {n}))"


def shown(keys: str, sketch: str) -> str:
    return f"concat(size({keys}), ':', array_join(transform({sketch}, q -> concat_ws('.', q.c, lower(hex(q.k)), lower(hex(q.x)))), ','))"


def next_documents(rows: DataFrame) -> DataFrame:
    """(id, h) of every distinct row with its half length and the (id, h) after it, the first after the last."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    narrow = rows.select("id", "h", F.length("text").alias("n")).groupBy("id", "h").agg(F.max("n").alias("n"))
    dealt = keep(narrow.repartitionByRange(parts, "id", "h").withColumn("part", F.spark_partition_id()))
    firsts = dealt.groupBy("part").agg(F.min(F.struct("id", "h")).alias("first"))
    # One row for each partition: the first document of the next one that has any.
    order = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = dealt.withColumn("next", F.lead(F.struct("id", "h")).over(Window.partitionBy("part").orderBy("id", "h")))
    out = inside.join(F.broadcast(firsts) if parts <= 100_000 else firsts, "part").withColumn("next", F.coalesce("next", "after"))
    return out.select("id", "h", F.floor(F.col("n") / 2).cast("int").alias("half"), F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, digests: bool = False, tries: int = TRIES) -> DataFrame:
    """Per row: id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next; with digests also differs_edited and differs_next."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    after = keep(next_documents(rows))
    # A running count, not a rank: a limit on ranks would be pushed below one of the two exchanges of the texts, which then differ.
    every = rows.withColumn("copy", F.count(F.lit(1)).over(Window.partitionBy("id", "h").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    asked = after.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("of_id"), F.col("h").alias("of_h"), "half")
    heads = every.where("copy = 1").join(asked, ["id", "h"]).select(F.col("of_id").alias("id"), F.col("of_h").alias("h"), "half", F.expr("substring(text, 1, half)").alias("head"), F.expr(digests_of("text", piece)).alias("n_keys"))
    both = every.join(heads, ["id", "h"]).select("id", "n_keys", "text", F.expr("concat(substring(text, 1, length(text) - half), head)").alias("edited"))
    keyed = both.select("id", "n_keys", "edited", F.length("text").cast("long").alias("n_chars"), F.expr(digests_of("text", piece)).alias("o_keys"), F.expr(digests_of("edited", piece)).alias("e_keys"))
    sketched = keyed.select("*", *(F.expr(cells(f"{x}_keys", "0", str(WIDTH))).alias(f"{x}_cells") for x in "oen"))
    what, size = (KEYS, "size({})") if digests else (COUNT, "{}")
    near = sketched.select("*", *(F.expr(difference("o_keys", f"{x}_keys", "o_cells", f"{x}_cells", what, tries)).alias(f"d_{x}") for x in "en"))
    return near.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), "n_chars", "edited", F.expr(shown("o_keys", "o_cells")).alias("fingerprint"), F.expr(shown("e_keys", "e_cells")).alias("edited_fingerprint"),
        F.expr(likeness("o_keys", "e_keys", size.format("d_e"))).alias("near_edited"), F.expr(likeness("o_keys", "n_keys", size.format("d_n"))).alias("near_next"),
        *((F.col("d_e").alias("differs_edited"), F.col("d_n").alias("differs_next")) if digests else ()),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
