"""Operator 9: document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

Each paragraph digest is added to three cells (a count, the XOR of digests, the XOR of
their check hashes). Subtracting the cells of two versions leaves the digests that
differ, and peeling recovers them: a cell that holds one digest gives it away, and
taking it out of its other cells frees more. If that fails, the sketch is retried
larger: digests are split into small parts by a fixed rule, each a sketch of its own,
and parts that still fail are tried with more cells and another hash. The digests of a
part that no size peels are compared themselves, so the result is always exact.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH_END = r"\n+|(?<=[.!?])[ \t]+(?=\p{Lu})"
# Also after marks of scripts without capitals, whatever follows.
SENTENCE_END = PARAGRAPH_END + r"|(?<=[^\x00-\u0588])(?<=[。．！？｡؟۔।॥։።။។])(?![。．！？｡؟۔।॥։።။។”’」』）])[ \t]*"
STRETCH_CHARS = 120
BASE_CELLS = 8  # in each of three tables
PART_DIGESTS = 3
_ZERO = "named_struct('c', 0, 'k', 0L, 'h', 0L)"


def digests(text: str, ends: str, stretch: int | None = None) -> str:
    """SQL for the distinct digests of the paragraphs of a text column that hold more than white space.

    With a stretch, a paragraph is cut after so many characters from its start, twice as
    many, four times as many and so on: what two versions of it begin with in common is
    at least a quarter of it in whole parts, and a long one adds few digests.
    """
    escaped = ends.replace("\\", "\\\\")
    parts = f"split({text}, '{escaped}')"
    if stretch:
        doublings = f"sequence(0, cast(ceil(log2(length(p) / {stretch}.0)) as int))"
        begin = f"if(k = 0, 0, {stretch} * cast(pow(2, k - 1) as int))"
        cut = f"transform({doublings}, k -> substring(p, {begin} + 1, {stretch} * cast(pow(2, k) as int) - {begin}))"
        parts = f"flatten(transform({parts}, p -> if(length(p) <= {stretch}, array(p), {cut})))"
    return f"array_distinct(transform(filter({parts}, p -> p rlike '[^ \\\\t\\\\r\\\\f]'), p -> xxhash64(p)))"


def signed(plus: str, minus: str | None = None) -> str:
    """SQL for digests with the sign by which they enter a sketch."""
    first = f"transform({plus}, d -> named_struct('c', 1, 'k', d))"
    return first if minus is None else f"concat({first}, transform({minus}, d -> named_struct('c', -1, 'k', d)))"


def bound(value: str, name: str, body: str) -> str:
    """SQL for body with value under a name, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hashed(key: str, size: int, seed: int, more: str) -> str:
    """SQL for an entry: its digest, its check hash, and its cell in each table, 20 bits each of another hash."""
    cells = ", ".join(f"'i{t}', cast(shiftrightunsigned(g, {20 * t}) & {size - 1} as int)" for t in range(3))
    return bound(f"xxhash64({key}, {seed})", "g", f"named_struct({more}, 'k', {key}, 'h', xxhash64({key}), {cells})")


def tables(entries: str, size: int, seed: int) -> str:
    """SQL for the three tables of a sketch, as an array."""

    def table(t: int) -> str:
        return (
            f"transform(sequence(0, {size - 1}), i -> aggregate(filter(hashed, s -> s.i{t} = i), {_ZERO}, "
            "(a, s) -> named_struct('c', a.c + s.c, 'k', a.k ^ s.k, 'h', a.h ^ s.h)))"
        )

    each = f"transform({entries}, s -> {hashed('s.k', size, seed, more_sign('s'))})"
    return bound(each, "hashed", f"array({', '.join(map(table, range(3)))})")


def more_sign(entry: str) -> str:
    return f"'c', {entry}.c"


def peel(sketch: str, size: int, seed: int, rounds: int) -> str:
    """SQL for the number of digests that peeling recovers from a subtracted sketch; null if cells remain.

    A step takes the digests that are alone in a cell of one table out of the two
    others; a round is a step for each table.
    """
    alone = "(abs(e.c) = 1 and e.h = xxhash64(e.k))"

    def without(state: str, t: int) -> str:
        return (
            f"transform({state}.t{t}, (e, i) -> aggregate(filter(p, q -> q.i{t} = i), e, "
            "(a, q) -> named_struct('c', a.c - q.c, 'k', a.k ^ q.k, 'h', a.h ^ q.h)))"
        )

    def step(state: str, t: int) -> str:
        found = f"transform(filter({state}.t{t}, e -> {alone}), e -> {hashed('e.k', size, seed, more_sign('e'))})"
        emptied = f"transform({state}.t{t}, e -> if({alone}, {_ZERO}, e))"
        left = ", ".join(f"'t{u}', {emptied if u == t else without(state, u)}" for u in range(3))
        return bound(found, "p", f"if(size(p) = 0, {state}, named_struct({left}, 'n', {state}.n + size(p)))")

    round_ = bound(step("st", 0), "s1", bound(step("s1", 1), "s2", step("s2", 2)))
    start = bound(sketch, "sk", "named_struct('t0', sk[0], 't1', sk[1], 't2', sk[2], 'n', 0)")
    empty = "e -> e.c = 0 and e.k = 0 and e.h = 0"
    return (
        f"aggregate(sequence(1, {rounds}), {start}, (st, x) -> {round_}, "
        f"st -> if(forall(st.t0, {empty}) and forall(st.t1, {empty}) and forall(st.t2, {empty}), st.n, cast(null as int)))"
    )


def differing(a: str, b: str, sketch_a: str, sketch_b: str) -> Column:
    """How many digests of the columns a and b differ, from their sketches; larger ones where these don't peel."""
    subtracted = (
        f"zip_with({sketch_a}, {sketch_b}, (v, w) -> zip_with(v, w, "
        "(x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h)))"
    )
    few = f"abs(size({a}) - size({b})) <= {2 * BASE_CELLS}"
    base = f"if({few}, {peel(subtracted, BASE_CELLS, 0, 4)}, cast(null as int))"

    def attempt(size: int, seed: int, rounds: int) -> str:
        return peel(tables("part", size, seed), size, seed, rounds)

    # Parts of about PART_DIGESTS, dealt in two steps; where the retries leave a part unpeeled, its digests are compared.
    compared = "2 * size(array_distinct(transform(part, s -> s.k))) - size(part)"
    deals = f"cast(ceil(sqrt((size({a}) + size({b})) / {PART_DIGESTS}.0)) as bigint)"
    within = bound(
        "filter(every, s -> pmod(s.k, m) = v)",
        "dealt",
        "transform(sequence(0L, m - 1), w -> filter(dealt, s -> pmod(shiftright(s.k, 24), m) = w))",
    )
    parts = bound(f"greatest(1L, {deals})", "m", f"flatten(transform(sequence(0L, m - 1), v -> {within}))")
    larger = (
        f"aggregate({bound(signed(a, b), 'every', parts)}, 0, (total, part) -> total + if(size(part) <= 1, size(part), "
        f"coalesce(if(size(part) = 2, {attempt(2, 4, 1)}, cast(null as int)), {attempt(8, 1, 2)}, {attempt(16, 2, 3)}, {attempt(64, 3, 4)}, {compared})))"
    )
    return F.expr(f"coalesce({base}, {larger})")


def sketch_text(digest_column: str, sketch_column: str) -> Column:
    """The fingerprint as text: the number of digests, then count:digests:checks of each cell."""
    each = f"transform(flatten({sketch_column}), e -> concat(e.c, ':', e.k, ':', e.h))"
    return F.expr(f"concat(size({digest_column}), '|', array_join({each}, ','))")


def likeness(n_differing: Column, a: str, b: str) -> Column:
    """Common among all distinct paragraphs of two texts; 1 if neither has any."""
    total = F.size(a) + F.size(b)
    return F.round(F.when(total == 0, 1.0).otherwise((total - n_differing) / (total + n_differing)), 6)


def with_next(docs: DataFrame, *, rows_per_bucket: int = 500, segments: int = 256) -> DataFrame:
    """(doc_id, text, next_text): each row beside the next one by descending doc_id, the last beside the first.

    doc_id is an integer column. Equal ids are ordered by a hash of their text, then the
    text; null ids come last. Rows are dealt to buckets of neighbours in this order, so
    no task sorts them all: segments between approximate quantiles, each cut evenly into
    as many buckets as its share of the rows asks for, an id that many rows have by the
    hash. Only the last row of a bucket looks for its next one in another.
    """
    rows = docs.select(
        F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_at")
    ).withColumn("_mix", F.xxhash64("text"))
    share = ", ".join(str(k / segments) for k in range(1, segments))
    n, low, cut = rows.agg(F.count("*"), F.min("_at"), F.expr(f"percentile_approx(_at, array({share}), 1000)")).first()
    times = Counter(cut or ())
    # An id at several quantiles is a segment of its own.
    edges = sorted({low, *times, *(x + 1 for x, k in times.items() if k > 1)}) if n else [0]
    held = [1 + sum(k for x, k in times.items() if a <= x < b) for a, b in zip(edges, [*edges[1:], math.inf], strict=True)]
    pers = [max(1, math.ceil(k * n / segments / rows_per_bucket)) for k in held]
    spans = [float(b - a) for a, b in pairwise(edges)] + [float(segments)]
    literal = lambda values: F.array(*map(F.lit, values))
    edge, per, span = literal(edges), literal(pers), literal(spans)
    segment = F.greatest(F.lit(1), F.size(F.filter(edge, lambda e: e <= F.col("_at"))))
    of = lambda values: F.element_at(values, F.col("_segment"))
    back = F.lit(0.5) - F.col("_mix").cast("double") / F.lit(2.0**64)  # 0 to 1, falling as the hash rises
    inside = (F.col("_at").cast("double") - of(edge).cast("double") + back) / of(span)
    bucketed = rows.withColumn("_segment", segment).withColumn("_bucket", F.least(of(per) - 1, F.floor(inside * of(per))).cast("long"))
    order = Window.partitionBy("_segment", "_bucket").orderBy(F.desc("_at"), "_mix", "text")
    placed = bucketed.withColumn("_place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    inner = placed.where("next_text is not null")
    firsts = placed.where("_place = 1").select(F.col("_segment").alias("_s"), F.col("_bucket").alias("_b"), F.col("text").alias("_first"))
    # The bucket after each: within its segment, else the next segment's top one, after the last segment the first one's.
    buckets = bucketed.select("_segment", "_bucket").distinct()
    tops = buckets.groupBy("_segment").agg(F.max("_bucket").alias("_b"))
    along = Window.orderBy(F.desc("_segment")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a segment
    next_top = F.coalesce(F.lead(F.struct("_segment", "_b")).over(Window.orderBy(F.desc("_segment"))), F.first(F.struct("_segment", "_b")).over(along))
    beyond = tops.select("_segment", next_top.alias("_beyond"))
    within = F.lead(F.struct("_segment", "_bucket")).over(Window.partitionBy("_segment").orderBy(F.desc("_bucket")))
    follow = (
        buckets.withColumn("_within", within).join(F.broadcast(beyond), "_segment")  # at most two rows a segment
        .select(
            "_segment", "_bucket", F.coalesce("_within._segment", "_beyond._segment").alias("_s"), F.coalesce("_within._bucket", "_beyond._b").alias("_b")
        )
    )
    lasts = placed.where("next_text is null").join(follow, ["_segment", "_bucket"]).join(firsts, ["_s", "_b"]).withColumn("next_text", F.col("_first"))
    columns = ["doc_id", "text", "next_text"]
    return inner.select(*columns).unionByName(lasts.select(*columns))


def edited(text: Column, following: Column) -> Column:
    """A text with its last half replaced by the first as many code points of another (or all it has)."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare_versions(docs: DataFrame, *, paragraph_end: str = PARAGRAPH_END, stretch: int | None = None) -> DataFrame:
    """Fingerprints of every row's text and edited text, and their likeness.

    Returns doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, n_differing_edited,
    n_differing_next, near_edited, near_next. A paragraph is a line or, within it, a
    sentence before a capital letter (or as paragraph_end says), and with a stretch each
    so many characters of it from its start; likeness is the share of common ones among all
    distinct paragraphs of the two, by the digests their sketches give away. A null
    text is empty, without paragraphs; two such texts are alike (1). Repeated
    paragraphs count once. One row out for each row in; only doc_id and text are read.
    """

    def sketched(df: DataFrame, text: str, name: str) -> DataFrame:
        digested = df.withColumn(f"{name}_d", F.expr(digests(text, paragraph_end, stretch)))
        return digested.withColumn(f"{name}_s", F.expr(tables(signed(f"{name}_d"), BASE_CELLS, 0)))

    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    for text, name in (("text", "_a"), ("edited", "_e"), ("next_text", "_n")):
        rows = sketched(rows, text, name)
    return (
        rows.withColumn("n_differing_edited", differing("_a_d", "_e_d", "_a_s", "_e_s"))
        .withColumn("n_differing_next", differing("_a_d", "_n_d", "_a_s", "_n_s"))
        .select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            "edited",
            sketch_text("_a_d", "_a_s").alias("fingerprint"),
            sketch_text("_e_d", "_e_s").alias("edited_fingerprint"),
            "n_differing_edited",
            "n_differing_next",
            likeness(F.col("n_differing_edited"), "_a_d", "_e_d").alias("near_edited"),
            likeness(F.col("n_differing_next"), "_a_d", "_n_d").alias("near_next"),
        )
    )
