"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Items and windows of as many words have 63-bit SimHash fingerprints over their words, each word as often as it stands.
Fingerprints are cut into eight blocks of at most eight bits. If two fingerprints differ in at most RADIUS = 15 bits, some
block differs in at most one, so items are listed under each of their blocks and under each of its eight one-bit changes,
and a window looks up its own eight blocks: no fingerprint within the radius is missed. What is found is checked by bit
count, then by the weighted similarity of its five-word shingles (least over greatest counts), which decides. With eight
bits in a block and one change, a window meets about 28 of 100 items of its size before the bit count; a radius of 15 in
63 leaves no way to be choosier that keeps the guarantee, so what keeps the search small is that there are few windows.

Windows are taken only where they can meet the threshold: of an item of n shingles, ordered by how many items have them,
rarest first, a window that meets it has one of the first n - ceil(threshold * n) + 1. Which texts have any such shingle is
found in one scan, where a Bloom filter of bounded size drops nearly all shingles before anything is joined; another filter
of the texts found lets a second scan leave out nearly all others, so they are never shuffled. Of the texts found the words
are written once, and only hashes, places and fingerprints travel until verification. All is DataFrame functions. The item
side is broadcast only while it has at most BROADCAST_SHINGLES shingles, which are counted.

Words are lower-cased. Null and empty texts have no window. A document shorter than an item is one window. An item of fewer
than five words is one shingle: it is found where its words stand. Items and windows of more than LONGEST words have no
fingerprint, and go to the verification at once. Rows that share a doc_id are one document, and a pair of document and
item is returned once, with its best window, the first of equals. Rows without a doc_id are left out, as are items without
words; items that share an item_id are one. Very long texts are searched whole. Without items or documents the result is
empty. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

RADIUS = 15
#: Shingles of all items, at most, for which the item side is broadcast: about 8 bytes each, listed fingerprints besides.
BROADCAST_SHINGLES = 200_000
#: Words in a fingerprinted item at most: counters have 20 bits, below one of carry, three in a long.
LONGEST = (1 << 20) - 1
#: Bits of the Bloom filter for each shingle in it, and the powers of two between which its size is.
BLOOM, BLOOM_LEAST, BLOOM_MOST = 256, 16, 22
_LANES = 1 | 1 << 21 | 1 << 42


def words(text: Column) -> Column:
    """The lower-case words of a text."""
    lower = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.array_remove(F.split(lower, common.GAP_PATTERN, -1), "")


def _held(**columns: Column) -> Column:
    """A row of computed columns behind a generator: the optimiser would else move them into lambdas that use them, and
    compute them again for every element."""
    return F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def shingles(of: Column, size) -> Column:
    """Hashes of the shingles in order; fewer words than size are one shingle."""
    size = size if isinstance(size, Column) else F.lit(size)
    last = F.greatest(F.size(of) - size + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(of, i, size)))


def fingerprint(hashes: Column) -> Column:
    """63-bit SimHash of word hashes: three counters in each of 21 sums. A bit is set if most words have it."""
    n = F.size(hashes)
    bar = (F.lit(1 << 20) - F.floor(n / 2) - 1).cast("long") * F.lit(_LANES)
    out = F.lit(0).cast("long")
    for k in range(21):
        total = F.aggregate(hashes, F.lit(0).cast("long"), _counter(k))
        bits = F.shiftrightunsigned(total + bar, 20).bitwiseAND(F.lit(_LANES))
        out = out.bitwiseOR(F.shiftleft(bits, k))
    return out


def _counter(k: int):
    return lambda total, h: total + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))


def _block(of: Column, k: int) -> Column:
    return F.shiftrightunsigned(of, 8 * k).bitwiseAND(F.lit(255)).cast("int")


def _met(a: Column, b: Column) -> Column:
    """Sum of least counts of two lists, by one walk over both in order."""
    marked = lambda of, side: F.transform(of, lambda h: F.struct(h.alias("h"), F.lit(side).alias("side")))
    both = F.array_sort(F.concat(marked(a, 0), marked(b, 1)))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("least"))

    def walked(state: Column, x: Column) -> Column:
        same, left = x["h"] == state["h"], x["side"] == 0
        n, m = F.when(same, state["a"]).otherwise(0), F.when(same, state["b"]).otherwise(0)
        grows = F.when(left, n < m).otherwise(m < n)
        return F.struct(x["h"].alias("h"), F.when(left, n + 1).otherwise(n).alias("a"), F.when(left, m).otherwise(m + 1).alias("b"), (state["least"] + grows.cast("int")).alias("least"))

    return F.aggregate(both, start, walked, lambda state: state["least"])


def similarity(a: Column, b: Column) -> Column:
    """Sum of least counts over sum of greatest counts of two shingle lists. Lists without repeats are sets."""
    counted = _met(a, b)
    sets = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    least = F.when(sets, F.size(F.array_intersect(a, b))).otherwise(counted)
    return least / (F.size(a) + F.size(b) - least)


def _first_block(differ: Column) -> Column:
    """Whether no block before the one that was looked up differs in one bit at most: each pair is found once."""
    out = F.lit(True)
    for k in range(8):
        out = out & ((F.col("block") <= k) | (F.bit_count(F.shiftrightunsigned(differ, 8 * k).bitwiseAND(F.lit(255))) > 1))
    return out


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, w, z, item_shingles, item_print) of the items that have words; item is a number of each."""
    base = benchmark.select(F.col(id_col).alias("item_id"), _held(words=words(F.col(text_col))).alias("v")).filter(F.size("v.words") > 0)
    sized = base.select("item_id", F.col("v.words").alias("words"), F.size("v.words").alias("w"), F.least(F.size("v.words"), F.lit(common.SHINGLE)).alias("z"))
    return sized.select("item_id", F.monotonically_increasing_id().alias("item"), "w", "z", shingles(F.col("words"), F.col("z")).alias("item_shingles"), _print(F.transform("words", lambda x: F.xxhash64(x)), F.col("w")).alias("item_print"))


def _print(hashes: Column, w: Column) -> Column:
    return F.when(w > LONGEST, F.lit(0).cast("long")).otherwise(fingerprint(hashes))


def wanted_shingles(items: DataFrame, threshold: float) -> DataFrame:
    """(h, z, w): shingles of which a window that meets an item of w words has at least one."""
    each = items.select("item", "w", "z", F.size("item_shingles").alias("n"), F.explode(F.array_distinct("item_shingles")).alias("h"))
    rarity = each.groupBy("h", "z").agg(F.count("*").alias("items"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("items", "h"))  # a group is an item
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    return each.join(rarity, ["h", "z"]).withColumn("place", place).filter(F.col("place") <= first).select("h", "z", "w").distinct()


class Bloom:
    """A filter of 64-bit hashes, three bits for each. Its words are one row that a subquery brings: as a constant they would
    stand in every text and copy of the plan, which the driver keeps. A full one passes everything, which costs time but
    loses nothing."""

    def __init__(self, hashes: DataFrame, column: str):
        count = hashes.select(column).distinct().count()
        power = min(max((count * BLOOM).bit_length(), BLOOM_LEAST), BLOOM_MOST)
        self.bits = 1 << power
        spots = hashes.select(F.explode(F.array(*self._spots(F.col(column)))).alias("spot"))
        held = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS int))")).alias("bits"))
        blank = hashes.sparkSession.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        each = held.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        # as many rows as the filter has longs, at most 2^16
        self.words = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")).scalar()

    def _spots(self, h: Column) -> list[Column]:
        return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(self.bits - 1).cast("long")) for k in (0, 21, 42)]

    def may_have(self, h: Column) -> Column:
        out = F.lit(True)
        for spot in self._spots(h):
            out = out & (F.getbit(F.get(self.words, F.shiftright(spot, 6).cast("int")), spot.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", threshold: float = common.SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) for each document and item whose best window meets the threshold."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"eight blocks with one change guarantee radii up to {RADIUS}")
    items = common.checkpointed(items_of(benchmark, item_col, item_text_col))
    sizes = [r["z"] for r in items.select("z").distinct().orderBy("z").collect()]  # at most five values
    few = (items.agg(F.sum(F.size("item_shingles"))).first()[0] or 0) <= BROADCAST_SHINGLES
    wanted = wanted_shingles(items, threshold)
    wanted = common.checkpointed(wanted.coalesce(1) if few else wanted)  # a few rows a file would make as many files and tasks
    sent = F.broadcast if few else (lambda df: df)
    # where texts have a wanted shingle; a text is told by its id and a hash
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    worded = texts.select("doc_id", "row", _held(words=words(F.col("text"))).alias("v")).filter(F.size("v.words") > 0)
    each = [F.struct(F.lit(z).alias("z"), shingles(F.col("v.words"), z).alias("hs")) for z in sizes] or [F.struct(F.lit(0).alias("z"), F.array().cast("array<long>").alias("hs"))]
    placed = worded.select("doc_id", "row", F.explode(F.array(*each)).alias("x")).select("doc_id", "row", "x.z", F.posexplode("x.hs").alias("at", "h"))
    hits = placed.filter(Bloom(wanted, "h").may_have(F.col("h"))).join(sent(wanted), ["h", "z"])
    anchors = common.checkpointed(hits.groupBy("doc_id", "row", "w").agg(F.collect_set("at").alias("ats")))
    found = anchors.select("doc_id", "row").distinct()
    kept = texts.filter(Bloom(found, "row").may_have(F.col("row"))).join(found, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    kept = common.checkpointed(kept.select("doc_id", "row", words(F.col("text")).alias("words")))

    around = kept.join(anchors, ["doc_id", "row"])
    n, w = F.size("words"), F.col("w")
    starts = F.flatten(F.transform("ats", lambda p: F.sequence(F.greatest(p - w + F.least(w, F.lit(common.SHINGLE)), F.lit(0)), F.greatest(F.least(p, n - w), F.lit(0)))))
    held = around.select("doc_id", "row", "w", _held(hashes=F.transform("words", lambda x: F.xxhash64(x)), starts=F.array_distinct(starts)).alias("v"))
    spread = F.transform("v.starts", lambda s: F.struct(s.alias("first_word"), _print(F.slice("v.hashes", s + 1, w), w).alias("print")))
    windows = held.select("doc_id", "row", "w", F.explode(spread).alias("window")).select("doc_id", "row", "w", "window.*")

    changes = F.array(*[F.lit(0), *[F.lit(1 << b) for b in range(8)]])
    listed = items.select("item", "w", "item_print", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col("item_print"), k).alias("value")) for k in range(8)])).alias("b"))
    listed = listed.select("item", "w", "item_print", "b.block", "b.value", F.explode(changes).alias("change"))
    listed = listed.select("item", "w", "item_print", "block", F.col("value").bitwiseXOR(F.col("change")).alias("value"))
    probes = windows.withColumn("b", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col("print"), k).alias("value")) for k in range(8)])))
    probes = probes.select("doc_id", "row", "w", "first_word", "print", "b.block", "b.value")
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    near = probes.join(sent(listed), ["w", "block", "value"]).filter((F.bit_count(differ) <= radius) & _first_block(differ))

    known = items.select("item", "item_id", "z", "item_shingles")
    met = near.select("doc_id", "row", "w", "first_word", "item").join(kept, ["doc_id", "row"])
    met = met.select("doc_id", "item", "w", "first_word", F.slice("words", F.col("first_word") + 1, F.col("w")).alias("inside")).join(sent(known), "item")
    scored = met.select("doc_id", "item_id", "w", "first_word", _held(own=shingles(F.col("inside"), F.col("z")), other=F.col("item_shingles")).alias("v"))
    scored = scored.select("doc_id", "item_id", "w", "first_word", similarity(F.col("v.own"), F.col("v.other")).alias("similarity"))
    best = scored.filter(F.col("similarity") >= threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("before"), "w")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.before")).alias("first_word"), F.col("b.w").alias("n_words"))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The same by brute force, over all windows and pairs that share a shingle.
OP1_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
iw AS (SELECT item_id, words, least(len(words), 5) AS z FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark) WHERE len(words) > 0),
dg AS (SELECT doc_id, z, len(words) AS n, list_transform(range(1, greatest(len(words) - z + 1, 1) + 1), lambda i: array_to_string(list_slice(words, i, i + z - 1), ' ')) AS g FROM dw, (SELECT DISTINCT z FROM iw) WHERE len(words) > 0),
ig AS (SELECT item_id, z, len(words) AS w, list_transform(range(1, len(words) - z + 2), lambda i: array_to_string(list_slice(words, i, i + z - 1), ' ')) AS g FROM iw),
ds AS (SELECT doc_id, z, n, unnest(g) AS s, unnest(range(len(g))) AS p FROM dg),
iss AS (SELECT item_id, z, w, unnest(g) AS s FROM ig),
ic AS (SELECT item_id, s, count(*) AS c FROM iss GROUP BY item_id, s),
anchors AS (SELECT DISTINCT ds.doc_id, ds.n, ds.p, iss.item_id, iss.w, iss.z FROM ds JOIN iss ON ds.s = iss.s AND ds.z = iss.z),
starts AS (SELECT DISTINCT doc_id, n, item_id, w, z, unnest(range(greatest(p - w + z, 0), greatest(least(p, n - w), 0) + 1)) AS begin_at FROM anchors),
inside AS (SELECT st.doc_id, st.item_id, st.w, st.z, st.begin_at, ds.s, count(*) AS c FROM starts st JOIN ds ON ds.doc_id = st.doc_id AND ds.z = st.z AND ds.p >= st.begin_at AND ds.p <= st.begin_at + greatest(least(st.w, st.n) - st.z, 0) GROUP BY st.doc_id, st.item_id, st.w, st.z, st.begin_at, ds.s),
scored AS (SELECT i.doc_id, i.item_id, i.w, i.z, i.begin_at, sum(i.c) AS size, sum(least(i.c, coalesce(ic.c, 0))) AS met FROM inside i LEFT JOIN ic ON ic.item_id = i.item_id AND ic.s = i.s GROUP BY i.doc_id, i.item_id, i.w, i.z, i.begin_at),
rated AS (SELECT doc_id, item_id, w, begin_at, CAST(met AS DOUBLE) / CAST(size + (w - z + 1) - met AS DOUBLE) AS similarity FROM scored)
SELECT doc_id, item_id, similarity, CAST(begin_at AS INTEGER) AS first_word, CAST(w AS INTEGER) AS n_words FROM rated WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, begin_at) = 1"""
