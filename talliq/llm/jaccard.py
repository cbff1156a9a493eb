"""n-gram Jaccard join by a MinHash LSH forest with exact verification.

A text is the set of its five-word shingles. Texts of one set are a class of copies, and one document stands for it. A
forest of TREES prefix tries holds the representatives' signatures: in each tree a label of DEEPEST levels, a byte of one
MinHash each. A trie is the labels in order, so a node is a prefix and its size the number of labels that begin with it.

Prefixes are matched at their deepest and shortened, tree by tree and document by document, until a text at the threshold
is found with a probability of at least RECALL: 1 - prod(1 - threshold ** depth) over the trees. In nodes of at most CROWD
members a prefix is shortened to SHALLOWEST, which costs next to nothing; in crowded ones the step comes next that adds the
fewest members for what it adds to recall. So what is common stays deep, and rare prefixes make up for it. Two texts meet
in a tree if they share the prefix that either of them has there. What meets is verified on the sets themselves. A pair
belongs to the first tree in which it meets, so it is looked at once.

Buckets are never expanded into rows of pairs. A bucket of more than MEMBERS, or of more than WEIGHT shingles, is cut into
blocks by a hash, and each two of its blocks meet in one task, which counts links and returns per member its number of
links and one edge of a spanning forest. So a bucket that holds a third of all documents is spread over many tasks, each
of a bounded size; that all links are counted means that different texts of one bucket are compared with each other, so
rows grow with members times blocks.

Null and empty texts have no words: each such document is a class and a group of its own without links. A text of fewer
than five words is a single shingle; a very long one is a set like any other, in memory alone or in a block. Repeated rows
of one id are one document; of different texts the one with the least digest counts. Rows without an id get no row and
count for no one, since links are told by id: give them an id first, as the pipeline does. Ties don't matter, as links are
counted and classes take the smallest id. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

TREES, SHALLOWEST, DEEPEST, RECALL = 20, 4, 8, 0.9995
#: Members of a node in which every prefix is shortened.
CROWD = 16
#: Members and shingles of a block; two blocks meet in a task.
MEMBERS, WEIGHT = 1024, 1 << 19
#: Shingles that are hashed at once, and that several sets have and are counted at once.
_HASHED, _STRIP = 1024, 2048


def _misses(depth: int, threshold: float) -> float:
    """Logarithm of the probability that texts at the threshold don't share a prefix of so many levels."""
    return float(np.log1p(-(threshold**depth)))


def shortened(crowded: dict[int, list[int]], threshold: float, trees: int = TREES, recall: float = RECALL) -> bytes:
    """The depth of a document's prefix in each tree. crowded: for trees with a crowded node, sizes of the nodes from
    SHALLOWEST to DEEPEST levels; in all others prefixes are as short as can be."""
    depths = [DEEPEST if t in crowded else SHALLOWEST for t in range(trees)]
    missed, goal = sum(_misses(d, threshold) for d in depths), float(np.log1p(-recall))
    while missed > goal:
        steps = []
        for t, sizes in crowded.items():
            d = depths[t]
            if d > SHALLOWEST:
                more = sizes[d - 1 - SHALLOWEST] - sizes[d - SHALLOWEST]
                steps.append(((more + 1) / (_misses(d, threshold) - _misses(d - 1, threshold)), t))
        if not steps:
            break
        _, t = min(steps)
        depths[t] -= 1
        missed += _misses(depths[t], threshold) - _misses(depths[t] + 1, threshold)
    return bytes(depths)


class Forest:
    def __init__(self, trees: int, size: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.trees, self.size = trees, size
        self.flip = r.integers(0, 1 << 32, trees * DEEPEST, np.uint32)[:, None]
        self.times = r.integers(0, 1 << 31, trees * DEEPEST, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.words = common.WordHashes()

    def shingles(self, text: bytes) -> np.ndarray:
        return common.shingle_set(self.words(common.words_of(text)), self.size)

    def labels(self, shingles: np.ndarray) -> bytes:
        """A label of DEEPEST bytes for each tree."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        lows = ((x[:_HASHED] ^ self.flip) * self.times).min(1)
        for k in range(_HASHED, len(x), _HASHED):
            lows = np.minimum(lows, ((x[k : k + _HASHED] ^ self.flip) * self.times).min(1))
        return ((lows * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


_forests: dict = {}


def _forest(*key) -> Forest:
    if key not in _forests:
        _forests.clear()
        _forests[key] = Forest(*key)
    return _forests[key]


def signatures(docs: DataFrame, trees: int, size: int) -> DataFrame:
    """(doc_id, digest, n, labels) from (doc_id, text bytes): digest and size of the shingle set, null without words."""

    def signed(batches):
        import hashlib

        forest = _forest(trees, size)
        for batch in batches:
            digests, counts, labels, known = [], [], [], {}
            for text in batch.column("text"):
                got = forest.shingles(text.as_py())
                counts.append(len(got))
                if len(got) == 0:
                    digests.append(None)
                    labels.append(None)
                    continue
                digest = hashlib.blake2b(got.tobytes(), digest_size=16).digest()
                if digest not in known:
                    known[digest] = forest.labels(got)
                digests.append(digest)
                labels.append(known[digest])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "digest": pa.array(digests, pa.binary()), "n": pa.array(counts, pa.int32()), "labels": pa.array(labels, pa.binary())})
        common.release()

    return docs.mapInArrow(signed, "doc_id long, digest binary, n int, labels binary")


def _sets(docs: DataFrame, trees: int, size: int) -> DataFrame:
    """(rep, shingles) from (rep, digest, text bytes): of different texts of one id, the one with the digest."""

    def made(batches):
        import hashlib

        forest = _forest(trees, size)
        for batch in batches:
            sets = [forest.shingles(t.as_py()).tobytes() for t in batch.column("text")]
            same = pa.array([hashlib.blake2b(x, digest_size=16).digest() == d.as_py() for x, d in zip(sets, batch.column("digest"), strict=True)])
            yield pa.record_batch({"rep": batch.column("rep"), "shingles": pa.array(sets, pa.binary())}).filter(same)
        common.release()

    return docs.mapInArrow(made, "rep long, shingles binary").dropDuplicates(["rep"])


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float, may: np.ndarray) -> np.ndarray:
    """Pairs of similar sets among those that may be, by counting common shingles over those that several sets have."""
    both = left if right is None else left + right
    flat = np.concatenate(both)
    values, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in both])
    row = np.repeat(np.arange(len(both)), sizes)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    on = shared[where]
    row, col = row[on], column[where[on]]
    n, m = len(left), len(both)
    common_counts = np.zeros((n, len(left) if right is None else m - n), np.float32)
    width, order = int(shared.sum()), np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, width, _STRIP):  # dense strips keep memory flat and use matrix products
        lo, hi = np.searchsorted(col, [a, a + _STRIP])
        strip = np.zeros((m, min(_STRIP, width - a)), np.float32)
        strip[row[lo:hi], col[lo:hi] - a] = 1
        common_counts += strip[:n] @ (strip[:n] if right is None else strip[n:]).T
    other = sizes[:n] if right is None else sizes[n:]
    union = sizes[:n, None] + other[None, :] - common_counts
    return may & (common_counts >= threshold * union - 1e-6)


def _forest_edges(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


class _Group:
    """The rows of two blocks of a bucket, or of one."""

    def __init__(self, rows: pa.Table):
        first = {c: rows.column(c)[0].as_py() for c in ("tree", "depth", "low", "high")}
        self.tree, self.depth, self.same = first["tree"], first["depth"], first["low"] == first["high"]
        self.ids, own = rows.column("rep").to_numpy(), rows.column("own").to_numpy()
        n = len(self.ids)
        self.labels = np.frombuffer(b"".join(rows.column("labels").to_pylist()), ">u8").reshape(n, -1)[:, : self.tree + 1].astype(np.uint64)
        self.depths = np.frombuffer(b"".join(rows.column("depths").to_pylist()), np.uint8).reshape(n, -1)[:, : self.tree + 1]
        self.a = np.flatnonzero(own == first["low"])
        self.b = self.a if self.same else np.flatnonzero(own == first["high"])

    def may(self) -> np.ndarray:
        """Pairs of low and high members that meet here first: in no earlier tree, and at the shorter of both prefixes."""
        a, b, tree = self.a, self.b, self.tree
        out = np.minimum(self.depths[a, tree][:, None], self.depths[b, tree][None, :]) == self.depth
        if self.same:
            np.fill_diagonal(out, False)
        bars = np.uint64(1) << (np.uint64(8 * DEEPEST) - np.uint64(8) * self.depths.astype(np.uint64))
        for t in range(tree):
            if not out.any():
                break
            differ = self.labels[a, t][:, None] ^ self.labels[b, t][None, :]
            out &= differ >= np.maximum(bars[a, t][:, None], bars[b, t][None, :])
        return out


_FIELDS = ("tree", "depth", "key", "low", "high")


def _by_group(rows: DataFrame, work, schema: str) -> DataFrame:
    """Applies work to the rows of each group of _FIELDS. Groups are small and many, so a task takes them one after the
    other from its sorted rows; no group is larger than two blocks."""

    def worked(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cut = np.zeros(max(0, len(held) - 1), bool)
            for c in _FIELDS:
                x = held.column(c).to_numpy() if c != "key" else np.array(held.column(c).to_pylist(), object)
                cut |= x[1:] != x[:-1]
            ends = (np.flatnonzero(cut) + 1).tolist()
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True) if ends else ():
                yield from work(held.slice(lo, hi - lo)).to_batches()
            held = held.slice(ends[-1]).combine_chunks() if ends else held
        if held is not None and len(held):
            yield from work(held).to_batches()
        held = None
        common.release()

    return rows.repartition(*_FIELDS).sortWithinPartitions(*_FIELDS).mapInArrow(worked, schema)


def _prefix(depth: int | Column) -> Column:
    return F.substring(F.col("label"), F.lit(1), F.lit(depth))


def prefixes(classes: DataFrame, threshold: float, trees: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rep, tree, depth, key, n) of the nodes where a document may meet another, and (rep, depths) where any prefix is
    longer than SHALLOWEST."""
    label = F.substring(F.col("labels"), F.col("tree") * DEEPEST + 1, F.lit(DEEPEST))
    entries = classes.select("rep", "n", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("rep", "n", "tree", label.alias("label"))
    nodes = entries.withColumn("key", _prefix(SHALLOWEST))
    counts = nodes.groupBy("tree", "key").agg(F.count("*").alias("members")).filter("members > 1")
    held = common.checkpointed(nodes.join(counts, ["tree", "key"]).drop("key"))

    crowded = held.filter(F.col("members") > CROWD)
    deeper = crowded.withColumn("depth", F.explode(F.sequence(F.lit(SHALLOWEST), F.lit(DEEPEST)))).withColumn("key", _prefix(F.col("depth")))
    sizes = deeper.groupBy("tree", "depth", "key").agg(F.count("*").alias("size"))
    sized = common.checkpointed(deeper.join(sizes, ["tree", "depth", "key"]).select("rep", "tree", "depth", "key", "n", "size"))
    told = sized.groupBy("rep").agg(F.collect_list(F.struct("tree", "depth", "size")).alias("all"))

    @F.arrow_udf("binary")
    def chosen(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():  # at most a row for each tree and depth
            of: dict[int, dict[int, int]] = {}
            for x in row:
                of.setdefault(x["tree"], {})[x["depth"]] = x["size"]
            out.append(shortened({t: [s[d] for d in range(SHALLOWEST, DEEPEST + 1)] for t, s in of.items()}, threshold, trees, recall))
        return pa.array(out, pa.binary())

    depths = common.checkpointed(told.select("rep", chosen("all").alias("depths")))
    rare = held.filter(F.col("members") <= CROWD).select("rep", "tree", F.lit(SHALLOWEST).alias("depth"), _prefix(SHALLOWEST).alias("key"), "n", F.lit(True).alias("asks"))
    own = F.conv(F.hex(F.substring(F.col("depths"), F.col("tree") + 1, F.lit(1))), 16, 10).cast("int")
    common_ones = sized.join(depths, "rep").select("rep", "tree", "depth", "key", "n", (own == F.col("depth")).alias("asks"))
    return rare.unionByName(common_ones), depths


def similar(docs: DataFrame, *, id_col="doc_id", text_col="text", threshold: float = common.SIMILAR, size: int = common.SHINGLE, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_class, n_links) for each document.

    copy_class is the smallest id with the same shingle set; class_id the smallest id among all that links reach;
    n_links counts the other documents whose sets have a Jaccard similarity of at least the threshold, copies included.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_bytes(text_col).alias("text")).filter("doc_id IS NOT NULL")
    signed = common.checkpointed(signatures(texts, trees, size))
    known = signed.filter("digest IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("digest", "n", "labels")).alias("s")).select("doc_id", "s.*")
    classes = common.checkpointed(
        known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    )
    copies = classes.select("rep", "copies")

    # members of shared prefixes
    entries, depths = prefixes(classes, threshold, trees, recall)
    buckets = entries.groupBy("tree", "depth", "key").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.max("asks").alias("asked")).filter("members > 1 AND asked")
    blocks = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    buckets = buckets.select("tree", "depth", "key", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("low"), F.greatest(b, F.col("own")).alias("high")))
    dealt = entries.select("rep", "tree", "depth", "key").join(buckets, ["tree", "depth", "key"]).withColumn("own", own).withColumn("m", F.explode(meets))
    shallow = F.lit(bytes([SHALLOWEST] * trees))
    members = classes.join(depths, "rep", "left").select("rep", "labels", F.coalesce("depths", shallow).alias("depths"), "copies")
    keyed = dealt.select("rep", "tree", "depth", "key", "own", "m.low", "m.high").join(members, "rep")

    # who has a partner that it meets here first
    def met(rows: pa.Table) -> pa.Table:
        group, needed = _Group(rows), np.zeros(len(rows), bool)
        if len(group.a) and len(group.b):
            may = group.may()
            needed[group.a[may.any(1)]] = True
            needed[group.b[may.any(0)]] = True
        return rows.filter(pa.array(needed))

    kind = "rep long, tree int, depth int, key binary, own int, low int, high int, labels binary, depths binary, copies long"
    pending = common.checkpointed(_by_group(keyed.select(*[f.split(" ")[0] for f in kind.split(", ")]), met, kind))
    wanted = pending.select("rep").distinct().join(classes.select("rep", "digest"), "rep")
    sets = _sets(texts.join(wanted, texts["doc_id"] == wanted["rep"]).select("rep", "digest", "text"), trees, size)

    def verified(rows: pa.Table) -> pa.Table:
        group, links, edges = _Group(rows), np.zeros(len(rows), np.int64), []
        weights = rows.column("copies").to_numpy()
        a, b = group.a, group.b
        if len(a) and len(b):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("shingles")]
            hit = _links([sets[i] for i in a], None if group.same else [sets[i] for i in b], threshold, group.may())
            links[a] += hit @ weights[b]
            if not group.same:
                links[b] += hit.T @ weights[a]
            i, j = np.nonzero(np.triu(hit) if group.same else hit)
            edges = _forest_edges(group.ids, np.stack([a[i], b[j]], 1))
        out = [(int(i), None, int(n)) for i, n in zip(group.ids, links, strict=True) if n] + [(a, b, 0) for a, b in edges]
        return pa.table({"rep": pa.array([r[0] for r in out], pa.int64()), "to": pa.array([r[1] for r in out], pa.int64()), "links": pa.array([r[2] for r in out], pa.int64())})

    checked = common.checkpointed(_by_group(pending.join(sets, "rep"), verified, "rep long, to long, links long"))
    edges = checked.filter("to IS NOT NULL").select(F.col("rep").alias("a"), F.col("to").alias("b"))
    groups = components(edges).select(F.col("node").alias("rep"), "component")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))

    by_rep = copies.join(groups, "rep", "left").join(links, "rep", "left")
    by_digest = classes.select("digest", "rep").join(by_rep, "rep").select("digest", "rep", "component", "links", "copies")
    found = known.select("doc_id", "digest").join(by_digest, "digest")
    with_words = found.select("doc_id", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("copy_class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    bare = signed.groupBy("doc_id").agg(F.max("digest").alias("digest")).filter("digest IS NULL")
    alone = bare.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_class"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(alone)


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(common.table(spark, sf_dir, "documents"))


#: The same by brute force, over all windows and pairs that share a shingle.
OP10_SQL = r"""
WITH RECURSIVE split_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS shingles FROM split_words),
keyed AS (SELECT doc_id, len(shingles) AS n, CASE WHEN len(shingles) = 0 THEN 'doc ' || doc_id ELSE md5(array_to_string(list_sort(shingles), chr(10))) END AS k, shingles FROM sets),
classes AS (SELECT k, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n, any_value(shingles) AS shingles FROM keyed GROUP BY k),
entries AS (SELECT rep, unnest(shingles) AS s FROM classes),
shared AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM entries a JOIN entries b ON a.s = b.s AND a.rep <> b.rep GROUP BY a.rep, b.rep),
links AS (SELECT x, y, b.copies FROM shared JOIN classes a ON a.rep = x JOIN classes b ON b.rep = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
reach AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
groups AS (SELECT x AS rep, min(y) AS class_id FROM reach GROUP BY x),
counts AS (SELECT x AS rep, sum(copies) AS linked FROM links GROUP BY x)
SELECT k.doc_id, g.class_id, c.rep AS copy_class, CAST(coalesce(t.linked, 0) + c.copies - 1 AS BIGINT) AS n_links
FROM keyed k JOIN classes c ON k.k = c.k JOIN groups g ON g.rep = c.rep LEFT JOIN counts t ON t.rep = c.rep"""
