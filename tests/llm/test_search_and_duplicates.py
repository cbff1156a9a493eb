import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talliq.llm import common, components, decontamination, jaccard, quality, substrings, suffixes, vectors

from .corpus import EDGES, documents, mixed, sentence


def clashing(df):
    for name in ("bucket", "cell", "rep", "keys", "key", "tree", "digest", "words", "h", "at", "w", "b", "block", "value", "hashes", "starts", "print"):
        df = df.withColumn(name, F.lit(1))
    return df


# --- op2

def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 2)]) for i in range(260)]
    rows += [(500, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (800, [float("inf")] * 6), (900, [1.0, 2.0]), (901, rows[7][1]), (902, rows[7][1]), (1000, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).withColumn("raw", F.lit(3))
    scaled = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in scaled if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(scaled[q], v, strict=True)), i) for i, v in scaled.items() if i != q and len(v) == len(scaled[q]))
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:10])}
    for block in (4096, 2):
        assert {tuple(r) for r in vectors.search(table, lambda i: i % 100 == 0, block=block).collect()} == want
    assert vectors.search(table.limit(0), lambda i: i % 100 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for scale in (1, 500, 1e9):
        v = np.floor(rng.normal(size=(3000, 16)) * scale)
        v[:, 3] = 7  # a dimension without a range
        cells = vectors.Cells(v.min(0), v.max(0))
        near, reach = cells.middles(cells.approximate(v)) @ v[:20].T, cells.reach(v[:20])
        assert (np.abs(near - v @ v[:20].T) <= reach).all()


def test_few_vectors_are_read(spark, monkeypatch):
    """Bounds rule out nearly all pairs, in tasks, between tasks, and after the first vectors are read."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(np.floor(rng.normal(size=(3000, 16)) * 500))], "id long, v array<long>").repartition(4)
    monkeypatch.setattr(vectors, "ROWS", 200)
    left = vectors.candidates(rows, rows.filter("id % 100 = 0"), 10)
    assert 30 * 10 <= left.count() <= 0.02 * 30 * 3000
    best = vectors.Running(2, 1)
    assert [best.bar(np.array(x, float)[:, None], slice(0, 1))[0] for x in ([1, 5, 3], [2], [9, 8])] == [3, 3, 8]


def test_scores_beyond_64_bits_are_left_out(spark):
    rows = [(0, [1e18, 0.0]), (1, [1e18, 0.0]), (2, [1.0, 0.0]), (3, [2.0**30, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["id"]: r["score"] for r in vectors.search(table.filter("vec_id > 0"), lambda i: i == 2).collect()}
    assert got == {3: 1 << 50}
    assert 1 not in {r["id"] for r in vectors.search(table, lambda i: i == 0).collect()}


# --- op10

def brute_jaccard(texts, threshold=0.8):
    hashes = common.WordHashes()
    sets = {i: set(common.shingle_set(hashes(common.words_of((t or "").encode()))).tolist()) for i, t in texts.items()}
    links, parent = Counter(), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    copies = {}
    for i in ids:
        copies.setdefault(frozenset(sets[i]) if sets[i] else i, i)
    return {i: (root(i), copies[frozenset(sets[i]) if sets[i] else i], links[i]) for i in ids}


@pytest.mark.parametrize(("members", "weight", "crowd"), [(1024, 1 << 19, 16), (3, 300, 2)])
def test_jaccard_equals_brute_force(spark, members, weight, crowd, monkeypatch):
    for name, value in (("MEMBERS", members), ("WEIGHT", weight), ("CROWD", crowd)):  # small blocks meet pairwise
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(6)
    texts = mixed(seed=4)
    base = sentence(rng, n=120).split()
    for k in range(14):
        other = list(base)
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(len(other))] = f"w{k}"
        texts.append(" ".join(other))
    texts += ["one two three", "One, two; three!", "one two", "a b c d e", "A B C D E"]
    texts = dict(enumerate(texts))
    got = {r["doc_id"]: (r["class_id"], r["copy_class"], r["n_links"]) for r in jaccard.similar(clashing(documents(spark, list(texts.items())))).collect()}
    assert got == brute_jaccard(texts)


def test_jaccard_edges(spark):
    assert jaccard.similar(documents(spark, [])).count() == 0
    got = {tuple(r) for r in jaccard.similar(documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x"), (3, None)])).collect()}
    assert got == {(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 3, 0)}


def test_other_texts_of_an_id_count_for_no_one(spark):
    rows = [(1, "one two three four five six"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "one two three four five six"), (4, ""), (4, "p q r")]
    got = {r["doc_id"]: r["n_links"] for r in jaccard.similar(documents(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] + got[3] == 1 and got[1] == 1 and got[4] == 0


def recall_of(depths, threshold):
    missed = 1.0
    for d in depths:
        missed *= 1 - threshold**d
    return 1 - missed


def test_prefixes_are_shortened_until_the_recall_is_met():
    rng = random.Random(4)
    assert set(jaccard.shortened({}, 0.8)) == {jaccard.SHALLOWEST}
    for _ in range(300):
        crowded = {}
        for t in rng.sample(range(jaccard.TREES), rng.randint(1, jaccard.TREES)):
            sizes = [rng.randint(17, 5000)]
            for _ in range(jaccard.DEEPEST - jaccard.SHALLOWEST):
                sizes.append(rng.randint(1, sizes[-1]))
            crowded[t] = sizes
        depths = jaccard.shortened(crowded, 0.8)
        assert recall_of(depths, 0.8) >= jaccard.RECALL
        assert all(depths[t] == jaccard.SHALLOWEST for t in range(jaccard.TREES) if t not in crowded)
        met = lambda of: sum(crowded[t][of[t] - jaccard.SHALLOWEST] for t in crowded)
        # a fixed depth of the same recall meets more
        assert met(depths) <= met([5] * jaccard.TREES) + len(crowded)
    few = jaccard.shortened({0: [5000, 4000, 3000, 2000, 1000]}, 0.8)
    assert few[0] == jaccard.DEEPEST  # nineteen rare trees are enough


def test_crowded_nodes_get_longer_prefixes(spark, monkeypatch):
    """Texts with a long common part crowd the tries; their prefixes grow, and no link is lost."""
    rng = random.Random(14)
    base = sentence(rng, n=200).split()
    texts = {}
    for k in range(60):
        other = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 9])):
            other[rng.randrange(200)] = f"w{rng.randrange(1000)}"
        texts[k] = " ".join(other)
    got = {r["doc_id"]: (r["class_id"], r["copy_class"], r["n_links"]) for r in jaccard.similar(documents(spark, list(texts.items()))).collect()}
    assert got == brute_jaccard(texts)
    signed = jaccard.signatures(documents(spark, list(texts.items())).select("doc_id", F.col("text").cast("binary").alias("text")), jaccard.TREES, 5)
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    _, depths = jaccard.prefixes(classes, 0.8, jaccard.TREES, jaccard.RECALL)
    rows = [bytes(r["depths"]) for r in depths.collect()]
    assert rows and all(recall_of(r, 0.8) >= jaccard.RECALL for r in rows) and max(max(r) for r in rows) > 5


def test_forest_recall():
    """Pairs right at the threshold, each looking for the other at the shortest prefixes that the recall needs."""
    forest, rng = jaccard.Forest(jaccard.TREES, 5), np.random.default_rng(2)
    crowded = {t: [100, 90, 60, 40, 30] for t in range(jaccard.TREES)}
    depths, found = jaccard.shortened(crowded, 0.8), 0
    for _ in range(400):
        common_part = rng.integers(0, 1 << 63, 80, np.uint64)
        a, b = (forest.labels(np.concatenate([common_part, rng.integers(0, 1 << 63, 10, np.uint64)])) for _ in range(2))
        found += any(a[8 * t : 8 * t + d] == b[8 * t : 8 * t + d] for t, d in enumerate(depths))
    assert found >= 398


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (20, 21), (22, 21), (5, 5), *[(k, k + 1) for k in range(100, 130)]]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20} | {k: 100 for k in range(100, 131)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op1

def brute_leaks(docs, items):
    split = lambda t: [w.decode() for w in common.words_of((t or "").encode())]
    shingles = lambda w, z: Counter(tuple(w[i : i + z]) for i in range(max(1, len(w) - z + 1)))
    out = {}
    for d, text in docs:
        words = split(text)
        for k, item in items:
            own = split(item)
            if not words or not own:
                continue
            z = min(5, len(own))
            want = shingles(own, z)
            best = 0.0
            for s in range(max(1, len(words) - len(own) + 1)):
                c = shingles(words[s : s + len(own)], z)
                both = sum((c & want).values())
                best = max(best, both / (sum(c.values()) + sum(want.values()) - both))
            if best >= 0.8:
                out[d, k] = best
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    items = [(k, sentence(rng, n=n)) for k, n in enumerate((15, 30, 31, 59, 8, 3, 1))] + [(7, None), (8, " .. "), (9, sentence(rng, n=30))]
    items.append((10, items[1][1]))
    docs = [(1000 + i, t) for i, t in enumerate(mixed(seed=3, n=8))]
    for k, item in items:
        if item is None:
            continue
        words = item.split()
        for j, version in enumerate((item, item.upper() + "!", " ".join(words[1:]), " ".join([*words[:-1], "other"]), " ".join([*words[: len(words) // 2], "odd", *words[len(words) // 2 + 1 :]]), " ".join(words[len(words) // 2 :]))):
            docs.append((k * 10 + j, f"{sentence(rng, n=rng.randint(0, 40))} {version} {sentence(rng, n=rng.randint(0, 20))}"))
    docs.append((900, items[0][1]))
    frame = clashing(documents(spark, docs))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(5)).withColumn("z", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(frame, bench).collect()}
    want = brute_leaks(docs, items)
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(set(want) - set(got)) <= 0.02 * len(want)  # only fingerprints beyond the radius
    assert all(k in got for k, s in want.items() if s > 0.85)
    for size in (0, 1 << 60):  # with joins that shuffle, and with broadcasts
        monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", size)
        assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(frame, bench).collect()} == got
    monkeypatch.setattr(decontamination, "LONGEST", 29)  # items beyond it are verified without fingerprints
    longer = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(frame, bench).collect()}
    lengths = {k: len(t.split()) for k, t in items if t}
    assert {k for k in want if lengths[k[1]] >= 30} <= longer and longer <= set(want)


def test_only_texts_with_a_rare_shingle_are_shuffled(spark):
    rng = random.Random(2)
    bench = spark.createDataFrame([(k, sentence(rng, n=40)) for k in range(30)], "item_id long, text string")
    items = common.checkpointed(decontamination.items_of(bench, "item_id", "text"))
    wanted = decontamination.wanted_shingles(items, 0.8)
    assert wanted.count() <= 30 * (36 - 29 + 1)  # 29 of 36 shingles are needed
    bloom = decontamination.Bloom(wanted, "h")
    assert wanted.filter(~bloom.may_have(F.col("h"))).isEmpty()
    assert spark.range(20_000).filter(bloom.may_have(F.xxhash64("id"))).count() < 20


def test_filters_are_not_in_the_text_of_plans(spark):
    hashes = common.checkpointed(spark.range(8000).select(F.xxhash64("id").alias("h")))
    bloom = decontamination.Bloom(hashes, "h")
    assert bloom.bits == 1 << 21
    found = spark.range(10_000).filter(bloom.may_have(F.xxhash64("id")))
    assert 8000 <= found.count() < 8010 and found.filter("id < 8000").count() == 8000
    for plan in (found._jdf.queryExecution().toString(), found._jdf.queryExecution().executedPlan().toString()):
        assert len(plan) < 50_000


def test_similarity_counts_repeats(spark):
    rng = random.Random(3)
    rows = [([rng.randrange(-4, 4) for _ in range(rng.randint(1, 30))], [rng.randrange(-4, 4) for _ in range(rng.randint(1, 30))]) for _ in range(200)]
    for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", decontamination.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = Counter(r["a"]), Counter(r["b"])
        assert abs(r["s"] - sum((a & b).values()) / sum((a | b).values())) < 1e-12


def test_leaks_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontamination.leaks(documents(spark, []), bench).count() == 0
    assert decontamination.leaks(documents(spark, [(1, "x")]), bench.limit(0)).count() == 0
    got = decontamination.leaks(documents(spark, [(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (6, None)]), bench).collect()
    assert [(r["doc_id"], r["first_word"], r["n_words"]) for r in got] == [(5, 0, 6)]


def test_fingerprints(spark):
    rows = [([1, 2, 3],), ([-1],), ([7] * 3000 + [9],), ([(1 << 63) - 1, -(1 << 63)],)]
    got = spark.createDataFrame(rows, "h array<long>").select("h", decontamination.fingerprint(F.col("h")).alias("f")).collect()
    for r in got:
        want = sum(1 << b for b in range(63) if sum(h >> b & 1 for h in r["h"]) * 2 > len(r["h"]))
        assert r["f"] == want


# --- op8

def prefix(a, b, most):
    k = 0
    while k < min(most, len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def brute_suffixes(text, depth):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common_prefix = lambda a, b: next((k for k in range(depth) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or b + k >= len(text)), depth)
    return order, [0 if k == 0 else common_prefix(order[k - 1], i) for k, i in enumerate(order)]


def test_suffixes_equal_sorting(monkeypatch):
    """On disk and in memory, with every depth of recursion, in small batches and with few ranges of symbols."""
    r = random.Random(1)
    for _ in range(150):
        monkeypatch.setattr(suffixes, "BATCH", r.choice([3, 7, 64, 1 << 16]))
        monkeypatch.setattr(suffixes, "RANGES", r.choice([2, 8, 4096]))
        letters = b"ab\x00\xffcdefghijklm"[: r.choice([1, 2, 3, 4, 15])]
        text = bytes(r.choices(letters, k=r.choice([0, 1, 2, 5, 30, 200, 500])))
        if r.random() < 0.5:
            word = bytes(r.choices(b"abc", k=r.randint(1, 80)))
            text = b"".join(r.choice([word, text[:5], b"xy"]) for _ in range(40))
        depth = r.choice([4, 10, 50])
        data = [text[:10], text[10:]] if r.random() < 0.5 else text
        got = list(suffixes.sorted_suffixes(data, depth, memory=r.choice([10, 1000, 1 << 20]), base=r.choice([0, 1, 2, 5, 50, 1 << 20])))
        positions, lengths = [int(x) for p, _ in got for x in p], [int(x) for _, n in got for x in n]
        order, want = brute_suffixes(text, depth)
        assert sorted(positions) == list(range(len(text))) and lengths == want
        assert [text[p : p + depth] for p in positions] == [text[p : p + depth] for p in order]


def brute_substrings(docs, length=50):
    seen, out = {}, Counter()
    docs = [(i if i is not None else 1 << 63, (t or "").encode()) for i, t in docs]
    for i, x in docs:
        for p in range(len(x) - length + 1):
            s = x[p : p + length]
            seen[s] = min(seen.get(s, i), i)
    for i, x in docs:
        mark = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] < i:
                mark[p : p + length] = b"\1" * length
        spans = sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        kept = bytes(c for c, m in zip(x, mark, strict=True) if not m)
        out[i if i < 1 << 63 else None, len(x), sum(mark), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substrings_equal_brute_force(spark, tmp_path):
    rng = random.Random(7)
    passage = sentence(rng, n=20)
    texts = mixed(seed=5, n=10)
    texts += [passage, f"before {passage}", f"{passage} after", passage[:49], passage[:50], "ä" + passage[3:70] + "ä", "!" * 300, "!" * 120, "ab" * 200, "ab" * 90 + passage, passage + "\n" + passage]
    docs = [*enumerate(texts), (5, texts[5]), (5, "another text of the same id " + passage), (None, passage), (None, "unlike anything else " * 3)]
    folder = str(tmp_path / "sf")
    clashing(documents(spark, docs)).write.parquet(f"{folder}/documents.parquet")
    assert Counter(tuple(r) for r in substrings.op8_substrings(spark, folder).collect()) == brute_substrings(docs)
    assert substrings.remaining(documents(spark, [])).count() == 0


def test_a_hot_anchor_is_spread_over_bounded_shards(spark, tmp_path):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda n: "".join(rng.choices(letters, k=n))
    grams = [word(16) for _ in range(20_000)]
    hot = min(grams, key=lambda g: int(substrings._gram_hashes(np.frombuffer(g.encode(), np.uint8))[0]))
    texts = [word(40) + hot + word(40) for _ in range(150)]  # one anchor, all different around it
    side = word(17)
    texts += [word(30) + hot + side + word(30) for _ in range(80)]  # more of the surroundings in common
    texts += [word(20) + side + hot + side[:3] + word(30) for _ in range(80)]
    passage = word(20) + hot + word(14)
    texts += [word(9) + passage + word(9) for _ in range(80)] + texts[:20] + [t[7:90] for t in texts[140:160]]
    docs = [*enumerate(texts), (3, texts[200]), (None, texts[201])]
    frame, shard = documents(spark, docs), 6_000
    packed = common.chunks(frame)
    weight = lambda blob: sum(len(common.expand(blob)[1]) * substrings.EACH + len(common.expand(blob)[0]) for _ in [0])

    def most(df):
        held = Counter()
        for r in df.filter("cell >= 0").collect():
            held[r["cell"]] += weight(bytes(r["blob"]))
        return max(held.values())

    assert most(substrings.shards(packed)) > 5 * shard
    assert most(substrings.shards(packed, shard=shard)) <= 2 * shard
    got = substrings.deduplicated(frame, substrings._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", shard=shard, chunk=4000)
    assert Counter(tuple(r) for r in got.collect()) == brute_substrings(docs)
    got = substrings.deduplicated(frame, substrings._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", shard=1, steps=6, cell=9000)
    assert Counter(tuple(r) for r in got.collect()) == brute_substrings(docs)


def test_segments_that_share_only_an_anchor_are_not_sorted(monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)).encode()
    gram = min((word(16) for _ in range(20_000)), key=lambda g: int(substrings._gram_hashes(np.frombuffer(g, np.uint8))[0]))
    beside, ahead = word(34), word(34)
    loose = [word(34) + gram + word(34) for _ in range(50)]
    meeting = [beside + gram + word(34), beside + gram + word(34), word(34) + gram + ahead, word(34) + gram + ahead, beside[17:] + gram + ahead[:17], beside[16:] + gram + ahead[:17]]
    seen, sort = [], substrings.sorted_suffixes
    monkeypatch.setattr(substrings, "sorted_suffixes", lambda text, length: seen.append(text) or sort(text, length))
    got = []
    for segments in (meeting, loose + meeting):
        which, a, e = substrings._removed_windows(segments, np.array([len(x) for x in segments]), np.arange(len(segments)), 50)
        got.append({(segments[k], x, y) for k, x, y in zip(which.tolist(), a.tolist(), e.tolist(), strict=True)})
    assert seen == [b"".join(meeting)] * 2 and got[0] == got[1]
    assert got[0] == {(meeting[1], 0, 50), (meeting[3], 34, 84), (meeting[5], 1, 51)}
    assert substrings._removed_windows(loose, np.array([len(x) for x in loose]), np.arange(50), 50)[0].size == 0


def test_segments_of_a_split_cell_are_dealt_together(monkeypatch):
    """Only anchors that are too frequent alone are looked at one by one; all others go to their part of the cell at once."""
    rng = random.Random(5)
    passages = [sentence(rng, n=40).encode() for _ in range(60)]
    body = bytes(common._chunk(0, list(range(80)), [b" ".join(rng.sample(passages, 5)) for _ in range(80)]).column("body")[0].as_py())
    monkeypatch.setattr(substrings, "_split", lambda *a: pytest.fail("a segment was dealt alone"))
    sent = substrings._sent(body, 50, 16, 2)
    answers = [substrings._told([blob], shard, 136)[0] for (_, blob), shard in zip(sent, (1 << 30, 60_000), strict=True)]
    rows = substrings._dealt(body, [c for c, _ in sent], answers, 50, 16, 2, 2)
    assert len({r[0] for r in rows}) == len(rows) > 4 and sum(0 <= r[0] < 2 for r in rows) == 1  # the second cell is split

    def found(rows):
        tables = [substrings._sorted_out(pa.table({"chunk": pa.array([0], pa.int64()), "blob": pa.array([blob], pa.binary())}), 50) for c, blob in rows if c >= 0]
        parts = [common.expand(blob) for c, blob in rows if c < 0] + [common.expand(b) for got in tables for b in got.column("blob").to_pylist()]
        return [x.tolist() for x in substrings._merged(*[np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)])]

    whole = substrings._dealt(body, [c for c, _ in sent], [substrings._told([blob], 1 << 30, 136)[0] for _, blob in sent], 50, 16, 2, 2)
    assert found(rows) == found(whole) and len(found(rows)[0]) > 50


def test_anchors_depend_on_content_only(monkeypatch):
    rng = random.Random(2)
    shared = sentence(rng, n=30).encode()
    keys = lambda text, a: {(int(h), int(f) - a) for h, f, m in zip(*substrings.anchored(text), strict=True) if f >= a and f + m - 1 + 50 <= a + len(shared)}
    one, two = keys(b"x" * 100 + shared + b"y" * 60, 100), keys(b"some other beginning " * 9 + shared + b"z" * 60, 189)
    assert len(one & two) >= len(one) - 2 and len(one) > 3
    text = b"".join(sentence(rng, n=60).encode() for _ in range(3))
    whole = substrings.anchored(text)
    monkeypatch.setattr(substrings, "_CHUNK", 37)
    parts = substrings.anchored(text)
    cover = lambda got: [int(h) for h, f, m in zip(*got, strict=True) for _ in range(int(m))]
    assert cover(whole) == cover(parts)


# --- op4

def test_quality(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 0
        words = sentence(rng, n=60).split()
        if toxic:
            words[rng.randrange(60)] = rng.choice(["vile", "nasty"])
        text = "&&& ".join(words).upper() if bad else " ".join(words)
        rows.append((i, text, None, f"http://site{i % 7}.example/{'bad' if bad else 'good'}/{i}", 0))
        if i % 2:
            continue
        labels.append((i, int(not bad), int(toxic)))
    labels += [(401, 1, 0), (1, None, 1), (3, 5, 5)]
    docs = clashing(spark.createDataFrame([*rows, (500, None, None, None, 0), (501, "", None, "", 0)], "doc_id long, text string, lang string, source string, n_chars long")).withColumn("host", F.lit(1)).withColumn("own", F.lit(2))
    got = {r["doc_id"]: r for r in quality.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 402 and all(0 <= r["quality"] <= 1 and 0 <= r["toxic"] <= 1 for r in got.values())
    unseen = [i for i in range(400) if i % 2]
    assert sum((got[i]["quality"] >= 0.5) == (i % 4 != 0) for i in unseen) >= 0.97 * len(unseen)
    assert sum((got[i]["toxic"] >= 0.5) == (i % 5 == 0) for i in unseen) >= 0.95 * len(unseen)


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.scored(documents(spark, [(1, "text"), (2, None)]), none).collect()
    assert {(r["doc_id"], r["quality"], r["toxic"]) for r in got} == {(1, 0.5, 0.0), (2, 0.5, 0.0)}
    assert quality.scored(documents(spark, []), none).count() == 0


def brute_strength(sites):
    """sites: (n, k, what it shrinks to)."""
    n, pairs, within = sum(n for n, _, _ in sites), sum(n * (n - 1) for n, _, _ in sites), sum(n * p * (1 - p) for n, _, p in sites)
    if not n or not pairs or not within:
        return 1e4
    between = max((sum((k - n * p) ** 2 for n, k, p in sites) - within) / pairs, within / n / 1e4)
    return min(max(within / n / between - 1, 1.0), 1e4)


def brute_sites(rows, labels, target):
    """Each row's site posterior without the labels of its own id."""
    split = lambda source: ((source or "").partition("/")[0], (source or "").partition("/")[2].partition("/")[0])
    valid = [(i, x[target]) for i, x in labels if x[target] in (0, 1)]
    counts, hosts = Counter(), Counter()
    for i, y in valid:
        for source in [r[2] for r in rows if r[0] == i and i is not None]:
            host, path = split(source)
            counts[host, path, "n"] += 1
            counts[host, path, "k"] += y
            hosts[host, "n"] += 1
            hosts[host, "k"] += y
    names = sorted({x[0] for x in hosts})
    total = sum(hosts[h, "n"] for h in names)
    rate = (sum(hosts[h, "k"] for h in names) + 0.5) / (total + 1) if total else 0.5
    strong = brute_strength([(hosts[h, "n"], hosts[h, "k"], rate) for h in names])
    of_host = lambda h, n=0, k=0: (max(hosts[h, "k"] - k, 0) + strong * rate) / (max(hosts[h, "n"] - n, 0) + strong)
    paths = sorted({x[:2] for x in counts})
    weak = brute_strength([(counts[h, p, "n"], counts[h, p, "k"], of_host(h)) for h, p in paths])
    out = []
    for i, _, source in rows:
        n, k = sum(j == i for j, _ in valid if i is not None), sum(y for j, y in valid if j == i and i is not None)
        host, path = split(source)
        out.append((max(counts[host, path, "k"] - k, 0) + weak * of_host(host, n, k)) / (max(counts[host, path, "n"] - n, 0) + weak))
    return out, rate


def test_quality_query_equals_brute_force(spark, tmp_path):
    rng, folder = random.Random(16), str(tmp_path / "sf")
    rows, labels = [], []
    for i in range(240):
        host, path = rng.randrange(4), rng.randrange(3)
        bad = rng.random() < (0.1, 0.5, 0.8, 0.4)[host] * (1 + path) / 2
        rows.append((i, " ".join(w + ("&&" if bad else "") for w in sentence(rng, n=30).split()), rng.choice([f"h{host}/p{path}/{i}", f"h{host}/p{path}"])))
        if i % 3:
            labels.append((i, {"quality": int(not bad), "toxic": int(rng.random() < 0.3)}))
    rows += [(900, "no labels here", "h9/x"), (901, "new path", "h1/new/1"), (None, "no id", "h1/p1"), (902, None, None), (903, "", ""), (5, rows[5][1], "h2/p0"), rows[7]]
    labels += [(1, {"quality": 1, "toxic": 0}), (2, {"quality": 5, "toxic": None}), (None, {"quality": 1, "toxic": 1}), (4000, {"quality": 0, "toxic": 1})]
    frame = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clashing(frame).write.parquet(f"{folder}/documents.parquet")
    known = spark.createDataFrame([(i, x["quality"], x["toxic"]) for i, x in labels], "doc_id long, quality int, toxic int")
    known.write.parquet(f"{folder}/labels.parquet")
    got = sorted(quality.op4_quality(spark, folder).collect(), key=str)
    models = quality.fit(frame, known, ("quality", "toxic"))
    want = []
    posts = {t: brute_sites(rows, labels, t) for t in ("quality", "toxic")}
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for k, (i, text, _) in enumerate(rows):
        row = {"doc_id": i}
        for t, (post, rate) in posts.items():
            shares, held = quality.features((text or "").encode())
            odds = float(models[t].odds(shares[None], [held])[0]) + logit(post[k]) - logit(rate)
            row |= {t: 1 / (1 + np.exp(-odds)), f"{t}_site": post[k]}
        want.append(row)
    key = lambda r: (str(r["doc_id"]), round(r["quality_site"], 9), round(r["quality"], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g["doc_id"] == w["doc_id"] and all(abs(g[c] - w[c]) < 1e-5 for c in w if c != "doc_id")
        assert g["keep"] == (w["quality"] >= 0.5 and w["toxic"] < 0.5)


def test_sparse_sites_shrink(spark):
    """A path of one label stays near its host; a host of few near the global rate; paths spread around their hosts."""
    rows = [(i, "t", None, f"h{i % 2}/a" if i < 200 else "new/b" if i < 201 else "h0/rare", 0) for i in range(202)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 if i % 2 else int(i % 10 == 0), 0) for i in range(202)], "doc_id long, quality int, toxic int")
    sites = quality.Sites(docs.join(labels, "doc_id"), ("quality", "toxic"))
    post = {(r["host"], r["path"]): r["p"] for r in sites.table.select("host", "path", sites.posterior("quality").alias("p")).collect()}
    assert post["h1", "a"] > 0.9 > sites.rates["quality"] > 0.3 > post["h0", "a"] and post["h0", "a"] < post["new", "b"] < post["h1", "a"]
    assert post["h0", "a"] - 0.1 < post["h0", "rare"] < 0.5  # its one label is 1
    # hosts differ, their paths don't: a path's prior is far stronger than a host's
    assert sites.of_path["quality"] > 10 * sites.of_host["quality"]

