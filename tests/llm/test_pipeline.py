import hashlib
import random
from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from talliq.llm import bpe, common, pii

from .corpus import documents, sentence


def test_stages_take_effect(spark, tmp_path):
    rng, folder = random.Random(21), str(tmp_path / "sf")
    item = sentence(rng, n=30)
    clean = [(i, sentence(rng, lang, rng.randint(30, 60)), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 15)]
    near = " ".join([*clean[0][1].split()[:-1], "end"])
    extra = [(100, None, "en"), (101, "123 456", "en"), (102, "", None), (103, clean[1][1], "de"), (104, near, "en"), (105, f"{clean[4][1][:30]} {item} and more words follow", "en"), (106, f"write to joe.doe@example.com about {sentence(rng, n=30)}", "en"), (0, clean[0][1], "en"), (None, f"nobody {sentence(rng, n=30)}", "en")]
    docs = documents(spark, clean + extra)
    docs.withColumn("told", F.lit(1)).withColumn("spans", F.lit(1)).withColumn("class_id", F.lit(2)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, folder)
        at.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        assert set(at.columns) == set(pipeline.COLUMNS), name
    ids = {name: sorted((r["doc_id"] for r in spark.read.parquet(f"{folder}/{name}").select("doc_id").collect()), key=str) for name, _ in pipeline.STAGES[:-1]}
    kept = {*range(60), 103, 104, 105, 106, None}
    assert set(ids["language_id"]) == kept and len(ids["language_id"]) == len(kept) + 1
    assert set(ids["near_duplicates"]) == kept - {103, 104} and len(ids["near_duplicates"]) == len(kept) - 2
    assert set(ids["decontamination"]) == kept - {103, 104, 105}
    redacted = {r["doc_id"]: r for r in at.collect()}
    assert redacted[106]["text"].startswith("write to [EMAIL] about") and redacted[106]["n_chars"] == len(redacted[106]["text"]) and redacted[7]["text"] == clean[7][1]
    out = pipeline.run(spark, folder)
    assert out.count() == len(kept) - 3 and "ids_sha256" in out.columns


def test_stages_judge_rows_rather_than_ids(spark, tmp_path):
    rng, folder = random.Random(22), str(tmp_path / "sf")
    item = sentence(rng, n=30)
    one, two, three, bare = (sentence(rng, n=50) for _ in range(4))
    near = " ".join([*one.split()[:-1], "end"])
    rows = [(1, one), (1, two), (1, near), (2, three), (2, three), (2, f"{three[:40]} {item} and more"), (None, bare), (None, bare), (None, near), (None, f"nobody {item} has an id"), (3, ""), (4, None)]
    documents(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    for given in (docs, docs.filter("true").dropDuplicates(["doc_id", "text"]), documents(spark, rows)):
        left = pipeline.near_duplicates(spark, given, folder)
        assert set(left.columns) == set(pipeline.COLUMNS)
        got = pairs(left)
        first = [p for p in got if p in {(1, one), (1, near)}]
        assert len(first) == 1 and sorted([p for p in got if p not in first], key=str) == sorted([(1, two), (2, three), rows[5], (None, bare), rows[9], (3, ""), (4, None)], key=str)
        assert pairs(pipeline.decontaminated(spark, given, folder)) == sorted([p for p in pairs(given) if item not in (p[1] or "")], key=str)


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "sf")
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert pipeline.run(spark, folder).count() == 0


def brute_language(rows, model):
    """Rows that have a letter; the machines take no others."""
    return [r for r in rows if any(c.isalpha() for c in r["text"] or "")]


def brute_near(rows):
    """The row of the least id (bare ones last) of each group that similarity of at least 0.8 joins."""
    hashes = common.WordHashes()
    sets = [set(common.shingle_set(hashes(common.words_of((r["text"] or "").encode()))).tolist()) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    return [sorted((rows[k]["doc_id"] is None, rows[k]["doc_id"] or 0) for k in g)[0] for g in groups.values()], [{(rows[k]["doc_id"], rows[k]["text"]) for k in g} for g in groups.values()]


def brute_clean(rows, items):
    split = lambda t: [w.decode() for w in common.words_of((t or "").encode())]
    shingles = lambda w, z: Counter(tuple(w[i : i + z]) for i in range(max(1, len(w) - z + 1)))

    def leaks(text):
        words = split(text)
        for item in items:
            own = split(item)
            z = min(5, len(own))
            want = shingles(own, z) if own else Counter()
            for s in range(max(1, len(words) - len(own) + 1)) if words and own else ():
                c = shingles(words[s : s + len(own)], z)
                both = sum((c & want).values())
                if both >= 0.8 * (sum(c.values()) + sum(want.values()) - both) - 1e-9:
                    return True
        return False

    return [r for r in rows if not leaks(r["text"])]


def test_each_stage_equals_brute_force(spark, tmp_path):
    """Every stage's whole result on what its predecessor kept."""
    rng, folder = random.Random(33), str(tmp_path / "sf")
    items = [sentence(rng, n=n) for n in (12, 25, 40)]
    rows = [(i, sentence(rng, lang, rng.randint(6, 90)), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 12)]
    for k in range(30):
        i, text, lang = rng.choice(rows)
        words = text.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{k}"
        rows.append((100 + k, " ".join(words), lang))
    for k in range(12):
        item = rng.choice(items).split()
        for _ in range(rng.randint(0, 2)):
            item[rng.randrange(len(item))] = "odd"
        rows.append((200 + k, f"{sentence(rng, n=rng.randint(0, 20))} {' '.join(item)} {sentence(rng, n=5)}", "en"))
    rows += [(300 + k, f"{sentence(rng, n=8)} {x}", "en") for k, x in enumerate(("joe.doe@example.com", "+1 (774) 555-1544", "10.0.0.7 and 4111111111111111", "call 555-123-4567 now"))]
    rows += [(400, None, "en"), (401, "1 2 3", None), (402, "", None), (None, rows[0][1], "en"), (None, "nobody has this one text here", None), (3, rows[3][1], "es"), (3, "another text under id three", "en")]
    documents(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, key = spark.read.parquet(f"{folder}/documents.parquet"), lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    result = {}
    for name, stage in pipeline.STAGES:
        given = at.collect()
        stage(spark, at, folder).write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        result[name] = (given, at.collect())
    given, got = result["language_id"]
    assert sorted(got, key=key) == sorted(brute_language(given, None), key=key)
    given, got = result["near_duplicates"]
    least, groups = brute_near(given)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(least)
    assert all(sum((r["doc_id"], r["text"]) in g for r in got) >= 1 for g in groups) and len(got) == len(groups)
    given, got = result["decontamination"]
    assert sorted(got, key=key) == sorted(brute_clean(given, items), key=key)
    given, got = result["pii"]
    field = pii.trained()
    clean = lambda t: pii._cut_out(t, [(pii.KINDS[k], b, e) for k, b, e, _ in pii.spans_of([t], field)[0]])
    want = [r.asDict() | {"text": clean(r["text"]), "n_chars": len(clean(r["text"]))} for r in given]
    assert sorted((r.asDict() for r in got), key=key) == sorted(want, key=key) and sum("[" in r["text"] for r in got) >= 4
    given, got = result["byte_bpe"]
    with open(bpe.default_ranks(), "rb") as f:
        encode = bpe._encoder(f.read(), bpe.default_pattern()).encode_ordinary
    want = [(r["doc_id"], len(encode(r["text"])), hashlib.sha256(" ".join(map(str, encode(r["text"]))).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in given]
    assert Counter(tuple(r) for r in got) == Counter(want)
    out = pipeline.run(spark, folder)
    assert Counter(tuple(r) for r in out.select(at.columns).collect()) == Counter(want)
