import hashlib
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from talliq.llm import bpe, langid, licenses, pii, secrets

from .corpus import EDGES, documents, mixed, sentence


def with_clashes(df):
    """Columns that operators might use themselves."""
    for name in ("bucket", "cell", "token", "spans", "s", "found", "label", "keys", "rep", "words", "h", "at", "own", "told", "p"):
        df = df.withColumn(name, F.lit(1))
    return df


# --- op7

@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_ranks(), "rb") as f:
        return bpe._encoder(f.read(), bpe.default_pattern())


@pytest.mark.parametrize("sizes", [{}, {"chunk": 300, "cell": 200}])
def test_bpe_query_equals_the_library_and_decodes(spark, encoder, sizes, tmp_path, monkeypatch):
    texts = [*mixed(), "'s 't I'll we've\n\n  x  \n", "   ", "1234567 ½ ²", "汉字 кириллица עברית", "long text, in pieces. " * 400]
    monkeypatch.setattr(bpe, "LONG", 5000)
    folder = str(tmp_path / "sf")
    with_clashes(documents(spark, list(enumerate(texts)))).write.parquet(f"{folder}/documents.parquet")
    query = bpe.encode_digests(spark.read.parquet(f"{folder}/documents.parquet"), **sizes) if sizes else bpe.op7_byte_bpe(spark, folder)
    got = {r["doc_id"]: r for r in query.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = encoder.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want, text


def test_bpe_round_trip_and_repeated_rows(spark):
    rows = [(1, "same text"), (1, "same text"), (None, "no id"), (2, None)]
    got = bpe.decode(bpe.encode_ids(documents(spark, rows))).collect()
    assert sorted((bytes(r["bytes"]).decode(), r["doc_id"]) for r in got if r["doc_id"] is not None) == [("", 2), ("same text", 1), ("same text", 1)]
    assert [bytes(r["bytes"]) for r in got if r["doc_id"] is None] == [b"no id"]
    assert bpe.encode_digests(documents(spark, [])).count() == 0


def test_each_distinct_word_is_encoded_once(spark, encoder):
    """A word's ids come from its cell; positions bring it back to each place."""
    chunk, split = bpe._Chunk(), bpe._splitter(bpe.default_pattern())
    for i, text in ((1, "to be or not to be"), (None, ""), (2, " be")):
        chunk.add(i, text, split)
    rows = chunk.rows(7, 3).to_pydict()
    there, ids, counts, at, places = bpe.expand(rows["body"][0])
    assert places.tolist().count(0) == 3 and sorted(at.tolist()) == [0, 1, 2, 3, 4]  # " be" stands most often
    places = at[places]
    words = [r for c, b in sorted(zip(rows["cell"][1:], rows["body"][1:], strict=True)) for r in [bpe.expand(b)]]
    flat = [w for sizes, raw in words for w in bpe.np.split(raw, bpe.np.cumsum(sizes)[:-1])]
    assert there.tolist() == [1, 0, 1] and ids.tolist() == [1, 0, 2] and counts.tolist() == [6, 0, 1]
    assert len(flat) == 5 and b"".join(flat[k].tobytes() for k in places) == b"to be or not to be be"


def test_unknown_ids_raise(spark):
    got = spark.createDataFrame([(1, [0]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert sorted((r["doc_id"], bytes(r["bytes"])) for r in bpe.decode(got).collect()) == [(1, b"!"), (2, b""), (3, b"")]
    with pytest.raises(Exception, match="unknown id"):
        bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>")).collect()


# --- op5

def test_languages_held_out(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, rng.randint(4, 60)), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 80)]
    docs = documents(spark, rows)
    model = langid.fit(docs.filter(~langid.held_out()))
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = with_clashes(docs).select("doc_id", "lang", langid.held_out().alias("h"), langid.predicted(model, spark).alias("q")).collect()
    held = [r for r in got if r["h"]]
    assert len(held) > 50 and sum(r["lang"] == r["q"]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["q"]["score"] <= 1 for r in got)


def brute_prediction(model, text):
    """Family by the greatest margin; within it, votes of each pair, ties by the sum of squashed margins."""
    x = langid.np.append(langid.features(text.encode()), 1.0)
    squash = lambda m: 1 / (1 + langid.np.exp(-2.0 * m))
    margins = [float(x @ w) for w in model.outer] or [0.0]
    k = max(range(len(margins)), key=lambda j: margins[j])
    members, score = model.members[model.families[k]], float(squash(margins[k])) if model.outer else 1.0
    votes, sums = [0] * len(members), [0.0] * len(members)
    for i, a in enumerate(members):
        for j in range(i + 1, len(members)):
            m = float(x @ model.inner[a, members[j]])
            votes[i if m > 0 else j] += 1
            sums[i] += squash(m)
            sums[j] += squash(-m)
    pick = max(range(len(members)), key=lambda j: (votes[j] + sums[j] / (len(members) + 1), -j))
    return members[pick], score * (sums[pick] / (len(members) - 1) if len(members) > 1 else 1)


def test_language_query_equals_brute_force(spark, tmp_path):
    from zlib import crc32

    rng, folder = random.Random(12), str(tmp_path / "sf")
    rows = [(i, sentence(rng, lang, rng.randint(1, 50)), lang if i % 7 else None) for i, lang in enumerate(["en", "de", "fr", "es"] * 40)]
    rows += [(1000 + i, t, "en") for i, t in enumerate(EDGES)] + [(None, rows[1][1], "de"), rows[2]]
    docs = documents(spark, rows)
    with_clashes(docs).write.parquet(f"{folder}/documents.parquet")
    # the rows to learn from are those of the query: labelled, and not held out
    learned = [r for r in rows if r[0] is not None and crc32(str(r[0]).encode()) % 4 != 2]
    model = langid.fit(documents(spark, learned))
    got = langid.op5_language_id(spark, folder).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, (i, text, _) in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        letters = any(c.isalpha() for c in text or "")
        lang, score = brute_prediction(model, text) if letters else ("und", 0.0)
        assert (g["doc_id"], g["held_out"], g["lang_pred"]) == (i, i is not None and crc32(str(i).encode()) % 4 == 2, lang)
        assert abs(g["score"] - score) < 1e-4 and 0 <= g["score"] <= 1
    held = [(g, w) for g, w in zip(sorted(got, key=key), sorted(rows, key=key), strict=True) if g["held_out"] and w[2] and len(w[1].split()) > 8]
    assert sum(g["lang_pred"] == w[2] for g, w in held) >= 0.97 * len(held) > 20


def test_fitting_reads_a_bounded_number_of_rows(spark):
    rng = random.Random(2)
    docs = documents(spark, [(i, sentence(rng, n=5), f"l{i % 10}") for i in range(600)])
    seen = []
    real = langid.Model
    langid.Model = lambda langs, x: seen.append(len(x)) or real(langs, x)
    try:
        langid.fit(docs, most=100)
    finally:
        langid.Model = real
    assert 50 <= seen[0] <= 160


def test_language_edges(spark):
    docs = documents(spark, [(i, t, "en" if i % 2 else None) for i, t in enumerate([*EDGES, "123 !?"])])
    model = langid.fit(docs)
    got = docs.select("text", langid.predicted(model, spark).alias("q")).collect()
    for r in got:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert r["q"]["lang"] == ("en" if letters else "und") and (letters or r["q"]["score"] == 0)
    assert langid.fit(documents(spark, [])) is None
    assert documents(spark, [(1, "abc")]).select(langid.predicted(None, spark)["lang"]).first()[0] == "und"
    assert langid.family_of("xx") == "xx"


# --- op6 and op9: exact spans against the patterns as they are written

def plain(pattern, text, keep, flags=0):
    return [m.span() for m in re.finditer(pattern, text, flags) if keep(m)]


def test_exact_secrets_equal_the_patterns():
    rng = random.Random(2)
    parts = ["password", "PASSWD", "secret", "token", "api_key", "ApiKey", " ", "=", ": ", '"', "'", "abc123", "AKIA", "A1Z2" * 4, "0123456789abcdef", "f" * 9, "\n", "é", "ſecret", "toKen"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = [("assign", *s) for s in plain(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, lambda m: len(m[2]) >= 6, re.I | re.A)]
        want += [("access", *s) for s in plain("AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 20)] + [("hex", *s) for s in plain("[0-9a-f]+", text, lambda m: len(m[0]) >= 24)]
        assert secrets.exact_spans(text) == want


def test_random_strings_pass_and_words_fail():
    rng = random.Random(4)
    for name, _, values in secrets._SETS:
        ps = [secrets.battery("".join(rng.choices(list(values), k=40)), values) for _ in range(400)]
        assert sum(p < 0.05 for p in ps) < 0.12 * 400 and sum(p > 0.5 for p in ps) > 0.35 * 400, name
    for text in ("configuration_options_version_2", "aaaaaaaaaaaaaaaaaaaaaaaa1", "0101010101010101010101010101", "the-quick-brown-fox-jumps-2024"):
        found = secrets.inferred(text)
        assert found is None or secrets.battery(text, found[1]) < 0.05
    assert secrets.inferred("abcdefghijklmnopqrstuvwx") is None and secrets.inferred("12345678901234567890") is None


def planted_secrets(rng, name, alphabet, length):
    return "".join(rng.choices(alphabet, k=length))


def readable(rng):
    words = ["config", "option", "version", "Request", "handler", "user", "Model", "index", "PATH", "build", "test", "value2", "v1", "x64", "utf8", "2024", "id7", "main", "Http", "Data"]
    out = rng.choice(words)
    while len(out) < rng.choice([20, 24, 32, 40, 48]):
        out += rng.choice(["_", "-", "/", "", ""]) + rng.choice(words)
    return out


def test_added_spans_are_precise_and_find_most(spark):
    """Random and readable runs of every encoding and length: shares found, and share of the found that is random."""
    rng = random.Random(41)
    truth, texts = {}, []
    for name, alphabet in secrets.ENCODINGS:
        if name in ("hex", "HEX"):  # the base patterns have these from 24 digits on
            continue
        for length in (24, 32, 40, 64):
            for _ in range(40):
                truth[len(texts)] = (name, length, planted_secrets(rng, name, alphabet, length))
                texts.append(f"see {truth[len(texts)][2]} there")
    texts += [f"see {readable(rng)} there" for _ in range(2500)]
    docs = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["q"] if s["kind"] == "random"] for r in docs.select("doc_id", secrets.found(spark, secrets.bars(docs)).alias("q")).collect()}
    found = [i for i, q in got.items() if q]
    right = [i for i in found if i in truth]
    assert len(right) >= 0.9 * len(found)
    for length, least in ((24, 0.5), (32, 0.7), (40, 0.7), (64, 0.7)):
        mine = [i for i, t in truth.items() if t[1] == length]
        assert sum(bool(got[i]) for i in mine) >= least * len(mine), length


def test_p_values_of_random_runs_are_uniform():
    rng = random.Random(8)
    for name, alphabet, values in secrets._SETS:
        for n in (20, 24, 40, 100):
            ps = sorted(secrets.battery("".join(rng.choices(sorted(alphabet), k=n)), values) for _ in range(600))
            for q in (0.05, 0.2, 0.5):
                share = sum(p < q for p in ps) / len(ps)
                assert abs(share - q) < 0.1, (name, n, q, share)


def test_tokens_within_paths(spark):
    rng = random.Random(5)
    tokens = [planted_secrets(rng, "base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 48) + "7a" for _ in range(20)]
    texts = [f"get /v1/user-keys/{t}/some_path now" for t in tokens] + ["/some/path-to/a_file/with-words/in/it"] * 5
    docs = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["q"]] for r in docs.select("doc_id", secrets.found(spark, secrets.bars(docs)).alias("q")).collect()}
    assert sum(got[i] == [t] for i, t in enumerate(tokens)) >= 17 and not any(got[i] for i in range(20, 25))


def test_secret_query_equals_brute_force(spark, tmp_path):
    """Counts, digests and the order of spans, with the added spans from candidates and bars."""
    rng, folder = random.Random(19), str(tmp_path / "sf")
    pieces = ["password=hunter22", 'secret: "abc123def"', "AKIA" + "A1B2C3D4E5F6G7H8", "0123456789abcdef" * 2, "plain words", "ä token = ünot", "api_key=short"]
    keys = [planted_secrets(rng, "base62", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", 50) for _ in range(30)]
    texts = [*EDGES, *(" ".join(rng.choice([*pieces, *keys]) for _ in range(rng.randint(0, 8))) for _ in range(80))]
    docs = with_clashes(documents(spark, [*enumerate(texts), (None, texts[-1]), (3, texts[3])]))
    docs.write.parquet(f"{folder}/documents.parquet")
    bar, got = secrets.bars(docs), secrets.op6_secrets(spark, folder).collect()
    assert bar and len(got) == len(texts) + 2
    for r in got:
        text = texts[-1] if r["doc_id"] is None else texts[r["doc_id"]] or ""
        base = [(s, 0, e) for s, e in plain(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, lambda m: len(m[2]) >= 6, re.I | re.A)]
        base += [(s, 1, e) for s, e in plain("AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 20)] + [(s, 2, e) for s, e in plain("[0-9a-f]+", text, lambda m: len(m[0]) >= 24)]
        added = [(s, 3, e) for s, e, encoding, length, p in secrets.candidates(text) if p >= bar.get((encoding, length), 2) and not any(s < y and x < e for x, _, y in base)]
        spell = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(spell(base).encode()).hexdigest() and r["spans"] == spell(base + added), text
    assert any("random" in r["spans"] for r in got)


def test_secret_scan(spark):
    rng = random.Random(9)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=48)).replace("/", "x") + "9aZ"
    texts = [*EDGES, f"see {key} there", 'token = "abcdef0123456789abcdef01"', "clean words only", "version_name_with_number_2 and path/to/some/file/name1"]
    docs = with_clashes(documents(spark, list(enumerate(texts))))
    bar = secrets.bars(docs)
    got = {r["doc_id"]: r["q"] for r in docs.select("doc_id", secrets.found(spark, bar).alias("q")).collect()}
    kinds = lambda i: [(s["kind"], texts[i][s["start"] : s["end"]]) for s in got[i]]
    n = len(EDGES)
    assert kinds(n) == [("random", key)]
    assert kinds(n + 1) == [("assign", 'token = "abcdef0123456789abcdef01'), ("hex", "abcdef0123456789abcdef01")]
    assert kinds(n + 2) == kinds(n + 3) == [] and all(not got[i] for i in range(n))
    assert secrets.bars(documents(spark, [])) == {}


def test_length_sets_the_bar():
    counts = secrets.np.zeros(secrets.BINS)
    counts[25:] = 1
    counts[:25] = 1
    assert secrets._bar(counts, 40, 0.1) == 1 / secrets.BINS
    few = secrets.np.zeros(secrets.BINS)
    few[30] = 1
    assert secrets._bar(few, 20, 0.1) is None and secrets._bar(few, 40, 0.1) is not None


def test_exact_pii_equals_the_patterns():
    rng = random.Random(3)
    parts = ["a", ".", "@", "x-y", "_", "1", "25", "256", "+1", " ", "(", ")", "555", "-", "4111111111111111", "4", "é", "%"]
    digits = lambda s: sum(c in "0123456789" for c in s)
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        want = [("email", *s) for s in plain(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, bool)]
        want += [("ip", *s) for s in plain(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m[0].split(".")))]
        want += [("card", *s) for s in plain(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 13 <= digits(m[0]) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0])))]
        want += [("phone", *s) for s in plain(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 9 <= digits(m[0]) <= 15)]
        assert pii.exact_spans(text) == want, text


@pytest.fixture(scope="module")
def field():
    return pii.trained()


def test_field_labels_held_out_sentences(field):
    wrong = total = 0
    for words, labels in pii.labelled_table(400, seed=77):
        for a, b in pii._runs(words):
            got = field.decode([[pii._features(words, k) for k in range(a, b)]])[0]
            wrong += sum(pii._LABELS[x] != y for x, y in zip(got, labels[a:b], strict=True))
            total += b - a
    assert wrong <= 0.02 * total


def test_viterbi_equals_enumeration(field):
    import itertools

    rows = [[pii._features(w, k) for k in range(len(w))] for w in (["+1", "(555)", "123-4567"], ["10.0.0.1"], ["x1", "4111", "1111", "1111"])]
    for row, got in zip(rows, field.decode(rows), strict=True):
        e = field.emit[pii.np.array(row)].sum(1)
        value = lambda y, e=e: field.move[0, y[0]] + field.move[y[-1], 0] + sum(e[t, c] for t, c in enumerate(y)) + sum(field.move[a, b] for a, b in itertools.pairwise(y))
        assert tuple(got) == max(itertools.product(range(len(pii._LABELS)), repeat=len(row)), key=value)


def test_pii_scan_and_redaction(spark, field):
    texts = [*EDGES, "mail joe.doe@example.com now", "call (774) 555-1544 today", "card 9807915762804490 here", "in 2024 there were 12 of 35", "from +1 (774) 555-1544 at 10.0.0.1"]
    docs = with_clashes(documents(spark, list(enumerate(texts)))).drop("spans").withColumn("spans", pii.found(spark, field=field))
    got = {r["doc_id"]: r for r in docs.withColumn("clean", pii.redacted()).withColumn("again", pii.cleaned(spark, field=field)).collect()}
    n = len(EDGES)
    assert all(r["again"] == r["clean"] for r in got.values())
    assert all(not got[i]["spans"] and got[i]["clean"] == texts[i] for i in range(n))
    assert got[n]["clean"] == "mail [EMAIL] now" and got[n + 2]["clean"] == "card [CARD] here" and got[n + 3]["clean"] == texts[n + 3]
    assert got[n + 1]["clean"] == "call [PHONE] today" and not got[n + 1]["spans"][0]["exact"]
    assert got[n + 4]["clean"] == "from [PHONE] at [IP]"
    assert [s["kind"] for s in got[n + 4]["spans"]] == ["ip", "phone"]
    assert documents(spark, []).select(pii.found(spark, field=field)).count() == 0


LONG = 1_000_000


@pytest.mark.parametrize("unit", ["7", ".", " ", "1.", "1 ", "1-", "+1", "+", "@", "a@", "a.", "x", "-", "(", "f", "A", "AKIA", "token", "token ", "secret=", "/", "\n", "Mr ", "Mr A", "A ", "Dear "])
def test_long_runs_take_linear_time(unit, field):
    import time

    text = unit * (LONG // len(unit))
    began = time.process_time()
    pii.exact_spans(text)
    secrets.exact_spans(text)
    secrets.candidates(text[: LONG // 10])
    assert time.process_time() - began < 6, unit
    began = time.process_time()
    pii.added_spans([text[: LONG // 20]], field)
    assert time.process_time() - began < 12, unit


def plain_pii(text, field):
    """All spans by the patterns as they are written, and the field's by decoding every word of the text at once."""
    digits = lambda s: sum(c in "0123456789" for c in s)
    out = [(0, *s, True) for s in plain(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, bool)]
    out += [(1, *s, True) for s in plain(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m[0].split(".")))]
    out += [(2, *s, True) for s in plain(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 13 <= digits(m[0]) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0])))]
    out += [(3, *s, True) for s in plain(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 9 <= digits(m[0]) <= 15)]
    words, at = [(m[0], *m.span()) for m in re.finditer(r"\S+", text)], []
    for a, b in pii._runs([w for w, _, _ in words]):
        labels = field.decode([[pii._features([w for w, _, _ in words], k) for k in range(a, b)]])[0]
        k = 0
        while k < len(labels):
            j = k
            while j < len(labels) and labels[j] == labels[k]:
                j += 1
            s, e = words[a + k][1], words[a + j - 1][2]
            while s < e and text[s] in pii._TRIM_LEFT:
                s += 1
            while e > s and text[e - 1] in pii._TRIM_RIGHT:
                e -= 1
            kind = pii._LABELS[labels[k]]
            if kind != "O" and pii._possible(kind, text[s:e]) and not any(s < y and x < e for _, x, y, _ in out):
                at.append((pii.KINDS.index(kind), s, e, False))
            k = j
    return sorted(out + at)


def spelled(spans, kinds):
    return ",".join(f"{kinds[s[0]]}:{s[1]}:{s[2]}" for s in spans)


def test_pii_query_equals_brute_force(spark, field, tmp_path, monkeypatch):
    rng = random.Random(31)
    monkeypatch.setattr(pii, "_PART", 7)
    sentences = pii.labelled_table(300, seed=5)
    texts = [*EDGES, *(" ".join(w for words, _ in rng.sample(sentences, 6) for w in words) for _ in range(60)), "\n".join(" ".join(w) for w, _ in sentences[:40]), "12 " * 50 + "call 555-123-4567"]
    folder = str(tmp_path / "sf")
    with_clashes(documents(spark, [*enumerate(texts), (None, texts[-1]), (3, texts[3])])).write.parquet(f"{folder}/documents.parquet")
    got = [r for r in pii.op9_pii(spark, folder).collect()]
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[-1] if r["doc_id"] is None else texts[r["doc_id"]] or ""
        want = plain_pii(text, field)
        base = [s for s in want if s[3]]
        assert r["spans"] == spelled(want, pii.KINDS), text
        assert r["base_sha256"] == hashlib.sha256(spelled(base, pii.KINDS).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in base) for k in range(4)]


def test_names_are_found_where_something_introduces_them(field):
    texts = [
        "I met Mr. Alden Brooks yesterday.", "Dear Quinlan Marsh, thank you", "my name is Tova Lindqvist and", "Dear Sir, we write", "Walden Pond is deep", "the Mr of the house", "Frau Ingrid Sommer schreibt",
        "signed\nPeregrin Hollow", "name is 7 and Mr 5", "Dr " * 5, "the called Number of it",
    ]
    got = [[t[a:b] for k, a, b in found if k == "name"] for t, found in zip(texts, pii.added_spans(texts, field), strict=True)]
    assert got[:9] == [["Alden Brooks"], ["Quinlan Marsh"], ["Tova Lindqvist"], [], [], [], ["Ingrid Sommer"], ["Peregrin Hollow"], []]


def test_neighbours_tell_cards_that_fail_luhn(field):
    texts = ["pay with 2123465659789240.", "rows 2123465659789240 | 7 | 9", "pay with 21234656597892401234567."]
    assert [[k for k, _, _ in found if k == "card"] for found in pii.added_spans(texts, field)][::2] == [["card"], []]


# --- op3

def brute_licenses(text):
    words = re.findall(licenses.common.WORD_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += here
        base |= {label} if here else set()
    labels, best = set(base), 1.0 if starts else 0.0
    for line in (text or "").split("\n"):
        held = set(re.findall(licenses.common.WORD_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), line)))
        for _, label, tokens, need in licenses.template_sets():
            share = len(held & set(tokens)) / len(tokens)
            if len(held & set(tokens)) >= need:
                labels.add(label)
                best = max(best, share)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


def test_licenses_equal_brute_force(spark, tmp_path):
    rng = random.Random(8)
    bits = ["CC BY", "cc-by", "General  Public License", "all rights reserved", "All Rights Reserved cc by cc by", "\n", "and", "Released under the MIT License", "Licensed under the Apache License, Version 2.0", "under the license released", "é cc by", " ", "mit"]
    texts = [*EDGES, *(" ".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(60)), *(t for _, t in licenses.TEMPLATES)]
    folder = str(tmp_path / "sf")
    documents(spark, list(enumerate(texts))).withColumn("token", F.lit(1)).withColumn("of", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.op3_licenses(spark, folder).collect()}
    for i, text in enumerate(texts):
        assert got[i][:6] == brute_licenses(text)[:6] and abs(got[i][6] - brute_licenses(text)[6]) < 1e-12, (text, got[i], brute_licenses(text))


def brute_windows(text):
    """Lines and windows: labels and score."""
    *_, labels, best = brute_licenses(text)
    labels = set(labels.split(",")) - {""}
    words = [w.decode() for w in licenses.common.words_of((text or "").encode())]
    for k, label, tokens, need in licenses.template_sets():
        width = len(licenses.common.words_of(licenses.TEMPLATES[k][1].encode()))
        for a in range(len(words)):
            held = len(set(words[a : a + width]) & set(tokens))
            if held >= need and "\n" in text:
                labels.add(label)
                best = max(best, held / len(tokens))
    return ",".join(sorted(labels)), best


def test_wrapped_notices(spark, tmp_path):
    rng = random.Random(18)
    wrapped = [(label, f"some code\n{mark}" + f"\n{mark}".join(textwrap.wrap(text, 34)) + "\nmore code") for label, text in licenses.TEMPLATES for mark in ("", " * ", "# ")]
    texts = [t for _, t in wrapped]
    texts += ["\n".join(w + " x" * 40 for w in text.split()) for _, text in licenses.TEMPLATES]  # scattered: no notice
    for _ in range(60):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["other", "the", "license", "public"])
        texts.append(" ".join(rng.choice([w, w, w, w + "\n", "\n" + w, w + "\n\n"]) for w in words))
    folder = str(tmp_path / "sf")
    documents(spark, list(enumerate(texts))).write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.op3_licenses(spark, folder).collect()}
    for i, (label, _) in enumerate(wrapped):
        assert label in got[i][0].split(",") and got[i][1] == 1.0, wrapped[i]
    for i, text in enumerate(texts):
        assert got[i][0] == brute_windows(text)[0] and abs(got[i][1] - brute_windows(text)[1]) < 1e-12, (text, got[i], brute_windows(text))
    assert not any(got[len(wrapped) + i][0] for i in range(len(licenses.TEMPLATES)))


def test_filters_leave_few_blocks_and_all_that_match(spark):
    """The positional filter rules out blocks that prefix and length filters leave; none of all three rules out a match."""
    templates = (("one", "a b c d e f g h i j"), ("two", "p q r s t"))
    sets = licenses.template_sets(templates, 0.6)
    order = list("pqrstabcdefghij")
    prefixes = licenses.prefix_table(spark, sets, order, templates)
    rng = random.Random(3)
    blocks = [sorted(rng.sample(order, rng.randint(1, 15)), key=order.index) for _ in range(400)]
    blocks.append([*"pqrst", *"efg"])  # long enough, with a word of the prefix, but only three words from it on
    frame = spark.createDataFrame(list(enumerate(blocks)), "doc_id long, tokens array<string>")
    got = {(r["doc_id"], r["template"]) for r in licenses.passing(frame, prefixes).collect()}
    need = {k: (set(words), n) for k, _, words, n in sets}
    match = {(i, k) for i, b in enumerate(blocks) for k, (words, n) in need.items() if len(words & set(b)) >= n}
    prefix = {k: [w for w in order if w in words][: len(words) - n + 1] for k, (words, n) in need.items()}
    loose = {(i, k) for i, b in enumerate(blocks) for k, (_, n) in need.items() if len(b) >= n and set(b) & set(prefix[k])}
    assert match <= got < loose and (400, 0) in loose - got
    assert licenses.passing(frame, prefixes).count() == len(got)


def test_licenses_edges(spark, tmp_path):
    folder = str(tmp_path / "sf")
    documents(spark, [(None, "cc by"), (1, "Released under the MIT License"), (1, "Released under the MIT License")]).write.parquet(f"{folder}/documents.parquet")
    got = [(r["doc_id"], r["labels"]) for r in licenses.op3_licenses(spark, folder).collect()]
    assert sorted(got, key=str) == [(1, "mit"), (1, "mit"), (None, "cc-by")]
    assert licenses.matched_blocks(documents(spark, [])).count() == 0


def test_fitting_gives_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(langid.common, "release", lambda: given.append(1))
    docs = spark.createDataFrame([(k, "ein Haus am See" if k % 2 else "a house by the lake", "de" if k % 2 else "en") for k in range(8)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is not None and given
