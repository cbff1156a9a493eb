"""Language identification by hierarchical discrimination.

A text is first assigned to a language family by linear support vector machines, then one-versus-one linear machines
separate the languages of that family. Features are hashed byte 1- to 4-grams of the whole text. The machines are fitted
on at most about PER_LANGUAGE labelled rows of each language, chosen by a hash of the id; which rows may be chosen is
the caller's filter. Only hashed counts of the chosen texts reach the driver.

Null text and text without a letter are `und` with score 0. Empty tables give an empty result; without a single labelled
row every text with a letter is `und` too. Whole texts count, however long; an arrow batch is in memory at once. Repeated
rows get equal results, ties between languages go to the first by name, rows without an id are not held out and not
learned from. Other columns of the table are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each language used for fitting, about; the only sampling in this operator.
PER_LANGUAGE = 400
#: Labelled rows used for fitting in all, about: what reaches the driver is 16 kB for each, however many languages there are.
MOST = 3200
DIMENSIONS = 1 << 13
UNDETERMINED = "und"

#: Families of closely related languages (fixed values; any other code is a family of its own).
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "uralic": ("fi", "et", "hu"),
}

#: ASCII letters lower-cased, bytes of longer characters kept, all else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower() in langs), lang)


def has_letter(text: bytes) -> bool:
    import regex

    return bool(regex.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def features(text: bytes) -> np.ndarray:
    """Square-rooted shares of hashed byte n-grams, of length 1."""
    letters = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    x = np.frombuffer(letters, np.uint8).astype(np.uint32)
    total = np.zeros(DIMENSIONS)
    h = x + np.uint32(1)
    for n in range(1, 5):
        total += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(19), minlength=DIMENSIONS)
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(0x01000193) + x[n:] + np.uint32(n)
    root = np.sqrt(total)
    return (root / np.sqrt(total.sum())).astype(np.float32)


def _machine(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> np.ndarray:
    """A linear machine with squared hinge loss by accelerated gradient descent; y is -1 or 1. x ends with a column of ones,
    so the last weight is the bias."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * len(y)
    rate = 1.0 / (1.0 + 2 * c * float(np.max(weight)) * 2.0)
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        grad = z - 2 * c / len(y) * (x.T @ (weight * y * slack))
        new = z - rate * len(y) / (len(y) + 1) * grad
        z, w = new + k / (k + 3) * (new - w), new
    return w


class Model:
    """Machines for families (one against the rest) and for each pair of languages within a family. Rows of x are features
    and a one."""

    def __init__(self, langs: np.ndarray, x: np.ndarray):
        names = sorted(set(langs.tolist()))
        self.families = sorted({family_of(n) for n in names})
        self.members = {f: [n for n in names if family_of(n) == f] for f in self.families}
        family = np.array([family_of(n) for n in langs.tolist()])
        sign = lambda hit: np.where(hit, 1.0, -1.0).astype(np.float32)
        self.outer = [_machine(x, sign(family == f)) for f in self.families] if len(self.families) > 1 else []
        self.inner = {}
        for members in self.members.values():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    of = (langs == a) | (langs == b)
                    self.inner[a, b] = _machine(x[of], sign(langs[of] == a))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        squash = lambda m: 1 / (1 + np.exp(-2.0 * m))
        if self.outer:
            margins = np.stack([x @ w for w in self.outer], 1)
            best = margins.argmax(1)
            score = squash(margins[np.arange(len(x)), best])
        else:
            best, score = np.zeros(len(x), int), np.ones(len(x))
        langs = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            at, members = np.flatnonzero(best == k), self.members[f]
            votes, margin = np.zeros((len(at), len(members))), np.zeros((len(at), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    m = x[at] @ self.inner[a, members[j]]
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    margin[:, i] += squash(m)
                    margin[:, j] += squash(-m)
            pick = (votes + margin / (len(members) + 1)).argmax(1) if len(at) else np.zeros(0, int)
            langs[at] = np.array(members, object)[pick]
            if len(members) > 1:
                score[at] *= margin[np.arange(len(at)), pick] / (len(members) - 1)
        return langs.tolist(), score


def fit(labelled: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = PER_LANGUAGE, most: int = MOST) -> Model | None:
    """Fits on labelled rows; null languages take no part. None if there is no labelled row."""
    rows = labelled.select(
        F.col(id_col).cast("string").alias("id"), common.text_bytes(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter("lang IS NOT NULL AND id IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    per_language = min(per_language, max(1, most // len(counts)))
    limits = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, float(min(1.0, per_language / n)))])
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < limits[F.col("lang")] * 1_000_003)

    def counted(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            there = pa.array([has_letter(t) for t in texts])
            x = pa.array([features(t).astype(np.float16).tobytes() for t, ok in zip(texts, there.to_pylist(), strict=True) if ok], pa.binary())
            kept = batch.filter(there)
            yield pa.record_batch({"id": kept.column("id"), "lang": kept.column("lang"), "x": x})

    # one Python node in a task: workers stay alive, and each holds what it has imported
    got = chosen.select("id", "lang", "text").mapInArrow(counted, "id string, lang string, x binary").orderBy("id", "x").collect()
    if not got:
        return None
    langs, x = np.array([r["lang"] for r in got], object), np.ones((len(got), DIMENSIONS + 1), np.float32)
    for k in range(len(got)):
        x[k, :-1] = np.frombuffer(got[k]["x"], np.float16)
        got[k] = None  # a row's bytes go as they are taken over
    model = Model(langs, x)
    del got, x
    common.release()  # of the rows' bytes, which the allocator would keep for as long as the driver lives
    return model


def predicted(model: Model | None, spark, text_col: str = "text") -> Column:
    """A struct (lang, score) for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        model, texts = shared.value, text.to_pylist()
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if model is not None:
            at = [i for i, t in enumerate(texts) if has_letter(t)]
            for k in range(0, len(at), 512):
                part = at[k : k + 512]
                names, s = model.predict(np.stack([features(texts[i]) for i in part]))
                scores[part] = s
                for i, name in zip(part, names, strict=True):
                    langs[i] = name
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict(common.text_bytes(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return docs.select(
        "doc_id", held_out().alias("held_out"), predicted(model, spark).alias("p")
    ).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
