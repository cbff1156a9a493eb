"""Quality and toxicity by hierarchical empirical Bayes.

A document's own evidence is a logistic model over its whole text: shares of symbols, capitals and repetition, and the
words that tell the classes apart. It is fitted on at most about PER_CLASS labelled rows of each combination of labels,
chosen by a hash of the id. Sites add evidence: labelled outcomes are counted by path and host over all labelled rows, a
host's posterior shrinks to the global rate and a path's to its host's, by strengths that follow from the spread of hosts
around the global rate and of paths around their hosts' posteriors. Sparse sites thus say little. The document's log odds
are its own plus what its path's posterior adds to the global rate; a labelled document's own labels are taken out of its
site's counts first.

The host is the part of the source before its first slash (after a scheme), the path the first part behind it; a null
source is the site of the empty name. Null text is empty. Without labels, every document has the neutral 0.5 of quality,
0 of toxicity and is kept. Repeated labels of a document all count, labels other than 0 and 1 don't; repeated documents and
those that share an id or have none each get a result, with the labels of the id, those without one with none. Of equally
telling words the first by hash are used. Very long texts count whole. An empty table gives an empty result; other columns
are not looked at. keep: quality at least 0.5 and toxicity below 0.5.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each combination of labels used for fitting, about; words that a model may use.
PER_CLASS, WORDS = 1500, 512
#: A word's chi-squared must be beyond what chance gives over many words.
LEAST_CHI = 25.0
#: Sites are broadcast while their count is at most this; beyond it, their join shuffles.
BROADCAST_SITES = 100_000
_SPACE = 1 << 22
_SHARES = 10


def _shares(text: bytes, words: list[bytes]) -> list[float]:
    x = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    letters = x[65:91].sum() + x[97:123].sum()
    symbols = x[33:48].sum() + x[58:65].sum() + x[91:97].sum() + x[123:127].sum()
    plain = x[44] + x[46] + x[39]
    lines = text.split(b"\n")
    many = max(1, len(words))
    tally = Counter(words)
    most, distinct = max(tally.values(), default=0), len(tally)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        x[65:91].sum() / max(1, letters), (symbols - plain) / n, plain / n, x[48:58].sum() / n, x[124] / n,
        min(1.0, distinct / many), most / many, same / many, np.log1p(len(words)) / 10, len(set(lines)) / len(lines),
    ]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shares, and the sorted distinct word hashes below _SPACE."""
    from zlib import crc32

    words = common.words_of(text)
    held = np.unique(np.fromiter((crc32(w) % _SPACE for w in set(words)), np.uint32))
    return np.array(_shares(text, words), np.float32), held


class Logistic:
    """Words chosen by chi-squared, and weights by Newton steps on the penalised likelihood."""

    def __init__(self, shares: np.ndarray, held: list[np.ndarray], y: np.ndarray, base: np.ndarray, steps: int = 12, ridge: float = 0.05):
        flat = np.concatenate(held) if held else np.zeros(0, np.uint32)
        row = np.repeat(np.arange(len(held)), [len(h) for h in held])
        values, where = np.unique(flat, return_inverse=True)
        there = np.bincount(where, minlength=len(values)).astype(float)
        good = np.bincount(where, weights=y[row], minlength=len(values))
        rate = y.mean()
        chi = (good - there * rate) ** 2 / np.maximum(there * rate * (1 - rate), 1e-9)
        chi[there < 5] = 0
        order = np.argsort(-chi, kind="stable")[:WORDS]
        self.words = np.sort(values[order[chi[order] >= LEAST_CHI]])
        self.mean, self.spread = shares.mean(0), shares.std(0) + 1e-6
        x = self.table(shares, held).astype(float)
        weight = np.where(y > 0, base[1], base[0])
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            bend = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]) + ridge * np.eye(len(w))
            step = np.linalg.solve(bend, x.T @ (weight * (y - p)) - ridge * w)
            w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        self.w = w

    def table(self, shares: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(shares), _SHARES + len(self.words) + 1), np.float32)
        x[:, :_SHARES] = np.clip((shares - self.mean) / self.spread, -6, 6)
        for i, h in enumerate(held):
            at = np.searchsorted(self.words, h)
            at = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == h)] if len(self.words) else at[:0]
            x[i, _SHARES + at] = 1
        x[:, -1] = 1
        return x

    def odds(self, shares: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
        return self.table(shares, held) @ self.w


def fit(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...], *, id_col="doc_id", text_col="text", per_class: int = PER_CLASS) -> dict[str, Logistic] | None:
    """One model for each target column of 0 and 1; None without both outcomes of any.

    The rows to fit on are chosen among the labels, before any text is read. There are about per_class of each of the
    two-to-the-targets combinations, so they are few whatever the table's size, and they go to the texts, not the texts
    to them.
    """
    known = labels.select(F.col(id_col).alias("id"), *[F.col(t).cast("int").alias(t) for t in targets]).filter("id IS NOT NULL")
    for t in targets:
        known = known.filter(F.col(t).isin(0, 1))
    cell = F.concat_ws("", *targets)
    counts = {r["cell"]: r["count"] for r in known.groupBy(cell.alias("cell")).count().collect()}
    if not counts:
        return None
    limits = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, float(min(1.0, per_class / n)))])
    few = known.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_003)) < limits[cell] * 1_000_003)
    texts = docs.select(F.col(id_col).alias("id"), common.text_bytes(text_col).alias("text"))
    chosen = texts.join(F.broadcast(few), "id")

    @F.arrow_udf("struct<shares:binary,held:binary>")
    def counted(text: pa.Array) -> pa.Array:
        got = [features(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([b.tobytes() for _, b in got], pa.binary())], ["shares", "held"])

    got = chosen.select("id", *targets, counted("text").alias("x")).orderBy("id").collect()
    shares = np.stack([np.frombuffer(r["x"]["shares"], np.float32) for r in got]) if got else np.zeros((0, _SHARES), np.float32)
    held = [np.frombuffer(r["x"]["held"], np.uint32) for r in got]
    share = np.array([min(1.0, per_class / counts["".join(str(r[t]) for t in targets)]) for r in got])
    models = {}
    for t in targets:
        y = np.array([r[t] for r in got], float)
        if 0 < y.sum() < len(y):  # weights undo the unequal sampling
            by = [float((1 / share[y == v]).sum() / max(1, (y == v).sum())) for v in (0, 1)]
            models[t] = Logistic(shares, held, y, np.array(by) / max(by))
    return models or None


def evidence(models: dict[str, Logistic] | None, spark, targets: tuple[str, ...], text_col: str = "text") -> Column:
    """A struct of log odds for the targets; 0 where there is no model."""
    shared = spark.sparkContext.broadcast(models or {})
    kind = "struct<" + ",".join(f"{t}:double" for t in targets) + ">"

    @F.arrow_udf(kind)
    def odds(text: pa.Array) -> pa.Array:
        texts, columns = text.to_pylist(), {t: np.zeros(len(text)) for t in targets}
        for k in range(0, len(texts), 512):
            got = [features(t) for t in texts[k : k + 512]]
            shares, held = np.stack([a for a, _ in got]), [b for _, b in got]
            for t, model in shared.value.items():
                columns[t][k : k + 512] = model.odds(shares, held)
        return pa.StructArray.from_arrays([pa.array(columns[t]) for t in targets], list(targets))

    return odds(common.text_bytes(text_col))


def host_and_path(source: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.substring_index(bare, "/", 1), F.regexp_extract(bare, "^[^/]*/([^/?#]*)", 1)


def _logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(safe / (1 - safe))


def _strength(sites: DataFrame, n: str, k: str, around: Column) -> float:
    """How many rows the prior weighs: by moments of the sites' rates around what they shrink to."""
    off, within = F.pow(F.col(k) - F.col(n) * around, 2), F.col(n) * around * (1 - around)
    r = sites.select(F.sum(off).alias("s"), F.sum(within).alias("w"), F.sum(n).alias("n"), F.sum(F.col(n) * (F.col(n) - 1)).alias("p")).first()
    if not r["n"] or not r["p"] or not r["w"]:
        return 1e4
    spread = float(r["w"]) / float(r["n"])
    between = max(float(r["s"] - r["w"]) / float(r["p"]), spread / 1e4)
    return min(max(spread / between - 1, 1.0), 1e4)


def _shrunk(n: Column, k: Column, strength: float, towards: Column) -> Column:
    return (k + strength * towards) / (n + strength)


class Sites:
    """Counts of labelled outcomes by host and path, global rates, and the strengths of hosts' and paths' priors."""

    def __init__(self, labelled: DataFrame, targets: tuple[str, ...], source_col: str = "source"):
        host, path = host_and_path(F.col(source_col))
        outcomes = labelled.select(host.alias("host"), path.alias("path"), *[F.when(F.col(t).isin(0, 1), F.col(t).cast("int")).alias(t) for t in targets])
        counted = (("n", F.count), ("k", lambda t: F.coalesce(F.sum(t), F.lit(0))))
        paths = common.checkpointed(outcomes.groupBy("host", "path").agg(*[f(t).alias(f"{t}_{name}") for t in targets for name, f in counted]))
        hosts = paths.groupBy("host").agg(*[F.sum(c).alias(f"host_{c}") for t in targets for c in (f"{t}_n", f"{t}_k")])
        whole = paths.agg(*[F.sum(c).alias(c) for t in targets for c in (f"{t}_n", f"{t}_k")]).first()
        self.targets, self.table = targets, paths.join(hosts, "host")
        self.rates = {t: (whole[f"{t}_k"] + 0.5) / (whole[f"{t}_n"] + 1) if whole[f"{t}_n"] else 0.5 for t in targets}
        self.of_host, self.of_path = {}, {}
        for t in targets:
            self.of_host[t] = _strength(hosts, f"host_{t}_n", f"host_{t}_k", F.lit(self.rates[t]))
            self.of_path[t] = _strength(self.table, f"{t}_n", f"{t}_k", self.host_posterior(t))

    def _rest(self, column: str, own: Column | None) -> Column:
        """A count without the document's own; a site without labels has none."""
        count = F.coalesce(F.col(column), F.lit(0))
        return count if own is None else F.greatest(count - F.coalesce(own, F.lit(0)), F.lit(0))

    def host_posterior(self, t: str, own_n: Column | None = None, own_k: Column | None = None) -> Column:
        return _shrunk(self._rest(f"host_{t}_n", own_n), self._rest(f"host_{t}_k", own_k), self.of_host[t], F.lit(self.rates[t]))

    def posterior(self, t: str, own_n: Column | None = None, own_k: Column | None = None) -> Column:
        """A path's posterior; without labels of the path its host's, without any of the host the global rate."""
        return _shrunk(self._rest(f"{t}_n", own_n), self._rest(f"{t}_k", own_k), self.of_path[t], self.host_posterior(t, own_n, own_k))


def scored(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", targets=("quality", "toxic")) -> DataFrame:
    """(doc_id, <target> probability, <target>_site posterior): the document's own evidence with its site's."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), *[F.col(t).cast("int").alias(t) for t in targets])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    models = fit(rows, known, targets)
    sites = Sites(rows.select("doc_id", "source").join(known, "doc_id"), targets)
    host, path = host_and_path(F.col("source"))
    own = rows.select("doc_id", host.alias("host"), path.alias("path"), evidence(models, spark, targets).alias("own"))
    valid = lambda t: F.when(F.col(t).isin(0, 1), F.col(t))
    mine = known.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[f for t in targets for f in (F.count(valid(t)).alias(f"own_{t}_n"), F.sum(valid(t)).alias(f"own_{t}_k"))])
    sent = F.broadcast if sites.table.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES else (lambda df: df)
    host_counts = [f"host_{t}_{c}" for t in targets for c in "nk"]
    of_host = sites.table.groupBy("host").agg(*[F.first(c).alias(c) for c in host_counts])
    both = own.join(sent(sites.table.drop(*host_counts)), ["host", "path"], "left").join(sent(of_host), "host", "left").join(mine, "doc_id", "left")
    out = [F.col("doc_id")]
    for t in targets:
        site = sites.posterior(t, F.col(f"own_{t}_n"), F.col(f"own_{t}_k"))
        odds = F.col(f"own.{t}") + _logit(site) - _logit(F.lit(sites.rates[t]))
        p = 1 / (1 + F.exp(-odds)) if models and t in models else F.lit(0.5 if t == "quality" else 0.0)
        out += [p.alias(t), site.alias(f"{t}_site")]
    return both.select(*out)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    got = scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return got.withColumn("keep", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))
