"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence is a logistic model's log-odds of being good, from surface
features and a lexicon of words that mark toxic labelled documents.  Sites are hosts and
paths below them (here: the ``host`` column and the ``path`` column under it).  Soft
counts of good documents over the whole corpus give each host a posterior rate shrunk
towards the global rate and each path one shrunk towards its host; both strengths are
estimated from the spread between groups.  A document is kept when its log-odds,
with the global prior replaced by its path's posterior, reach ``threshold``.

Model fitting uses a bounded sample of labelled rows (``sample_rows``, ordered by a hash of
the id); all counts and posteriors cover all documents.  Null text is empty and judged
like any other text; null host or path is a group of its own; rows repeat freely.  An id
that is labelled more than once is good if all its labels say so and toxic if one does; of
documents that share a labelled id the smallest text is fitted, so a sampled id is one row.
With no labels, or labels of one class, own evidence is 0 and everything is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_BYTES, map_arrow, materialize, sub_batches, text_buffer, tidied, word_hash, words

N_FEATURES = 9
SALTS, BROADCAST_SITES = 16, 10_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTERS = _WORD.copy()
_LETTERS[48:58] = False
_MARKS = np.zeros(256, bool)
_MARKS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'-"]] = True


@dataclass
class Model:
    """Standardised logistic weights (last: intercept), and hashes of toxic words."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    prior: float = 0.5
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def lexical(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Surface features of each row, and hash, row and first-occurrence mark of its lower-cased words."""
    data, offsets = text_buffer(col)
    n = len(offsets) - 1
    size = np.maximum(offsets[1:] - offsets[:-1], 1).astype(float)
    low = _LOWER[data]
    start, end, row = words(low, offsets, _WORD)
    h = word_hash(low, start, end)
    count = np.bincount(row, minlength=n).astype(float)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n).astype(float)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    letters = np.maximum(_sums(_LETTERS[data], offsets), 1)
    out = np.zeros((n, N_FEATURES))
    some = np.maximum(count, 1)
    out[:, 0] = np.log1p(count)
    out[:, 1] = distinct / some
    out[:, 2] = _sums(_UPPER[data], offsets) / letters
    out[:, 3] = _sums(_MARKS[data], offsets) / size
    out[:, 4] = _sums(data == 124, offsets) / some
    out[:, 5] = np.bincount(row, weights=again, minlength=n) / some
    out[:, 6] = letters / size
    out[:, 7] = letters / some
    return out, h[order][new], row[order][new], order[new]


def _features(col: pa.Array, toxic: np.ndarray) -> np.ndarray:
    out, h, row, _ = lexical(col)
    if len(toxic) and len(h):
        at = np.minimum(np.searchsorted(toxic, h), len(toxic) - 1)
        out[:, 8] = np.log1p(np.bincount(row[toxic[at] == h], minlength=len(out)))
    return out


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", good: str = "quality", toxic: str = "toxic", sample_rows: int = 12_000, rounds: int = 40) -> Model:
    """Fit on at most ``sample_rows`` labelled rows, the only rows that reach the driver (as features)."""
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(good).cast("int").alias("_good"), F.coalesce(F.col(toxic).cast("int"), F.lit(0)).alias("_toxic"))
    marks = marks.filter("_id is not null and _good is not null").groupBy("_id").agg(F.min("_good").alias("_good"), F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = F.broadcast(marks).join(texts, "_id").groupBy("_id", "_good", "_toxic").agg(F.min("text").alias("text"))
    chosen = chosen.select(F.col("_id").cast("string").alias("_row"), "text", "_good", "_toxic")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                x, h, row, _ = lexical(part.column("text"))
                cut = np.searchsorted(row, np.arange(len(x) + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x)), pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(h.view(np.int64))), part.column("_good"), part.column("_toxic"), part.column("_row")],
                    ["x", "words", "good", "toxic", "_row"],
                )

    seen = materialize(map_arrow(chosen, describe, "x array<double>, words array<long>, good int, toxic int, _row string"), "quality-sample")
    # words that toxic labelled documents hold and others all but never do
    counted = seen.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    marked = counted.filter("t >= 3 and t >= 0.9 * n").select("w").toPandas()["w"].to_numpy(np.int64)
    lexicon = np.sort(marked.view(np.uint64))
    marks = F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame({"w": marked}), "w long"))
    toxic_hits = seen.select("_row", F.explode("words").alias("w")).join(marks, "w").groupBy("_row").agg(F.count(F.lit(1)).alias("hits"))
    rows = seen.select("_row", "x", "good", "toxic").join(toxic_hits, "_row", "left").na.fill(0, ["hits"]).toPandas()
    if not len(rows):
        return Model()
    x = np.stack(rows["x"].to_numpy())
    x[:, 8] = np.log1p(rows["hits"].to_numpy(float))
    y = ((rows["good"] == 1) & (rows["toxic"] == 0)).to_numpy(float)
    if y.min() == y.max():
        return Model()
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-6
    for _ in range(rounds):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(w, mean, scale, float(y.mean()), lexicon)


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "log_odds", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the model's log-odds as column ``name``.  Only texts go to Python."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def judge(col: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([col], ["text"])
        parts = [model.log_odds(_features(p.column("text"), model.toxic)) for p in sub_batches(batch)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    kept = list(docs.columns if keep is None else keep)
    return docs.select(*kept, F.arrow_udf(judge, "double")(F.coalesce(F.col(text), F.lit(""))).alias(name))


def _strength(groups: DataFrame, n: str, rate: str, centre) -> float:
    """Method of moments for a beta prior: how many documents the group above counts for."""
    r = groups.agg(
        F.sum(n).alias("n"), F.sum(F.col(n) * F.pow(F.col(rate) - centre, 2)).alias("spread"), F.sum(F.col(n) * centre * (1 - centre)).alias("var"),
        F.count(F.lit(1)).alias("g"),
    ).first()
    if not r.n or not r.var:
        return 10.0
    mean_var, n0 = r.var / r.n, r.n / r.g
    between = (r.spread / r.n - mean_var / n0) / mean_var  # of the variance, the part that lies between groups
    between = min(max(between, 1e-4), 0.95)
    return 1 / between - 1


def site_posteriors(scored: DataFrame, *, host: str, path: str, odds: str = "log_odds") -> DataFrame:
    """``_host, _path, global_rate, host_rate, path_rate`` by grouped sums over all documents."""
    p = 1 / (1 + F.exp(-F.col(odds)))
    paths = scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good"))
    paths = materialize(paths, "quality-sites")
    hosts = paths.groupBy(F.col("_host").alias("_h")).agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    rate = (total.good + 1) / (total.n + 2) if total.n else 0.5
    k_host = _strength(hosts.withColumn("r", F.col("host_good") / F.col("host_n")), "host_n", "r", F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + k_host * rate) / (F.col("host_n") + k_host))
    both = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_h"])).drop("_h")
    k_path = _strength(both.withColumn("r", F.col("good") / F.col("n")), "n", "r", F.col("host_rate"))
    return both.select(
        "_host", "_path", F.lit(rate).alias("global_rate"), "host_rate",
        ((F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate"),
    )


def _logit(rate):
    r = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate))
    return F.log(r / (1 - r))


@tidied
def classify(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", threshold: float = 0.5, columns: list[str] | None = None, prefix: str = "", **fitting) -> DataFrame:
    """``docs`` (or its ``columns``) with ``log_odds, host_rate, path_rate, posterior, keep``, these five after ``prefix``.

    Texts are scored once, into a written table that the site counts and the result both read.  Up to BROADCAST_SITES
    sites are broadcast; more are joined by host and path, with a frequent site's rows dealt over SALTS keys."""
    model = fit(docs, labels, **fitting)
    names = list(docs.columns if columns is None else columns)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    keys = docs.withColumns({"_site": F.col(host), "_below": F.col(path)})
    scored = materialize(score(keys, model, keep=[*names, "_site", "_below"], name="_odds"), "quality-scored")
    sites = site_posteriors(scored, host="_site", path="_below", odds="_odds")
    sites = materialize(sites.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "quality-rates")
    sites = F.broadcast(sites) if sites.count() <= BROADCAST_SITES * SALTS else sites
    rows = scored.withColumn("_salt", salt)
    joined = rows.join(sites, rows["_site"].eqNullSafe(sites["_host"]) & rows["_below"].eqNullSafe(sites["_path"]) & (rows["_salt"] == sites["_deal"]), "left")
    odds = F.col("_odds") - _logit(sites["global_rate"]) + _logit(sites["path_rate"])
    posterior = 1 / (1 + F.exp(-F.coalesce(odds, F.col("_odds"))))
    out = joined.withColumn("_posterior", posterior)
    made = {"log_odds": F.col("_odds"), "host_rate": sites["host_rate"], "path_rate": sites["path_rate"], "posterior": F.col("_posterior"), "keep": F.col("_posterior") >= threshold}
    return out.select(*[rows[c] for c in names], *[c.alias(prefix + n) for n, c in made.items()])
