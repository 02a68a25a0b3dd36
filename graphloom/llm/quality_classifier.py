"""Quality classifier by hierarchical empirical Bayes.

A logistic classifier over text gives each document its own evidence.  Hosts and paths get
posteriors by grouped aggregation: a path's rate of bad documents is shrunk toward its host's, a
host's toward the whole corpus's, and how far is estimated from the spread of the groups
themselves (few rows: nearly the parent's rate).  A document's posterior odds are its evidence
times the odds of its path over the odds of the training rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .scratch import table

#: The classifier is fitted on at most so many labelled rows, those of least hash; all else covers all rows.
SAMPLE_ROWS = 8000
TERMS = 256
LEAST_ROWS_OF_TERM = 8
SHAPES = 9
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def shapes(column: pa.Array) -> np.ndarray:
    """Shares that tell junk from prose: upper case, digits, other marks, bars, bare words, distinct words, shortness, word length, runs of one word."""
    words = tx.Words(column, lower=False)
    n = len(words.counts)
    prefix = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    per = lambda mask: np.diff(prefix(mask)[words.offsets])
    data = words.data
    size = np.maximum(np.diff(words.offsets), 1)
    count = np.maximum(words.counts, 1)
    hashes, of = words.hashes(), words.text_of()
    distinct = np.zeros(n)
    for i, (at, k) in enumerate(zip(words.at[:-1].tolist(), words.counts.tolist(), strict=True)):
        distinct[i] = len(np.unique(hashes[at : at + k])) / math.sqrt(k) if k else 0
    again = np.zeros(n)
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[1:][same], minlength=n)
    marked = ~ALNUM[data[words.ends - 1]] & (data[words.ends - 1] != 46) & (data[words.ends - 1] != 44) if len(hashes) else np.zeros(0, bool)
    odd = per((data == 35) | (data == 36) | (data == 37) | (data == 38) | (data == 42) | (data == 124))
    out = np.stack([
        per((data >= 65) & (data <= 90)) / size, per((data >= 48) & (data <= 57)) / size, np.minimum(odd / size * 4, 1), per(data == 124) / count,
        np.bincount(of[marked], minlength=n) / count if len(of) else np.zeros(n), np.minimum(distinct / 10, 3), 1 / np.sqrt(count), size / count / 10, again / count,
    ], 1)
    return np.nan_to_num(np.clip(out, 0, 5))


def term_sets(column: pa.Array) -> list[np.ndarray]:
    """Distinct hashes of each text's words: runs of ASCII letters and digits (A-Z lower-cased) and characters beyond ASCII."""
    words = tx.Words(column, inside=ALNUM)
    hashes = words.hashes()
    return [np.unique(hashes[a:b]) for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)]


def read(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Term sets and shapes of all texts, block by block."""
    sets, rows = [], [np.zeros((0, SHAPES))]
    for block in tx.blocks(iter(pa.table({"t": column}).to_batches()), "t"):
        sets += term_sets(block.column("t"))
        rows.append(shapes(block.column("t")))
    return sets, np.concatenate(rows)


def design(sets: list[np.ndarray], rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """One row for each text: presence of the terms, shapes, a constant."""
    x = np.zeros((len(sets), len(terms) + SHAPES + 1), np.float32)
    for i, s in enumerate(sets):
        if len(terms) and len(s):
            at = np.minimum(np.searchsorted(terms, s), len(terms) - 1)
            x[i, at[terms[at] == s]] = 1
    x[:, len(terms) : -1] = rows
    x[:, -1] = 1
    return x


@dataclass
class Classifier:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray  # of the terms, then of the shapes, then the constant
    base: float  # share of bad rows in training

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Log odds of bad for each text, over the training odds."""
        return design(*read(column), self.terms) @ self.weights - math.log(self.base / (1 - self.base))


def fit(column: pa.Array, bad: np.ndarray) -> Classifier:
    """Chooses the terms that part the classes most (chi-square), then ridge logistic regression by Newton steps."""
    bad = bad.astype(float)
    base = min(max(bad.mean(), 1e-3), 1 - 1e-3) if len(bad) else 0.5
    sets, rows = read(column)
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    terms, at = np.unique(hashes, return_inverse=True)
    n, k = np.bincount(at, minlength=len(terms)), np.bincount(at, bad[of] if len(of) else None, minlength=len(terms))
    score = np.where(n >= LEAST_ROWS_OF_TERM, (k - n * base) ** 2 / np.maximum(n * base * (1 - base), 1e-9), 0)
    chosen = np.argsort(-score, kind="stable")[:TERMS]
    terms = np.sort(terms[chosen[score[chosen] > 10.83]])  # chi-square at 0.001
    x = design(sets, rows, terms)
    w = np.zeros(x.shape[1])
    w[-1] = math.log(base / (1 - base))
    ridge = np.full(len(w), 0.3)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * np.sqrt(p * (1 - p))[:, None].astype(np.float32)).astype(np.float64)
        step = np.linalg.solve(curve.T @ curve + np.diag(ridge), x.T @ (bad - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(terms, w, base)


def labelled(labels: DataFrame, id_col: str) -> DataFrame:
    """(_id, _bad): 1 for ids that any row of theirs calls bad (quality 0 or toxic 1), else 0."""
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(bad).alias("_bad"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on the labelled rows, at most ``sample_rows`` of them."""
    some = labelled(labels, id_col).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(some, "_id")
    sample = rows.orderBy(F.xxhash64("_id"), "_id", "_text").limit(sample_rows).select("_text", "_bad")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # the bounded sample
        schema = got[0].schema if got else pa.schema([("_text", pa.string()), ("_bad", pa.int32())])
        whole = pa.Table.from_batches(got, schema)
        model = fit(whole.column("_text"), whole.column("_bad").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([model.terms.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.base])], names=["terms", "weights", "base"])

    found = sample.mapInArrow(learn, "terms binary, weights binary, base double").first()
    if found is None:
        return fit(pa.array([], pa.string()), np.zeros(0))
    return Classifier(np.frombuffer(bytes(found["terms"]), np.uint64), np.frombuffer(bytes(found["weights"]), np.float64), found["base"])


def _strength(groups: DataFrame, rate: str, parent: Column) -> float:
    """Pseudo-rows with which a group is shrunk toward its parent, by the method of moments over groups of two rows or more."""
    far = F.col("n") * (F.col(rate) / F.col("n") - parent) ** 2
    noise = parent * (1 - parent)
    x = groups.where("n > 1").agg(F.sum(far).alias("q"), F.sum(noise).alias("v"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k")).first()
    if not x["k"] or x["n"] * x["n"] <= x["nn"]:
        return 100.0
    between = (x["q"] - x["v"]) / (x["n"] - x["nn"] / x["n"])
    mean_noise = x["v"] / x["k"]
    return min(max(mean_noise / between - 1 if between > 0 else 1e6, 1.0), 1e6)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, keep_below: float = 0.5, sample_rows: int = SAMPLE_ROWS, keep_text: bool = True) -> DataFrame:
    """``docs`` (with the text if ``keep_text``) with _evidence (log odds), _prior (its path's rate of bad), _posterior and _kept (posterior under keep_below).

    Host and corpus rates count a labelled document by its label and any other by its probability; the rate of a
    document's own path leaves the document itself out, whose evidence comes in once.

    host defaults to ``source`` and path to ``source``/``lang``.  Null or empty texts are scored by their
    shape; null hosts and paths are groups of their own; without labels the evidence comes from
    constants alone; repeated rows are scored alike, also those with equal posteriors; very long texts are read whole; an
    empty table gives an empty result.  Columns named _evidence, _host, _path, _own, _prior, _posterior or _kept are replaced or dropped.
    """
    docs = docs.drop("_evidence", "_host", "_path", "_own", "_prior", "_posterior", "_kept")
    model = train(docs, labels, id_col, text_col, sample_rows)
    host = F.coalesce(F.col("source") if host is None else host, F.lit(""))
    path = F.coalesce(F.col("lang") if path is None else path, F.lit(""))
    kept = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("_evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, text_col):
            found = np.round(model.evidence(block.column(text_col)), 9)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in kept), pa.array(found)], names=[*kept, "_evidence"])

    rows = table(docs.mapInArrow(run, schema).withColumns({"_host": host, "_path": path}), "evidence")
    own = F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("_evidence") + F.lit(math.log(model.base / (1 - model.base)))))))
    rows = rows.withColumn("_own", own)
    slim = rows.select(F.col(id_col).alias("_id"), "_host", "_path", "_own").join(labelled(labels, id_col), "_id", "left")
    slim = slim.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_own").alias("guessed"), F.sum(F.coalesce("_bad", "_own")).alias("bad"))
    slim = table(slim, "paths")
    whole = slim.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = min(max(whole["bad"] / whole["n"], 1e-6), 1 - 1e-6) if whole["n"] else model.base
    hosts = slim.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k = _strength(hosts, "bad", F.lit(overall))
    hosts = hosts.select("_host", ((F.col("bad") + k * overall) / (F.col("n") + k)).alias("host_rate"))
    paths = slim.join(hosts, "_host")
    k = _strength(paths, "bad", F.col("host_rate"))
    n_path, guessed, host_rate = (f"{c}_{uuid.uuid4().hex}" for c in ("n", "guessed", "rate"))
    rows = rows.join(paths.select("_host", "_path", "n", "guessed", "host_rate").withColumnsRenamed({"n": n_path, "guessed": guessed, "host_rate": host_rate}), ["_host", "_path"], "left")
    others = (F.col(guessed) - F.col("_own") + F.lit(k) * F.col(host_rate)) / (F.col(n_path) - 1 + k)
    rows = rows.withColumn("_prior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), others))).drop("_own", n_path, guessed, host_rate)
    odds = F.col("_evidence") + F.log(F.col("_prior") / (1 - F.col("_prior")))
    rows = rows.withColumn("_posterior", F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds)))))
    return rows.withColumn("_kept", F.coalesce(F.col("_posterior") < keep_below, F.lit(True))).drop("_host", "_path")
