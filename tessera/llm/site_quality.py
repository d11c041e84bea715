"""Quality by hierarchical empirical Bayes.

A document classifier gives each document's evidence: a logistic regression on
counts of its text, fitted on a bounded sample of labelled documents. Sites give
the rest: the mean evidence of a host's documents is shrunk toward the global
mean, and that of a path's documents toward its host's, by as much as the
variance within and between the groups (method of moments) calls for. Sparse
sites therefore follow their parent. A document's posterior odds are its own
odds times the odds of its path, without the document itself, over the global
odds.

Texts are read once, into a narrow table of counts. Group sums are partial
aggregates, so a host with a third of all rows moves as one row a task; the
groups' sums meet the narrow rows by broadcast where Spark measures the written
table as small, else by a join that adaptive execution splits where it is skewed.

Defined results
- null or empty text: counts of 0. Null host or path: a group of its own.
- null doc_id: judged like any other; never part of the sample.
- repeated rows: each counts. Documents with both labels count as bad.
- very long texts: counts only, which don't grow with them.
- labels empty, or all alike: evidence 0.5 for all, which is kept.
- an empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, bare, blank_parts, forget, let, written

#: At most so many labelled ids, those of least hash, fit the classifier, with at most twice as many rows, as ids may be repeated.
MAX_LABELLED = 20_000
THRESHOLD = 0.5
FEATURES = 9
LEAST = 1e-4


def evidence_counts(text: Column) -> Column:
    """An array of FEATURES numbers that don't grow with the text."""
    text = F.coalesce(text, F.lit(""))
    upper, digits, symbols, marks = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>{}[]~^_=+\\@", "!?"
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(BLANKS)) != "")

    def of(n: Column, plain: Column, w: Column, filled: Column) -> Column:
        """From the number of characters, that of those which are no blanks, the words and the lines that have any."""
        count = F.greatest(F.size(w), F.lit(1))
        share = lambda chars: (n - F.length(F.translate(text, chars, ""))) / F.greatest(plain, F.lit(1))
        return F.array(
            F.log1p(F.size(w)),
            plain / count,
            F.size(F.array_distinct(w)) / count,
            (F.size(filled) - F.size(F.array_distinct(filled))) / F.greatest(F.size(filled), F.lit(1)),
            share(upper),
            share(digits),
            share(symbols),
            share(marks),
            share(".,;:"),
        )

    # variables are bound one inside the other, so that each is computed once and nothing large is copied
    return let(F.length(text), lambda n: let(blank_parts(text), lambda p: let(n - F.size(p) + 1, lambda plain: let(F.array_remove(p, ""), lambda w: let(lines, lambda x: of(n, plain, w, x))))))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a ridge logistic regression by Newton's method, and the features' means and scales."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = ridge * np.append(np.ones(z.shape[1] - 1), 1e-6)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w, mean, scale


def evidence(rows: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Column:
    """The classifier's probability, from the column x of rows (doc_id, x)."""
    known = bare(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = rows.where("doc_id is not null").join(F.broadcast(known), "doc_id").orderBy("doc_id", "x").limit(2 * max_labelled).select("x", "y").collect()
    y = np.array([float(r["y"] > 0) for r in sample])
    if not len(y) or y.min() == y.max():
        return F.lit(0.5)
    w, mean, scale = fitted(np.array([r["x"] for r in sample]), y)
    z = F.lit(float(w[-1]))
    for i in range(len(mean)):
        unit = (F.get("x", F.lit(i)) - float(mean[i])) / float(scale[i])
        z = z + F.least(F.greatest(unit, F.lit(-6.0)), F.lit(6.0)) * float(w[i])
    return F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(LEAST)), F.lit(1 - LEAST))


def spread(groups: DataFrame, parent_mean: Column) -> DataFrame:
    """One row: kappa, the within-group variance over the between-group variance, from groups with n, s (sum) and q (sum of squares)."""
    terms = groups.select("n", (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("inside"), (F.col("n") * F.pow(F.col("s") / F.col("n") - parent_mean, F.lit(2))).alias("outside"))
    sums = terms.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum("inside").alias("w"), F.sum("outside").alias("b"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
    within = F.greatest(F.col("w"), F.lit(0.0)) / F.greatest(F.col("n") - F.col("g"), F.lit(1))
    size = F.greatest(F.col("n") - F.col("nn") / F.col("n"), F.lit(1e-9))
    between = F.greatest((F.col("b") - (F.col("g") - 1) * within) / size, F.lit(1e-6))
    return sums.select(F.greatest(within / between, F.lit(1.0)).alias("kappa"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, *, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, host, path, evidence, host_quality, path_quality, quality and kept of every document."""
    rows = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), evidence_counts(F.col("text")).alias("x"))
    rows = written(rows, "quality-counts")
    rows = rows.withColumn("p", evidence(rows, labels, max_labelled)).drop("x")
    sums = [F.sum(x).alias(n) for n, x in (("n", F.lit(1)), ("s", F.col("p")), ("q", F.col("p") * F.col("p")))]
    paths = written(rows.groupBy("host", "path").agg(*sums), "quality-paths")
    again = [F.sum(n).alias(n) for n in ("n", "s", "q")]
    hosts = paths.groupBy("host").agg(*again)
    mean = hosts.agg((F.sum("s") / F.sum("n")).alias("m"))
    hosts = hosts.withColumn("m", mean.scalar())
    k_host = spread(hosts, F.col("m"))
    hosts = hosts.withColumn("k", k_host.scalar()).withColumn("host_quality", (F.col("s") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k")))
    hosts = written(hosts.select(F.col("host").alias("h"), "m", "host_quality"), "quality-hosts")
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    k_path = spread(both, F.col("host_quality"))
    sites = written(both.withColumn("k", k_path.scalar()).select("h", F.col("path").alias("t"), "n", "s", "m", "k", "host_quality"), "quality-sites")
    forget(paths, hosts)
    both = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("t")), "left")
    site = (F.col("s") + F.col("k") * F.col("host_quality")) / (F.col("n") + F.col("k"))
    others = (F.col("s") - F.col("p") + F.col("k") * F.col("host_quality")) / (F.col("n") - 1 + F.col("k"))
    inner = lambda x: F.least(F.greatest(x, F.lit(LEAST)), F.lit(1 - LEAST))
    odds = lambda x: inner(x) / (1 - inner(x))
    post = odds(F.col("p")) * odds(others) / odds(F.col("m"))
    out = both.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_quality", site.alias("path_quality"), (post / (1 + post)).alias("quality"))
    return out.withColumn("kept", F.col("quality") >= threshold)
