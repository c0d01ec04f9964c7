"""Document quality by hierarchical empirical Bayes over hosts and paths.

A classifier on surface features gives each document its own evidence. Evidence is summed per path and per
host; a host's rate is shrunk towards the global rate and a path's rate towards its host's, by strengths that
are estimated from how much the rates of hosts and paths vary beyond chance. A document's posterior joins the
log odds of its path, without the document's own share, with its own evidence. Sparse sites thus lean on what is
known above them, and one document alone makes its site no better than it is.

Features, evidence and sums are native column expressions; sites are grouped with partial aggregates, so a host
with a third of all rows is a handful of partial sums. The classifier is fitted by Newton steps on the driver to at
most ``MAX_LABELLED`` labelled rows, those with the smallest hashes of their ids.

Defined results: null and empty texts have features of 0 and are judged like other texts; a null host or path is a
site of its own; documents with repeated ids are judged each by itself. Without labels of both kinds the evidence
is 0 and every posterior is the global prior, 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.session import cut_lineage

#: Labelled rows the classifier is fitted to, at most.
MAX_LABELLED = 20_000
#: Penalty of the classifier's weights, in rows.
RIDGE = 1.0
#: Documents that a prior counts as when rates don't vary beyond chance.
MOST_STRENGTH = 1e6


def _count(text: Column, pattern_chars: str) -> Column:
    """How many characters of ``text`` are among the given ones."""
    return F.char_length(text) - F.char_length(F.translate(text, pattern_chars, ""))


#: Characters that features count.
SIGNS = "#$%&*<>{}[]\\^~=+@_|/"
LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"


def features(text: Column) -> dict[str, Column]:
    """Surface features of a text, each of a bounded range."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    return {
        "signs": F.sqrt(_count(t, SIGNS) / n),
        "upper": _count(t, LETTERS_UPPER) / n,
        "digits": F.sqrt(_count(t, "0123456789") / n),
        "exclaims": F.sqrt(_count(t, "!?") / n),
        "spaces": _count(t, " \t\n") / n,
        "stops": F.sqrt(_count(t, ".,;:") / n),
        "length": F.log1p(n) / 10,
        "distinct": F.size(F.array_distinct(words)) / F.sqrt(count * F.sqrt(count)),
        "words": F.log1p(count) / 10,
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.log1p(n / F.size(lines)) / 10,
    }


@dataclass
class Classifier:
    """Weights of the features, in their order, with an intercept last; ``base`` is the log odds of the labelled rows."""

    names: list[str]
    weights: np.ndarray
    base: float

    def evidence(self) -> Column:
        """Log likelihood ratio of good to bad, from the feature columns."""
        score = F.lit(float(self.weights[-1] - self.base))
        for name, w in zip(self.names, self.weights[:-1]):
            score = score + F.col(f"f_{name}") * F.lit(float(w))
        return score


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Classifier:
    """``rows`` has doc_id and the feature columns f_*; ``labels`` doc_id and a label of 0 or 1."""
    names = [c[2:] for c in rows.columns if c.startswith("f_")]
    known = labels.select("doc_id", F.col(label_col).cast("double").alias("label")).filter("doc_id is not null and label is not null")
    few = max(1, labels.count() // (4 * max_labelled))  # so that the draw moves a few times ``max_labelled`` rows, whatever the number of tasks
    drawn = known.withColumn("h", F.xxhash64("doc_id")).filter(F.pmod("h", F.lit(few)) == 0)
    sample = rows.join(drawn, "doc_id").orderBy("h").limit(max_labelled).select("label", *[f"f_{c}" for c in names])
    data = sample.toPandas().to_numpy(dtype=np.float64)
    y = data[:, 0] if len(data) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return Classifier(names, np.zeros(len(names) + 1), 0.0)
    x = np.column_stack([data[:, 1:], np.ones(len(y))])
    penalty = RIDGE * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(names, w, float(np.log(y.mean() / (1 - y.mean()))))


def _strength(groups: DataFrame, parent: Column) -> float:
    """How many documents the rate above counts as, by the method of moments: variance of rates beyond chance.

    ``groups`` has n and good (expected good documents) of each site.
    """
    rate = F.col("good") / F.col("n")
    chance = parent * (1 - parent)
    row = groups.agg(
        F.sum(F.col("n") * (rate - parent) * (rate - parent)).alias("spread"), F.sum(chance).alias("expected"),
        F.sum((F.col("n") - 1) * chance).alias("slope"),
    ).first()
    if not row["slope"] or row["spread"] is None:
        return MOST_STRENGTH
    share = (row["spread"] - row["expected"]) / row["slope"]  # of the variance that is between sites
    return float(min(max(1 / share - 1, 1.0), MOST_STRENGTH)) if share > 0 else MOST_STRENGTH


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, posterior, keep), a row per row of ``docs``.

    ``host`` and ``path`` are column expressions over ``docs``; a path is told apart within its host.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    made = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        *[c.cast("double").alias(f"f_{name}") for name, c in features(F.col(text_col)).items()],
    )
    rows = cut_lineage(made)
    model = fit(rows, labels, label_col, max_labelled)
    judged = rows.select("doc_id", "host", "path", model.evidence().alias("evidence"))
    prior = 1 / (1 + np.exp(-model.base))
    good = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(model.base))))
    judged = judged.withColumn("p", good)
    paths = cut_lineage(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("good") / F.sum("n")).first()[0]
    top = float(min(max(total if total is not None else prior, 1e-6), 1 - 1e-6))
    k_host = _strength(hosts, F.lit(top))
    host_rate = ((F.col("good") + k_host * top) / (F.col("n") + k_host)).alias("host_rate")
    hosts = cut_lineage(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), host_rate))
    sites = cut_lineage(paths.join(hosts, "host"))
    k_path = _strength(sites, F.col("host_rate"))
    # the document's own share is taken out of both levels before they shrink
    at_host = (F.col("host_good") - F.col("p") + k_host * top) / (F.col("host_n") - 1 + k_host)
    at_path = (F.col("good") - F.col("p") + k_path * at_host) / (F.col("n") - 1 + k_path)
    joined = judged.join(sites, ["host", "path"]).select("doc_id", "evidence", "host_rate", at_path.alias("path_rate"))
    rate = F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(rate / (1 - rate)))))
    return joined.select(
        "doc_id", F.round("evidence", 6).alias("evidence"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"),
        F.round(posterior, 6).alias("posterior"), (posterior >= 0.5).alias("keep"),
    )


def url_host(url: Column) -> Column:
    """Host of a page's address, for tables of pages."""
    return F.lower(F.parse_url(url, F.lit("HOST")))


def url_path(url: Column) -> Column:
    """First step of a page's path."""
    return F.regexp_extract(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), r"^/([^/]*)", 1)
