"""Mixing sources to target weights by soft membership.

A classifier learned from labelled rows gives every document posteriors over domains. Documents get
nonnegative rates so that the expected tokens of each domain, the sum over documents of rate * tokens
* posterior, match the targets: weights times a budget of tokens.

*Classifier.* For each domain, boosted trees over dense features of whole texts (shape, lexicons learned
for the rarer domains), calibrated by isotonic regression and normalised; fitted on a bounded sample of
``sample_rows`` labelled documents. The model's size does not depend on the data.

*Rates.* Projected gradient for least squares, ||P'(t*r) - T||^2, preconditioned, in the metric in which a
document weighs as many as its tokens, so that rates do not depend on length. A rate follows from
the document's posteriors and the residuals of the steps so far, which are a few numbers a step: each
step is one aggregation of a narrow table to as many sums as there are domains, and no rate is
stored until the end. Steps stop when the residual is small or no longer falls.

The default budget is the smallest at which no domain has to be cut, so that the targets are met by
repeating documents and none is lost; a budget below that makes rates under 1. ``copies`` is the rate's
whole part plus one with the probability of its fraction, drawn by a hash of the id.

Tokens are the words between white space of the whole text; ideographs, kana and syllables, which stand
without spaces, count one each. ``residual`` is how far the expected tokens stay from the targets, as a share
of all of them; above ``RESIDUAL`` there is a warning, as targets may be out of reach (no document with
a share of a wanted domain, or a least rate that is too high).

Null texts count as empty, with no tokens, the share of each domain as posteriors and a rate like any
other. Without labelled rows there is one domain and every rate is budget / tokens. Repeated rows get
equal rates and copies. An empty table gives an empty one. Columns of docs are passed on; columns of the result's names are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, table, tidy, written
from .toxicity import Features, Model, Trees, isotonic, learn_lexicon

NEW = "posterior array<double>, tokens long"
#: Share of all tokens by which targets may be missed without a warning.
RESIDUAL = 0.01


def tokens_in(text: str) -> int:
    """Words between white space, and one for each character of scripts that have no spaces: by
    the first bytes of U+3000 to U+D7FF in UTF-8. A run of such characters adds one as a word, too."""
    n = len(text.split())
    if not text.isascii():
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        n += int(np.count_nonzero((raw >= 0xE3) & (raw <= 0xED)))
    return n


@dataclass
class Domains:
    """One calibrated ensemble of trees for each domain, against the rest; posteriors sum to 1."""

    names: list[str]
    prior: np.ndarray
    lexicons: list[frozenset[str]] = field(default_factory=list)
    models: list[Model] = field(default_factory=list)

    def features(self) -> Features:
        return Features(*self.lexicons)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        if not self.models:
            return np.tile(self.prior, (len(x), 1))
        p = np.stack([m.score(x) for m in self.models], 1) + 1e-4
        return p / p.sum(1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8_000, folds: int = 3) -> Domains:
    with scratch(docs.sparkSession):
        marked = labels.select(F.col(id_col).alias("id"), domain.cast("string").alias("domain")).filter("id IS NOT NULL AND domain IS NOT NULL").groupBy("id").agg(F.min("domain").alias("domain"))
        some = marked.orderBy(F.xxhash64("id", F.lit(29)), "id").limit(sample_rows)
        texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        rows = written(texts.join(F.broadcast(some), "id").repartition(24), "mixing-sample")  # some: at most sample_rows small rows
        count = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
        names = sorted(count)
        if not names:
            return Domains(["all"], np.ones(1))
        n = sum(count.values())
        made = Domains(names, np.array([count[x] / n for x in names]))
        if len(names) == 1:
            return made
        rare = [x for x in names if count[x] < max(count.values())]
        made.lexicons = [learn_lexicon(rows.select("text", (F.col("domain") == x).cast("int").alias("y")), n, count[x]) for x in sorted(rare, key=lambda x: -count[x])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = made.features()
            for batch in batches:
                x = [make(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("domain"), pa.array(x, pa.list_(pa.float64()))], ["id", "domain", "x"])

        got = sorted((r[0], r[1], list(r[2])) for r in rows.mapInArrow(run, "id string, domain string, x array<double>").collect())
        x, fold = np.array([r[2] for r in got]), np.arange(len(got)) % folds
        for name in names:
            y = np.array([float(r[1] == name) for r in got])
            out = np.zeros(len(y))
            for k in range(folds):
                out[fold == k] = Trees(rounds=40).fit(x[fold != k], y[fold != k]).margin(x[fold == k])
            made.models.append(Model(frozenset(), Trees(rounds=40).fit(x, y), isotonic(out, y)))
        return made


def memberships(docs: DataFrame, model: Domains, *, text_col: str = "text") -> DataFrame:
    """docs with posterior over model.names and tokens."""
    rest = docs.drop("posterior", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = model.features() if model.models else lambda text: [0.0]
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(text_col)]
            p = model.posterior(np.array([make(t) for t in texts]).reshape(len(texts), -1)) if texts else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(p), pa.list_(pa.float64())), pa.array([tokens_in(t) for t in texts], pa.int64())], [*batch.schema.names, "posterior", "tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), NEW])
    return rest.mapInArrow(tidy(run), schema)


def rate_after(steps: list[list[float]], domains: int, least: float = 0.0) -> Column:
    """The rate after gradient steps: from 1, each takes posterior . step, never below least."""
    if not steps:
        return F.lit(1.0)
    taken = F.from_json(F.lit(str(steps)), "array<array<double>>")
    dot = lambda s: sum((F.col("posterior")[i] * s[i] for i in range(1, domains)), F.col("posterior")[0] * s[0])
    return F.aggregate(taken, F.lit(1.0), lambda r, s: F.greatest(F.lit(float(least)), r - dot(s)))


def fit_rates(members: DataFrame, names: list[str], weights: dict[str, float] | None, boost: dict[str, float] | None, budget: float | None, least: float = 0.0, *, most: int = 40, close: float = 1e-3) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
    """(steps, targets, reached) by projected gradient; members has posterior and tokens."""
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p = [F.col("posterior")[i] for i in range(k)]

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and the curvature over the documents whose rate can move."""
        rated = members.select("posterior", "tokens", rate_after(steps, k, least).alias("rate"))
        sums = [F.sum(F.col("tokens") * F.col("rate") * x) for x in p]
        got = rated.agg(*sums, *(F.sum(F.when(F.col("rate") > (least if steps else -1.0), F.col("tokens") * p[i] * p[j])) for i, j in pairs)).first()
        curve = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[k:], strict=True):
            curve[i, j] = curve[j, i] = v or 0.0
        return np.array([x or 0.0 for x in got[:k]]), curve

    now, curve = totals([])
    given = np.array([max(0.0, weights.get(n, 0.0)) for n in names]) if weights else now * [(boost or {}).get(n, 1.0) for n in names]
    share = given / given.sum() if given.sum() > 0 else np.full(k, 1 / k)
    whole = budget if budget is not None else max((n / s for n, s in zip(now, share, strict=True) if s > 0), default=0.0)
    target, steps = share * whole, []
    off = lambda reached: np.abs(reached - target).max() / max(1.0, target.sum())
    while off(now) > close and len(steps) < most and np.linalg.eigvalsh(curve)[-1] > 0:
        # in the metric of tokens the gradient is posterior . (now - target): preconditioned by the
        # curvature first, and plain, which always descends, where the projection spoils that
        for move in (np.linalg.pinv(curve, rcond=1e-6) @ (now - target), (now - target) / np.linalg.eigvalsh(curve)[-1]):
            trial = [*steps, [float(x) for x in move]]
            reached, bent = totals(trial)
            if off(reached) < off(now) * 0.999:
                break
        else:
            break
        steps, now, curve = trial, reached, bent
    return steps, target, now


@dataclass
class Mix:
    """A fitted mixture. members: (id, posterior, tokens), and whole rows if they were asked for, in the shared folder."""

    model: Domains
    steps: list[list[float]]
    target: np.ndarray
    reached: np.ndarray
    members: DataFrame
    least: float = 0.0
    names: dict[str, str] = field(default_factory=dict)  # columns of whole rows in members

    def rates(self, rows: DataFrame, id_col: str) -> DataFrame:
        """rows, which have posterior and tokens, with rate and copies."""
        draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(41)), F.lit(1_000_000)) / 1e6
        copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
        return rows.withColumn("rate", rate_after(self.steps, len(self.model.names), self.least)).withColumn("copies", copies.cast("int"))

    @property
    def residual(self) -> float:
        return float(np.abs(self.reached - self.target).max() / max(1.0, self.target.sum()))

    def repeated(self) -> DataFrame:
        """The rows of the documents that were fitted, each as often as its copies, with their own columns."""
        rated = self.rates(self.members, "id")
        once = rated.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        return once.select(*(F.col(n).alias(c) for c, n in self.names.items()))


def fit_mix(docs: DataFrame, labels: DataFrame, domain: str, *, weights: dict[str, float] | None = None, boost: dict[str, float] | None = None, budget: float | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8_000, whole_rows: bool = False) -> Mix:
    """weights: target shares by domain; or boost: factors on the shares found, 1 where not named.
    least: the rate that no document goes below; at 1 none is lost. whole_rows: keep the documents' rows
    beside their posteriors, in the same table, so that `repeated` reads texts and features them once."""
    model = fit_domains(docs, labels, F.expr(domain), id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)} if whole_rows else {}  # so that no name of docs is in the way
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in names.items() if c != text_col))
    found = memberships(rows, model)
    if whole_rows:
        found = found.withColumnRenamed("text", names[text_col])
    members = written(found.select("id", "posterior", "tokens", *names.values()), "mixing-members", compression="zstd" if whole_rows else "snappy")
    steps, target, reached = fit_rates(members.select("posterior", "tokens"), model.names, weights, boost, budget, least)
    made = Mix(model, steps, target, reached, members, least, names)
    if made.residual > RESIDUAL:
        warnings.warn(f"the mixture misses its targets by {made.residual:.1%} of all tokens", stacklevel=2)
    return made


#: The labels make three domains: good prose, poor prose and toxic text.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END"
TARGET = {"good": 0.78, "poor": 0.12, "toxic": 0.10}


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = fit_mix(docs, table(spark, sf_dir, "labels"), DOMAIN, weights=TARGET)
    names = fitted.model.names
    return fitted.rates(fitted.members.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "tokens", *(F.col("posterior")[i].alias(f"p_{n}") for i, n in enumerate(names)), "rate", "copies", F.lit(fitted.residual).alias("residual"))
