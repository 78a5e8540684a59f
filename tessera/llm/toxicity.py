"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a small fixed lexicon and of one learned from the labelled
rows, how close such words stand to the second person, and rates of capitals, punctuation,
repeated letters and obfuscated spellings (letters mixed with digits or symbols, undone before the
lexicons are looked up).

Fitting reads a bounded, documented sample: at most ``sample_rows`` labelled rows whose id the
caller admits, chosen by a hash of the id. The learned lexicon holds word beginnings that occur in
toxic rows of the sample much more often than their share of all rows explains. Trees are fitted to
the sample on the driver (``sample_rows`` rows of a dozen numbers); isotonic regression is fitted
to out-of-fold margins. Scoring is one map over all rows.

A null text counts as empty. Without labelled rows every score is 0; with one class only, its
value. Labels that are null are left out; of several labels for one id the largest counts. Repeated
rows get equal scores; an empty table gives an empty one. Columns of docs are passed on; ones named score or predicted are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, scratch, table, tidy, written

#: Insults that count from the start, whatever the labels say.
LEXICON = frozenset("stupid idiot idiots idiotic moron morons trash garbage disgusting pathetic worthless scum loser losers clown dumb imbecile filth filthy vermin shut hate kill".split())
SECOND_PERSON = frozenset("you your yours yourself ur u tu te toi vous du dich dir ihr sie usted ustedes vosotros".split())
WORD = re.compile(r"[^\W_]+")
ODD = re.compile(r"(?<=[^\W\d_])[*@$#!0-9][*@$#!\w]*[^\W\d_]")
REPEAT = re.compile(r"([^\W\d_])\1\1")
SPELT = str.maketrans("013457@$!", "oieastasi")
BEGINNINGS = range(3, 8)
NEAR = 5
CACHE = 200_000


def beginnings(word: str) -> list[str]:
    """The word itself, and its beginnings under a mark of their own."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


class Features:
    """Text to numbers; each learned lexicon, from labels, gives one density."""

    def __init__(self, *learned: frozenset[str]) -> None:
        self.learned = learned
        self.heads = frozenset(x[:3] for words in learned for x in words)
        self.plain: set[str] = set()  # words without a kind
        self.kinds: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """1: in the fixed lexicon, 2: second person, 4: a letter three times, 8 << i: in learned[i]."""
        k = (word in LEXICON) + 2 * (word in SECOND_PERSON) + 4 * (REPEAT.search(word) is not None)
        if word[:3] in self.heads:
            own = beginnings(word)
            k += sum(8 << i for i, words in enumerate(self.learned) if any(x in words for x in own))
        return k

    def look_up(self, words: set[str]) -> None:
        if len(self.plain) > CACHE:
            self.plain.clear()
        if len(self.kinds) > CACHE:
            self.kinds.clear()
        for w in words - self.plain - self.kinds.keys():
            if k := self.kind(w):
                self.kinds[w] = k
            else:
                self.plain.add(w)

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = WORD.findall(text.lower())
        different = set(words)
        self.look_up(different)
        # most words of most texts have no kind; only the others are gone through
        hot = different & self.kinds.keys()
        kinds = [(i, self.kinds[w]) for i, w in enumerate(words) if w in hot] if hot else []
        odd = [self.whole(text, m.start(), m.end()) for m in ODD.finditer(text)]
        undone = [self.kind(w) for x in odd for w in WORD.findall(x.lower().translate(SPELT))]
        hits = [i for i, k in kinds if k & ~6]
        persons = [i for i, k in kinds if k & 2]
        near = j = 0
        for i in hits:
            while j < len(persons) and persons[j] < i - NEAR:
                j += 1
            near += j < len(persons) and persons[j] <= i + NEAR
        n = max(1, len(words))
        byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128)
        upper = int(byte[65:91].sum())
        letters = max(1, int(byte[97:123].sum()) + upper)
        marks = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum())
        shouted = sum(map(str.isupper, text.split())) if upper > 0.2 * letters else 0
        every = [k for _, k in kinds] + undone
        fixed, *learned = (sum((k & bit) > 0 for k in every) for bit in (1, *(8 << i for i in range(len(self.learned)))))
        return [math.log1p(len(words)), fixed / n, math.log1p(len(hits) + sum((k & ~6) > 0 for k in undone)), len(persons) / n, near / n, upper / letters, shouted / n, byte[33] / n, marks / n, int(byte[48:58].sum()) / n, len(odd) / n, sum((k & 4) > 0 for _, k in kinds) / n, len(different) / n, int(byte[35:39].sum() + byte[42] + byte[124]) / n, *(x / n for x in learned)]

    @staticmethod
    def whole(text: str, start: int, end: int) -> str:
        """The letters before an odd place and what follows it."""
        at = start
        while at > 0 and start - at < 30 and text[at - 1].isalpha():
            at -= 1
        return text[at:end]


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss, on features cut at quantiles."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 48
    least: int = 5
    ridge: float = 1.0
    base: float = 0.0
    cuts: list = field(default_factory=list)
    made: list = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:])) for j in range(x.shape[1])]
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        b, margin, width = self._binned(x), np.full(len(y), self.base), self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), int), {}
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if (split := self._split(b[rows], g[rows], h[rows], width)) is None:
                        continue
                    j, cut = split
                    tree[k] = split
                    node[rows] = 2 * k + 1 + (b[rows, j] > cut)
            leaves = 2 ** (self.depth + 1) - 1
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.made.append((tree, value))
            margin += value[node]
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> tuple[int, int] | None:
        best, found = 1e-6, None
        if len(b) < 2 * self.least:
            return None
        whole = g.sum() ** 2 / (h.sum() + self.ridge)
        for j in range(b.shape[1]):
            gs, hs, ns = (np.cumsum(np.bincount(b[:, j], w, width)) for w in (g, h, None))
            gain = gs**2 / (hs + self.ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.ridge) - whole
            gain[(ns < self.least) | (ns[-1] - ns < self.least)] = 0
            if gain.max() > best:
                best, found = gain.max(), (j, int(gain.argmax()))
        return found

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.base)
        for tree, value in self.made:
            node = np.zeros(len(x), int)
            for k in sorted(tree):
                at, (j, cut) = node == k, tree[k]
                node[at] = 2 * k + 1 + (b[at, j] > cut)
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots and non-decreasing probabilities to interpolate."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    learned: frozenset[str] = frozenset()
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    constant: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        m = self.trees.margin(x)
        # the uncalibrated probability only orders what calibration ties
        return np.clip(0.998 * np.interp(m, *self.knots) + 0.002 / (1 + np.exp(-m)), 0, 1)


def sample(docs: DataFrame, labels: DataFrame, admitted: Column, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y) of at most rows labelled documents, written to the shared folder."""
    marked = labels.filter(admitted & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    some = marked.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(some), "id").repartition(24), "toxicity-sample")  # some: at most `rows` small rows


def learn_lexicon(rows: DataFrame, n: int, positive: int, *, candidates: int = 20_000, size: int = 2_000, least: int = 3, nats: float = 9.0) -> frozenset[str]:
    """Beginnings of words that toxic rows have more often than chance explains."""

    def count(keep: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    found = {x for w in set(WORD.findall(text.lower())) for x in beginnings(w)}
                    seen.update(found if keep is None else found & keep)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["x", "n"])

        return run

    toxic = rows.filter("y = 1").select("text").mapInArrow(count(None), "x string, n long").groupBy("x").agg(F.sum("n").alias("n"))
    pos = {r[0]: r[1] for r in toxic.filter(F.col("n") >= least).orderBy(F.desc("n"), "x").limit(candidates).collect()}
    if not pos:
        return frozenset()
    clean = rows.filter("y = 0").select("text").mapInArrow(count(frozenset(pos)), "x string, n long").groupBy("x").agg(F.sum("n").alias("n"))
    neg, base = {r[0]: r[1] for r in clean.collect()}, positive / n
    found = []
    for x, k in pos.items():
        total = k + neg.get(x, 0)
        p = k / total
        if p > 0.5 and p > base:
            gain = total * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0))
            found.append((-gain, x))
    return frozenset(x for g, x in sorted(found)[:size] if -g >= nats)


def fit(docs: DataFrame, labels: DataFrame, admitted: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000, folds: int = 4) -> Model:
    with scratch(docs.sparkSession):
        rows = sample(docs, labels, admitted, sample_rows, id_col, text_col, label_col)
        n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
        if not n or positive in (0, n):
            return Model(constant=float(bool(n and positive == n)))
        learned = learn_lexicon(rows, n, positive)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = Features(learned)
            for batch in batches:
                x = [make(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

        got = sorted((r[0], r[1], list(r[2])) for r in rows.mapInArrow(run, "id string, y int, x array<double>").collect())
        x, y = np.array([r[2] for r in got]), np.array([r[1] for r in got], float)
        fold, out = np.arange(len(y)) % folds, np.zeros(len(y))
        for k in range(folds):
            out[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
        return Model(learned, Trees().fit(x, y), isotonic(out, y))


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5)."""
    rest = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(model.learned)
        for batch in batches:
            x = np.array([make(t.as_py()) for t in batch.column(text_col)]).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"))], [*batch.schema.names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "score double", "predicted int"])
    return rest.mapInArrow(tidy(run), schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
