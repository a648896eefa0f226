"""Toxicity grades by cumulative-link (proportional-odds) regression on sparse text features.

One weight vector is shared by all thresholds: ``P(grade >= k) = logistic(w . x - t_k)`` with rising
``t_k``; the expected severity is the sum of these over k.  It is fitted by the likelihood of the
grades, ``P(grade = k) = P(grade >= k) - P(grade >= k + 1)``, less an L1 penalty.  Weights are not
negative: a term can raise the severity of a text, harmless words around it do not lower it.

Features are words (1 if present) and the first four, five and six characters of words, by how many
of the text's words begin so (1 from one in ``1 / DENSE`` on).  So inflected and coined forms of a
term are recognised, and a text full of them differs from one where such a word occurs.

Grades come from the labels alone: 0 for clean documents, 1 for toxic ones, 2 for toxic ones of low
quality where the labels judge quality too.  A document is called toxic if ``P(grade >= 1)`` reaches
a cut that is fitted between 0.02 and 0.8 on documents left out of the fit.

Bound, a parameter: of the labelled documents at most ``per_class`` toxic and twice as many clean
ones are read for the fit, those of the lowest hash; they weigh as many as they stand for.  No other
cap: a feature enters if its likelihood gradient at weight zero exceeds the penalty.  Scoring reads
every word of every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, prepare, table

WORD = re.compile(r"\w+")
GRADES = 2
STARTS = (4, 5, 6)
#: A start that one word in fifty has counts in full.
DENSE = 50.0
#: The penalty is this over the root of the number of documents fitted.
L1 = 0.03


def features(text: str | None) -> dict[str, float]:
    """Words of a text, and their starts (``abcd~``) by density."""
    words = WORD.findall(text.lower()) if text else []
    counts = Counter(words)
    starts: Counter = Counter()
    for w, n in counts.items():
        for k in STARTS:
            if len(w) >= k:
                starts[w[:k] + "~"] += n
    return {**dict.fromkeys(counts, 1.0), **{f: min(1.0, DENSE * n / len(words)) for f, n in starts.items()}}


@dataclass
class Model:
    """``weights`` by feature, rising ``thresholds``; an empty model calls nothing toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    cut: float = 0.5

    def chances(self, text: str | None) -> list[float]:
        """``P(grade >= k)`` for k = 1, 2, ..."""
        if not self.thresholds:
            return [0.0] * GRADES
        known = self.weights
        words = WORD.findall(text.lower()) if text else []
        found: dict[str, float] = {}
        for w, n in Counter(words).items():
            if w in known:
                found[w] = 1.0
            for k in STARTS:
                if len(w) >= k and (start := w[:k] + "~") in known:
                    found[start] = found.get(start, 0.0) + DENSE * n / len(words)
        score = math.fsum(known[f] * min(1.0, v) for f, v in found.items())
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, score - t)))) for t in self.thresholds]


def best_cut(p: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None = None, clean_cost: float = 1.5) -> float:
    """Where to cut ``P(grade >= 1)``, from 0.02 to 0.8: the middle of the gap of the least cost of errors.

    An error on a clean document costs ``clean_cost`` times one on a toxic document.
    """
    weight = np.ones(len(p)) if weight is None else weight
    edges = np.unique(np.concatenate(([0.02, 0.8], p[(p > 0.02) & (p < 0.8)])))
    middles = (edges[1:] + edges[:-1]) / 2
    wrong = [clean_cost * np.sum(weight * ((p >= m) & (toxic == 0))) + np.sum(weight * ((p < m) & (toxic == 1))) for m in middles]
    width = np.diff(edges)
    return float(min(zip(wrong, -width, middles, strict=True))[2])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def cumulative_link(score: np.ndarray, t: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of ``grades``, and its gradients by each row's score and by the thresholds."""
    n, k = weight.sum(), len(t)
    edges = np.concatenate(([-np.inf], t, [np.inf]))
    above = np.where(grades > 0, _logistic(score - np.where(grades > 0, edges[grades], 0)), 1.0)
    beyond = np.where(grades < k, _logistic(score - np.where(grades < k, edges[grades + 1], 0)), 0.0)
    p = np.maximum(above - beyond, 1e-300)
    by_t = np.zeros(k + 2)
    np.add.at(by_t, grades, weight * above * (1 - above) / p)
    np.add.at(by_t, grades + 1, -weight * beyond * (1 - beyond) / p)
    return float(-(weight * np.log(p)).sum() / n), weight * (above + beyond - 1) / n, by_t[1:-1] / n


def null_thresholds(grades: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The thresholds of the greatest likelihood if no feature counts: those of the shares of the grades."""
    share = np.array([weight[grades >= k].sum() for k in range(1, int(grades.max()) + 1)]) / weight.sum()
    share = np.clip(share, 1e-9, 1 - 1e-9)
    return -np.log(share / (1 - share))


def _solve(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, weight: np.ndarray, w: np.ndarray, free: np.ndarray, l1: float, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient steps from weights ``w`` and thresholds ``free`` (the first, and the logarithms of the gaps)."""
    n, m = len(grades), len(w)
    # The curvature by scores is at most one half; by features that times the largest eigenvalue of x'x / n.
    v, size = np.ones(m), 0.0
    for _ in range(30):
        v = np.bincount(cols, weights=values * (weight / weight.sum() * np.bincount(rows, weights=values * v[cols], minlength=n))[rows], minlength=m)
        size = np.linalg.norm(v)
        v = v / (size or 1.0)
    pace = 1 / (0.5 * size + 1e-9)

    def at(w: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, by_score, by_t = cumulative_link(np.bincount(rows, weights=values * w[cols], minlength=n), _rising(free), grades, weight)
        by_f = np.concatenate(([by_t.sum()], np.cumsum(by_t[::-1])[::-1][1:] * np.exp(free[1:])))
        return loss + l1 * w.sum(), np.bincount(cols, weights=values * by_score[rows], minlength=m), by_f

    now = at(w, free)
    last_w, last_f, pull, pace_f, still = w, free, 1.0, 2.0, 0
    for _ in range(rounds):
        then = (1 + math.sqrt(1 + 4 * pull * pull)) / 2
        push = (pull - 1) / then
        y_w, y_f = np.maximum(w + push * (w - last_w), 0), free + push * (free - last_f)
        _, by_w, by_f = at(y_w, y_f) if push else now
        new_w, new_f = np.maximum(y_w - pace * (by_w + l1), 0), y_f - pace_f * by_f
        new = at(new_w, new_f)
        if new[0] > now[0]:  # overshot: no momentum, then shorter steps
            pace, pace_f = (pace, pace_f) if push else (0.7 * pace, 0.5 * pace_f)
            last_w, last_f, pull = w, free, 1.0
            if pace_f < 1e-9:
                break
            continue
        still = still + 1 if now[0] - new[0] < tolerance * new[0] else 0
        last_w, last_f, w, free, now, pull = w, free, new_w, new_f, new, then
        if still == 5:
            break
    return w, free


def _rising(free: np.ndarray) -> np.ndarray:
    return np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, values: np.ndarray | None = None, weight: np.ndarray | None = None, rounds: int = 400, l1: float = 5e-4, relax: float = 0.3, tolerance: float = 1e-7
) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and rising thresholds of the greatest penalised likelihood.

    ``rows``, ``cols``, ``values`` are the entries of the feature matrix.  Solved over the features
    that matter: those whose gradient exceeds the penalty are added until there is none left.  The
    features chosen so are then fitted once more with ``relax`` times the penalty, which takes back
    most of its shrinkage.
    """
    n = len(grades)
    values = np.ones(len(rows)) if values is None else values
    weight = np.ones(n) if weight is None else weight
    t = null_thresholds(grades, weight)
    free = np.concatenate((t[:1], np.log(np.maximum(np.diff(t), 1e-3))))
    w, active = np.zeros(n_features), np.zeros(n_features, bool)
    for _ in range(50):
        _, by_score, _ = cumulative_link(np.bincount(rows, weights=values * w[cols], minlength=n), _rising(free), grades, weight)
        gain = -np.bincount(cols, weights=values * by_score[rows], minlength=n_features)
        more = ~active & (gain > l1 * 1.01)
        if not more.any():
            break
        active |= more & (gain >= 0.3 * gain[more].max())
        place, take = np.cumsum(active) - 1, active[cols]
        w[active], free = _solve(rows[take], place[cols[take]], values[take], grades, weight, w[active], free, l1, rounds, tolerance)
    active = w > 0
    if relax < 1 and active.any():
        place, take = np.cumsum(active) - 1, active[cols]
        w[active], free = _solve(rows[take], place[cols[take]], values[take], grades, weight, w[active], free, l1 * relax, rounds, tolerance)
    return w, _rising(free)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, quality_col: str | None, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """``id``, ``text``, ``grade`` of the sample, and how many labelled documents one of each kind stands for."""
    poor = F.col(quality_col).cast("int") == 0 if quality_col else F.lit(False)
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"), F.coalesce(poor, F.lit(False)).cast("int").alias("poor")).filter("id is not null and toxic in (0, 1)")
    told = materialise(told.groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("poor").alias("poor")), "toxic-labels")
    known = told.join(docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    known = materialise(known.select("id", (F.col("toxic") * (1 + F.col("poor"))).alias("grade")), "toxic-labels")
    n = {r["toxic"]: r["n"] for r in known.groupBy((F.col("grade") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}  # two rows
    most = {1: per_class, 0: 2 * per_class}
    some = [known.filter("grade > 0" if k else "grade = 0").orderBy(F.xxhash64("id"), "id").limit(most[k]) for k in (0, 1)]
    chosen = some[0].unionByName(some[1])  # at most 3 * per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "id").filter("text is not null").select("id", "text", "grade")
    # Near copies would lend the words of one document the weight of many: of those that share the
    # least hash of their five-word runs, by either of two seeds, one is kept.
    found = materialise(found.mapInArrow(_least_batches, "id long, text string, grade int, least1 long, least2 long, mark long"), "toxic-labelled")
    kind = (F.col("grade") > 0).alias("kind")
    for least in ("least1", "least2"):
        first = found.groupBy(kind, least).agg(F.min(F.struct("mark", "id")).alias("x")).select("kind", least, "x.mark", "x.id")
        found = found.withColumn("kind", F.col("grade") > 0).join(first, ["kind", least, "mark", "id"], "left_semi").drop("kind")
    return found.dropDuplicates(["id"]).select("id", "text", "grade"), {k: max(1.0, n.get(k, 0) / most[k]) for k in (0, 1)}


def _least_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least: list[list[int]] = [[], []]
        marks = []
        for text in batch.column(1):
            words = text.as_py().lower().encode("utf-8", "surrogatepass").split()
            runs = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
            for k in (0, 1):
                least[k].append(min(xxhash.xxh64_intdigest(r, k + 1) for r in runs))
            marks.append(xxhash.xxh64_intdigest(b" ".join(words), 7))
        made = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (*least, marks)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["id", "text", "grade", "least1", "least2", "mark"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, grade in zip(batch.column(0), batch.column(1), strict=True):
            found = sorted(features(text.as_py()).items())
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([v for _, v in found], pa.float64()), pa.array([grade.as_py()] * len(found), pa.int32())], names=["feature", "value", "grade"])


def _index_batches(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted((index[f], v) for f, v in features(t.as_py()).items() if f in index) for t in batch.column(0)]
            cols, values = pa.array([[i for i, _ in h] for h in hits], pa.list_(pa.int32())), pa.array([[v for _, v in h] for h in hits], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), cols, values], names=["grade", "cols", "vals"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", quality_col: str | None = "quality", per_class: int = 3000, penalty: float = L1) -> Model:
    """Fit on labelled rows: up to ``per_class`` toxic and twice as many clean documents.

    Labels outside 0 and 1, of unknown documents or of null texts are not used; of contrary labels
    of one document the toxic one holds, and its lowest quality.  A null quality counts as good, and
    so does all quality if ``labels`` has no ``quality_col``.  Repeated rows and near copies of the
    documents count once.  Without documents of both kinds, with empty tables, the model is empty.
    """
    prepare(docs.sparkSession)
    sample, stands_for = _labelled(docs, labels, id_col, text_col, label_col, quality_col if quality_col in labels.columns else None, per_class)
    sample = materialise(sample, "toxic-sample")
    sizes = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # a row for each grade
    toxic = sorted(g for g in sizes if g > 0)
    if 0 not in sizes or not toxic:
        return Model()
    # Grades without documents are left out: those of one kind of toxic documents are grade 1.
    place = {0: 0, **{g: i + 1 for i, g in enumerate(toxic)}}
    scale = {g: stands_for[min(g, 1)] for g in sizes}
    grades = np.repeat([place[g] for g in sizes], [sizes[g] for g in sizes])
    weight = np.repeat([scale[g] for g in sizes], [sizes[g] for g in sizes]).astype(float)
    l1 = penalty / math.sqrt(len(grades))
    _, by_score, _ = cumulative_link(np.zeros(len(grades)), null_thresholds(grades, weight), grades, weight)
    pull = {g: float(-by_score[grades == place[g]][0]) for g in sizes}
    gain = F.sum(F.col("value") * F.element_at(F.create_map(*[F.lit(x) for g in sorted(sizes) for x in (g, pull[g])]), F.col("grade")))
    kept = sample.select("text", "grade").mapInArrow(_feature_batches, "feature string, value double, grade int").groupBy("feature").agg(F.round(gain, 12).alias("gain")).filter(F.col("gain") > l1)
    index = {r["feature"]: i for i, r in enumerate(kept.orderBy("feature").select("feature").collect())}  # at most one for every l1 of gain, of which 1 is shared by the features of a document
    if not index:
        return Model()
    data = sample.select("text", "grade").mapInArrow(_index_batches(index), "grade int, cols array<int>, vals array<double>").collect()  # at most 3 * per_class rows
    data.sort(key=lambda r: (r["grade"], r["cols"], r["vals"]))
    rows = np.repeat(np.arange(len(data)), [len(r["cols"]) for r in data])
    cols = np.array([c for r in data for c in r["cols"]], np.int64)
    values = np.array([v for r in data for v in r["vals"]], float)
    grades = np.array([place[r["grade"]] for r in data])
    weight = np.array([scale[r["grade"]] for r in data], float)

    def fitted(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.cumsum(some) - 1
        take = some[rows]
        return fit_ordinal(number[rows[take]], cols[take], grades[some], len(index), values[take], weight[some], l1=l1)

    def toxic_chance(w: np.ndarray, t: np.ndarray) -> np.ndarray:
        return _logistic(np.bincount(rows, weights=values * w[cols], minlength=len(data)) - t[0])

    # The cut is fitted on documents that a fit on the others has not seen.
    p, fold = np.zeros(len(data)), np.arange(len(data)) % 3
    for k in range(3):
        rest = fold != k
        if len(set(grades[rest] > 0)) == 2:
            p[fold == k] = toxic_chance(*fitted(rest))[fold == k]
    w, t = fitted(np.ones(len(data), bool))
    return Model({f: float(w[i]) for f, i in index.items() if w[i] != 0}, tuple(float(x) for x in t), best_cut(p, (grades > 0).astype(int), weight))


def _scored(model: Model, texts: pa.Array) -> np.ndarray:
    return np.array([model.chances(t.as_py()) for t in texts], float).reshape(len(texts), -1)


def _chance_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _scored(model, batch.column(1))
            first = got[:, 0] if len(got) else np.zeros(0)
            grade = ((first >= model.cut) * np.maximum(1, (got >= 0.5).sum(axis=1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.sum(axis=1)), pa.array(grade), pa.array(first)], names=["id", "severity", "grade", "p_toxic"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``severity`` (expected grade), ``grade``, ``p_toxic``, ``toxic`` per row.

    Null and empty texts have no features and score as such; equal texts score alike; repeated rows
    are returned each.  Texts are read whole.  Other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_chance_batches(model), "id long, severity double, grade int, p_toxic double").withColumn("toxic", F.col("grade") > 0)


def _clean_batches(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.chances(t.as_py())[0] < model.cut for t in batch.column(at)], pa.bool_()))

    return run


def clean_only(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not call toxic; nothing is shuffled.

    Nulls, repeats and long texts are as in :func:`score`.
    """
    prepare(docs.sparkSession)
    return docs.mapInArrow(_clean_batches(model, docs.columns.index(text_col)), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
