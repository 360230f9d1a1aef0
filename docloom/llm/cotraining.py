"""Quality classifier by co-training (operator 5).

Two logistic classifiers see different views of a document: the words and character statistics of its
text, and its page metadata (language, source, length).  Over rounds each one labels the unlabelled
documents it is most sure of for the other.  All unlabelled documents are candidates in every round: Spark
scores them and takes the most confident ones.  Both are then calibrated on labelled documents kept apart
(Platt scaling), combined by a last logistic step on the two calibrated scores, and applied to all
documents.

A document is good when its label says quality 1 and toxic 0 (a null counts as missing; a row needs
quality, toxic may be missing).  ``rejected`` is a combined probability of being good under 0.5.

The classifiers are fitted on at most ``LABELLED`` labelled documents, those with the smallest hashes of
their ids, and the pseudo-labels, ``EXCHANGE`` from each view per round.  Features are counted once per
document; every document is read whole.

Defined results: a null text counts as empty, a null source or language as a value of its own, a null
n_chars as 0; documents with several labels count once, with the mean of their labels; every input row
gives one row, also where ids are null or repeated; without labels of both kinds nothing can be learned:
all scores are the share of good labels (1 without labels) and nothing is rejected; an empty table gives
no rows; other columns are carried by ``keep_good`` and ignored otherwise.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, slices, table, text_batches, text_bytes

LABELLED = 6000
ROUNDS = 5
#: Pseudo-labels that each view gives the other per round.
EXCHANGE = 300
WORD_SLOTS = 1 << 18
META_SLOTS = 1 << 10
#: Words count only where they tell the two kinds apart by so many standard deviations.
SIGNIFICANT = 4.0
THRESHOLD = 0.5


@lru_cache(maxsize=1 << 14)
def _slot(word: bytes) -> int:
    return zlib.crc32(word) % WORD_SLOTS


def text_features(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word slots, their weights, dense statistics) of one whole text."""
    words = raw.lower().split()
    counts = Counter(w.strip(b".,;:!?\"'()") for w in words)
    counts.pop(b"", None)
    slots = np.fromiter(map(_slot, counts), dtype=np.int32, count=len(counts))
    weights = np.ones(len(slots), dtype=np.float32)
    n, size = max(1, len(words)), max(1, len(raw))
    upper = sum(map(raw.count, (b"A", b"E", b"I", b"N", b"O", b"R", b"S", b"T")))
    lower = sum(map(raw.count, (b"a", b"e", b"i", b"n", b"o", b"r", b"s", b"t")))
    top = max(counts.values(), default=0)
    dense = np.array(
        [
            np.log1p(n) / 10,
            upper / max(1, upper + lower),
            sum(map(raw.count, (b"!", b"?"))) / n,
            sum(map(raw.count, (b"#", b"$", b"%", b"&", b"*", b"@"))) / n,
            raw.count(b"|") / n,
            sum(map(raw.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / size,
            len(counts) / n,
            top / n,
            size / n / 10,
            raw.count(b"\n") / n,
            sum(map(raw.count, (b".", b","))) / n,
            1.0,
        ],
        dtype=np.float32,
    )
    return slots, weights, np.minimum(dense, 5).astype(np.float32)


@lru_cache(maxsize=1 << 12)
def _meta_slots(lang, source) -> np.ndarray:
    names = (f"lang={lang}", f"source={source}", f"both={lang},{source}")
    return np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % META_SLOTS for x in names], dtype=np.int32)


def meta_features(lang, source, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    slots = _meta_slots(lang, source)
    size = np.log1p(max(0, n_chars or 0))
    return slots, np.full(len(slots), 0.3, dtype=np.float32), np.array([size / 10, (size / 10) ** 2, float(size < 5), float(size > 9), 1.0], dtype=np.float32)


class Logistic:
    """Logistic regression on (slots, weights, dense) rows: Adam over the whole sample, L2.

    With ``select`` only slots that differ significantly between the two kinds get a weight.
    """

    def __init__(self, slots: int, select: bool = False):
        self.w, self.d, self.select = np.zeros(slots, dtype=np.float64), None, select

    def _chosen(self, of: np.ndarray, slots: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Whether each entry is in a slot that tells good from bad."""
        good = target > 0.5
        n1, n0 = max(1, good.sum()), max(1, (~good).sum())
        in_good = np.bincount(slots[good[of]], minlength=len(self.w))
        in_bad = np.bincount(slots[~good[of]], minlength=len(self.w))
        share = (in_good + in_bad) / (n1 + n0)
        z = (in_good / n1 - in_bad / n0) / np.sqrt(np.maximum(share * np.maximum(1 - share, 1e-3) * (1 / n1 + 1 / n0), 1e-12))
        return (np.abs(z) > SIGNIFICANT)[slots]

    @staticmethod
    def _flat(rows):
        of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        return of, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64), np.stack([r[2] for r in rows]).astype(np.float64)

    def margin(self, rows) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        of, slots, weights, dense = self._flat(rows)
        return np.bincount(of, weights=self.w[slots] * weights, minlength=len(rows)) + dense @ self.d

    def fit(self, rows, target: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.1, l2: float = 2e-4) -> Logistic:
        of, slots, weights, dense = self._flat(rows)
        self.w[:] = 0
        if self.select:
            chosen = self._chosen(of, slots, target)
            of, slots, weights = of[chosen], slots[chosen], weights[chosen]
        self.d = np.zeros(dense.shape[1])
        moments = [np.zeros_like(x) for x in (self.w, self.w, self.d, self.d)]
        weight = weight / weight.sum()
        for k in range(1, steps + 1):
            z = np.bincount(of, weights=self.w[slots] * weights, minlength=len(rows)) + dense @ self.d
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
            grads = np.bincount(slots, weights=e[of] * weights, minlength=len(self.w)) + l2 * self.w / 10, dense.T @ e + l2 * self.d / 10
            for i, (x, g) in enumerate(zip((self.w, self.d), grads, strict=True)):
                m, s = moments[2 * i], moments[2 * i + 1]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-9)
        return self


def _platt(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """a, b of the calibrated probability 1 / (1 + exp(-(a * margin + b)))."""
    a, b = 1.0, 0.0
    good, bad = target.sum(), len(target) - target.sum()
    soft = np.where(target > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        ga, gb = ((p - soft) * margin).sum() + 1e-3 * (a - 1), (p - soft).sum()
        haa, hab, hbb = (w * margin * margin).sum() + 1e-3, (w * margin).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        a, b = float(np.clip(a, 0, 20)), float(np.clip(b, -20, 20))
    return a, b


class Model:
    """Both views, their calibrations and the combination."""

    def __init__(self, prior: float):
        self.prior, self.text, self.meta = prior, None, None
        self.calibration, self.combination = ((1.0, 0.0), (1.0, 0.0)), (1.0, 1.0, 0.0)

    def scores(self, text_rows, meta_rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            flat = np.full(len(text_rows), self.prior)
            return flat, flat, flat
        margins = [a * v.margin(r) + b for v, r, (a, b) in zip((self.text, self.meta), (text_rows, meta_rows), self.calibration, strict=True)]
        x, y, c = self.combination
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return sigmoid(margins[0]), sigmoid(margins[1]), sigmoid(x * margins[0] + y * margins[1] + c)


#: (margins to 0/1 per view: text and meta classifier, how many good, how many bad, ids not to offer) -> for each
#: view the most confident good and bad rows (id, text row, meta row, margin), best first.
MostConfident = Callable[[list, int, int, set], list[tuple[list, list]]]


def co_train(labelled: list[tuple], most_confident: MostConfident | None, rounds: int = ROUNDS) -> Model:
    """labelled: (id, text row, meta row, good in [0, 1]); ``most_confident`` searches the unlabelled documents."""
    good = np.array([x[3] for x in labelled])
    model = Model(float(good.mean()) if len(good) else 1.0)
    hard = good > 0.5
    if len(labelled) < 8 or hard.all() or not hard.any():
        return model
    # Every fourth document (by hash) of either kind calibrates.
    held = np.zeros(len(labelled), dtype=bool)
    for kind in (hard, ~hard):
        held[np.flatnonzero(kind)[3::4]] = True
    if not (hard[held].any() and (~hard[held]).any()):
        held[:] = False
    fit = np.flatnonzero(~held)
    views = [[x[1] for x in labelled], [x[2] for x in labelled]]
    # What each view was given: id -> (rows of both views, label).
    given: list[dict] = [{}, {}]
    classifiers = [Logistic(WORD_SLOTS, select=True), Logistic(META_SLOTS)]

    def refit(v: int) -> None:
        extra = list(given[v].values())
        rows = [views[v][i] for i in fit] + [x[0][v] for x in extra]
        target = np.concatenate([good[fit], [x[1] for x in extra]])
        weight = np.concatenate([np.ones(len(fit)), np.full(len(extra), 0.5)])
        classifiers[v].fit(rows, target, weight)

    for v in (0, 1):
        refit(v)
    share = float(good[fit].mean())
    n_good, n_bad = max(1, round(EXCHANGE * share)), max(1, round(EXCHANGE * (1 - share)))
    for _ in range(rounds if most_confident else 0):
        found, offers = most_confident(classifiers, n_good, n_bad, given[0].keys() | given[1].keys()), []
        for v, (best, worst) in enumerate(found):
            a, b = _platt(classifiers[v].margin([views[v][i] for i in np.flatnonzero(held)]), good[held]) if held.any() else (1.0, 0.0)
            p = lambda z, a=a, b=b: 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            offers.append({i: ((t, m), 1.0) for i, t, m, z in best if p(z) > 0.95} | {i: ((t, m), 0.0) for i, t, m, z in worst if p(z) < 0.05})
        given[1] |= offers[0]
        given[0] |= offers[1]
        if not offers[0] and not offers[1]:
            break
        for v in (0, 1):
            refit(v)
    model.text, model.meta = classifiers
    if held.any():
        at = np.flatnonzero(held)
        margins = [classifiers[v].margin([views[v][i] for i in at]) for v in (0, 1)]
        model.calibration = tuple(_platt(m, good[at]) for m in margins)
        x = np.stack([a * m + b for m, (a, b) in zip(margins, model.calibration, strict=True)] + [np.ones(len(at))], axis=1)
        w = np.array([1.0, 0.0, 0.0])
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 0.5 * (x.T @ (p - good[at]) / len(at) + 0.01 * (w - [1.0, 0.0, 0.0]))
        model.combination = tuple(np.maximum(w[:2], 0)) + (float(w[2]),)
    else:
        model.combination = (1.0, 0.0, 0.0)
    return model


FEATURES = "id {id}, slots binary, dense binary, lang string, source string, n_chars long"


def document_features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of FEATURES: the text's features counted, the metadata as they are."""
    id_type = docs.schema[id_col].dataType.simpleString()
    text_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [text_features(text_bytes(t)) for t in batch.column(1).to_pylist()]
            slots, dense = ([x[i].tobytes() for x in found] for i in (0, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.binary()), pa.array(dense, pa.binary()), *(batch.column(i) for i in (2, 3, 4))], ["id", "slots", "dense", "lang", "source", "n_chars"])

    rows = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return rows.mapInArrow(count, FEATURES.format(id=id_type))


def _rows_of(batch: pa.RecordBatch) -> tuple[list, list]:
    """Feature rows of both views from a batch (or table) of FEATURES."""
    text = []
    for slots, dense in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        slots = np.frombuffer(slots, dtype=np.int32)
        text.append((slots, np.ones(len(slots), dtype=np.float32), np.frombuffer(dense, dtype=np.float32)))
    return text, [meta_features(*x) for x in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return slices(batches, 1, 1 << 20)


def _fetch(features: DataFrame, ids: list) -> dict:
    """id -> (text row, meta row) of the documents with these ids (a bounded list)."""
    if not ids:
        return {}
    wanted = F.broadcast(features.sparkSession.createDataFrame([(i,) for i in ids], f"wanted {features.schema['id'].dataType.simpleString()}"))
    found = features.join(wanted, F.col("id") == F.col("wanted"), "left_semi").orderBy("id", "slots", "dense", "lang", "source", "n_chars").toArrow()
    text, meta = _rows_of(found)
    return dict(zip(found.column(0).to_pylist(), zip(text, meta, strict=True), strict=True))


def spark_most_confident(features: DataFrame, known: DataFrame) -> MostConfident:
    """Searches all rows of ``features`` whose id is not null and not in known(id)."""
    id_type = features.schema["id"].dataType.simpleString()

    def search(classifiers: list, n_good: int, n_bad: int, skip: set) -> list[tuple[list, list]]:
        models = features.sparkSession.sparkContext.broadcast(classifiers)

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            text, meta = models.value
            for batch in _pieces(batches):
                x, y = _rows_of(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text.margin(x)), pa.array(meta.margin(y))], ["id", "z0", "z1"])

        scored = features.filter("id IS NOT NULL").mapInArrow(margins, f"id {id_type}, z0 double, z1 double")
        scored = materialise(scored.join(known, "id", "left_anti"), "quality-margins")
        chosen = []
        for v in ("z0", "z1"):
            for order, n in ((F.desc(v), n_good), (F.asc(v), n_bad)):
                # Documents that were given away before are passed over; repeated ids count once.
                rows = scored.groupBy("id").agg(F.max("z0").alias("z0"), F.max("z1").alias("z1")).orderBy(order, F.xxhash64("id"), "id").limit(n + len(skip)).collect()
                chosen.append([(r.id, r[v]) for r in rows if r.id not in skip][:n])
        release(scored)
        models.unpersist()
        rows = _fetch(features, sorted({i for x in chosen for i, _ in x}))
        chosen = [[(i, *rows[i], z) for i, z in x] for x in chosen]
        return [(chosen[0], chosen[1]), (chosen[2], chosen[3])]

    return search


def fit_quality(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", labelled: int = LABELLED) -> Model:
    """A model from a bounded sample of the labelled and from all unlabelled rows of ``features``."""
    good = F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("double"))
    known = labels.select(F.col(id_col).alias("id"), good.alias("good")).filter("good IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.avg("good").alias("good"))
    known = materialise(known, "quality-labels")
    chosen = known.join(features.select("id"), "id", "left_semi").orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(labelled).collect()
    rows = _fetch(features, [r.id for r in chosen])
    return co_train([(r.id, *rows[r.id], r.good) for r in chosen], spark_most_confident(features, known.select("id")))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """id, text_score, meta_score, score, rejected for every row of docs(id, text, lang, source, n_chars)."""
    features = materialise(document_features(docs, id_col), "quality-features")
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(features, labels, id_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in _pieces(batches):
            a, b, c = m.scores(*_rows_of(batch))
            rejected = (c < threshold) if m.text is not None else np.zeros(len(c), dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in (a, b, c)), pa.array(rejected, pa.bool_())], [id_col, "text_score", "meta_score", "score", "rejected"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return features.mapInArrow(score, f"`{id_col}` {id_type}, text_score double, meta_score double, score double, rejected boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns; texts are read again, so rows need no key."""
    features = materialise(document_features(docs, id_col), "quality-features")
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(features, labels, id_col))
    release(features)
    text_at, lang_at, source_at, size_at = (docs.columns.index(c) for c in ("text", "lang", "source", "n_chars"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches, text_at):
            text = [text_features(text_bytes(t)) for t in batch.column(text_at).to_pylist()]
            meta = [meta_features(*x) for x in zip(*(batch.column(i).to_pylist() for i in (lang_at, source_at, size_at)), strict=True)]
            good = m.scores(text, meta)[2] >= threshold if m.text is not None else np.ones(batch.num_rows, dtype=bool)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
