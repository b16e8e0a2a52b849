"""A convolutional text classifier: hashed word embeddings, several filter widths, max pooling, trained in numpy.

A word is embedded as the sum of three hashed rows: the word, its first four and its first five bytes, so that unseen
compounds of a known stem are near it. Filters of 1, 2 and 3 words run over the embeddings; each filter keeps its largest
response over the whole text, and a logistic unit weighs these. Gradients reach the words that won the pooling only.

The classifier is fitted on a bounded sample of labelled rows (`Settings.per_class`); a part of them, which training does
not see, sets the score's scale and, for each language, the threshold of the decision. Scores depend on the text alone.
Scoring runs over whole texts in the tasks that read them, with no shuffle; the model has a fixed size (about 20 MB).
"""

from __future__ import annotations

import dataclasses
import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.wordarrays import LETTERS, Words, pieces

PREFIXES = (4, 5)


@dataclasses.dataclass(frozen=True)
class Settings:
    #: labelled rows of each class at most; which ones is decided by a hash of the id
    per_class: tuple[int, int] = (2500, 1500)
    word_rows: int = 1 << 18
    stem_rows: int = 1 << 16
    dims: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 4
    #: training ends after an epoch of less than this mean weighted loss
    enough: float = 0.01
    batch: int = 48
    rate: float = 0.02
    decay: float = 1e-4
    #: every so-manyth row of the sample is kept for scale and thresholds
    calibration: int = 5
    seed: int = 7


def buckets(words: Words, s: Settings) -> np.ndarray:
    """Rows of the embedding tables for every word, shape (3, words)."""
    cols = [words.hash % np.uint64(s.word_rows), *(p % np.uint64(s.stem_rows) + np.uint64(s.word_rows + k * s.stem_rows) for k, p in enumerate(words.prefix))]
    return np.stack(cols).astype(np.int32)


def start(s: Settings, rng: np.random.Generator | None = None) -> np.ndarray:
    """The embedding table before training: the first values drawn from the seed, in blocks."""
    rng = rng or np.random.default_rng(s.seed)
    out = np.empty((s.word_rows + len(PREFIXES) * s.stem_rows, s.dims), np.float32)
    for at in range(0, len(out), 1 << 14):
        block = out[at : at + (1 << 14)]
        block[:] = rng.normal(0, 0.05, block.shape)
    return out


@dataclasses.dataclass
class Model:
    settings: Settings
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict | None = None
    constant: float | None = None
    #: rows of the table that training changed, and their values
    learned: tuple[np.ndarray, np.ndarray] | None = None

    @functools.cached_property
    def table(self) -> np.ndarray:
        out = start(self.settings)
        if self.learned is not None:
            out[self.learned[0]] = self.learned[1]
        return out

    def __getstate__(self) -> dict:
        """Without the rows of the table that are as drawn: they are drawn anew where the table is used."""
        state = dict(self.__dict__)
        if (table := state.pop("table", None)) is not None:
            rows = np.flatnonzero((table != start(self.settings)).any(1))
            state["learned"] = rows, table[rows]
        return state

    def responses(self, ids: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pooled filter responses by document, embeddings of the words). Texts shorter than a filter have response 0."""
        e = self.table[ids[0]]
        for row in ids[1:]:
            e = e + self.table[row]
        n = np.diff(per_doc)
        pooled = np.zeros((len(n), len(self.settings.widths) * self.settings.filters), np.float32)
        for k, (w, f, b) in enumerate(zip(self.settings.widths, self.filters, self.biases)):
            at = slice(k * self.settings.filters, (k + 1) * self.settings.filters)
            if len(e) < w:
                continue
            r = e[: len(e) - w + 1] @ f[0]
            for j in range(1, w):
                r += e[j : len(e) - w + 1 + j] @ f[j]
            rows = np.flatnonzero(n >= w)
            if not len(rows):
                continue
            # windows that reach into the next text do not count
            for back in range(1, w):
                ends = per_doc[1:] - back
                r[ends[(ends >= 0) & (ends < len(r))]] = -np.inf
            pooled[rows, at] = np.maximum(np.maximum.reduceat(r, per_doc[rows], axis=0) + b, 0)
        return pooled, e

    def margins(self, ids: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        return self.responses(ids, per_doc)[0] @ self.weights + self.bias

    def scores(self, ids: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(per_doc) - 1, self.constant)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margins(ids, per_doc).astype(np.float64) + b, -30, 30)))


def _join(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    per_doc = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([d.shape[1] for d in docs], out=per_doc[1:])
    return np.concatenate(docs, axis=1) if docs else np.zeros((1 + len(PREFIXES), 0), np.int32), per_doc


def train(docs: list[np.ndarray], toxic: np.ndarray, langs: list, s: Settings = Settings()) -> Model:
    """Fit on documents given as embedding rows. With no row or one class only the score is that constant (0 with none)."""
    rng = np.random.default_rng(s.seed)
    table = start(s, rng)
    filters = [rng.normal(0, 1 / np.sqrt(w * s.dims), (w, s.dims, s.filters)).astype(np.float32) for w in s.widths]
    model = Model(s, filters, [np.zeros(s.filters, np.float32) for _ in s.widths], rng.normal(0, 0.3, len(s.widths) * s.filters).astype(np.float32), 0.0)
    model.table = table
    toxic = np.asarray(toxic, np.float64)
    model.thresholds = {}
    if not len(docs) or toxic.min() == toxic.max():
        model.constant = float(toxic.mean()) if len(docs) else 0.0
        return model
    held = np.arange(len(docs)) % s.calibration == 0 if len(docs) >= 50 else np.zeros(len(docs), bool)
    fit = np.flatnonzero(~held)
    weight = np.where(toxic == 1, 0.5 / max(toxic[fit].mean(), 1e-3), 0.5 / max(1 - toxic[fit].mean(), 1e-3))
    slow = [np.zeros_like(x) for x in (*filters, *model.biases, model.weights)]
    seen = np.zeros(len(table), np.float32)
    bias_seen = 0.0
    for _ in range(s.epochs):
        loss = 0.0
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // s.batch)):
            ids, per_doc = _join([docs[i] for i in part])
            pooled, e = model.responses(ids, per_doc)
            z = pooled @ model.weights + model.bias
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[part]) * weight[part] / len(part)).astype(np.float32)
            loss += float((weight[part] * np.logaddexp(0, np.where(toxic[part] == 1, -z, z))).sum())
            grads_f, grads_b = [np.zeros_like(f) for f in model.filters], [np.zeros_like(b) for b in model.biases]
            rows, changes = [], []
            for k, (w, f) in enumerate(zip(s.widths, model.filters)):
                on = pooled[:, k * s.filters : (k + 1) * s.filters] > 0
                back = g[:, None] * model.weights[None, k * s.filters : (k + 1) * s.filters] * on
                for d in np.flatnonzero(on.any(1)):
                    lo, hi = per_doc[d], per_doc[d + 1]
                    r = e[lo : hi - w + 1] @ f[0]
                    for j in range(1, w):
                        r = r + e[lo + j : hi - w + 1 + j] @ f[j]
                    best = r.argmax(0) + lo
                    for j in range(w):
                        grads_f[k][j] += e[best + j].T * back[d]
                        rows.append(best + j)
                        changes.append((f[j] * back[d]).T)
                grads_b[k] += back.sum(0)
            grads = [*grads_f, *grads_b, pooled.T @ g]
            for x, v, dx in zip((*model.filters, *model.biases, model.weights), slow, grads):
                dx = dx + s.decay * x
                v += dx * dx
                x -= s.rate * dx / (np.sqrt(v) + 1e-6)
            gb = float(g.sum())
            bias_seen += gb * gb
            model.bias -= s.rate * gb / (np.sqrt(bias_seen) + 1e-6)
            if rows:
                at, dx = np.concatenate(rows), np.concatenate(changes)
                for t in ids:
                    hit, inverse = np.unique(t[at], return_inverse=True)
                    total = np.zeros((len(hit), s.dims), np.float32)
                    np.add.at(total, inverse, dx)
                    seen[hit] += (total * total).mean(1)
                    model.table[hit] -= s.rate * 2 * total / (np.sqrt(seen[hit])[:, None] + 1e-6)
        if loss / len(fit) < s.enough:
            break
    _calibrate(model, docs, toxic, langs, np.flatnonzero(held) if held.any() else fit)
    return model


def _calibrate(model: Model, docs, toxic, langs, rows) -> None:
    """Scale by logistic regression on the margin; each language's threshold halves the summed error rates of its rows."""
    z = np.concatenate([model.margins(*_join([docs[i] for i in part])) for part in np.array_split(rows, max(1, len(rows) // 200))]).astype(np.float64)
    y = toxic[rows]
    w = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) if 0 < y.mean() < 1 else np.ones(len(y))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d = w * (p - y)
        h = w * p * (1 - p)
        grad = np.array([(d * z).sum() + 1e-2 * (a - 1), d.sum() + 1e-2 * b])
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.scale = (max(float(a), 1e-3), float(b))
    score = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + b, -30, 30)))
    for lang in sorted({langs[i] for i in rows if langs[i] is not None}):
        mine = np.array([langs[i] == lang for i in rows])
        s, t = score[mine], y[mine] == 1
        if t.sum() < 3 or (~t).sum() < 3:
            continue
        cuts = np.unique(np.concatenate([s, [0.5]]))
        error = [(s[t] < c).mean() + (s[~t] >= c).mean() for c in cuts]
        best = np.flatnonzero(error <= min(error) + 1e-12)
        # of equally good cuts the one nearest to 0.5, between the neighbouring scores
        c = float(cuts[best[np.abs(cuts[best] - 0.5).argmin()]])
        model.thresholds[lang] = min(max(c, 0.2), 0.8)


def sample(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The labelled sample as embedding rows (id, toxic, lang, ids): `per_class` rows of each class at most, those with the smallest hash.

    Labels other than 0 and 1, and null ids, do not count; of several labels of a document the largest does.
    """
    per = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for value, most in enumerate(s.per_class):
        part = per.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.select(F.col("doc_id").alias("_id"), "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = Words(b.column(b.schema.get_field_index("text")), LETTERS, PREFIXES)
            ids = buckets(w, s)
            rows = [np.ascontiguousarray(ids[:, i:j]).tobytes() for i, j in zip(w.per_doc, w.per_doc[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rows, pa.binary())], ["id", "toxic", "lang", "ids"])

    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select(F.col("_id").cast("long"), F.col("toxic").cast("int"), "lang", "text")
    return rows.mapInArrow(run, "id long, toxic int, lang string, ids binary")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, score, threshold and rejected of every document; null and empty texts have the score of no words.

    `threshold` is the language's, 0.5 for languages that had too few labels; `rejected`: score >= threshold. Repeated
    rows are scored each for itself, an empty table gives an empty result and other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in pieces(batches, "text"):
            w = Words(b.column(2), LETTERS, PREFIXES)
            s = m.scores(buckets(w, m.settings), w.per_doc)
            t = np.array([m.thresholds.get(x, 0.5) for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array(t), pa.array(s >= t)], ["doc_id", "lang", "score", "threshold", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, "doc_id long, lang string, score double, threshold double, rejected boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, whose text is not rejected; decided where the row is read, so nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in pieces(batches, "text"):
            w = Words(b.column(text), LETTERS, PREFIXES)
            limits = np.array([m.thresholds.get(x, 0.5) for x in b.column(lang).to_pylist()])
            yield b.filter(pa.array(m.scores(buckets(w, m.settings), w.per_doc) < limits))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Trains in one task, as the settings bound the sample; the driver gets only what training changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        rows = pa.Table.from_batches(got).sort_by([(c, "ascending") for c in ("id", "lang", "ids")]).to_pydict() if got else {c: [] for c in ("ids", "toxic", "lang")}
        ids = [np.frombuffer(x, np.int32).reshape(1 + len(PREFIXES), -1) for x in rows["ids"]]
        model = train(ids, np.array(rows["toxic"], np.int64), rows["lang"], s)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = sample(docs, labels, s).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0][0]) if got else train([], np.zeros(0, np.int64), [], s)
