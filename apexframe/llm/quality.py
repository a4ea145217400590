"""Quality classifier by co-training of two views of a document.

The text view sees content: frequencies of neighbouring character pairs and how words
repeat. The page view sees metadata and layout: source, language, lengths, lines, shares
of character kinds, how far the text compresses. Both are logistic regressions. They start
from a bounded sample of the labelled rows; in each round Spark scores *all* documents outside
that sample with both views, and of each class the distinct texts that a view is most sure of
become training rows of the *other* view. Each view is then
calibrated (Platt) on labelled rows held out from training, and a last
logistic regression on the two calibrated log-odds gives the probability of good quality.

Training rows are featurised where they are and stored in the shared folder; one task fits the
bounded table of them, and the driver sees nothing but the weights.

Toxicity is a label of its own, which pairs of characters hardly show. A second pair of co-trained
views learns it: which words of a lexicon the text has, and the same page view. The lexicon holds the
words whose shares among toxic and other training rows differ beyond chance. A document is as good as
the worse of its quality and its freedom from toxicity.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.llm.common import spread, stored, text_key, uniform

#: About so many labelled rows fit the models, and a view hands over so many pseudo-labelled texts in a round at most.
LABELLED_ROWS = 2400
PSEUDO_ROWS = 200
HELD_OUT = 0.3
ROUNDS = 2
#: A view hands over only what it is that sure of by its calibrated odds, and would be had the classes been of equal size.
SURE = 0.95
#: Words of the toxicity view at most, and the deviations from chance that a word needs.
LEXICON = 256
DEVIATIONS = 4.5

_WORD = re.compile(r"[^\W\d_]+")

_LETTERS, _DIGIT, _SPACE, _NEWLINE, _WIDE, _CONTROL = 0, 26, 27, 28, 29, 30


def _byte_classes() -> np.ndarray:
    """64 classes: letters without case, digit, space, line break, beyond ASCII, control, and each punctuation mark."""
    table, mark = np.zeros(256, np.uint16), 31
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = _WIDE
        elif c.isalpha():
            table[b] = ord(c.lower()) - 97
        elif c.isdigit():
            table[b] = _DIGIT
        elif c in " \t":
            table[b] = _SPACE
        elif c in "\r\n":
            table[b] = _NEWLINE
        elif b < 32 or b == 127:
            table[b] = _CONTROL
        else:
            table[b] = mark
            mark += 1
    return table


CLASSES = _byte_classes()
TEXT_WIDTH = 64 * 64 + 3
SOURCE_SLOTS, LANG_SLOTS = 16, 8
PAGE_WIDTH = SOURCE_SLOTS + LANG_SLOTS + 13


def views(text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors of the text view and of the page view; nulls count as empty or as a value of their own."""
    data = (text or "").encode("utf-8", "surrogatepass")
    content, page = np.zeros(TEXT_WIDTH, np.float32), np.zeros(PAGE_WIDTH, np.float32)
    codes = CLASSES[np.frombuffer(data, np.uint8)]
    words = data.split()
    if len(codes) > 1:
        pairs = np.bincount(codes[:-1] * np.uint16(64) + codes[1:], minlength=4096)
        content[:4096] = np.sqrt(pairs / (len(codes) - 1))
    if len(words) > 1:
        content[4096] = sum(map(eq, words, words[1:])) / (len(words) - 1)
        distinct = len(set(words))
        content[4097] = distinct / len(words)
        content[4098] = np.log(distinct) / np.log(len(words))
    slot = lambda value, n: xxhash.xxh3_64_intdigest("" if value is None else str(value)) % n
    page[slot(source, SOURCE_SLOTS)] = 1
    page[SOURCE_SLOTS + slot(lang, LANG_SLOTS)] = 1
    kinds, n = np.bincount(codes, minlength=64), max(1, len(codes))
    lines = data.split(b"\n")
    packed = len(zlib.compress(data, 1))
    page[SOURCE_SLOTS + LANG_SLOTS :] = [
        np.log1p(len(data) if n_chars is None or n_chars != n_chars else max(0, n_chars)),
        np.log1p(len(lines)),
        np.log1p(len(data) / len(lines)),
        np.log1p(len(data) / max(1, len(words))),
        kinds[:26].sum() / n,
        kinds[_DIGIT] / n,
        kinds[_SPACE] / n,
        kinds[_WIDE] / n,
        kinds[31:].sum() / n,
        kinds.max() / n,
        len(set(lines)) / len(lines),
        packed / n,
        np.log1p(packed) - np.log1p(len(data)),
    ]
    return content, page


def words_of(text: str | None) -> set[str]:
    """Distinct words (runs of letters, without case) of a text."""
    return set(_WORD.findall((text or "").lower()))


def lexicon(words: list[str], y: np.ndarray, most: int = LEXICON) -> list[str]:
    """Words whose share of the rows of class 1 differs most from that of class 0; ``words`` has the distinct words of each row, joined by spaces."""
    counts = Counter(), Counter()
    for row, label in zip(words, y, strict=True):
        counts[int(label)].update(row.split())
    n, n1 = len(y), int(y.sum())
    found = []
    for word in counts[1].keys() | counts[0].keys():
        a, both = counts[1][word], counts[1][word] + counts[0][word]
        spread = both * n1 / n * (1 - n1 / n) * (1 - both / n)
        z = abs(a - both * n1 / n) / np.sqrt(spread) if both >= 4 and spread > 0 else 0
        if z >= DEVIATIONS:
            found.append((-z, word))
    return [w for _, w in sorted(found)[:most]]


def present(rows: list[set[str]], place: dict[str, int]) -> np.ndarray:
    """Which words of a lexicon each row has."""
    out = np.zeros((len(rows), len(place)), np.float32)
    for i, row in enumerate(rows):
        for w in place.keys() & row:
            out[i, place[w]] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Logistic:
    """Logistic regression on standardised columns, fitted by accelerated gradient steps; ``fit`` overwrites its rows."""

    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 250) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, np.inf).astype(np.float32)
        z = x  # overwritten, so that the driver holds one copy
        z -= mean
        z /= scale
        if z.shape[0] < z.shape[1]:
            # The weights stay in the span of the rows: the same steps on one number a row, over inner products.
            alpha, b = cls._descend(z @ z.T, y, l2, steps, own=True)
            w = z.T @ alpha
        else:
            w, b = cls._descend(z, y, l2, steps)
        weights = (w / scale).astype(np.float32)
        return cls(weights, float(b - mean @ weights))

    @staticmethod
    def _descend(z: np.ndarray, y: np.ndarray, l2: float, steps: int, own: bool = False) -> tuple[np.ndarray, float]:
        """Accelerated gradient steps; ``own``: z holds inner products of rows and the result is a number for each row."""
        n = len(z)
        back = (lambda miss: miss) if own else (lambda miss: z.T @ miss)
        # The bound on the curvature fixes the step: a quarter of the largest singular value squared.
        v = np.ones(z.shape[1], np.float32) / np.sqrt(max(1, z.shape[1]))
        top = 0.0
        for _ in range(15):
            u = z @ v if own else z.T @ (z @ v)
            top = float(np.linalg.norm(u))
            v = u / max(1e-12, top)
        step = 1 / (0.25 * (top / n + 1) * 1.1 + l2)
        w, b = np.zeros(z.shape[1], np.float32), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        w0, b0 = w, b
        for t in range(steps):
            k = t / (t + 3)
            wa, ba = w + k * (w - w0), b + k * (b - b0)
            miss = (_sigmoid(z @ wa + ba) - y).astype(np.float32)
            w0, b0 = w, b
            w, b = wa - step * (back(miss) / n + l2 * wa), ba - step * float(miss.mean())
        return w, b

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def _platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a logistic regression with few columns; the last weight is the bias."""
    z = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = _sigmoid(z @ w)
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-9:
            break
    return w


@dataclass
class QualityModel:
    """Two calibrated views and their combination; ``constant`` stands in where the labels hold one class or none."""

    constant: float | None = None
    text: Logistic | None = None
    page: Logistic | None = None
    calibration: tuple[np.ndarray, np.ndarray] | None = None
    combine: np.ndarray | None = None
    prior: float = 0.5
    toxic: QualityModel | None = None
    words: dict[str, int] | None = None

    def odds(self, content: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of the text view and of the page view."""
        a, b = (np.clip(m.odds(x) * c[0] + c[1], -12, 12) for m, x, c in ((self.text, content, self.calibration[0]), (self.page, page, self.calibration[1])))
        return a, b

    def score(self, content: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, page view, combined) probabilities of good quality."""
        if self.constant is not None:
            same = np.full(len(content), self.constant)
            return same, same, same
        a, b = self.odds(content, page)
        return _sigmoid(a), _sigmoid(b), _sigmoid(np.column_stack([a, b, np.ones(len(a))]) @ self.combine)

    def toxicity(self, texts: list[str | None], page: np.ndarray) -> np.ndarray:
        """Probability that a text is toxic; 0 without a toxic label to learn from."""
        if self.toxic is None:
            return np.zeros(len(texts))
        if self.toxic.constant is not None:
            return np.full(len(texts), self.toxic.constant)
        return self.toxic.score(present([words_of(t) for t in texts], self.words), page)[2]


def fit_views(content: np.ndarray, page: np.ndarray, y: np.ndarray, held: np.ndarray, told: tuple[np.ndarray, np.ndarray]) -> QualityModel:
    """Both views of one label, calibrated and combined.

    ``y`` holds labels (NaN: none), ``told`` the pseudo-labels that each view has from the other (NaN: none);
    rows in ``held`` only calibrate, unless one of the two parts would lack a class.
    """
    known = ~np.isnan(y)
    if len(np.unique(y[known])) < 2:
        return QualityModel(constant=float((y[known].sum() + 0.5) / (known.sum() + 1)))
    fit, calibrates = known & ~held, known & held
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[calibrates])) < 2:
        fit = calibrates = known
    models = []
    for x, guess in zip((content, page), told, strict=True):
        rows = fit | (~known & ~np.isnan(guess))
        models.append(Logistic.fit(x[rows], np.where(known, y, guess)[rows]))
    odds = [m.odds(x[calibrates]) for m, x in zip(models, (content, page), strict=True)]
    calibration = tuple(_platt(o, y[calibrates]) for o in odds)
    joint = np.column_stack([np.clip(o * c[0] + c[1], -12, 12) for o, c in zip(odds, calibration, strict=True)])
    return QualityModel(None, models[0], models[1], calibration, _platt(joint, y[calibrates], ridge=0.1), float(y[fit].mean()))


#: A training row: its label and toxicity (null: none), what the views were told, and its features.
_TOLD = ("text_told", "page_told", "toxic_text_told", "toxic_page_told")
TRAINING_SCHEMA = "key binary, y double, toxic double, " + ", ".join(f"{c} double" for c in _TOLD) + ", words string, content binary, page binary"


def _featurised(rows: DataFrame) -> DataFrame:
    """(key, y, toxic, told..., text, source, lang, n_chars) rows to training rows."""
    carried = ["key", "y", "toxic", *_TOLD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                found = [views(*x) for x in zip(texts, *(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
                out = [pa.array([" ".join(sorted(words_of(t))) for t in texts], pa.string()), pa.array([c.astype(np.float16).tobytes() for c, _ in found], pa.binary()), pa.array([p.tobytes() for _, p in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *out], names=[*carried, "words", "content", "page"])

    return rows.select(*carried, "text", "source", "lang", "n_chars").mapInArrow(run, TRAINING_SCHEMA)


def _fit_rows(rows: pd.DataFrame) -> QualityModel:
    """The model of a table of training rows (see TRAINING_SCHEMA), whose order doesn't matter."""
    rows = rows.sort_values(["key", "content"], kind="stable", ignore_index=True)
    if rows[["y", "toxic"]].isna().all(axis=None):
        return QualityModel(constant=0.5)
    content = np.empty((len(rows), TEXT_WIDTH), np.float32)
    for i, row in enumerate(rows.pop("content")):
        content[i] = np.frombuffer(row, np.float16)
    page = np.frombuffer(b"".join(rows["page"]), np.float32).reshape(len(rows), PAGE_WIDTH)
    held = np.array([xxhash.xxh3_64_intdigest(k, seed=9) / 2**64 < HELD_OUT for k in rows["key"]])
    told = [rows[c].to_numpy(float) for c in _TOLD]
    y, toxic = rows["y"].to_numpy(float), rows["toxic"].to_numpy(float)
    model = QualityModel(constant=0.5) if np.isnan(y).all() else fit_views(content, page, y, held, (told[0], told[1]))
    del content
    if (toxic == 1).any():
        fit = ~np.isnan(toxic) & ~held
        fit = fit if len(np.unique(toxic[fit])) == 2 else ~np.isnan(toxic)
        model.words = {w: i for i, w in enumerate(lexicon(rows["words"][fit].tolist(), toxic[fit]))}
        model.toxic = fit_views(present([set(w.split()) for w in rows["words"]], model.words), page, toxic, held, (told[2], told[3]))
    return model


def _fitted(training: DataFrame) -> QualityModel:
    """One task fits the bounded training table; its weights (some 30 KB) come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        model = _fit_rows(pd.concat(held, ignore_index=True)) if held else QualityModel(constant=0.5)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    row = training.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(row.model) if row is not None else QualityModel(constant=0.5)


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> list[Column]:
    plain = lambda c, kind: (F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kind)
    return [plain(id_col, "long").alias("id"), plain(text_col, "string").alias("text"), plain(source_col, "string").alias("source"), plain(lang_col, "string").alias("lang"), plain(chars_col, "long").alias("n_chars")]


def _surest(rows: DataFrame, model: QualityModel, used: DataFrame, most: int) -> DataFrame | None:
    """Training rows with pseudo-labels: of each label, view and class the distinct texts outside ``used`` that the view is most sure of.

    All of ``rows`` is scored. The classes share ``most`` as the labelled rows do. Copies of a text count once, with the metadata of one of them.
    """
    heads = [(name, m) for name, m in (("", model), ("toxic_", model.toxic)) if m is not None and m.constant is None]
    if not heads:
        return None
    names = [f"{name}{view}" for name, _ in heads for view in ("text", "page")]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                found = [views(*x) for x in zip(texts, *(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
                page, odds = np.stack([p for _, p in found]), []
                if model.constant is None:
                    odds += model.odds(np.stack([c for c, _ in found]), page)
                if model.toxic is not None and model.toxic.constant is None:
                    odds += model.toxic.odds(present([words_of(t) for t in texts], model.words), page)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("pick"), *(pa.array(o.astype(np.float32)) for o in odds)], names=["key", "pick", *names])

    schema = "key binary, pick long, " + ", ".join(f"{n} float" for n in names)
    # Copies of a text leave one row: the one with the smallest hash of its metadata.
    one = rows.mapInArrow(score, schema).groupBy("key").agg(F.min(F.struct("pick", *names)).alias("best")).select("key", "best.*")
    scored = stored(one.join(F.broadcast(used), "key", "left_anti"), "view-odds")  # `used` is a bounded training table
    logit, chosen = (lambda p: float(np.log(p / (1 - p)))), []
    for name, m in heads:
        for view, other in (("text", "page"), ("page", "text")):
            odds = F.col(f"{name}{view}")
            for label, way, part in ((1.0, odds, m.prior), (0.0, -odds, 1 - m.prior)):
                best = scored.where(way >= logit(SURE) + max(0.0, logit(part))).orderBy(F.desc(way), "key").limit(max(1, round(most * part)))
                told = [F.lit(label if c == f"{name}{other}_told" else None).cast("double").alias(c) for c in _TOLD]
                chosen.append(best.select("key", "pick", *told))
    every = chosen[0]
    for c in chosen[1:]:
        every = every.unionByName(c)
    # Two heads or views may choose one text; a bounded table, at most 4 x `most` rows.
    every = stored(every.groupBy("key", "pick").agg(*(F.max(c).alias(c) for c in _TOLD)), "pseudo-labels")
    found = rows.join(F.broadcast(every), ["key", "pick"]).groupBy("key", "pick", *_TOLD).agg(F.first(F.struct("text", "source", "lang", "n_chars")).alias("r"))
    return _featurised(found.select("key", F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("toxic"), *_TOLD, "r.*"))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", label_col: str = "quality", labelled_rows: int = LABELLED_ROWS, toxic_col: str = "toxic", rounds: int = ROUNDS, pseudo_rows: int = PSEUDO_ROWS) -> QualityModel:
    """Fit quality and, where ``labels`` has that column, toxicity by co-training.

    About ``labelled_rows`` labelled ids, chosen by a hash, give one row each (of rows that repeat an id the one with
    the smallest hash). In each of ``rounds`` rounds a view hands over at most ``pseudo_rows`` texts of each label.

    Edge cases: labels without an id or without any mark, and ids without a document, are left out; of
    labels that repeat an id the largest counts; without a label of one class the model is constant; an empty table too.
    """
    toxic = F.col(toxic_col) if toxic_col in labels.columns else F.lit(None)
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"), toxic.cast("double").alias("toxic"))
    marks = marks.where((F.col("y").isNotNull() | F.col("toxic").isNotNull()) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"), F.max("toxic").alias("toxic"))
    marks = stored(marks, "quality-labels")
    chosen = marks.where(uniform(F.col("id"), F.lit(3)) < labelled_rows / max(1, marks.count()))
    meta = F.xxhash64("id", "source", "lang", "n_chars")
    rows = spread(docs.select(*_columns(docs, id_col, text_col, source_col, lang_col, chars_col))).select("*", text_key(F.col("text")).alias("key"), meta.alias("pick"))
    picked = rows.join(F.broadcast(chosen), "id").groupBy("id", "y", "toxic").agg(F.min(F.struct("pick", "key")).alias("best"))  # `chosen` is bounded by labelled_rows
    picked = stored(picked.select("y", "toxic", "best.*"), "labelled-keys")
    # Labelled texts that are copies of each other stay rows of their own; the join brings each key its text once.
    texts = rows.join(F.broadcast(picked.select("key", "pick").distinct()), ["key", "pick"]).groupBy("key", "pick").agg(F.first(F.struct("text", "source", "lang", "n_chars")).alias("r"))
    none = [F.lit(None).cast("double").alias(c) for c in _TOLD]
    labelled = texts.join(F.broadcast(picked), ["key", "pick"]).select("key", "y", "toxic", *none, "r.*")
    training = stored(_featurised(labelled), "training-0")
    model = _fitted(training)
    for turn in range(rounds):
        more = _surest(rows, model, training.select("key").distinct(), pseudo_rows)
        if more is None:
            break
        training = stored(training.unionByName(more), f"training-{turn + 1}")
        model = _fitted(training)
    return model


def _scored(batch: pa.RecordBatch, names: list[str], model: QualityModel, size: int = 256) -> Iterator[tuple[int, int, tuple]]:
    """Scores of slices of a batch, so that dense features never cover a whole batch."""
    columns = [batch.column(batch.schema.names.index(n)) if n in batch.schema.names else None for n in names]
    for at in range(0, batch.num_rows, size):
        n = min(size, batch.num_rows - at)
        lists = [[None] * n if c is None else c.slice(at, n).to_pylist() for c in columns]
        found = [views(*x) for x in zip(*lists, strict=True)]
        page = np.stack([p for _, p in found])
        a, b, good = model.score(np.stack([c for c, _ in found]), page)
        toxic = model.toxicity(lists[0], page)
        yield at, n, (a, b, toxic, np.minimum(good, 1 - toxic))


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """Scores of all documents: id, text_score, page_score (quality), toxic_score, score, rejected (score < threshold).

    The score is the lesser of the probability of good quality and that of not being toxic.

    Edge cases: null or empty texts are scored by what they have (no characters); null
    metadata is a value of its own; with no labels every score is 0.5 and nothing is
    rejected; with labels of one class the score is that class's smoothed share; without toxic labels toxic_score is 0. Repeated rows score alike; an
    empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, (a, b, t, c) in _scored(batch, ["text", "source", "lang", "n_chars"], shared.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(np.asarray(x, np.float64)) for x in (a, b, t, c)), pa.array(c < threshold)], names=["id", "text_score", "page_score", "toxic_score", "score", "rejected"])

    rows = spread(docs.select(*_columns(docs, id_col, text_col, source_col, lang_col, chars_col)))
    found = rows.mapInArrow(run, "id long, text_score double, page_score double, toxic_score double, score double, rejected boolean")
    return found.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns as they are.

    Edge cases: as in :func:`score_documents`; with no labels every document stays, rows that repeat stay or go together, and
    columns of any name (dots included) pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, (_, _, _, c) in _scored(batch, [text_col, source_col, lang_col, chars_col], shared.value):
                yield batch.slice(at, n).filter(pa.array(c >= threshold))

    return spread(docs).mapInArrow(run, docs.schema)
