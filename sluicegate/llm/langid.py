"""Language identification with a blended-spectrum string kernel.

The kernel counts the n-grams, for all orders 1 to ``max_n``, that occur in
both texts (presence, not frequency), divided by the geometric mean of the two
texts' own counts of different n-grams, known to landmarks or not.  A text's
own count is a linear count over hashed n-grams (its error is below 0.2 %).
Nystroem landmarks are labelled texts; a one-versus-rest
kernel ridge regression is solved on their feature space.  A text is scored
through matrix products of its batch's presence matrix over the landmarks'
n-grams with the landmarks' own presence matrix and the regression's weights.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices

UNKNOWN = "und"
#: The presence matrix of a batch has no more cells than this.
_CELLS = 1 << 24
_COUNT_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    """Lower-case code points; whatever isn't a letter is a space, runs of which collapse."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    return x[_keep(x)] if len(x) else x


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        if chr(i).isalpha():
            table[i] = True
    return table


_LETTER: np.ndarray | None = None


def _is_letter(x: np.ndarray) -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    return _LETTER[np.minimum(x, 0x10FFFF)]


def _keep(x: np.ndarray) -> np.ndarray:
    letter = _is_letter(x)
    keep = letter.copy()
    keep[1:] |= ~letter[1:] & letter[:-1]
    return keep


def grams(texts: list[str], max_n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text number, hash) of all n-grams of a batch, repeats included, for each order; in the order of the texts.

    Texts are joined with separators that no n-gram may span.
    """
    parts, owner = [], []
    for i, t in enumerate(texts):
        c = codes(t).astype(np.uint64)
        c = np.where(_is_letter(c.astype(np.int64)), c, np.uint64(32))
        parts.append(np.concatenate([[np.uint64(32)], c, [np.uint64(32)]]))
        owner.append(np.full(len(parts[-1]), i, dtype=np.int32))
    x, own = np.concatenate(parts), np.concatenate(owner)
    out = []
    h = np.zeros(len(x), dtype=np.uint64)
    for n in range(1, max_n + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = (h[:m] * _MIX) ^ (x[n - 1 :] + np.uint64(n))
        h ^= h >> np.uint64(29)
        same = own[:m] == own[n - 1 :]
        out.append((own[:m][same], h[same]))
    return out


def cells(h: np.ndarray) -> np.ndarray:
    """The place of each hash in tables of ``_COUNT_BITS`` bits."""
    return (h * _MIX >> np.uint64(64 - _COUNT_BITS)).astype(np.int32)


def distinct(found: list[tuple[np.ndarray, np.ndarray]], texts: int) -> np.ndarray:
    """How many different n-grams each text has, by linear counting; ``found`` has the text numbers and cells of each order."""
    size = 1 << _COUNT_BITS
    seen, out = np.zeros(size, dtype=bool), np.zeros(texts)
    ends = [np.searchsorted(own, np.arange(texts + 1)).tolist() for own, _ in found]
    for i in range(texts):
        mine = [c[e[i] : e[i + 1]] for (_, c), e in zip(found, ends)]
        for part in mine:
            seen[part] = True
        ones = np.count_nonzero(seen)
        out[i] = -size * np.log1p(-min(ones, size - 1) / size)
        for part in mine:
            seen[part] = False
    return out


class Model:
    """What is broadcast: the landmarks' n-grams and the weights of each language."""

    def __init__(self, labels: list[str], max_n: int, vocabulary: np.ndarray, weights: np.ndarray, intercept: np.ndarray, sharpness: float):
        self.labels, self.max_n, self.vocabulary, self.weights, self.intercept, self.sharpness = labels, max_n, vocabulary, weights, intercept, sharpness
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def lookup(self, h: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Places in the vocabulary, -1 for hashes that aren't there."""
        if self._table is None:
            own = cells(self.vocabulary)
            first = np.full(1 << _COUNT_BITS, -1, dtype=np.int32)
            first[own] = np.arange(len(own), dtype=np.int32)
            shared = np.zeros(1 << _COUNT_BITS, dtype=bool)
            shared[own[first[own] != np.arange(len(own))]] = True
            self._table = first, shared
        first, shared = self._table
        place = first[cell]
        other = (place < 0) | (self.vocabulary[place] != h)
        place[other] = -1
        again = np.flatnonzero(other)
        again = again[shared[cell[again]]]  # another n-gram of the vocabulary has that cell
        if len(again):
            at = np.searchsorted(self.vocabulary, h[again])
            at[at == len(self.vocabulary)] = 0
            hit = self.vocabulary[at] == h[again]
            place[again[hit]] = at[hit]
        return place

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams of the vocabulary each text has, and the root of the number of all of its own."""
        out = np.zeros((len(texts), len(self.vocabulary)), dtype=np.float32)
        found = []
        for own, h in grams(texts, self.max_n):
            cell = cells(h)
            found.append((own, cell))
            if len(self.vocabulary):
                place = self.lookup(h, cell)
                hit = np.flatnonzero(place >= 0)
                out[own[hit], place[hit]] = 1
        return out, np.sqrt(np.maximum(distinct(found, len(texts)), 1))[:, None].astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        p, norm = self.presence(texts)
        return (p @ self.weights) / norm + self.intercept

    def decide(self, texts: list[str | None], batch_chars: int = 400_000) -> list[tuple[str, float, float]]:
        """(language, its share after a softmax, the evidence for it) of each text.

        The evidence is the score in the regression on a scale from 0, which a
        text without an n-gram of any landmark has, to 1, the target of texts
        of the language.
        """
        out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, float("-inf"))] * len(texts)
        if not self.labels:
            return out
        todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        most = max(1, min(256, _CELLS // max(1, len(self.vocabulary))))
        at = 0
        while at < len(todo):
            end, chars = at, 0
            while end < len(todo) and (end == at or (chars < batch_chars and end - at < most)):
                chars += len(texts[todo[end]])
                end += 1
            raw = self.scores([texts[i] for i in todo[at:end]])
            evidence = (raw - self.intercept) / np.maximum(1 - self.intercept, 1e-6) if len(self.labels) > 1 else np.ones_like(raw)
            e = np.exp((raw - raw.max(axis=1, keepdims=True)) * self.sharpness)
            e /= e.sum(axis=1, keepdims=True)
            for i, k, row, score in zip(todo[at:end], e.argmax(axis=1), e, evidence):
                out[i] = (self.labels[k], float(row[k]), float(score[k]))
            at = end
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [d[:2] for d in self.decide(texts)]


def train(rows: list[tuple[str, str]], landmarks: int = 160, max_n: int = 4, ridge: float = 1e-2, sharpness: float = 12.0) -> Model:
    """Fit on (text, language) rows; landmarks are taken evenly from each language."""
    rows = sorted((t, y) for t, y in rows if t and any(map(str.isalpha, t)))
    labels = sorted({y for _, y in rows})
    if not labels:
        return Model([], max_n, np.empty(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), sharpness)
    per = max(2, landmarks // len(labels))
    marks = []
    for y in labels:
        own = [t for t, l in rows if l == y]
        marks += [own[i] for i in sorted({int(v) for v in np.linspace(0, len(own) - 1, min(per, len(own)))})]
    vocabulary = np.unique(np.concatenate([np.unique(h) for t in marks for _, h in grams([t], max_n)]))
    model = Model(labels, max_n, vocabulary, np.zeros((0, 0), np.float32), np.zeros(0, np.float32), sharpness)

    def unit_presence(texts):
        p, norm = model.presence(texts)
        return p / norm

    l_rows = unit_presence(marks)  # landmarks x vocabulary
    gram = (l_rows @ l_rows.T).astype(np.float64)
    val, vec = np.linalg.eigh(gram)
    good = val > 1e-6 * val.max()
    whiten = vec[:, good] / np.sqrt(val[good])  # Nystroem: phi(x) = K(x, landmarks) whiten
    phi = np.concatenate([unit_presence([t for t, _ in rows[i : i + 128]]) @ l_rows.T for i in range(0, len(rows), 128)]) @ whiten
    y = np.array([[1.0 if l == k else -1.0 for k in labels] for _, l in rows])
    weight = np.array([1.0 / sum(1 for _, m in rows if m == l) for _, l in rows])[:, None]
    weight *= len(rows) / weight.sum()
    mean_x, mean_y = (weight * phi).sum(0) / weight.sum(), (weight * y).sum(0) / weight.sum()
    cx = phi - mean_x
    beta = np.linalg.solve(cx.T @ (weight * cx) + ridge * len(rows) * np.eye(cx.shape[1]), cx.T @ (weight * (y - mean_y)))
    model.weights = (l_rows.T.astype(np.float64) @ (whiten @ beta)).astype(np.float32)
    model.intercept = (mean_y - mean_x @ beta).astype(np.float32)
    return model


def fit(docs: DataFrame, per_language: int = 300, max_rows: int = 6000, max_chars: int = 40_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=None, **options) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    The sample's bounds are ``per_language`` rows of each language in
    expectation, ``max_rows`` rows in all, of each text its first ``max_chars``
    characters; which rows it takes depends on a hash of id and text only.  Rows
    are taken in turn: no language gives its second before all gave their first.
    Of more than ``max_rows`` languages only the most frequent are learned.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    if held_out is not None:
        rows = rows.where(~F.coalesce(held_out(F.col("id")), F.lit(True)))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows)
    draw = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.withColumn("draw", draw).join(F.broadcast(counts), "lang").where(F.col("draw") < F.lit(float(per_language)) / F.col("n"))
    drawn = drawn.select("id", "draw", "lang", F.substring("text", 1, max_chars).alias("text"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    sample = drawn.withColumn("turn", turn).orderBy("turn", "draw", "id", "lang", "text").limit(max_rows).select("text", "lang").collect()
    return train([(r["text"], r["lang"]) for r in sample], **options)


def crc_held_out(col):
    """The held-out fold: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(col.cast("string").cast("binary")) % 4 == 2


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each whole text; ``und`` and 0 where it is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            got = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (0 to 1).

    Learns only from rows with text and language outside the held-out fold.
    Without any such row every prediction is ``und``.  A null id counts as
    held out.  Repeated rows are predicted each; ties go to the language that
    sorts first; further columns are ignored.
    """
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, held_out=crc_held_out, **options)
    return predict(docs, model, id_col, text_col).select(id_col, F.coalesce(crc_held_out(F.col(id_col)), F.lit(True)).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, model: Model, least: float, short: int = 24, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` for whose language there is ``least`` evidence or more; a null language is filled in.

    A text of few n-grams in common with any landmark comes near 0, whatever
    the number of languages.  Texts of fewer than ``short`` letters say too
    little to be rejected.  Null texts and those without a letter go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text, lang = names.index(text_col), names.index(lang_col)

    def run(batches):
        for b in slices(batches):
            got = shared.value.decide(b.column(text).to_pylist())
            cols = list(b.columns)
            cols[lang] = pa.array([g[0] if own is None else own for own, g in zip(b.column(lang).to_pylist(), got)], pa.string())
            out = pa.RecordBatch.from_arrays(cols, names=names)
            yield out.filter(pa.array([g[0] != UNKNOWN and (g[2] >= least or next(islice(filter(str.isalpha, t), short - 1, None), None) is None) for g, t in zip(got, b.column(text).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
