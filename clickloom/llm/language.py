"""Language identification with string kernels: blended-spectrum n-gram presence, Nyström landmarks, ridge regression.

The kernel of two texts is the mean, over n = 1, 2, 3, of |G_n(x) & G_n(y)| / sqrt(|G_n(x)| |G_n(y)|), where G_n holds
the distinct letter n-grams of the whole text (lower case; runs of other characters count as one blank). Letters above
U+03FF share codes and trigrams are hashed to 2**20 cells. Landmarks are labelled texts; kernel values to all landmarks,
times the inverse root of their own kernel matrix, are a text's features, and one ridge regression per language gives
its value. Texts are scored in batches by matrix products: presence matrix x landmark matrix x weights.

The fit uses at most about ``FIT_PER_LANGUAGE`` labelled texts of each language (a hash decides which); prediction is
the same function for every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import query, table, tidy

FIT_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 150, 16
ORDERS, CELLS = (1, 2, 3), 1 << 20
RIDGE = 1e-2
UNKNOWN = "und"

_TABLE: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """Code of each code point: 0 if it is no letter, else 1 to 1023 by its lower-case form."""
    if not _TABLE:
        out = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = ord(x.lower()[0])
                out[c] = low if 0 < low < 0x400 else 1 + low * 0x9E3779B1 % 1023
        _TABLE.append(out)
    return _TABLE[0]


class Grams:
    """The distinct n-gram cells of a text, for each order."""

    def __init__(self):
        self.codes, self.seen = letter_codes(), np.zeros(CELLS, np.int32)

    def __call__(self, text: str) -> list[np.ndarray] | None:
        """None if the text has no letter."""
        c = self.codes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        if not c.any():
            return None
        blank = np.zeros(len(c) + 1, bool)
        blank[1:] = c == 0
        c = c[~(blank[1:] & np.concatenate([[True], blank[1:-1]]))]  # one blank for a run, none at the start
        c = np.append(c, 0) if c[-1] else c
        out = []
        for n in ORDERS:
            h = c
            for k in range(1, n):
                h = h[:-1] * 1024 + c[k:] if n < 3 else h[:-1].astype(np.int64) * 1024 + c[k:]
            if n > 2:
                h = (h * 0x9E3779B1 >> 7) & (CELLS - 1)
            at = np.arange(len(h), dtype=np.int32)
            self.seen[h] = at  # the last place of a cell wins, so each cell is counted once
            out.append(h[self.seen[h] == at])
        return out


class Model:
    """Landmark vocabulary and weights; picklable and bounded by the landmarks."""

    def __init__(self, languages: list[str], landmarks: list[list[np.ndarray]]):
        self.languages = languages
        self.vocabulary = [np.unique(np.concatenate([g[i] for g in landmarks])) for i in range(len(ORDERS))]
        self.first = np.cumsum([0, *map(len, self.vocabulary)])
        self.columns: list[np.ndarray] | None = None
        self.landmark = self._presence(landmarks).T / len(ORDERS)
        self.weights = np.zeros((len(landmarks), len(languages)), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"columns": None}

    def _presence(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        if self.columns is None:
            self.columns = []
            for v, first in zip(self.vocabulary, self.first, strict=False):
                place = np.full(CELLS, -1, np.int32)
                place[v] = np.arange(len(v)) + first
                self.columns.append(place)
        out = np.zeros((len(texts), self.first[-1]), np.float32)
        for row, grams in zip(out, texts, strict=True):
            for g, place in zip(grams, self.columns, strict=True):
                at = place[g]
                row[at[at >= 0]] = max(1, len(g)) ** -0.5
        return out

    def kernel(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        return self._presence(texts) @ self.landmark

    def fit(self, texts: list[list[np.ndarray]], labels: np.ndarray, landmarks: list[list[np.ndarray]]) -> None:
        """Ridge regression on Nyström features, +1 for the own language and -1 for the others, each language weighing
        the same; the inverse root and the regression weights become one matrix."""
        value, vector = np.linalg.eigh(self.kernel(landmarks).astype(float))
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] * value[keep] ** -0.5
        x = self.kernel(texts).astype(float) @ root
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.where(labels[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        share = 1.0 / np.bincount(labels, minlength=len(self.languages))[labels]
        xw = x * share[:, None]
        w = np.linalg.solve(xw.T @ x + RIDGE * np.eye(x.shape[1]), xw.T @ y)
        self.weights = (root @ w[:-1]).astype(np.float32)
        self.bias = w[-1].astype(np.float32)

    def values(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        return self.kernel(texts) @ self.weights + self.bias


def fit_language_model(labelled: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> Model | None:
    """A model of ``labelled(text, lang, spread)``; ``spread`` is a number in [0, 1) that picks the bounded sample.

    Rows without text, letters or language are left out. None if nothing can be learned. The driver sees one row per
    language and the sample.
    """
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(per_language / n))])
    rows = labelled.where(F.col("spread") < share[F.col("lang")]).select("lang", "text", "spread").collect()
    rows = sorted(rows, key=lambda r: (r["spread"], r["lang"], r["text"]))
    grams = Grams()
    known = [(r["lang"], g) for r in rows if (g := grams(r["text"])) is not None]
    languages = sorted({lang for lang, _ in known})
    if not languages:
        return None
    landmarks = [g for lang in languages for g in [g for x, g in known if x == lang][:LANDMARKS_PER_LANGUAGE]]
    model = Model(languages, landmarks)
    model.fit([g for _, g in known], np.array([languages.index(x) for x, _ in known]), landmarks)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score. ``und`` and 0 for a null text, one without letters, or without a model."""
    names = docs.columns

    def run(batches):
        grams = Grams()
        for batch in batches:
            lang, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            known, rows = [], []

            def flush():
                if known:
                    value = model.values(known)
                    best = value.argmax(axis=1)
                    for i, b, v in zip(rows, best, value.max(axis=1), strict=True):
                        lang[i], score[i] = model.languages[b], min(1.0, max(0.0, (float(v) + 1) / 2))
                known.clear()
                rows.clear()

            for i, text in enumerate(batch.column("text") if model is not None else ()):
                g = grams(text.as_py() or "")
                if g is not None:
                    known.append(g)
                    rows.append(i)
                    if len(known) == 256:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"]
            )

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double")


def _held_out():
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    return F.coalesce(rest == 0, F.lit(False))


def fit_on(docs: DataFrame) -> Model | None:
    """Learns from rows with a language whose crc32 of the doc_id is not divisible by five; never from a null doc_id."""
    spread = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    known = docs.where(F.col("doc_id").isNotNull() & ~_held_out())
    return fit_language_model(known.select(F.col("text").cast("string").alias("text"), "lang", spread.alias("spread")))


def identify(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` with held_out, lang_pred and score (columns of these names are replaced).

    A null doc_id is not held out. Only the text enters a prediction. Repeated rows get the same answer; an empty table
    has none.
    """
    plain = docs.drop("held_out", "lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    return predict(plain.withColumn("held_out", _held_out()), fit_on(docs))


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit_on(docs))
    return out.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
