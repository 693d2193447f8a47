"""Language identification by string kernels.

The kernel of two texts is the blended spectrum presence kernel: the number of distinct character 1-, 2- and 3-grams that both
hold, over the root of the product of the texts' own numbers. Landmarks give a Nyström map, one-versus-rest kernel ridge
regression gives a weight for each landmark and language, and batches of texts are scored by two matrix products: presence
times landmarks, kernel values times weights. N-grams are hashed to 2^17 places; text is lower-cased and its digits, signs and
white space are folded into one mark.

The classifier is fitted on a bounded sample: at most PER_LANGUAGE labelled rows of each language, those with the smallest
hash of their key; LANDMARKS of them are landmarks. Whole texts are used for fitting and for scoring.

Edge cases: a text that is null or has no letter gets 'und' and score 0; without labelled rows every text does. Null labels
are not learned. Repeated rows are scored alike. Other columns are never read. A very long text is folded and counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, keyed, lean, table

PER_LANGUAGE, LANDMARKS, RIDGE, PLACES, ORDERS = 300, 256, 1e-2, 1 << 17, 3
#: Rows scored by one pair of matrix products.
ROWS = 128
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_FOLD = np.arange(1 << 16, dtype=np.uint32)
_FOLD[[c for c in range(1 << 16) if not chr(c).isalpha()]] = 32


def grams(text: str) -> np.ndarray:
    """The distinct places of a text's n-grams, 1 to ORDERS."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    far = c > 0xFFFF
    if far.any():
        high = c[far]
        letters = [x for x in np.unique(high).tolist() if chr(x).isalpha()]
        c = _FOLD[np.where(far, 0, c)]
        c[far] = np.where(np.isin(high, letters), high, 32)
    else:
        c = _FOLD[c]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    seen, h = np.zeros(PLACES, bool), np.zeros(len(c), np.uint32)
    for n in range(ORDERS):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] + c[n:]) * _MIX[n]
        h ^= h >> np.uint32(15)
        seen[h & np.uint32(PLACES - 1)] = True
    return np.flatnonzero(seen)


class Model:
    """Landmarks and the weight of each for each language."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        sets = [grams(t) for t in texts]
        order = np.argsort([(i * 0x9E3779B1) % (1 << 32) for i in range(len(sets))])
        marks = order[:LANDMARKS]
        vocabulary = np.unique(np.concatenate([sets[i] for i in marks]))
        self.place = np.full(PLACES, -1, np.int32)
        self.place[vocabulary] = np.arange(len(vocabulary))
        self.marks = np.zeros((len(vocabulary), len(marks)), np.float32)
        for k, i in enumerate(marks):
            self.marks[self.place[sets[i]], k] = 1
        self.marks /= np.sqrt(np.maximum(self.marks.sum(0), 1))
        kernel = self.kernel(sets)
        values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
        good = values > 1e-6 * values.max()
        nystrom = vectors[:, good] / np.sqrt(values[good])
        features = kernel @ nystrom
        target = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        weight = 1 / target.shape[0] / np.maximum((target > 0).mean(0), 1e-9)[np.array([self.langs.index(x) for x in langs])]
        weight *= len(weight) / weight.sum() / target.shape[0]
        inner = (features * weight[:, None]).T @ features + RIDGE / target.shape[0] * np.eye(features.shape[1])
        self.weights = (nystrom @ np.linalg.solve(inner, (features * weight[:, None]).T @ target)).astype(np.float32)

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), self.marks.shape[0]), np.float32)
        for r, s in enumerate(sets):
            p = self.place[s]
            x[r, p[p >= 0]] = 1 / np.sqrt(max(len(s), 1))
        return x @ self.marks

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The language and score of each text: the largest one-versus-rest value, moved from [-1, 1] to [0, 1]."""
        value = self.kernel([grams(t) for t in texts]) @ self.weights
        best = value.argmax(1)
        return np.array(self.langs, object)[best], np.clip((value[np.arange(len(best)), best] + 1) / 2, 0, 1)


def fit(rows: DataFrame, key: str = "doc_id") -> Model:
    """A model of the rows' text and lang (non-null): at most PER_LANGUAGE rows a language, by the hash of their key."""
    named = rows.where("lang is not null and text is not null").select(key, "lang")
    langs = [r.lang for r in named.select("lang").distinct().orderBy("lang").collect()]
    picked = []
    for lang in langs:
        picked += [r[key] for r in named.where(F.col("lang") == lang).orderBy(F.xxhash64(key), key).limit(PER_LANGUAGE).collect()]
    if not picked:
        return Model([], [])
    spark = rows.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(int(p),) for p in sorted(set(picked))], f"{key} long"))
    found = rows.select(key, "text", "lang").where("lang is not null and text is not null").join(chosen, key, "left_semi").orderBy(F.xxhash64(key), key).limit(len(picked)).collect()
    return Model([r.text for r in found], [r.lang for r in found])


def _scorer(shared):
    def run(batches):
        model: Model = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                text = part.column(part.num_columns - 1)
                ok = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                lang, score = np.full(len(ok), "und", object), np.zeros(len(ok))
                if model.langs and ok.any():
                    lang[ok], score[ok] = model.predict(text.filter(pa.array(ok)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keyed(docs, "doc_id", "text").mapInArrow(lean(_scorer(shared)), "doc_id long, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text has a letter and whose predicted language scores least or more; a null lang
    takes the predicted one."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    named = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                pair = pa.RecordBatch.from_arrays([part.column(place)], ["text"])
                for s in _scorer(shared)([pair]):
                    if named is not None:
                        columns = part.columns
                        columns[named] = pc.coalesce(columns[named], s.column("lang_pred"))
                        part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                    keep = pc.and_(pc.not_equal(s.column("lang_pred"), "und"), pc.greater_equal(s.column("score"), least))
                    yield part.filter(keep)

    return bounded(docs).mapInArrow(lean(run), docs.schema)


def held_out(key):
    """Whether a row is kept from learning: crc32 of the key as text, mod 5, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the predicted language and its score; learned from the documents that are not held out."""
    docs = keyed(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id")))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op8_language_id": op8_language_id}
