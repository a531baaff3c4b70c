"""Language identification by string kernels: blended-spectrum n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts sums, for n = 1 to 4, the cosine of their sets of character n-grams (presence, not counts), the
n-grams hashed into SLOTS slots each. Landmark texts span the Nystroem space; ridge regression there gives a column of
weights for each language. As the kernel is an inner product of presence vectors, landmarks times weights fold into one
SLOTS x languages matrix per n, and a batch of texts is scored by one matrix product per n.

Only the fit works on a sample: PER_LANG labelled texts of each language, those with the smallest hashes of their ids, FIT_ROWS in all but one of
each language at least; texts of over FIT_BYTES come last. Of these LANDMARKS in all are landmarks. Scoring reads every text whole.

Defined results: "und" with score 0 for a text that is null, empty or has no letter, and for every text if nothing was
learned. A training row with a null language or id, or without letters, takes no part. Ties go to the smaller language. Of rows that
repeat an id and language, the text with the smallest hash stands for all; every row is scored. Very long texts are scored whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read_table, small_batches

#: Texts of each language that the fit reads, and the most that it reads in all.
PER_LANG, FIT_ROWS = 300, 3000
#: Bytes up to which a text is preferred for the fit, which takes place on the driver.
FIT_BYTES = 50_000
#: Frequent languages of which only some rows are ranked, the sample being the same.
MOST_LANGS = 1000
#: Landmarks of the Nystroem approximation.
LANDMARKS = 256
ORDERS, SLOTS, RIDGE = (1, 2, 3, 4), 1 << 13, 1e-2
#: Steepness of the softmax that turns regression outputs into scores.
STEEP = 6.0

_letters: np.ndarray | None = None
_lowered: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its lower-case form if that is one code point."""
    global _letters, _lowered
    if _letters is None:
        n = 0x110000
        letters, lowered = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
        for c in range(n):
            x = chr(c)
            if x.isalpha():
                letters[c] = True
                low = x.lower()
                if len(low) == 1:
                    lowered[c] = ord(low)
        _letters, _lowered = letters, lowered
    return _letters, _lowered


def _points(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, with one blank for each run of other characters; empty if no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    letters, lowered = _tables()
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[x]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    x = np.where(is_letter, lowered[x], 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.concatenate(([32], x[keep], [32])).astype(np.uint32)


def _presence(points: list[np.ndarray], n: int) -> np.ndarray:
    """A row per text of 0 and 1 over hashed n-grams, scaled to length 1."""
    out = np.zeros((len(points), SLOTS), np.float32)
    for k, x in enumerate(points):
        if len(x) >= n:
            h = np.zeros(len(x) - n + 1, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x9E3779B1) + x[j : len(x) - n + 1 + j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            out[k, h >> np.uint32(32 - 13)] = 1
    norm = np.sqrt(out.sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1)


class KernelRidge:
    """langs and, for each n, the folded weights."""

    def __init__(self, langs: list[str], weights: list[np.ndarray]):
        self.langs, self.weights = langs, weights

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> KernelRidge:
        points = [_points(t) for t in texts]
        known = [k for k, p in enumerate(points) if len(p)]
        points, labels = [points[k] for k in known], [labels[k] for k in known]
        langs = sorted(set(labels))
        if not langs:
            return cls([], [])
        marks = np.unique(np.linspace(0, len(points) - 1, min(LANDMARKS, len(points))).astype(int))
        k_nm = np.zeros((len(points), len(marks)))
        for n in ORDERS:
            x = _presence(points, n)
            k_nm += x @ x[marks].T
        k_mm = k_nm[marks]
        value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
        good = value > 1e-8 * max(value[-1], 1e-12)
        root = vector[:, good] / np.sqrt(value[good])
        phi = k_nm @ root
        y = np.array([[1.0 if lang == x else 0.0 for x in langs] for lang in labels])
        # each language counts alike, however many texts it has
        w = 1 / y.sum(axis=0)[y.argmax(axis=1)]
        gram = phi.T @ (phi * w[:, None]) / len(langs)
        beta = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), phi.T @ (y * w[:, None]) / len(langs))
        alpha = root @ beta
        folded = []
        for n in ORDERS:
            folded.append((_presence([points[m] for m in marks], n).T @ alpha).astype(np.float32))
        return cls(langs, folded)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        points = [_points(t) for t in texts]
        known = [k for k, p in enumerate(points) if len(p)]
        out, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return out, score
        for at in range(0, len(known), 64):
            part = known[at : at + 64]
            s = sum(_presence([points[k] for k in part], n) @ w for n, w in zip(ORDERS, self.weights))
            e = np.exp(STEEP * (s - s.max(axis=1, keepdims=True)))
            e /= e.sum(axis=1, keepdims=True)
            for k, best, p in zip(part, s.argmax(axis=1), e.max(axis=1)):
                out[k], score[k] = self.langs[best], min(1.0, float(p))
        return out, score


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, fit_rows: int = FIT_ROWS) -> KernelRidge:
    """Fit on at most per_lang texts of each language, fit_rows in all; texts come by the hashes of their ids."""
    known = F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    rows = docs.where(known).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).bitwiseAND(2**52 - 1).alias("h"), (F.octet_length(text_col) > FIT_BYTES).alias("long"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.col("long")).alias("short"))
    n_langs = langs.count()
    if not n_langs:
        return KernelRidge([], [])
    # of a frequent language only the smallest hashes are ranked, three times as many as are wanted on average
    frequent = langs.where(F.col("short") > 3 * per_lang).orderBy(F.desc("short"), "lang").limit(MOST_LANGS).collect()
    if frequent:
        share = F.create_map(*(F.lit(x) for r in frequent for x in (r["lang"], 3 * per_lang / r["short"])))
        part = F.coalesce(share[F.col("lang")], F.lit(2.0))
        rows = rows.where((part > 1) | (~F.col("long") & (F.col("h") < part * float(2**52))))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "id"))
    picked = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= per_lang).orderBy("nth", "lang").limit(max(fit_rows, n_langs)).select("id", "lang").distinct().collect()
    pairs = {(r["id"], r["lang"]) for r in picked}
    chosen = docs.where(known & F.col(id_col).isin([r["id"] for r in picked]) & F.col(lang_col).isin(sorted({r["lang"] for r in picked})))
    texts = chosen.groupBy(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).agg(F.min_by(F.col(text_col), F.struct(F.octet_length(text_col) > FIT_BYTES, F.xxhash64(text_col))).alias("text")).collect()
    sample = sorted(((r["id"], r["lang"], r["text"]) for r in texts if (r["id"], r["lang"]) in pairs), key=lambda r: (hash_order(r[0]), r))
    return KernelRidge.fit([r[2] for r in sample], [r[1] for r in sample])


def hash_order(x) -> int:
    """A fixed shuffle of ids, so that landmarks don't follow the ids' order."""
    return zlib.crc32(str(x).encode())


def predict(docs: DataFrame, model: KernelRidge, *, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score; existing columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(lang_pred, score)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = docs.withColumn(lang_pred, F.lit("")).withColumn(score, F.lit(0.0)).schema

    def run(batches):
        known = shared.value
        for b in batches:
            langs, scores = known.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang_pred, score])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of documents that training never sees."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, predicted language, score; learned from the documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(True))))
    return predict(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model).drop("text")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those whose language can't be told ("und"); their own language labels teach the model, and decide nothing.

    If no language was learned, only texts that are null or without a letter go.
    """
    model = fit(docs.where(~F.coalesce(held_out(id_col), F.lit(True))), id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not model.langs:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    return predict(docs, model, text_col=text_col, lang_pred="__gl_lang", score="__gl_score").where(F.col("__gl_lang") != "und").drop("__gl_lang", "__gl_score")
