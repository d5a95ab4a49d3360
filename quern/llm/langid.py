"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 lower-cased code points of the whole text; term frequency is a gram's share of the
text's grams, inverse document frequency is counted over all learning documents. The model is trained with
follow-the-regularised-leader (FTRL-proximal) under an elastic-net penalty on a bounded sample of whole documents, then
calibrated by one temperature on a part of the sample that it wasn't trained on (smoothed targets).

The sample holds at most about ``per_language`` documents of each language, chosen by a 64-bit hash of id and text, and of
these at most the first ``sample_bytes`` of text in order of that hash, a language's share each; it comes to the driver.
Document frequencies and predictions cover all documents.

Defined results: a null text or one without a letter (a character of a Unicode category L) is ``und`` with score 0. Without any labelled document everything
is ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.words import U64, blocks, mix

#: Hashed features (2**15), longest n-gram, sampled documents of a language, passes over the sample.
BITS, LONGEST, PER_LANGUAGE, PASSES = 15, 3, 600, 3
#: Bytes of sampled text on the driver; a single longer document may exceed a language's share.
SAMPLE_BYTES = 256 << 20
#: FTRL learning rate and its offset, L1 and L2 weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: Term frequencies are shares; this brings them to the size of counts in a short text.
SCALE = 100.0


def grams(text: str, bits: int = BITS, longest: int = LONGEST) -> np.ndarray:
    """The feature of every n-gram of a text, blanks at both ends."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    out, h = [], np.zeros(len(x), U64)
    for n in range(1, longest + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = h[:m] * U64(0x100000001B3) + x[n - 1 :] + U64(n)
        out.append((mix(h) >> U64(64 - bits)).astype(np.int32))
    return np.concatenate(out)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(grams(text), return_counts=True)
    return at, n * idf[at] * (SCALE / n.sum())


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each feature, over all of docs (text), and their number: a vector from each task, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen = np.zeros(1 << BITS, bool)
                seen[grams(t)] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(1 << BITS), 0
    for r in rows:
        if r["feature"] < 0:
            total = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, total


class Ftrl:
    """Per-coordinate FTRL-proximal for softmax regression; weights that L1 holds at zero are exactly zero."""

    def __init__(self, size: int, classes: int):
        self.z, self.n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.bias, self.temperature = languages, bias, temperature
        self.table = (idf[:, None] * weights * SCALE).astype(np.float64)

    def logits(self, text: str) -> np.ndarray:
        return self.table[grams(text)].mean(0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, passes: int = PASSES, seed: int = 11, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from docs (doc_id, text, lang); rows without text, lang or a letter are no examples."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 1)), np.zeros(1), 1.0)
    df, total = document_frequency(docs)
    idf = np.log((1 + total) / (1 + df)) + 1
    share = F.xxhash64(F.lit(seed), "doc_id", "text")
    chosen = F.lit(False)
    for lang in languages:
        chosen = chosen | ((F.col("lang") == lang) & (share <= -(1 << 63) + int((1 << 64) * min(1.0, per_language / counts[lang])) - 1))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("share", "doc_id", "text"))
    sample = docs.filter(chosen).select("doc_id", "text", "lang", share.alias("share")).withColumn("upto", upto)
    sample = sample.filter(F.col("upto") - F.octet_length("text") <= sample_bytes // len(languages))
    rows = sorted(sample.collect(), key=lambda r: (zlib.crc32(f"{seed}/{r['doc_id']}".encode()), r["text"]))
    examples = [(*features(r["text"], idf), languages.index(r["lang"])) for r in rows]
    held, learn = examples[::5], [e for i, e in enumerate(examples) if i % 5] or examples
    model = Ftrl(1 << BITS, len(languages))
    for _ in range(passes):
        for at, x, y in learn:
            model.update(np.append(at, 1 << BITS), np.append(x, 1.0), y)
    w = model.weights(np.arange((1 << BITS) + 1))
    logits, truth = np.array([x @ w[at] + w[-1] for at, x, _ in held]), np.array([y for *_, y in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    # A held part without an error would draw the temperature to 0; the targets allow for one error unseen.
    target = np.full((len(truth), len(languages)), 1 / (len(truth) + 2) / max(1, len(languages) - 1))
    target[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
    loss = [-(target * np.log(np.maximum(softmax(logits / t), 1e-300))).sum() for t in grid]
    return Model(languages, idf, w[:-1], w[-1], float(grid[int(np.argmin(loss))]))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs (whatever columns) with lang_pred and score; columns of those names are replaced."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            found = [shared.value.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    found = identify(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
