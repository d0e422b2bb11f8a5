"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary n-gram classifier (log odds of hashed byte n-grams of length one to
three, every language of a side with equal weight) tells the languages with that bit from those without.  A text's
margins are decoded to the codeword of least weighted logistic loss, where a bit counts for a language as much as its
classifier was right on that language's training texts.  Near ties are flagged as ambiguous.

The model learns from at most about ``train_rows`` labelled texts (a hash fraction of all of them, the documented
bound); prediction reads whole texts, and nothing but texts.

Rows: a null text, or one without a letter, is ``und`` with score 0; repeated rows get equal results; null languages
are never learned; with no labelled row everything is ``und``; further columns are ignored; an empty table gives an
empty table.  Ties between languages go to the alphabetically first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, of_sample, table
from .textcols import slices, utf8

FEATURES = 4096
SLICE_BYTES, SLICE_ROWS = 1 << 19, 256  # a row has as many counts as there are features
UNDETERMINED = "und"

#: Letters in lower case and bytes of other scripts stay, all else is a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte n-grams, a row for each text."""
    n = len(offsets) - 1
    b = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(offsets))
    total = np.zeros(n * FEATURES, np.int64)
    gram = np.zeros(len(b), np.uint32)
    for k in range(3):
        if len(b) <= k:
            break
        gram = gram[: len(b) - k] * np.uint32(257) + b[k:] + np.uint32(1)
        slot = (gram * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
        same = row[k:] == row[: len(row) - k]
        told = (b[k:] != 32) & same
        total += np.bincount(row[k:][told] + slot[told], minlength=n * FEATURES)
    return total.reshape(n, FEATURES)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", errors="replace")))


def letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    plain = np.r_[0, np.cumsum((_FOLD[data] != 32) & (data < 128))]
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[k] = has_letter(data[offsets[k] : offsets[k + 1]].tobytes())
    return out


def code(languages: int) -> np.ndarray:
    """Codewords of -1 and 1, a row for each language: all splits for few languages, else the best of seeded draws."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        splits = np.arange(1, 2 ** (languages - 1))
        return np.stack([np.where(splits >> k & 1, 1, -1) for k in range(languages)]).astype(np.int8)
    bits, random, best = 10 * math.ceil(math.log2(languages)), np.random.default_rng(7), None
    for _ in range(300):
        words = random.choice(np.array([-1, 1], np.int8), (languages, bits))
        apart = (bits - words.astype(int) @ words.T.astype(int)) // 2
        least = (apart + np.eye(languages, dtype=int) * bits).min()
        if (np.abs(words.sum(0)) < languages).all() and (best is None or least > best[0]):
            best = (least, words)
    if best is None:
        raise ValueError("no code found")
    return best[1]


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray
    weights: np.ndarray  # FEATURES x bits
    trust: np.ndarray  # languages x bits

    def margins(self, counts: np.ndarray) -> np.ndarray:
        n = counts.sum(1, keepdims=True)
        return counts @ self.weights / np.maximum(n, 1) * np.minimum(np.sqrt(n), 20)

    def losses(self, counts: np.ndarray) -> np.ndarray:
        z = self.margins(counts)
        return np.stack([(np.logaddexp(0, -z * w) * t).sum(1) for w, t in zip(self.words, self.trust)], 1)


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 8000, smoothing: float = 0.5) -> Model:
    """df: the rows to learn from.  Two passes over a sample of about train_rows rows: n-gram sums, then bit accuracy."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    picked = labelled.where(of_sample(F.col(id_col).cast("string"), train_rows, labelled.select(lang_col).count()))
    picked = bounded_batches(picked).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            counts, langs = ngram_counts(*utf8(batch.column("text"))), np.array(batch.column("lang").to_pylist())
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + counts[langs == lang].sum(0)
        for lang, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * FEATURES), pa.array(range(FEATURES), pa.int32()), pa.array(c, pa.int64())], ["lang", "feature", "n"])

    rows = picked.mapInArrow(sums, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in rows})
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((FEATURES, 1)), np.ones((0, 1)))
    seen = np.zeros((len(languages), FEATURES))
    for r in rows:
        seen[languages.index(r.lang), r.feature] = r.n
    rate = (seen + smoothing) / (seen + smoothing).sum(1, keepdims=True)
    words = code(len(languages))
    if len(languages) == 1:
        weights = np.zeros((FEATURES, 1))
    else:
        weights = np.stack([np.log(rate[w > 0].mean(0)) - np.log(rate[w < 0].mean(0)) for w in words.T], 1)
    model = Model(languages, words, weights, np.ones(words.shape))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), words.shape[1]), np.int64)
        rows = np.zeros(len(languages), np.int64)
        for batch in slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            z = model.margins(ngram_counts(*utf8(batch.column("text"))))
            own = np.array([languages.index(x) for x in batch.column("lang").to_pylist()])
            np.add.at(total, own, z * words[own] > 0)
            np.add.at(rows, own, 1)
        bits = words.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(languages)), bits)), pa.array(np.tile(np.arange(bits), len(languages))), pa.array(total.ravel()), pa.array(np.repeat(rows, bits))], ["lang", "bit", "good", "n"])

    found = picked.mapInArrow(right, "lang long, bit long, good long, n long").groupBy("lang", "bit").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()
    for r in found:
        model.trust[r["lang"], r["bit"]] = (r["good"] + 1) / (r["n"] + 2)
    model.trust /= model.trust.mean(1, keepdims=True)
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.1) -> DataFrame:
    """df's rows with lang_pred, score and ambiguous (the runner-up's score is within margin); other columns are kept,
    but for those three names."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = df.select(kept).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    names = np.array([*model.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE_BYTES, SLICE_ROWS):
            data, offsets = utf8(batch.column(text_col))
            told = letters(data, offsets) & bool(model.languages)
            pick, score, close = np.full(len(told), len(names) - 1), np.zeros(len(told)), np.zeros(len(told), bool)
            if told.any():
                chance = np.exp(-model.losses(ngram_counts(data, offsets)[told]))
                chance /= chance.sum(1, keepdims=True)
                best = chance.argmax(1)
                top = np.sort(chance, 1)
                pick[told], score[told] = best, top[:, -1]
                close[told] = top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0) < margin
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[pick].tolist(), pa.string()), pa.array(score), pa.array(close)], schema.names)

    return bounded_batches(df).select(kept).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op10_langid_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


QUERIES = {"op10_langid_ecoc": op10_langid_ecoc}
ORACLES: dict[str, str] = {}
