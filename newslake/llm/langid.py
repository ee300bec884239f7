"""Language identification by error-correcting output codes.

Each language has a binary codeword. For each bit a naive Bayes classifier over hashed byte n-grams tells the languages with a
one from those with a zero; loss-weighted decoding takes the codeword nearest to the margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: Buckets of hashed n-grams, in blocks of which each is one row on its way to the sums.
BUCKETS = 1 << 13
COUNT_BLOCK = 1 << 9
GRAMS = (1, 2, 3)
#: Codes of so many languages or fewer hold every split of them; of more, this many random bits per doubling.
EXHAUSTIVE = 6
BITS_PER_DOUBLING = 12
SMOOTHING = 0.5
#: Texts whose two nearest codewords differ by less than this share of the loss are flagged.
AMBIGUOUS = 0.1
#: Bytes of text that are hashed at a time.
PIECE = 1 << 22


def buckets(text: bytes) -> np.ndarray:
    """Counts of the hashed byte n-grams of a lower-cased text, padded with a space at both ends."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    raw = np.frombuffer(b" " + text + b" ", dtype=np.uint8)
    longest = max(GRAMS)
    for start in range(0, len(raw), PIECE):
        part = raw[start:start + PIECE + longest - 1].astype(np.uint32)
        for n in GRAMS:
            size = min(PIECE, len(raw) - start) if start + PIECE < len(raw) else len(part) - n + 1
            if size <= 0:
                continue
            h = np.full(size, n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ part[k:k + size]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """Rows of -1 and 1, one per language; every two differ, and so do every two columns and their opposites."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        splits = [[1 if i == 0 or (m >> (i - 1)) & 1 else -1 for i in range(n)] for m in range((1 << (n - 1)) - 1)]
        return np.array(splits, dtype=float).T
    rng = np.random.default_rng(7)
    bits = BITS_PER_DOUBLING * int(np.ceil(np.log2(n)))
    columns: list[tuple] = []
    while len(columns) < bits or len(np.unique(np.array(columns).T, axis=0)) < n:
        c = tuple(rng.permutation([1.0 if i % 2 else -1.0 for i in range(n)]))
        if c not in columns and tuple(-x for x in c) not in columns:
            columns.append(c)
    return np.array(columns).T


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether two codewords are about as near."""
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, False
        counts = buckets(text.lower().encode("utf-8", "replace"))
        margins = counts @ self.weights / np.sqrt(counts.sum())
        losses = np.logaddexp(0.0, -self.codes * margins).sum(1)
        if len(losses) == 1:
            return self.languages[0], 1.0, False
        first, second = np.sort(losses)[:2]
        likely = np.exp(first - losses)
        return self.languages[int(np.argmin(losses))], float(1.0 / likely.sum()), bool(second - first < AMBIGUOUS * max(second, 1e-12))


def train(labelled: DataFrame) -> Model:
    """A model from rows ``text``, ``lang``; all rows count, and rows without a text or a language give nothing.

    What comes to the driver is a table of languages times ``BUCKETS`` counts, whatever the number of rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                one = buckets(text.as_py().lower().encode("utf-8", "replace"))
                sums[lang.as_py()] = sums[lang.as_py()] + one if lang.as_py() in sums else one
        for lang, one in sums.items():
            parts = one.reshape(-1, COUNT_BLOCK)
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(parts), "block": list(range(len(parts))), "counts": [p.tolist() for p in parts]},
                pa.schema([("lang", pa.string()), ("block", pa.int32()), ("counts", pa.list_(pa.int64()))]))

    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(
        count, "lang string, block int, counts array<bigint>")
    added = rows.select("lang", "block", F.posexplode("counts").alias("at", "n")).groupBy("lang", "block", "at").agg(F.sum("n").alias("n"))
    table = added.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("at", "n")))["n"].alias("counts")).collect()
    languages = sorted({r["lang"] for r in table})
    sums = np.zeros((len(languages), BUCKETS))
    for r in table:
        sums[languages.index(r["lang"]), r["block"] * COUNT_BLOCK:(r["block"] + 1) * COUNT_BLOCK] = r["counts"]
    shares = (sums + SMOOTHING) / (sums + SMOOTHING).sum(1, keepdims=True) if languages else sums
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS, codes.shape[1]))
    for bit in range(codes.shape[1]):
        one, zero = shares[codes[:, bit] > 0], shares[codes[:, bit] < 0]
        if len(one) and len(zero):
            weights[:, bit] = np.log(one.mean(0)) - np.log(zero.mean(0))
    return Model(languages, codes, weights)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents plus ``lang_pred``, ``score`` and ``ambiguous``; reads the column ``text`` alone.

    A null text or one without a letter is ``und`` with score 0, as is any text if the model knows no language. Repeated
    rows get equal answers, an empty table gives an empty one, and clashing columns are replaced. The model travels with the task: languages times ``BUCKETS`` numbers.
    """
    kept = docs.drop("lang_pred", "score", "ambiguous")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; documents with crc32(doc_id) mod 4 = 2 are never learned from."""
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    rows = docs.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "text", "lang")
    model = train(rows.where("NOT held_out AND doc_id IS NOT NULL"))
    return classify(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
