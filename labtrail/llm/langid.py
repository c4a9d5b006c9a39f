"""Language by the nearest of several centroids per language, over TF-IDF vectors of byte n-grams.

A text becomes counts of its lower-case 2- and 3-byte grams, hashed to a fixed number of cells; runs
of characters other than letters count as a space. Document frequencies are counted over all training
rows. The centroids of a language come from spherical k-means over a bounded sample of its rows. A text
gets the language of the nearest centroid by cosine, and is rejected if it lies much further from that
centroid than the centroid's own sample.

Defined cases: a null text, or one without a letter, has the language `und`, score 0, and is
rejected; the same holds for all rows if there is nothing to learn from. Rows without a language or
key do not train. Ties go to the language that sorts first. Repeated rows are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

#: Cells that each of the two kinds of grams is hashed to, as a power of two.
CELL_BITS = 14
CELLS = 2 << CELL_BITS
#: Rows of a language that its centroids are fitted on, about, and centroids of a language.
SAMPLE_ROWS = 400
CENTROIDS = 4
#: A text is rejected below this part of the cosine that nearly all of the centroid's sample reaches.
SLACK = 0.3

# ASCII letters in lower case, other ASCII characters as spaces, bytes of longer characters as they are
_PLAIN = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else 32 if b < 128 else b for b in range(256))


def held_out(key: str) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells that occur in a text, and how often."""
    b = np.frombuffer(f" {text} ".lower().encode("utf-8", "replace").translate(_PLAIN), np.uint8).astype(np.uint32)
    pairs = (b[:-1] << 8) | b[1:]
    triples = (pairs[:-1] << 8) | b[2:]
    shift = np.uint32(32 - CELL_BITS)
    cells = np.concatenate(
        [
            ((pairs[pairs != 0x2020] * np.uint32(2654435761)) >> shift),
            ((triples[triples != 0x202020] * np.uint32(2246822519)) >> shift) + np.uint32(1 << CELL_BITS),
        ]
    )
    if len(cells) < 4000:
        return np.unique(cells, return_counts=True)
    counts = np.bincount(cells, minlength=CELLS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighted(cells: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[cells]
    return values / max(np.sqrt((values * values).sum()), 1e-30)


def document_frequencies(rows: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of texts and, for each cell, the number of texts it occurs in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, number = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                found[grams(value.as_py())[0]] += 1
                number += 1
        cells = np.append(np.flatnonzero(found), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int64()), pa.array(np.append(found[cells[:-1]], number), pa.int64())], names=["cell", "n"]
        )

    counted = rows.select(text).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found, total = np.zeros(CELLS, np.int64), 0
    for cell, n in counted.collect():  # one row per cell at most
        if cell < 0:
            total = n
        else:
            found[cell] = n
    return total, found


def k_means(vectors: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: centroids, and the cosine of each vector to its own."""
    picked = [0]
    near = vectors @ vectors[0]
    while len(picked) < min(k, len(vectors)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[picked[-1]])
    centroids = vectors[picked]
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
    return centroids, vectors @ centroids.T


@dataclass(frozen=True)
class Model:
    """`centroids` has a column per centroid, weighted by idf; `limits` the least cosine of each."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray


def fit(rows: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", k: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from rows that have a key, a text with a letter and a label."""
    rows = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    total, found = document_frequencies(rows, text)
    idf = np.log((1.0 + total) / (1.0 + found)) + 1.0
    numbers = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not numbers:
        return Model([], np.zeros((CELLS, 0)), idf, np.zeros(0))
    share = F.lit(0)
    for name, number in numbers.items():
        share = F.when(F.col(label) == name, F.lit(int(min(1.0, sample_rows / number) * 1_000_000) + 1)).otherwise(share)
    taken = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < share).select(F.col(label).alias("label"), F.col(text).alias("text"))
    out = T.StructType([T.StructField("label", T.StringType()), T.StructField("centroid", T.BinaryType()), T.StructField("limit", T.DoubleType())])

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group["text"])[: 4 * sample_rows]
        vectors = np.zeros((len(texts), CELLS), np.float32)
        for row, value in enumerate(texts):
            cells, counts = grams(value)
            vectors[row, cells] = weighted(cells, counts, idf)
        found, cosines = k_means(vectors, k)
        own = np.argmax(cosines, axis=1)
        limits = [float(np.quantile(cosines[own == c, c], 0.01)) if (own == c).any() else 2.0 for c in range(len(found))]
        frame = {"label": group["label"].iloc[0], "centroid": [x.astype("<f4").tobytes() for x in found], "limit": limits}
        return pd.DataFrame(frame)[lambda x: x["limit"] < 2.0]

    fitted = sorted(taken.groupBy("label").applyInPandas(centroids, out).collect(), key=lambda r: (r[0], bytes(r[1])))
    matrix = np.stack([np.frombuffer(r[1], "<f4") for r in fitted], axis=1).astype(np.float64) if fitted else np.zeros((CELLS, 0))
    return Model([r[0] for r in fitted], matrix, idf, np.array([r[2] for r in fitted]) * SLACK)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `lang_pred`, `score` (cosine of the nearest centroid) and `rejected` to every row."""
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    names = [f.name for f in kept]
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            languages, scores, rejected = [], [], []
            for value in batch.column(at):
                body = value.as_py()
                if body is None or not fitted.languages or not LETTER.search(body):
                    found = UNKNOWN, 0.0, True
                else:
                    cells, counts = grams(body)
                    cosines = weighted(cells, counts, fitted.idf) @ fitted.centroids[cells]
                    best = int(np.argmax(cosines))
                    cosine = float(min(max(cosines[best], 0.0), 1.0))
                    found = fitted.languages[best], cosine, bool(cosine < fitted.limits[best])
                languages.append(found[0])
                scores.append(found[1])
                rejected.append(found[2])
            added = [pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, "lang_pred", "score", "rejected"])

    return docs.select(*names).mapInArrow(judge, T.StructType([*kept, *fields]))


def identify(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on the rows that are not held out, and predict every row."""
    model = fit(docs.where(~held_out(key)), label, key, text)
    return predict(docs, model, text)
