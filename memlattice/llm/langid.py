"""Language identification by nearest centroids: normalised TF-IDF vectors of byte n-grams, several clustered centroids
for each language, cosine, and rejection by distance.

N-grams are hashed to a fixed number of columns, so that a document of any length becomes one vector of fixed size, and
that vector, not the text, is what training collects.

Edge cases: a text that is null or has no letter is ``und`` with score 0. A text that is further from every centroid
than nearly all learned texts of that language were is still named after the nearest one, and marked ``rejected``.
Repeated rows are named alike; a null id is carried along and not held out. Further columns are ignored. An empty table
gives an empty result; without a language to learn from every row is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Query, Scratch, crc_mod, table

#: Columns of a vector; documents of a language, and of all, to learn from, at most about; centroids a language; bytes of
#: text at a time.
COLUMNS, ROWS, ALL_ROWS, CENTROIDS, STEP = 4096, 1000, 4000, 4, 1 << 20
_gap = re.compile(r"[\W\d_]+")


def counts(text: str, columns: int = COLUMNS) -> np.ndarray:
    """Hashed counts of the 1- to 3-byte n-grams of the letters of ``text``, runs of anything else being one blank."""
    plain = np.frombuffer((" " + _gap.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace"), np.uint8)
    out = np.zeros(columns, np.int64)
    for lo in range(0, len(plain), STEP):
        b = plain[lo : lo + STEP + 2].astype(np.uint32)
        n = min(STEP, len(plain) - lo)
        two = b[:-1] * np.uint32(257) + b[1:] * np.uint32(65537)
        three = two[:-1] + b[2:] * np.uint32(16777619)
        for k, x in enumerate((b, two, three)):
            h = (x[:n] + np.uint32(k * 7919)) * np.uint32(2654435761)
            out += np.bincount(h >> np.uint32(32 - int(columns).bit_length() + 1), minlength=columns)
    return out


def unit(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(x.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from far-apart starts; at most ``k`` unit centroids."""
    centres = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(centres) < min(k, len(x)):
        far = (x @ x[centres].T).max(axis=1)
        centres.append(int(np.argmin(far)))
    c = x[centres]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    idf: np.ndarray = field(default_factory=lambda: np.ones(COLUMNS, np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, COLUMNS), np.float32))
    names: list[str] = field(default_factory=list)  #: of the centroids
    least: dict[str, float] = field(default_factory=dict)  #: cosine below which a language is rejected


def fit(x: np.ndarray, langs: list[str], k: int = CENTROIDS, reject: float = 0.005) -> Model:
    """Centroids from count vectors. Texts that lie nearer to another language's middle than to their own's are left
    out of the second clustering, so that wrong labels get no centroid."""
    if not len(x):
        return Model()
    y = np.array(langs)
    idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    v = unit(x, idf)
    names = sorted(set(langs))
    middle = np.stack([v[y == n].mean(axis=0) for n in names])
    middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-12)
    near = np.array(names)[(v @ middle.T).argmax(axis=1)]
    parts, owners, least = [], [], {}
    for n in names:
        own = v[(y == n) & (near == n)] if ((y == n) & (near == n)).any() else v[y == n]
        c = cluster(own, k)
        parts.append(c)
        owners += [n] * len(c)
        least[n] = float(np.quantile((own @ c.T).max(axis=1), reject))
    return Model(idf, np.concatenate(parts), owners, least)


def train(docs: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from about ``rows`` documents of each language (fewer where there are so many languages that they would
    pass ALL_ROWS), chosen by a hash of id, none of which is held out. The driver gets a sparse vector of each, no text."""
    spark = docs.sparkSession
    known = docs.where((crc_mod(F.col(id_col), 5) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = docs.where((crc_mod(F.col(id_col), 5) != 0) & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().collect()
    each = min(rows, ALL_ROWS // max(1, len(sizes)) + 1)
    part = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 30))
    share = F.lit(0)
    for lang, n in sorted((r[0], r[1]) for r in sizes):
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, each / n) * (1 << 30)))).otherwise(share)
    chosen = known.where(part < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [counts(t.as_py()) for t in b.column("text")]
            at = [np.flatnonzero(v).astype("<u2") for v in x]
            sparse = [i.tobytes() for i in at], [v[i].astype("<u4").tobytes() for v, i in zip(x, at)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), *(pa.array(p, pa.binary()) for p in sparse)], names=["id", "lang", "at", "n"])

    scratch = Scratch(spark, "langid")
    got = scratch.write(chosen.mapInArrow(run, "id long, lang string, at binary, n binary"), "vectors")
    got = got.orderBy("id", "lang", "at", "n").limit(2 * each * max(1, len(sizes))).toArrow()  # a bound against repeated ids
    scratch.clear()
    x = np.zeros((len(got), COLUMNS), np.float32)
    for row, at, n in zip(x, got.column("at").to_pylist(), got.column("n").to_pylist()):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
    return fit(x, got.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row; score is the cosine to the nearest centroid, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.centroids, model.names, model.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids, names, least = shared.value
        for b in batches:
            langs, scores, rejected = [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                if not names or not any(map(str.isalpha, text)):
                    langs.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                cos = centroids @ unit(counts(text), idf)
                k = int(cos.argmax())
                langs.append(names[k]), scores.append(float(np.clip(cos[k], 0, 1))), rejected.append(bool(cos[k] < least[names[k]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Query] = {"op1_language_id": op1_language_id}
