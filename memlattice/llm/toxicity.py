"""Toxicity by compression distance: one zstandard dictionary trained on ordinary text, one trained on toxic text, and
how much shorter a window of a document gets when the toxic one is there as well.

Both dictionaries come from zstandard's trainer, each from texts of its own class. A toxic document is ordinary text for
the most part, so a dictionary of its windows as they are knows little that is toxic; its windows are therefore narrowed,
round by round: those that the toxic dictionary shortens more than nearly all ordinary ones are kept, each cut down to
the part whose removal costs the most of the gain, and the dictionary is trained again on these parts. Every decision
is a compressed length. Lengths are compared between the ordinary dictionary alone and both of them (the toxic one
nearest), as two dictionaries that share nothing differ by chance far more than by toxic text.

All that is learned is cross-fitted: a document's gains for ``calibration`` come from dictionaries without its fold.

Edge cases: null, empty and blank texts have no windows and get the score of a text without gains. Repeated rows are
scored alike; a null id is carried along and not held out. Texts of any length are scored whole, a window at a time.
Further columns are ignored. An empty table gives an empty result. Without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Query, Scratch, crc_mod, labelled_sample, table

#: Words and bytes of a window, at most; labelled documents a class; bytes of windows a class that the driver trains on,
#: about; ordinary windows a fold that thresholds are taken from.
WINDOW, WINDOW_BYTES, ROWS, TRAIN_BYTES, HELD = 16, 1024, 3000, 4 << 20, 4000
#: Bytes of the ordinary dictionary, of the first toxic one, of the toxic one from narrowed windows; rounds of narrowing;
#: share of ordinary windows that may pass a round's threshold.
ORDINARY, FIRST, NARROW, ROUNDS, PASS = 256 << 10, 96 << 10, 8 << 10, 3, 0.02
GRAM = 6
LEVELS = (1, 2, 3, 4, 5, 6)
FEATURES = 2 * len(LEVELS) + 2
FOLDS = (0, 1, 3)


def windows(text: str | None, n: int = WINDOW, most: int = WINDOW_BYTES) -> Iterator[bytes]:
    ws = (text or "").lower().encode("utf-8", "replace").split()
    for k in range(0, len(ws), n):
        w = b" " + b" ".join(ws[k : k + n]) + b" "
        if len(w) <= most:
            yield w
        else:
            yield from (w[i : i + most] for i in range(0, len(w), most))


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of ``size`` bytes from ``samples``; the samples themselves where they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=segment, d=6, level=3).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def compressor(dictionary: bytes):
    """Searches for matches of three bytes and more at every place, so that lengths depend little on chance."""
    import zstandard as z

    how = z.ZstdCompressionParameters(window_log=20, hash_log=17, chain_log=18, search_log=3, min_match=3, target_length=32, strategy=z.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False, write_checksum=False)
    shared = z.ZstdCompressionDict(dictionary or b" " * 8)
    shared.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=shared, compression_params=how)


class Pair:
    """Gains of windows by an ordinary dictionary and a toxic one.

    Only windows that hold ``GRAM`` bytes of the toxic dictionary which the ordinary one lacks are compressed: others
    have nothing to gain, but for chance.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        import ahocorasick

        self.alone, self.both = compressor(ordinary).compress, compressor(ordinary + toxic).compress
        grams = lambda d: {d[i : i + GRAM] for i in range(len(d) - GRAM + 1)}
        self.find, new = None, grams(toxic) - grams(ordinary)
        if new:
            found = ahocorasick.Automaton()
            for g in new:
                found.add_word(g.decode("latin-1"), True)
            found.make_automaton()
            self.find = found.iter

    def gain(self, w: bytes) -> int:
        if self.find is None or next(self.find(w.decode("latin-1")), None) is None:
            return 0
        return len(self.alone(w)) - len(self.both(w))

    def narrowed(self, w: bytes) -> bytes | None:
        """The word of the window whose removal costs the most gain; None if none does."""
        ws, gain = w.split(), self.gain(w)
        lost = [gain - self.gain(b" " + b" ".join(ws[:i] + ws[i + 1 :]) + b" ") for i in range(len(ws))]
        return b" " + ws[int(np.argmax(lost))] + b" " if lost and max(lost) > 0 else None

    def features(self, text: str | None) -> list[float]:
        """What decides about a document: how many windows gain so many bytes or more, as numbers and shares, the
        largest gain and the mean of the three largest."""
        gains = np.fromiter(map(self.gain, windows(text)), np.int64)
        if not len(gains):
            return [0.0] * FEATURES
        over = np.array([(gains >= k).sum() for k in LEVELS])
        top = np.sort(gains)[::-1]
        return [*np.log1p(over).tolist(), *np.sqrt(over / len(gains)).tolist(), float(top[0]), float(top[:3].mean())]


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = -50.0
    folds: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)  #: dictionaries that did not see a fold


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps for weighted ridge logistic regression over standardised columns; the bias is not penalised."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a, w = np.c_[(x - middle) / spread, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    pen = np.r_[np.full(x.shape[1], ridge * len(x) / 100 + 1e-6), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(pen)
        step = np.linalg.solve(h, a.T @ (weight * (p - y)) + pen * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * middle / spread).sum())


def dictionaries(toxic: dict[int, list[bytes]], plain: dict[int, list[bytes]]) -> Model:
    """Both dictionaries, from windows by fold, and those of each fold's complement."""
    but = lambda parts, f: [w for g in FOLDS if g != f for w in parts[g]]
    ordinary = {f: trained(but(plain, f), ORDINARY, 24) for f in (*FOLDS, None)}
    parts, size, segment = toxic, FIRST, 24
    for _ in range(ROUNDS):
        narrow = {}
        for f in FOLDS:
            pair = Pair(ordinary[f], trained(but(parts, f), size, segment))
            least = np.quantile(list(map(pair.gain, plain[f][:HELD])) or [0], 1 - PASS)
            cut = [pair.narrowed(w) for w in toxic[f] if pair.gain(w) > least]
            narrow[f] = [w for w in cut if w]
        parts, size, segment = narrow, NARROW, 16
    last = {f: trained(but(parts, f), NARROW, 16) for f in (*FOLDS, None)}
    return Model(ordinary[None], last[None], folds={f: (ordinary[f], last[f]) for f in FOLDS})


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = TRAIN_BYTES) -> Model:
    """A model from about ``rows`` labelled documents of each class, none of which is held out. The driver gets windows
    of about ``most`` bytes a class, chosen by their hash from documents of any length, and the features of each
    document; never a whole text."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    sample = labelled_sample(docs, labels, "toxic", rows, scratch).select("id", "text", "y", "fold", "weight")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, y, fold in zip(b.column("text"), b.column("y").to_pylist(), b.column("fold").to_pylist()):
                ws = list(dict.fromkeys(windows(text.as_py())))
                for k in range(0, len(ws), 4096):
                    part = ws[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(part), pa.int32()), pa.array([fold] * len(part), pa.int32()), pa.array(part, pa.binary())], names=["y", "fold", "w"])

    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model()
    share = lambda y: int(min(1.0, most / max(sizes[y], 1)) * (1 << 30))
    cuts = sample.select("text", "y", "fold").mapInArrow(cut, "y int, fold int, w binary").distinct()
    rank = F.pmod(F.xxhash64(F.lit("window"), "w"), F.lit(1 << 30))
    cuts = cuts.where(rank < F.when(F.col("y") == 1, share(1)).otherwise(share(0))).withColumn("rank", rank)
    got = scratch.write(cuts, "windows").orderBy("rank", "w", "fold", "y").limit(most // 8).toArrow()
    parts = {(y, f): [] for y in (0, 1) for f in FOLDS}
    for y, f, w in zip(*(got.column(c).to_pylist() for c in ("y", "fold", "w"))):
        parts[y, f].append(w)
    model = dictionaries(*({f: parts[y, f] for f in FOLDS} for y in (1, 0)))
    shared = spark.sparkContext.broadcast(model.folds)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = {f: Pair(*d) for f, d in shared.value.items()}
        for b in batches:
            x = [pairs[f].features(t.as_py()) for t, f in zip(b.column("text"), b.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), b.column("weight"), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "weight", "x"])

    got = scratch.write(sample.repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(measure, "id long, y int, weight double, x array<double>"), "features").orderBy("id", "y").toPandas()
    scratch.clear()
    w, b = logistic(np.stack(got["x"]), got["y"].to_numpy(float), got["weight"].to_numpy(float))
    model.weights, model.bias = w.tolist(), b
    return model


def mark(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(doc, score): each row of ``docs`` as one value, so that no name can clash, and its score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic, weights, bias = shared.value
        pair = Pair(ordinary, toxic)
        for b in batches:
            x = np.array([pair.features(s.as_py()) for s in b.column(0).field(text_col)]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(weights) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mark(rows, model).select("doc.doc_id", "score")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Query] = {"op3_toxicity": op3_toxicity}
