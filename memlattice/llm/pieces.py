"""SentencePiece encoding and decoding on the tokenizers library: the model file is parsed here, and normaliser,
white-space marker, scores or merges and byte fallback are rebuilt from it.

Edge cases: a null text has null ids; an empty text none. Repeated rows are encoded alike and a null id is carried
along. Texts of any length are encoded whole: the split into marked words, which is checked to be lossless for the
model, keeps the work of a long text in proportion to its length. Further columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Query, table

MARK = "▁"
#: Begins the stand-in names of control pieces: a code point that is no character.
HIDDEN = "\ufdd0"
LOOKS_LIKE_BYTE = re.compile("<0x[0-9A-F]{2}>")
#: Kinds of pieces and models in the file format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: whole numbers, or the bytes of the other kinds."""
    at = 0

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, raw[at : at + n]
        at += n


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    suffix: bool = False
    charsmap: bytes = b""
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(raw: bytes) -> Spec:
    out = Spec()
    for n, value in fields(raw):
        if n == 1:
            piece = dict(fields(value))
            out.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif n == 2:
            trainer = dict(fields(value))
            out.kind, out.byte_fallback, out.suffix = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
        elif n == 3:
            norm = dict(fields(value))
            out.charsmap, out.prefix, out.squeeze, out.escape = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
    out.unknown = next((i for i, p in enumerate(out.pieces) if p[2] == UNKNOWN), 0)
    if out.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model kind {out.kind}: only unigram (1) and BPE (2) models can be rebuilt")
    if out.suffix:
        raise ValueError("models that mark white space at the end of words can't be rebuilt")
    return out


def build(spec: Spec, cache: int = 10_000):
    """The tokenizers.Tokenizer that encodes as the model does; ``cache``: words whose merges are remembered."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    usable = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER)}
    # Pieces that no text may give keep their ids under names that no text has.
    names = [p if kind in (NORMAL, USER, BYTE) else f"{HIDDEN}{i};" for i, (p, _, kind) in enumerate(spec.pieces)]
    unknown = names[spec.unknown]
    if spec.kind == BPE:
        score = {p: spec.pieces[i][1] for p, i in usable.items()}
        pairs = []
        for p in usable:
            for k in range(1, len(p)):
                if p[:k] in usable and p[k:] in usable:
                    pairs.append((-score[p], usable[p], usable[p[:k]], usable[p[k:]], p[:k], p[k:]))
        merges = [x[4:] for x in sorted(pairs)]
        model = models.BPE(vocab={p: i for i, p in enumerate(names)}, merges=merges, unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=cache)
    else:
        low = lowest(spec)
        model = models.Unigram([(n, s if k in (NORMAL, USER) else low) for n, (_, s, k) in zip(names, spec.pieces)], unk_id=spec.unknown, byte_fallback=spec.byte_fallback)
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    space = MARK if spec.escape else " "
    if spec.prefix:
        steps.append(normalizers.Prepend(" "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if not any(re.search(f"[^{space}]{space}", p) for p in usable):  # no piece goes over the start of a word
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{space}+[^{space}]*|[^{space}]+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.prefix else [])])
    tok.add_tokens([AddedToken(p, normalized=False) for p, _, k in spec.pieces if k == USER])
    return tok


def lowest(spec: Spec) -> float:
    return min((s for _, s, k in spec.pieces if k == NORMAL), default=0.0)


def best_path(word: str, spec: Spec, usable: dict[str, int], longest: int) -> list[int]:
    """The unigram model's ids for a word, by dynamic programming. For words that spell out a byte piece's name, which
    the tokenizer would take for the piece."""
    penalty, score, back = lowest(spec) - 10, [0.0], [(0, -1)]
    for end in range(1, len(word) + 1):
        options = [(score[k] + spec.pieces[usable[word[k:end]]][1], -k, usable[word[k:end]]) for k in range(max(0, end - longest), end) if word[k:end] in usable]
        if word[end - 1] not in usable:
            options.append((score[end - 1] + penalty, 1 - end, -1))
        value, k, piece = max(options)
        score.append(value)
        back.append((-k, piece))
    at, path = len(word), []
    while at:
        start, piece = back[at]
        path.append((piece, word[start:at]))
        at = start
    byte = {p: i for i, (p, _, k) in enumerate(spec.pieces) if k == BYTE}
    ids: list[int] = []
    for piece, part in reversed(path):
        if piece >= 0:
            ids.append(piece)
        elif spec.byte_fallback:
            ids += [byte[f"<0x{b:02X}>"] for b in part.encode()]
        elif not ids or ids[-1] != spec.unknown:
            ids.append(spec.unknown)
    return ids


def once(data: np.ndarray, starts: np.ndarray, spell: Callable[[list[bytes]], list[bytes]], unit: type) -> tuple[np.ndarray, np.ndarray]:
    """(what ``spell`` gives for each run of bytes from one start to the next, one after the other; where each begins,
    and the end). Equal runs are asked for once."""
    ends = np.append(starts, len(data)).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    _, places, kept = runs.dictionary.buffers()
    raw, at = kept.to_pybytes() if kept else b"", np.frombuffer(places, np.int64)[: len(runs.dictionary) + 1].tolist()
    which, found = runs.indices.to_numpy(), spell([raw[lo:hi] for lo, hi in zip(at, at[1:])])
    flat, size = np.frombuffer(b"".join(found), unit), np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(unit).itemsize
    before, each = np.cumsum(size) - size, size[which]
    bounds = np.concatenate(([0], np.cumsum(each)))
    return flat[np.repeat(before[which] - bounds[:-1], each) + np.arange(bounds[-1])], bounds


class Codec:
    """Encodes and decodes by a rebuilt tokenizer. Where words can be told apart without loss, each distinct word is
    given to the tokenizer once, in multithreaded batches, and remembered (``room`` of them at most)."""

    def __init__(self, raw: bytes, room: int = 600_000):
        import sentencepiece
        from tokenizers import normalizers, pre_tokenizers

        self.spec, self.room = parse(raw), room
        self.tok, self.bare = build(self.spec), build(self.spec)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.plain = not self.spec.charsmap and not self.spec.squeeze and self.spec.prefix and self.spec.escape
        self.split: int | None = None  # the byte at which words begin
        if self.spec.escape and self.spec.prefix and self.bare.pre_tokenizer is not None and not any(k == USER for _, _, k in self.spec.pieces):
            self.split = ord(" ")
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([])
        self.silent = {i for i, (_, _, k) in enumerate(self.spec.pieces) if k not in (NORMAL, USER, BYTE)}
        self.spells = {i: b"" for i in self.silent}  # by id; names of bytes that are no byte pieces are the tokenizer's
        for i, (p, _, k) in enumerate(self.spec.pieces):
            if i not in self.silent and (k == BYTE) == bool(LOOKS_LIKE_BYTE.fullmatch(p)):
                self.spells[i] = bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode()
        self.begins = np.array([k == NORMAL and p.startswith(MARK) for p, _, k in self.spec.pieces])  # pieces at a word's start
        self.known: dict[bytes, bytes] = {}

    def blank(self, text: str) -> str:
        """The normalised text with blanks for marks."""
        if self.plain:
            return " " + text.replace(MARK, " ") if text else ""
        return self.tok.normalizer.normalize_str(text).replace(MARK, " ")

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as native 32-bit numbers; 256 words are one item of the multithreaded batch."""
        items = [words[k : k + 256] for k in range(0, len(words), 256)]
        out: list[bytes] = []
        for item, e in zip(items, self.bare.encode_batch_fast(items, is_pretokenized=True, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) != len(item) or any(w.rfind(MARK) for w in item):  # not each has its one mark in its first piece
                e = self.bare.encode_batch([item], is_pretokenized=True, add_special_tokens=False)[0]
                ids, cuts = np.array(e.ids, np.uint32), np.flatnonzero(np.diff(np.array(e.word_ids), prepend=-1))
            raw, at = ids.tobytes(), (4 * cuts).tolist()
            out += [raw[lo:hi] for lo, hi in zip(at, [*at[1:], len(raw)])]
        if self.spec.kind == UNIGRAM and self.spec.byte_fallback:
            usable = {p: i for i, (p, _, k) in enumerate(self.spec.pieces) if k == NORMAL}
            for k, w in enumerate(words):
                if LOOKS_LIKE_BYTE.search(w):
                    out[k] = array("I", best_path(w, self.spec, usable, max(map(len, usable)))).tobytes()
        return out

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, with blanks for marks, from memory where it has them."""
        found = list(map(self.known.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if new:
            fresh = dict(zip(new, self.word_ids([w.decode().replace(" ", MARK) for w in new])))
            if len(self.known) + len(new) > self.room:
                self.known.clear()
            self.known.update(fresh)
            found = [fresh[w] if x is None else x for w, x in zip(words, found)]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as native 32-bit numbers."""
        if self.split is None:
            return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        plain = [self.blank(t).encode() for t in texts]
        data = np.frombuffer(b"".join(plain), np.uint8)
        bounds = np.cumsum([0, *map(len, plain)])
        start = data == self.split  # a word begins with the first of its blanks, and with its text
        start[1:] &= data[:-1] != self.split
        start[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(start)
        ids, at = once(data, starts, self.learn, np.uint32)
        cuts = at[np.searchsorted(starts, bounds)].tolist()
        return [ids[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])]

    def decode(self, ids: list[Sequence[int]]) -> list[str]:
        """Texts from ids; pieces that no text gives, such as a text's begin and end, spell nothing.

        Pieces and byte pieces are joined as bytes. Where these are UTF-8, so is each run of byte pieces, and the
        tokenizer's decoder gives the same; where they are not, or an id is none of the model's, it decodes."""
        out: list[str | None] = []
        for x in ids:
            try:
                text = b"".join(map(self.spells.__getitem__, x)).decode()
                out.append(text.removeprefix(" ") if self.spec.prefix else text)
            except (KeyError, UnicodeDecodeError):
                out.append(None)
        odd = [k for k, t in enumerate(out) if t is None]
        for k, t in zip(odd, self.tok.decode_batch([[i for i in ids[k] if i not in self.silent] for k in odd], skip_special_tokens=False) if odd else []):
            out[k] = t
        return out

    def spelled(self, text: str) -> str:
        """What the ids of a text should decode to: the normalised text with blanks for marks."""
        plain = self.blank(text)
        return plain.removeprefix(" ") if self.spec.prefix else plain

    def verified(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """For each text: its ids, whether SentencePiece gives the same for the whole text, and whether they decode to
        the normalised text (where every character has a piece or falls back to bytes)."""
        raws = self.encode(texts)
        back, out = self.decode([array("I", x) for x in raws]), []
        for lo in range(0, len(texts), 256):
            theirs = self.own.encode(texts[lo : lo + 256], num_threads=1)
            out += [(raw, raw == array("I", y).tobytes(), z == self.spelled(t)) for t, raw, y, z in zip(texts[lo : lo + 256], raws[lo:], theirs, back[lo:])]
        return out


def loaded(path: str | None) -> Codec:
    """The codec of the model file at ``path``, kept for the life of the worker process."""
    kept = sys.__dict__.setdefault("_memlattice_pieces", {})
    if path not in kept:
        at = path
        if at is None:
            import public_tokenizers

            at = public_tokenizers.path("piece_bpe_32k.model")
        with open(at, "rb") as f:
            kept[path] = Codec(f.read())
    return kept[path]


def batches_of(texts: list[str | None], size: int = 1 << 22) -> Iterator[list[str]]:
    """Texts of about ``size`` characters together, or one that is longer."""
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(part[-1]) + 64
        if n > size:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str | None = None, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        codec = loaded(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [array("I", raw) for part in batches_of(texts) for raw in codec.encode(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else list(x) for t, x in zip(texts, ids)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for b in batches:
            ids = b.column(1).to_pylist()
            texts = codec.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t for x, t in zip(ids, texts)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, parity, round_trip) for each row: encoded, held against SentencePiece's ids for the
    whole text, decoded again in batches and held against the text, in one pass, so that ids need not be written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        codec = loaded(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            out = []
            for part in batches_of(texts):
                out += [(len(raw) // 4, zlib.crc32(raw), same, trip) for raw, same, trip in codec.verified(part)]
            cols = [[None if t is None else o[k] for t, o in zip(texts, out)] for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())))], names=["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op4_sentencepiece": op4_sentencepiece}
