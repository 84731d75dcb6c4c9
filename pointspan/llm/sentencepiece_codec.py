"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed from its protobuf wire format and rebuilt: the
normaliser (precompiled character map, white space), the marker U+2581 for
spaces, the pieces with their scores as a unigram model, or as merges by
score where the model is of the BPE type, and bytes for unknown characters.
Before a tokenizer is used it is compared with the sentencepiece library on
``PARITY_TEXTS``; any difference is an error.

Where no piece has the marker after another character, nothing can join
across such a place, so the distinct words of a batch are encoded instead of whole
texts: the ids are the same.  Words are remembered with their packed ids up to
``MEMO_BYTES``, and forgotten at the end of a task, as Python workers outlive
it.  Batches hold about ``BATCH_CHARS`` characters and are encoded by several
threads; results leave batch by batch, so neither a long table nor a long text
adds up in a worker.

Defined results: a null or empty text has no ids and decodes to the empty
text; characters without a piece become bytes, or the unknown id where the
model has no bytes; a text round-trips if decoding gives it back exactly
(not so with a marker character in it, or where the normaliser changes it);
texts of over ``LONG`` characters are cut before single spaces where nothing
joins across them, which leaves their ids as they are; repeated rows give
repeated results; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import ctypes
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BATCH_CHARS, LONG = 1_000_000, 1_000_000
#: What remembered words may take in a worker, and what one takes besides its characters and ids.
MEMO_BYTES, ENTRY = 48_000_000, 200
THREADS = 2
PARITY_PIECES = 200
#: Piece types and model types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PARITY_TEXTS = (
    "", " ", "a", "  two  spaces ", "A line.\nAnother\tline.\r\n", "Größe, façade, niño, Ærøskøbing", "数据 и данные", "emoji \U0001f600\U0001f9d1‍\U0001f680 end",
    "x" * 300, "1234567890 3.14159 1e-9", "if (a<b) { return a[0]; }", "▁marked▁", "ends with space ", "\x00\x01control", "tab\t\ttab", "İstanbul ǅ ﬁne ½", "the the the the", "   ", "\n\n\n",
)


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> Spec:
    spec = Spec()
    for number, value in wire(data):
        if number == 1:
            own = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(wire(value))
            spec.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0], own[3]))
        elif number == 2:
            own = dict(wire(value))
            spec.model_type, spec.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(wire(value))
            spec.charsmap = own.get(2, b"")
            spec.dummy_prefix, spec.squeeze, spec.escape = (bool(own.get(i, 1)) for i in (3, 4, 5))
    return spec


class Codec:
    """Encodes and decodes batches of texts; built once in each Python worker."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.spec = parse_model(data)
        self.bytes_of = [self._bytes(p, kind) for p, _, kind in self.spec.pieces]
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in self.spec.pieces if kind in (NORMAL, USER_DEFINED))
        self.by_word = not inner and not any(kind == USER_DEFINED for _, _, kind in self.spec.pieces)
        self.plain = self.spec.escape and not self.spec.squeeze and not self.spec.charsmap
        self.later = self._build(False)
        self.first = self._build(True) if self.spec.dummy_prefix and not (self.by_word and self.plain) else self.later
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.room = MEMO_BYTES

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def _build(self, prefix: bool):
        from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers

        pieces = self.spec.pieces
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        if self.spec.model_type == UNIGRAM:
            # Pieces that no text may match get a name of noncharacters.
            hidden = (CONTROL, UNUSED, UNKNOWN)
            named = [(f"\U0010ffff{i}\U0010ffff" if kind in hidden else p, s) for i, (p, s, kind) in enumerate(pieces)]
            model = models.Unigram(named, unk_id=unknown, byte_fallback=self.spec.byte_fallback)
        elif self.spec.model_type == BPE:
            ids = {p: i for i, (p, _, _) in enumerate(pieces)}
            usable = {p: s for p, s, kind in pieces if kind == NORMAL}
            merges = [(-s, ids[p], k, p) for p, s in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            model = models.BPE(ids, [(p[:k], p[k:]) for _, _, k, p in sorted(merges)], unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=self.spec.byte_fallback)
        else:
            raise ValueError(f"model type {self.spec.model_type} is not supported")
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.spec.charsmap)] if self.spec.charsmap else []
        if self.spec.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if prefix:
            steps.append(normalizers.Prepend(MARK if self.spec.escape else " "))
        if self.spec.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if steps:
            out.normalizer = normalizers.Sequence(steps)
        if self.by_word:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        # Pieces that the model's user defined are never split.
        out.add_tokens([AddedToken(p, normalized=True) for p, _, kind in pieces if kind == USER_DEFINED])
        return out

    def parts(self, text: str) -> list[str]:
        """A very long text cut before single runs of spaces."""
        if not self.by_word or self.spec.squeeze or len(text) <= LONG:
            return [text]
        out, at = [], 0
        while len(text) - at > LONG:
            end = text.find(" ", at + LONG // 2)
            while end > 0 and text[end - 1] in (" ", MARK):
                end = text.find(" ", end + 1)
            if end <= at:
                break
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        for _, ids in self.batches(texts):
            yield from ids

    def batches(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[list[int]]]]:
        """Where each batch of about ``BATCH_CHARS`` characters starts, and the ids of its texts."""
        waiting, chars, start = [], 0, 0
        for at, text in enumerate(texts):
            waiting.append(text or "")
            chars += len(waiting[-1])
            if chars >= BATCH_CHARS:
                yield start, list(self._encode(waiting))
                waiting, chars, start = [], 0, at + 1
        if waiting:
            yield start, list(self._encode(waiting))

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        if self.by_word and self.plain:
            yield from self._encode_words(texts)
            return
        split = [self.parts(t) for t in texts]
        heads = self.first.encode_batch_fast([p[0] for p in split], add_special_tokens=False)
        for text, pieces, head in zip(texts, split, heads, strict=True):
            ids = head.ids if text else []
            for piece in pieces[1:]:
                ids = ids + self.later.encode_batch_fast([piece], add_special_tokens=False)[0].ids
            yield ids

    def _encode_words(self, texts: list[str]) -> Iterator[list[int]]:
        """Each distinct word of the batch goes through the tokenizer once; the first ones are remembered."""
        head = MARK if self.spec.dummy_prefix else ""
        split = [self.words((head + t).replace(" ", MARK)) if t else [] for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        found = {w: array("i", e.ids).tobytes() for w, e in zip(new, self.later.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        known = self.known
        known |= found
        for words in split:
            yield np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32).tolist()
        for word, ids in found.items():
            self.room -= len(word) + len(ids) + ENTRY
            if self.room < 0:
                self.room += len(word) + len(ids) + ENTRY
                del known[word]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.spec.dummy_prefix and text[:1] == " " else text

    def own_texts(self) -> list[str]:
        """Texts that hold pieces of the model itself: of each type, the longest ones and some throughout."""
        out = []
        for kind in (NORMAL, USER_DEFINED, UNUSED, CONTROL, UNKNOWN):
            own = [p.replace(MARK, " ") for p, _, k in self.spec.pieces if k == kind]
            some = own[:: max(1, len(own) // PARITY_PIECES)] + sorted(own, key=len)[-PARITY_PIECES:]
            out += [f"{p} a{p}b {p}{p}" for p in some]
        return out

    def verify(self, data: bytes, texts=PARITY_TEXTS) -> None:
        """Raise if the ids or texts differ from those of the sentencepiece library."""
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=data)
        texts = [*texts, *self.own_texts()]
        for text, ids in zip(texts, self.encode(texts), strict=True):
            if ids != own.encode(text) or self.decode(ids) != own.decode(ids):
                raise ValueError(f"no parity with the model's own library: {text[:80]!r}")


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker keeps it else while other stages run."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


@lru_cache(maxsize=2)
def codec_of(data: bytes) -> Codec:
    """The worker's codec, kept from task to task."""
    return Codec(data)


def read_model(spark, path: str) -> bytes:
    """The model file, of a few MB at most, from a path on the driver."""
    with open(path, "rb") as f:
        return f.read()


def sentencepiece(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids, round_trip`` and the columns in ``keep``."""
    data = read_model(docs.sparkSession, model)
    Codec(data).verify(data)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data)
        try:
            for batch in batches:
                for start, found in codec.batches(t.as_py() for t in batch.column(1)):
                    part = batch.slice(start, len(found))
                    own = part.column(1).to_pylist()
                    same = [codec.decode(ids) == (text or "") for text, ids in zip(own, found, strict=True)]
                    lengths = [len(ids) for ids in found]
                    values = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=sum(lengths))
                    ids = pa.ListArray.from_arrays(pa.array([0, *accumulate(lengths)], pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), ids, pa.array(same, pa.bool_()), *part.columns[2:]], names)
        finally:
            codec.forget()  # the worker lives on
            give_back()

    rest = docs.select(*keep).schema.fields
    names = ["doc_id", "n_tokens", "ids", "round_trip", *keep]
    schema = "doc_id long, n_tokens long, ids array<int>, round_trip boolean" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(k).alias(f"_{k}") for k in keep]).mapInArrow(each, schema)
