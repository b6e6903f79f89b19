"""SentencePiece encoding and decoding on the tokenizers library.

``SpModel.parse`` reads the model file's protobuf: pieces with score and type,
model kind, byte fallback, and the normaliser's settings.  ``Codec`` rebuilds
from them

* the normaliser: the precompiled character map if there is one, white space
  collapsing, dummy prefix, and the marker U+2581 for spaces;
* the model: unigram scores as they are, or BPE merges ordered by the score of
  the piece they make; bytes of unknown characters as byte pieces;
* the decoder.

A long text is cut where a marker follows another character, but only if no
piece has a marker inside (checked on the vocabulary): there no piece and no
merge can cross, so whole texts are encoded exactly, in bounded memory.  Each
slice of a batch is one multithreaded call of the library.  ``verify_parity`` compares ids with the sentencepiece library; every
Python worker runs it on fixed probes before its first batch and fails on a
difference.  The model file is read by the driver from the path it is given
and shipped in the closure (0.5 MB), so executors need no file.

Defined results: null and empty texts have no ids and decode to the empty
string; lone surrogates are replaced by ``?``; control pieces never come from
text; rows repeating an id are encoded each on its own.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "▁"
# Fixed values of the model format: piece types and model kinds.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PROBES = ["", " ", "a", "Hello  world", "  lead and trail  ", "tabs\tand\nlines\n\n", "Ünïcödé ñ é ß", "中文 \U0001d4b3 \U0001f600",
          "</s><s><0x0A><unk>", "▁mark▁", "aaaaaaaaa bbbb ==== ----", "1234567890 3.14", "\x00\x01​﻿"]
BATCH_CHARS, PIECE_CHARS = 1 << 18, 1 << 16
_BOUNDARY = re.compile(f"[^{MARKER}](?={MARKER})")


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: ints, 32-bit floats or bytes."""
    at, n = 0, len(buf)

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7
    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, buf[at:at + size]
            at += size
        elif kind == 5:
            yield key >> 3, struct.unpack_from("<f", buf, at)[0]
            at += 4
        elif kind == 1:
            yield key >> 3, buf[at:at + 8]
            at += 8
        else:
            raise ValueError(f"not a SentencePiece model: wire type {kind}")


@dataclass
class SpModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True
    unk_surface: str = " ⁇ "

    @classmethod
    def parse(cls, data: bytes) -> SpModel:
        m = cls()
        for num, value in _fields(data):
            if num == 1:
                p = dict(_fields(value))
                m.pieces.append((p.get(1, b"").decode("utf-8"), p.get(2, 0.0), p.get(3, NORMAL)))
            elif num == 2:
                t = dict(_fields(value))
                m.kind, m.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
                m.suffix_marker = bool(t.get(24, 0))
                m.unk_surface = t[44].decode("utf-8") if 44 in t else m.unk_surface
            elif num == 3:
                s = dict(_fields(value))
                m.charsmap = s.get(2, b"")
                m.dummy_prefix, m.collapse_spaces, m.escape_spaces = (bool(s.get(i, 1)) for i in (3, 4, 5))
        if m.kind not in (UNIGRAM, BPE) or m.suffix_marker or not m.escape_spaces:
            raise ValueError("unsupported SentencePiece model settings")
        return m


class Codec:
    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, decoders, models, normalizers
        m = self.model = SpModel.parse(data)
        self._spelled = None
        self._charsmap = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        names = [p for p, _, _ in m.pieces]
        usable = {p: i for i, (p, _, t) in enumerate(m.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        unk = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
        if m.kind == BPE:
            merges = [(-m.pieces[i][1], len(p[:k]), p[:k], p[k:]) for p, i in usable.items() for k in range(1, len(p))
                      if p[:k] in usable and p[k:] in usable]
            merges.sort(key=lambda x: (x[0], usable[x[2] + x[3]], x[1]))
            core = models.BPE(vocab={p: i for i, p in enumerate(names)}, merges=[(a, b) for _, _, a, b in merges],
                              unk_token=names[unk] if unk is not None else None, byte_fallback=m.byte_fallback, fuse_unk=True,
                              cache_capacity=0)    # texts are not words: caching them only costs memory
        else:
            # Pieces that never come from text get names that no text holds.  Byte pieces keep theirs, which the
            # fallback looks up; a text that spells one is cut inside the name (see ``_cut``).
            low = min((s for _, s, t in m.pieces if t == NORMAL), default=0.0)
            from_text = set(usable.values())
            core = models.Unigram([(p if i in from_text or t == BYTE else f"\U0010ffff{i}\U0010ffff",
                                    s if t in (NORMAL, USER_DEFINED, UNUSED) else low)
                                   for i, (p, s, t) in enumerate(m.pieces)], unk_id=unk, byte_fallback=m.byte_fallback)
            self._spelled = re.compile(r"<(?=0x[0-9A-F]{2}>)") if m.byte_fallback else None
            if m.byte_fallback and any("<0" in p for p in usable):
                raise ValueError("unsupported SentencePiece model: a piece reaches into byte names")
        self.tokenizer = Tokenizer(core)
        #: no piece reaches over a marker that follows another character
        self.cuttable = not any(re.search(f"[^{MARKER}]{MARKER}", p) for p in usable)
        self._surfaces = [b"" if t == CONTROL else m.unk_surface.encode() if t == UNKNOWN else
                          bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARKER, " ").encode()
                          for p, _, t in m.pieces]
        steps = [decoders.Replace(MARKER, " ")]
        if m.byte_fallback:
            steps.append(decoders.ByteFallback())
        steps.append(decoders.Fuse())
        if m.dummy_prefix:
            steps.append(decoders.Strip(" ", 1, 0))
        self.tokenizer.decoder = decoders.Sequence(steps)
        self.control = {i for i, p in enumerate(m.pieces) if p[2] == CONTROL}

    def normalize(self, text: str | None) -> str:
        text = (text or "").encode("utf-8", "replace").decode("utf-8")
        if self._charsmap is not None:
            text = self._charsmap.normalize_str(text)
        if self.model.collapse_spaces:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        return (MARKER if self.model.dummy_prefix else "") + text.replace(" ", MARKER)

    def surface(self, text: str | None) -> str:
        """What a text's ids decode to: the normalised text with spaces for markers."""
        t = self.normalize(text).replace(MARKER, " ")
        return t[1:] if self.model.dummy_prefix and t else t

    def _cut(self, text: str) -> list[str]:
        """Normalised text in pieces of about PIECE_CHARS characters that no merge reaches over."""
        if self._spelled is not None and "<0x" in text:
            at = [0, *(m.end() for m in self._spelled.finditer(text)), len(text)]
            return [p for a, z in zip(at, at[1:]) for p in self._long(text[a:z])]
        return self._long(text)

    def _long(self, text: str) -> list[str]:
        if not self.cuttable or len(text) <= PIECE_CHARS:
            return [text] if text else []
        out, at = [], 0
        while len(text) - at > PIECE_CHARS:
            m = _BOUNDARY.search(text, at + PIECE_CHARS - 1)
            if not m:
                break
            out.append(text[at:m.end()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts, encoded in one multithreaded batch."""
        cuts = [self._cut(self.normalize(t)) for t in texts]
        ids = iter(self.tokenizer.encode_batch_fast(list(chain.from_iterable(cuts)), add_special_tokens=False))
        return [np.concatenate([np.zeros(0, np.int32), *(np.array(next(ids).ids, np.int32) for _ in c)]) for c in cuts]

    def decode(self, ids: list) -> list[str]:
        """Texts of id sequences; control pieces have no surface.  Where the bytes of the pieces are
        valid UTF-8 they are the text; else the library's byte fallback replaces the bad ones."""
        out = []
        for x in ids:
            x = x.tolist() if isinstance(x, np.ndarray) else list(x)
            raw = b"".join(map(self._surfaces.__getitem__, x))
            try:
                text = raw.decode("utf-8")
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode([i for i in x if i not in self.control], skip_special_tokens=False))
        return out


def verify_parity(codec: Codec, data: bytes, texts: list[str]) -> list[int]:
    """Positions of texts whose ids differ from the sentencepiece library's."""
    import sentencepiece
    ref = sentencepiece.SentencePieceProcessor(model_proto=data)
    return [i for i, (a, b) in enumerate(zip(codec.encode(texts), ref.encode(texts, num_threads=1))) if list(a) != list(b)]


_codecs: dict[bytes, Codec] = {}


def codec_for(data: bytes, threads: int | None = None) -> Codec:
    """One verified codec per Python worker."""
    if data not in _codecs:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        if threads:
            os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        codec = Codec(data)
        wrong = verify_parity(codec, data, PROBES)
        if wrong:
            raise ValueError(f"ids differ from sentencepiece on probes {wrong}")
        _codecs[data] = codec
    return _codecs[data]


def encode_table(docs: DataFrame, model_path: str, keep: list[str], text: str = "text", threads: int = 2) -> DataFrame:
    """``keep`` columns plus ``ids array<int>``, ``n_tokens`` and ``round_trip`` (the ids decode to the
    normalised text), one row per row.  Slices of about ``BATCH_CHARS`` characters leave a task one
    by one, so that its memory does not depend on how many rows a batch holds."""
    with open(model_path, "rb") as f:
        data = f.read()
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(data, threads)
        for b in batches:
            texts = b.column(len(keep))
            lo = 0
            while lo < b.num_rows:
                part, size = [], 0
                while lo + len(part) < b.num_rows and (not part or size < BATCH_CHARS):
                    part.append(texts[lo + len(part)].as_py())
                    size += len(part[-1] or "")
                ids = codec.encode(part)
                same = [codec.surface(t) == d for t, d in zip(part, codec.decode(ids))]
                ends = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                cols = [b.column(j).slice(lo, len(part)) for j in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(np.diff(ends), pa.int32()),
                     pa.array(same, pa.bool_())], names=[*keep, "ids", "n_tokens", "round_trip"])
                lo += len(part)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
