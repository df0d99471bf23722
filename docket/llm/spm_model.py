"""Reader of SentencePiece model files (the public protobuf layout), without the protobuf library."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

# Fixed values of the file format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"


@dataclass
class SpmModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, type
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    treat_whitespace_as_suffix: bool = False

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def parse(data: bytes) -> SpmModel:
    """Model file bytes -> pieces, scores and the settings of trainer and normaliser."""
    model = SpmModel()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
            model.pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            model.model_type = f.get(3, UNIGRAM)
            model.byte_fallback = bool(f.get(35, 0))
            model.treat_whitespace_as_suffix = bool(f.get(24, 0))
        elif number == 3:
            f = dict(_fields(value))
            model.charsmap = f.get(2, b"")
            model.add_dummy_prefix = bool(f.get(3, 1))
            model.remove_extra_whitespaces = bool(f.get(4, 1))
            model.escape_whitespaces = bool(f.get(5, 1))
    if model.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    if model.treat_whitespace_as_suffix or not model.escape_whitespaces:
        raise ValueError("models with white space as suffix or unescaped white space are not supported")
    if any(t == USER_DEFINED for _, _, t in model.pieces):
        raise ValueError("models with user-defined pieces are not supported")
    return model
