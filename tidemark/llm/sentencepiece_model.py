"""SentencePiece model files read from their protobuf bytes, and the same tokenizer rebuilt on the tokenizers library."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Fixed values of the model format: piece types, model types, the space marker.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    treat_whitespace_as_suffix: bool = False
    charsmap: bytes = b""
    unknown: str = " \u2047 "  # how the unknown piece is written


def fields(data: bytes):
    """(number, value) of each protobuf field: int for varints and fixed widths, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield number, int.from_bytes(data[at : at + n], "little")
            at += n
        else:
            raise ValueError(f"wire type {wire} in a model file")


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v.to_bytes(4, "little"))[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.model_type = v
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 44:
                    model.unknown = v.decode("utf-8")
                elif n == 24:
                    model.treat_whitespace_as_suffix = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    if model.model_type not in (UNIGRAM, BPE) or model.treat_whitespace_as_suffix or not model.escape_whitespaces:
        raise ValueError("only unigram and BPE models with a leading space marker are supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs that join into a piece, best score first; equal scores by the joined piece's id, then the longer left part."""
    ids = {p: i for i, (p, _, k) in enumerate(model.pieces) if k in (NORMAL, USER_DEFINED)}
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind in (NORMAL, USER_DEFINED):
            found += [(-score, i, -cut, piece[:cut], piece[cut:]) for cut in range(1, len(piece)) if piece[:cut] in ids and piece[cut:] in ids]
    return [(a, b) for *_, a, b in sorted(found)]


def splits_at_mark(model: Model) -> bool:
    """Whether no piece holds the marker after another character: words can then be encoded one by one."""
    return not any(MARK in p.lstrip(MARK) for p, _, k in model.pieces if k in (NORMAL, USER_DEFINED))


def build(model: Model):
    """The tokenizer on the tokenizers library: normaliser, marker, scores (or merges by score) and byte fallback."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next(i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN)
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=20_000)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(rf"\A +|[ {MARK}]+\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if splits_at_mark(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out
