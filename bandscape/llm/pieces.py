"""Vocabularies of pieces with scores, as published for SentencePiece."""

from __future__ import annotations

from typing import NamedTuple

import sentencepiece

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Vocabulary(NamedTuple):
    """Ordinary pieces with their ids and scores; ids of the 256 byte pieces."""

    pieces: list[str]
    ids: list[int]
    scores: list[float]
    bytes_: list[int]
    size: int


def load(path: str = MODEL) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    ids = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Vocabulary([model.id_to_piece(i) for i in ids], ids, [model.get_score(i) for i in ids],
                      [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], size)
