"""A unigram model over the pieces of a SentencePiece file.

A space is written as the piece letter U+2581, and one is put before the text; no piece holds that
letter after another one, so a text's best segmentation is that of its words, each with the letter
before it. The score of a piece is -log(1 + rank), in whole millionths, with the rank that the file's
scores give (they are minus the rank). Of the pieces that the file never forms by merging (score below
-10^8: runs of the space letter) only the letter itself is used, as the worst piece. A character that is no piece is written as its UTF-8 bytes, each at the worst piece's score
less 10. The best segmentation has the greatest score, of those the fewest pieces, of those the
longest last piece.
"""

from __future__ import annotations

import math
from functools import lru_cache

SPACE = "▁"
PENALTY = 10.0
UNIT = 1_000_000


class Unigram:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_ids: dict[int, int] = {}
        #: piece → (id, score)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.raw: list[bytes] = [b""] * size
        for i in range(size):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.raw[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.raw[i] = piece.replace(SPACE, " ").encode()
                if score > -1e8:
                    self.pieces[piece] = (i, -round(UNIT * math.log(1 - score)))
        worst = min((s for _, s in self.pieces.values()), default=0)
        self.pieces.setdefault(SPACE, (model.piece_to_id(SPACE), worst))
        self.longest = max(map(len, self.pieces), default=1)
        self.byte_score = worst - round(UNIT * PENALTY)

    def bytes_of(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]

    def byte_cost(self, c: str) -> tuple[int, int]:
        """Score and number of the byte pieces of a character."""
        n = len(c.encode("utf-8", "surrogatepass"))
        return n * self.byte_score, n


def words_of(text: str) -> list[str]:
    """The pre-tokens of a text; a leading space letter stands for the space before each."""
    return text.split(" ") if text else []


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(path)
