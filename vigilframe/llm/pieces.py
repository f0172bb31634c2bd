"""The fixed public piece vocabulary and its lattice over words (operators 3 and 9)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces by text, their scores, the pieces that stand for single bytes, and hashes for lookups in numpy."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
        self.longest = max(map(len, self.ids))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[str]] = {}
        for piece in self.ids:
            by_length.setdefault(len(piece), []).append(piece)
        for length, pieces in by_length.items():
            h = prefix_hashes(code_points(pieces, length))[:, -1]
            order = np.argsort(h)
            self.tables[length] = (h[order], np.array([self.ids[p] for p in pieces])[order])

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Ids of the substrings of this length with these hashes, -1 where no piece has it."""
        known, ids = self.tables.get(length, (None, None))
        if known is None:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, ids[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str | None) -> Vocabulary:
    """The worker's vocabulary; None: the public file installed on it."""
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path(VOCABULARY))


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, column 0 of the empty one; a substring's hash is h[e] - h[s] * BASE**(e - s)."""
    h = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    for t in range(points.shape[1]):
        h[:, t + 1] = h[:, t] * _BASE + points[:, t] + np.uint64(1)
    return h


def edges(vocab: Vocabulary, words: list[str], length: int):
    """Yields (start, end, ids) in order of end for words of one length; ids are -1 where no piece fits."""
    h = prefix_hashes(code_points(words, length))
    power = np.full(vocab.longest + 1, _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    for end in range(1, length + 1):
        for start in range(max(0, end - vocab.longest), end):
            yield start, end, vocab.find(h[:, end] - h[:, start] * power[end - start], end - start)
