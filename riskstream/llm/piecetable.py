"""The pieces of a SentencePiece vocabulary file, found in many strings at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = "▁"
CELLS = 1 << 21  # of the lattices computed at once

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TABLES: dict[str, PieceTable] = {}


def gather(parts: list[bytes], order: np.ndarray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The items of ``parts`` in the given order one after the other, and how many each has."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // dtype.itemsize
    starts = np.cumsum(sizes) - sizes
    lengths = sizes[order]
    at = np.repeat(starts[order] - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return np.frombuffer(b"".join(parts), dtype)[at], lengths


def equal_lengths(strings: list[str], most: int) -> Iterator[np.ndarray]:
    """Numbers of strings of equal length, so many that ``most`` cells for each character stay below ``CELLS``."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(lengths, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(same):
            step = max(1, CELLS // (most * (int(lengths[same[0]]) + 1)))
            for i in range(0, len(same), step):
                yield same[i:i + step]


def code_points(strings: list[str]) -> np.ndarray:
    """Code points of strings of equal length, a row each."""
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), -1).astype(_U)


def _running(codes: np.ndarray) -> np.ndarray:
    """Running polynomial hashes of each row, one more column than ``codes``."""
    h = np.zeros((codes.shape[0], codes.shape[1] + 1), _U)
    for i in range(codes.shape[1]):
        h[:, i + 1] = h[:, i] * _BASE + codes[:, i] + _U(1)
    return h


class PieceTable:
    """Pieces other than control, unknown and byte pieces, numbered from 0."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.vocabulary_size = n
        self.ids = np.array([i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
                                                         or sp.is_byte(i))])
        self.pieces = [sp.id_to_piece(int(i)) for i in self.ids]
        self.scores = np.array([sp.get_score(int(i)) for i in self.ids])
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.size, self.max_len = len(self.pieces), max(map(len, self.pieces))
        hashes = np.array([_running(code_points([p]))[0, -1] for p in self.pieces], _U)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int32)
        self.powers = [_U(pow(int(_BASE), i, 1 << 64)) for i in range(self.max_len + 1)]

    def edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length the number of the piece that begins at each place of each row, -1 where there is none."""
        h, width, out = _running(codes), codes.shape[1], []
        for k in range(1, min(self.max_len, width) + 1):
            part = h[:, k:] - h[:, :width + 1 - k] * self.powers[k]
            at = np.minimum(np.searchsorted(self.hashes, part), self.size - 1)
            out.append(np.where(self.hashes[at] == part, self.numbers[at], -1))
        return out


def piece_table(path: str) -> PieceTable:
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]
