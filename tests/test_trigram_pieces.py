"""Postings are made of a bounded amount of text at once."""

import numpy as np

from tidepanel.operators import trigrams


def test_pieces_are_bounded_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(trigrams, "BATCH", 4)
    monkeypatch.setattr(trigrams, "PIECE_BYTES", 10)
    size = np.array([3, 3, 3, 3, 50, 0, 0, 0, 0, 0, 10, 1])
    found = list(trigrams.pieces(size))
    assert [k for a, b in found for k in range(a, b)] == list(range(len(size)))
    assert all(b - a <= 4 and (size[a:b].sum() <= 10 or b - a == 1) for a, b in found)
    assert list(trigrams.pieces(np.array([], int))) == []
