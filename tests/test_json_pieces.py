from __future__ import annotations

from fieldlens.sources import json_ranges


def test_json_ranges_look_at_small_pieces():
    """The arrays of a piece are many times as large as it is, whatever is read at a time."""
    seen = []

    class Long:
        def chunks(self, ahead=False):
            yield 7, bytes(3 * json_ranges.PIECE_BYTES + 5)

    for at, data in json_ranges._pieces(Long()):
        seen.append((at, len(data)))
    size = json_ranges.PIECE_BYTES
    assert size <= 1 << 20 and seen == [(7, size), (7 + size, size), (7 + 2 * size, size), (7 + 3 * size, 5)]
