"""Encoders over Arrow batches of many tokens."""

import pyarrow as pa

from glyphlake.operators import encoders
from glyphlake.operators.encoders import _hashed, _in_slices, _weighted


def test_batches_are_encoded_a_few_rows_at_a_time(monkeypatch):
    rows = [[f"w{(i * j) % 97}" for j in range(i % 30)] if i % 11 else None for i in range(2000)]
    column, seen = pa.array(rows, pa.list_(pa.string())), []

    def counted(part):
        seen.append(len(part))
        return _weighted(part)

    monkeypatch.setattr(encoders, "SLICE_ROWS", 300)
    whole = [None if m is None else sorted(m) for m in _weighted(column).to_pylist()]
    assert [None if m is None else sorted(m) for m in _in_slices(column, counted).to_pylist()] == whole
    assert max(seen) == 300 and sum(seen) == 2000
    assert _in_slices(column, lambda part: _hashed(part, 384)).equals(_hashed(column, 384))
    none = column.slice(0, 0)
    assert len(_in_slices(none, _weighted)) == 0 and len(_in_slices(none, lambda part: _hashed(part, 384))) == 0
