"""Rows of a file that come in several batches make one file."""

import pyarrow as pa

from kinetable.sources import files


def test_groups_go_on_over_batches():
    batch = lambda names, values: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.int64())], ["file", "v"])
    batches = [batch(["a", "a", "b"], [1, 2, 3]), batch([], []), batch(["b"], [4]), batch(["b", "c"], [5, 6]), batch(["d"], [7])]
    got = [(n, t["v"].to_pylist()) for n, t in files.file_groups(iter(batches))]
    assert got == [("a", [1, 2]), ("b", [3, 4, 5]), ("c", [6]), ("d", [7])]
    assert list(files.file_groups(iter([]))) == []
