"""Arrow batches in parts that a worker can take apart."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that a worker holds as Python's objects at once, about; a longer text is a part of its own.
MOST_BYTES = 2 << 20


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in parts of up to ``most`` bytes of a text or binary column. A batch of Spark has thousands of rows, however long they are;
    a part is a view of it."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
            yield b.slice(at, stop - at)
            at = stop
