"""Scans that add columns to documents, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with about ``most`` bytes of text."""
    raw = column.cast(pa.binary())
    sizes = np.asarray(pc.fill_null(pc.binary_length(raw), 0))
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield start, i - start
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes) - start


def annotate(
    docs: DataFrame,
    factory: Callable[[], Callable[[list[bytes]], Sequence]],
    added: str,
    *,
    text: str = "text",
    keep: Sequence[str] | None = None,
    accept: Callable[[Sequence], np.ndarray] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``docs`` (its columns in ``keep``, default all) with the columns of the DDL string ``added``.

    ``factory()`` is called once per task and gives the function from a list of UTF-8 texts to
    the added columns. With ``accept`` only the rows it marks stay, and no column is added. An
    added column replaces one of the same name, whatever its case.
    """
    new = StructType.fromDDL(added)
    taken = set() if accept else {f.name.lower() for f in new.fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    read = [*kept, *([text] if text not in kept else [])]
    source = docs.select(*[f"`{c}`" for c in read])
    out = [source.schema[c] for c in kept] + ([] if accept else new.fields)
    kinds = [_arrow(f.dataType) for f in new.fields]
    names = [f.name for f in out]
    at = read.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = factory()
        for batch in batches:
            for start, length in slices(batch.column(at), slice_bytes):
                part = batch.slice(start, length)
                made = compute(utf8(part.column(at)))
                if accept:
                    part = part.filter(pa.array(np.asarray(accept(made), dtype=bool)))
                columns = [part.column(i) for i in range(len(kept))]
                if not accept:
                    columns += [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds)]
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, StructType(out))


def _arrow(kind) -> pa.DataType:
    return to_arrow_type(kind)
