"""Token counts: batch encoding in Arrow functions that return lengths only.

token_counts(docs, path) adds nothing to the plan but one map over Arrow batches: no shuffle, no state but a bounded cache.
Batches for the library are balanced by bytes, and texts are cut at boundaries where no token can reach across (tokens.py),
so a text of any length costs memory for its own pieces only.

Cases: null text counts as empty: 0 bytes, 0 tokens. Repeated rows and ids give a row each. An empty table gives an empty
result. Other columns, whatever their names, are not read; columns to keep are named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import arrow_schema, released
from skyloom.llm.tokens import encoder

#: Rows are handed to the encoder in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of about `limit` bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if i > start and held + n > limit:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(size) > start:
        yield start, len(size) - start


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """keep..., n_bytes long, n_tokens long, over_limit boolean (more than `limit` tokens) for every row of docs."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", n_bytes long, n_tokens long, over_limit boolean"
    schema = arrow_schema(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, n in slices(texts):
                own = texts.slice(start, n)
                counts, _ = coder.encode(own, ids=False)
                n_bytes = pc.fill_null(pc.binary_length(own), 0).cast(pa.int64())
                columns = [c.slice(start, n) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, n_bytes, pa.array(counts), pa.array(counts > limit)], schema=schema)

    return kept.mapInArrow(released(count), ddl)
