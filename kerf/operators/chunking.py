"""Documents to chunks in one Arrow pass: no shuffle, one document in memory at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from kerf.kernels import engine
from kerf.plans.options import CHUNK_SCHEMA, Options

_EMPTY = {"breadcrumb": [], "heading_hierarchy": [], "parse_errors": [], "scope": [], "entities": [], "siblings": [], "imports": [], "format_metadata": {}}
#: Chunk rows of an Arrow batch at most, and characters of them.
ROWS, CHARS = 2048, 4 << 20


def chunk(docs: DataFrame, parsers: dict | None = None, **options) -> DataFrame:
    """Chunk rows of (doc_id, path, content), content a string or bytes.

    A document that can't be read or cut gives one row with ``error`` and no text; null, empty and blank ones give none.
    Filters on documents belong before this call: they aren't pushed through it.
    """
    o = Options.of(**options)
    schema: StructType = _parse_datatype_string(CHUNK_SCHEMA)
    arrow = to_arrow_schema(schema)
    registered = dict(engine.PARSERS if parsers is None else parsers)

    def run(batches):
        engine.PARSERS.update(registered)
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, path, content = (batch.column(i)[k].as_py() for i in range(3))
                try:
                    for r in engine.chunks(path, content, o):
                        rows.append({"doc_id": doc_id, "error": None, **r})
                        held += 2 * r["char_count"]
                        if len(rows) >= ROWS or held >= CHARS:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                except Exception as e:
                    rows.append({"doc_id": doc_id, "filepath": path, "error": f"{type(e).__name__}: {e}", **_EMPTY})
                    if len(rows) >= ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "path", "content").mapInArrow(run, schema)


def chunk_string(path: str, content: str, **options) -> list[dict]:
    """The chunk rows of one text, on the driver."""
    return engine.chunk(path, content, Options.of(**options))
