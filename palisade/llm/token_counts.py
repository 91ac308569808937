"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries (see ``cells``), cells go to the library in
calls of about equal bytes, and only numbers come back. A very long text is cut like
others, so the library sees no more of it at once than a call's bytes, unless it has
a longer stretch without a safe boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, UTF-8 bytes, tokens, tokens > ``limit``.

    Null and empty text: 0 bytes, 0 tokens. Null ids and repeated rows stay, a row each.
    Empty tables give empty results; other columns are not read.
    """

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from palisade.llm.cells import counter

        encoder = counter(tokenizer)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            n = pa.array(encoder.encode(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n, pc.greater(n, pa.scalar(limit, pa.int64()))],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(count, SCHEMA)
