"""Token-ID / binary output: texts to token files and back.

Documents are dealt by ranges of their id, so file after file holds them in
ascending order. Each task writes its range under a temporary name that no
other attempt uses and renames it; a table of the finished files (one row a
file) is then written, and only files it names belong to the dataset. A lost
executor costs its own files; a task that runs twice leaves at worst a file
that no table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import Store, shared_dir, shuffle_partitions, written

FILES = "part int, seq int, file string, n_docs bigint, n_ids bigint, n_bytes bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string"
#: Ids after which a file is closed and the next one begun.
FILE_IDS = 64_000_000


def write_token_files(docs: DataFrame, tokenizer: str, root: str, end_id: int = 0, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all of ``docs`` below ``root``; returns the table of files.

    Null text counts as empty (its ids are ``end_id`` alone). A very long text is
    one document of one file, in as many blocks as it needs. Null ids come first; rows with equal ids stand in the order of a hash of their text.
    ``base``: the number of ids in all files before.
    """
    n = shuffle_partitions(docs.sparkSession)

    def write(batches):
        import struct
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from palisade.llm.cells import packer
        from palisade.llm.pfor import Writer

        part, encoder, store, end = TaskContext.get().partitionId(), packer(tokenizer), Store(root), struct.pack("<I", end_id)
        done, writer, temp = [], None, ""

        def finish():
            name = f"ids-{part:06d}-{len(done):04d}-{uuid.uuid4().hex[:8]}.pfor"
            writer.close()
            store.rename(temp, name)
            done.append((part, len(done), name, writer.n_docs, writer.n_ids, writer.n_bytes))

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()])):
                if writer is None:
                    temp = f"_tmp-{part:06d}-{uuid.uuid4().hex}"
                    writer = Writer(store.create(temp))
                writer.add(doc_id, ids + end)
                if writer.n_ids >= file_ids:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    files = written(dealt.mapInArrow(write, FILES), f"{root}/manifest")
    # one row a file: small enough for one task at any size
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, root: str) -> DataFrame:
    """Per document, from the files: its id, the ids before it in the whole
    dataset, its number of ids, and their crc32."""
    n = shuffle_partitions(files.sparkSession)

    def read(batches):
        import zlib

        import pyarrow as pa

        from palisade.llm.pfor import Reader

        store = Store(root)
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "file"]
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open(name) as f:
                    r, held = Reader(f), []
                    for k, start, ids in r.documents():
                        held.append((None if r.null[k] else int(r.doc_ids[k]), base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name))
                        if len(held) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=names)

    return files.select("file", "base").repartition(n, "file").mapInArrow(read, ROWS)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, root: str | None = None) -> DataFrame:
    """Write the files, then read every document back from them."""
    root = root or shared_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, root, end_id), root)
