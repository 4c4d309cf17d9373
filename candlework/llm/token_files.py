"""Token-id files: Parquet list columns in document order, made for selective reads.

Each file holds a range of document ids in ascending order, one row a document: its id, the file's part number, the count
of ids before it in its part, its own count, and its ids as a list. Row groups are small, pages hold a bounded number of
rows and have column indexes, so a reader finds a document by its id's statistics and reads only its pages; counts can be
read without ids. Ids are dictionary encoded, the ascending columns delta encoded (version 2 pages).

Plan: one range shuffle of the texts by id, and of equal ids by the beginning of the text, into as many parts as their
bytes need, a sort inside partitions, encoding in the task that writes. Starts are
prefix sums in two steps: inside a part when it is written, and over parts from one sum a part when it is read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm._bpe import encoder, texts

#: Fixed values of the format: bytes of a row group, bytes and rows of a page.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}


#: Bytes of text of a file, on average, and characters of it that part rows with one id.
PART_BYTES, LEAD = 32 << 20, 64
#: Files whose starts (16 bytes each) are sent to every executor at most.
MOST_PARTS = 200_000


def write_token_files(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end: int = 2) -> None:
    """Write the ids of every whole text, each with the end id after it, below path.

    A null text is written as the end id alone. Null ids come first; rows with the same id are all written, ordered by
    their texts. No documents make files without rows.
    """

    def encode(batches):
        part, before, known = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            for data, offsets, low, high in texts(batch.column(1)):
                ids = known.encode(data, offsets, low, high)
                n = np.array([len(x) + 1 for x in ids], np.int64)
                cut = np.concatenate(([0], np.cumsum(n)))
                flat = np.full(cut[-1], end, np.int32)
                for a, x in zip(cut.tolist(), ids):
                    flat[a : a + len(x)] = x
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat))
                columns = [batch.column(0).slice(low, high - low), pa.array(np.full(len(n), part, np.int32)), pa.array(before + cut[:-1]), pa.array(n), lists]
                yield pa.RecordBatch.from_arrays(columns, [doc_id, "part", "part_start", "n_tokens", "ids"])
                before += int(cut[-1])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id), F.col(text).cast("string").alias("_text"))
    whole = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranged = rows.repartitionByRange(max(1, -(-whole // PART_BYTES)), F.col(doc_id), F.left("_text", F.lit(LEAD))).sortWithinPartitions(doc_id, "_text")
    ranged.mapInArrow(encode, f"`{doc_id}` {kind}, part int, part_start long, n_tokens long, ids array<int>").write.options(**LAYOUT).mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with start: how many ids all documents before this one have."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each file
    base, total = {}, 0
    for part, n in sizes:
        base[part] = total
        total += n
    bases = spark.createDataFrame(list(base.items()) or [(0, 0)], "part int, base long")
    if len(base) <= MOST_PARTS:  # else the join shuffles; ids are never in the way of that if they aren't selected
        bases = F.broadcast(bases)
    return files.join(bases, "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def with_crc32(rows: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """Per row of read_token_files: doc_id, start, n_tokens, and ids_crc32 of its ids as little-endian 32-bit numbers."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            cut = lists.offsets.to_numpy()
            values = memoryview(lists.values.to_numpy().astype("<u4"))
            crc = [zlib.crc32(values[a:b].cast("B")) for a, b in zip(cut.tolist(), cut.tolist()[1:])]
            n = np.diff(cut).astype(np.int64)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in (doc_id, "start")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n), pa.array(crc, pa.int64())], [doc_id, "start", "n_tokens", "ids_crc32"])

    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.select(doc_id, "start", "ids").mapInArrow(digest, f"`{doc_id}` {kind}, start long, n_tokens long, ids_crc32 long")
