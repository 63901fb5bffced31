"""Token counts of documents from flat token files, by a scan for separators.

A flat token file is a run of fixed-width token ids in which an end-of-document
id follows each document; it has no index.  A file is read in blocks that start
anywhere in a document.  A block is searched for the separator in one
vectorised pass and keeps the lengths that lie whole inside, the tokens before
its first separator and those after its last.  A prefix scan over the blocks of
a file, first over chunks of ``CHUNK`` blocks and then inside each, carries the
open document and the number of documents so far over the boundaries.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.llm.packing import ChunkEncoder
from geomill.session import bound_batches, checkpoint_dir

BLOCK_BYTES = 1 << 20
#: Blocks that the inner level of the prefix scan holds.
CHUNK = 256


def _opened(name: str):
    """(file system, path in it) of a file that Spark names so; local names come as file:/path."""
    return FileSystem.from_uri("/" + name[5:].lstrip("/") if name.startswith("file:") else name)


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data) of the flat files under ``path``, of any size: tasks read byte ranges.

    Where the workers can't open the path themselves Spark reads the files,
    each as one row, which holds below 2 GB.
    """
    files = spark.read.format("binaryFile").load(path)
    one = files.select("path").first()
    try:
        _opened(one[0] if one else "/")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):

        def split(batches):
            for batch in batches:
                for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                    whole = data.as_py() or b""
                    for lo in range(0, len(whole), block_bytes):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([lo // block_bytes]), pa.array([whole[lo : lo + block_bytes]], pa.binary())], ["file", "block", "data"])

        return files.select("path", "content").mapInArrow(split, "file string, block long, data binary")

    def read(batches):
        for batch in batches:
            for name, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()):
                system, where = _opened(name)
                with system.open_input_file(where) as f:
                    data = f.read_at(block_bytes, block * block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([data], pa.binary())], ["file", "block", "data"])

    last = F.floor((F.col("length") - 1) / block_bytes)
    ranges = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return ranges.repartition("path", "block").mapInArrow(read, "file string, block long, data binary")


def scan(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of the documents in ``blocks`` (file, block, data).

    ``width`` is 2 or 4 bytes, little-endian.  n_tokens leaves the separator
    out; ordinal counts a file's documents from 0; start is the document's
    first token in its file.  Tokens after a file's last separator are a
    document that isn't closed; a file that ends with a separator has none.
    Blocks hold whole tokens and each occurs once; empty and null blocks have
    no tokens; two separators in a row are an empty document; an empty table
    gives no rows.
    """
    kind = blocks.schema["file"].dataType.simpleString()

    def search(batches):
        for batch in batches:
            rows = []
            for file, block, data in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("data")):
                buffer = data.as_buffer()
                tokens = np.frombuffer(buffer, f"<u{width}") if buffer is not None else np.empty(0, np.uint16)
                at = np.flatnonzero(tokens == separator)
                rows.append((file, block, len(tokens), len(at), int(at[0]) if len(at) else None, len(tokens) - 1 - int(at[-1]) if len(at) else len(tokens), (np.diff(at) - 1).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((batch.schema.field("file").type, *[pa.int64()] * 5, pa.list_(pa.int64())))], ["file", "block", "tokens", "seps", "head", "tail", "inner"])

    found = blocks.select("file", F.col("block").cast("long").alias("block"), "data").mapInArrow(search, f"file {kind}, block long, tokens long, seps long, head long, tail long, inner array<long>")
    found = written(found).withColumn("chunk", F.floor(F.col("block") / CHUNK))
    inside = W.partitionBy("file", "chunk").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    near = found.withColumn("p", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).withColumn("d", F.coalesce(F.sum("seps").over(inside), F.lit(0)))
    end = F.when(F.col("seps") > 0, F.col("p") + F.col("tokens") - F.col("tail"))
    near = near.withColumn("end", end).withColumn("e", F.max("end").over(inside))
    chunks = near.groupBy("file", "chunk").agg(F.sum("tokens").alias("ct"), F.sum("seps").alias("cs"), F.max("end").alias("ce"))
    across = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("cp", F.coalesce(F.sum("ct").over(across), F.lit(0))).withColumn("cd", F.coalesce(F.sum("cs").over(across), F.lit(0)))
    chunks = chunks.select("file", "chunk", "cp", "cd", F.max(F.col("cp") + F.col("ce")).over(across).alias("cb"), F.lead("chunk").over(W.partitionBy("file").orderBy("chunk")).isNull().alias("final"))
    both = near.join(chunks, near.file.eqNullSafe(chunks.file) & (near.chunk == chunks.chunk)).drop(chunks.file).drop(chunks.chunk)
    start = F.coalesce(F.col("cp") + F.col("e"), F.col("cb"), F.lit(0))  # where the open document begins
    position = F.col("cp") + F.col("p")
    last = F.col("final") & F.lead("block").over(W.partitionBy("file", "chunk").orderBy("block")).isNull()
    both = both.select("file", (F.col("cd") + F.col("d")).alias("before"), "seps", "inner", start.alias("start"), (position + F.col("head") - start).alias("first"), last.alias("last"), (position + F.col("tokens")).alias("stop"), (position + F.col("tokens") - F.col("tail")).alias("open"))
    closed = _closed(both)
    opened = F.when(F.col("seps") > 0, F.col("open")).otherwise(F.col("start"))
    tails = both.filter(F.col("last") & (F.col("stop") > opened)).select("file", (F.col("before") + F.col("seps")).alias("ordinal"), opened.alias("start"), (F.col("stop") - opened).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tails)


def _closed(both: DataFrame) -> DataFrame:
    """The documents that end in a block, with their starts by a running sum inside it."""
    kind = both.schema["file"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                first, inner = some.column("first").to_pylist(), some.column("inner").to_pylist()
                lengths = [np.array([a, *b], np.int64) for a, b in zip(first, inner)]
                many = np.array([len(x) for x in lengths])
                starts = [s + np.concatenate(([0], np.cumsum(x[:-1] + 1))) for s, x in zip(some.column("start").to_pylist(), lengths)]
                ordinals = [b + np.arange(len(x)) for b, x in zip(some.column("before").to_pylist(), lengths)]
                files = some.column("file").take(pa.array(np.repeat(np.arange(len(many)), many)))
                yield pa.RecordBatch.from_arrays([files, *(pa.array(np.concatenate(x)) for x in (ordinals, starts, lengths)), pa.array(np.ones(int(many.sum()), bool))], ["file", "ordinal", "start", "n_tokens", "closed"])

    return both.filter("seps > 0").select("file", "before", "inner", "start", "first").mapInArrow(run, f"file {kind}, ordinal long, start long, n_tokens long, closed boolean")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared checkpoint folder, read again."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/geomill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tokens(docs: DataFrame, tokenizer: str, separator: int, block_bytes: int = BLOCK_BYTES, width: int = 2) -> tuple[DataFrame, DataFrame]:
    """(blocks, names): the tokens of ``docs`` as flat files of ids of ``width`` bytes (2 or 4), a file for each task, and (file, ordinal, doc_id).

    Both are columns of one written table; ``separator`` follows each document.
    An id that doesn't fit ``width``, or is the separator, fails the job.  Null
    texts have no tokens.
    """
    bound_batches(docs.sparkSession)
    kind, most = f"<u{width}", (1 << 8 * width) - 1
    if not 0 <= separator <= most:
        raise ValueError(f"separator {separator} doesn't fit {width} bytes")
    mark = np.array([separator], kind).tobytes()

    def run(batches):
        encode, file = ChunkEncoder(tokenizer, special_as_text=True), TaskContext.get().partitionId()
        held, block, ordinal = bytearray(), 0, 0

        def row(data, first, ids):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["file", "block", "data", "first", "ids"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for run in encode.runs(batch.column("text")):
                for data in run:
                    own = np.frombuffer(data, "<u4")
                    if len(own) and (own.max() > most or (own == separator).any()):
                        raise ValueError(f"a token id doesn't fit {width} bytes or is the separator {separator}")
                    held += own.astype(kind).tobytes() + mark
            yield row(None, ordinal, ids)
            ordinal += len(ids)
            while len(held) >= block_bytes:
                yield row(bytes(held[:block_bytes]), None, None)
                del held[:block_bytes]
                block += 1
        if held:
            yield row(bytes(held), None, None)

    table = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "file int, block long, data binary, first long, ids array<long>"))
    names = table.filter("first IS NOT NULL").select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return table.filter("data IS NOT NULL").select("file", "block", "data"), names


def document_tokens(docs: DataFrame, tokenizer: str, separator: int, width: int = 2) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens of each document, counted in the flat files that it is written to.

    Null, empty and blank texts have 0 tokens; repeated rows and null ids keep
    a row each; an empty table gives no rows; other columns are ignored.
    """
    blocks, names = write_tokens(docs, tokenizer, separator, width=width)
    return names.join(scan(blocks, separator, width), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
