"""Token counts of documents in flat token files, found by scanning for separators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import load
from .scratch import fresh_path, materialize

_SUPER = 1024


def _checked(path: str, separator: int, dtype: str) -> None:
    """Refuses ids that don't fit, and a separator that text may have."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    top = max(separator, *library.get_vocab(with_added_tokens=True).values())
    if top > np.iinfo(dtype).max:
        raise ValueError(f"id {top} does not fit {dtype}")
    if library.id_to_token(separator) is not None and separator not in library.get_added_tokens_decoder():
        raise ValueError(f"id {separator} is an ordinary token")


def _writer(uri: str, path: str, separator: int, dtype: str):
    def write(batches):
        bpe = load(path, specials_are_text=True)
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        ordinal = 0
        with fs.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                for lo, hi, ids, offsets in bpe.encode_column(batch.column(1)):
                    n = hi - lo
                    flat = np.full(len(ids) + n, separator, dtype)
                    keep = np.ones(len(flat), bool)
                    keep[offsets[1:] + np.arange(n)] = False
                    flat[keep] = ids
                    out.write(flat.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{name}"] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)[lo:hi], pa.array([flat.nbytes] + [0] * (n - 1), pa.int64())], ["file", "ordinal", "doc_id", "n_bytes"])
                    ordinal += n

    return write


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", separator: int = 50256, dtype: str = "<u2") -> DataFrame:
    """Writes each partition's documents, each followed by ``separator``, as one flat file of ids.

    Returns (file, ordinal, doc_id, n_bytes), where the n_bytes of a file add up to its size. Each
    attempt of a task writes a file of its own and only files named in the committed table count,
    so retries leave nothing wrong behind. Special tokens spelled in a text are ordinary text, so a
    separator stands nowhere else; an id that is an ordinary token is refused, as are ids that ``dtype``
    can't hold. Null texts are empty documents.
    """
    _checked(tokenizer, separator, dtype)
    uri = fresh_path(docs.sparkSession, "tokens")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.mapInArrow(_writer(uri, tokenizer, separator, dtype), "file string, ordinal long, doc_id long, n_bytes long")
    return materialize(rows, "token-index")


def _scanner(separator: int, dtype: str):
    width = np.dtype(dtype).itemsize

    def scan(batches):
        for batch in batches:
            for file, block, start, stop in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at((stop - start) * width, start * width), dtype)
                at = np.flatnonzero(ids == separator) + start
                n = len(at)
                begin = np.concatenate(([-1], at[:-1] + 1)) if n else at
                last = int(at[-1]) + 1 if n else -1
                columns = [[file] * (n + 1), [block] * (n + 1), np.arange(-1, n), np.append([n], begin), np.append([last], at)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 0 else pa.int64()) for i, x in enumerate(columns)], ["file", "block", "local", "begin", "end"])

    return scan


def token_counts(files: DataFrame, separator: int = 50256, dtype: str = "<u2", block_tokens: int = 4 << 20) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document in flat files of ids.

    ``files`` has columns (file, n_bytes); ids are fixed-width, in no index. Files are cut into
    blocks of ``block_tokens`` that are searched for the separator independently. A document that
    crosses blocks is stitched by a prefix scan over the blocks' summaries: how many separators
    came before, and where the last one ended. The scan has two levels (blocks in runs of 1024, then
    the runs of a file), so that no file, however long, is scanned in one task by its blocks.

    n_tokens does not count the separator. Defined cases: separators in a row are documents of 0
    tokens; ids after the last separator are a document with terminated = false; an empty file has
    no documents; bytes beyond the last whole id are not read.
    """
    spark: SparkSession = files.sparkSession
    width = np.dtype(dtype).itemsize
    files = files.select("file", F.expr(f"n_bytes div {width}").alias("size"))
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (8 * block_tokens)))
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("size - 1"), F.lit(block_tokens).cast("long")))
    blocks = files.where("size > 0").select("file", "size", cuts.alias("start"))
    blocks = blocks.select("file", F.expr(f"start div {block_tokens}").alias("block"), "start", F.least(F.col("start") + block_tokens, F.col("size")).alias("stop"))
    found = materialize(blocks.repartition(tasks, "file", "block").mapInArrow(_scanner(separator, dtype), "file string, block long, local long, begin long, end long"), "separators")
    part = found.where("local = -1").select("file", "block", F.expr(f"block div {_SUPER}").alias("run"), F.col("begin").alias("n"), F.col("end").alias("last"))
    runs = part.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run_base"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("run_last"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("file", "run", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n"), F.coalesce(F.max("last").over(inside), F.lit(0)).alias("last"))
    base = part.join(runs, ["file", "run"]).select("file", "block", (F.col("n") + F.col("run_base")).alias("base"), F.greatest("last", "run_last", F.lit(0)).alias("last"))
    docs = found.where("local >= 0").join(base, ["file", "block"])
    start = F.when(F.col("begin") < 0, F.col("last")).otherwise(F.col("begin"))
    docs = docs.select("file", (F.col("base") + F.col("local")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    ends = found.where("local = -1").groupBy("file").agg(F.sum("begin").alias("ordinal"), F.greatest(F.max("end"), F.lit(0).cast("long")).alias("start"))
    rest = ends.join(files, "file").where("start < size").select("file", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return docs.union(rest)
