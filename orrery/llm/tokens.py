"""Token counts: a separator scan over flat, unindexed token files.

A token file is nothing but 16- or 32-bit ids, little endian, with an
end-of-document id after each document. Blocks of a file are read independently
and searched for separators with numpy; a prefix scan over the blocks' summaries
(their separators' number and last position) then stitches documents that cross
block borders. The scan is over one short row for each block, so that a file with a
third of all tokens costs no more than its blocks' summaries in one task.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import materialise, shared_dir, table

BLOCK_BYTES = 4 << 20
#: The tokenizer of the query: a rank file, its split pattern and its free id.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
EOD = 50_256
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def write_token_files(docs: DataFrame, path: str, ranks: bytes, eod: int = EOD, dtype: str = "<u2", id_col="doc_id", text_col="text") -> DataFrame:
    """Writes one flat file for each partition of docs under path, a URI that all machines reach.

    Returns doc_id, file, ordinal: which document stands where. A task that runs
    again writes a file of its own name; only files named in the result count.
    Null and empty texts are documents without tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file, about 1 MB

    def write(batches):
        fs, root = _filesystem(path)
        encode = encoder(shared.value).encode_ordinary
        name, out, n = f"{uuid.uuid4().hex}.bin", None, 0
        try:
            for batch in batches:
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                for text in batch["text"]:
                    ids = encode(text) if isinstance(text, str) and text else []
                    ids.append(eod)
                    out.write(np.array(ids, dtype).tobytes())
                yield pd.DataFrame({"doc_id": batch["doc_id"], "file": name, "ordinal": np.arange(n, n + len(batch), dtype=np.int64)})
                n += len(batch)
        finally:
            if out is not None:
                out.close()

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(source.mapInPandas(write, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, file string, ordinal long"))


def list_blocks(spark: SparkSession, path: str, files: DataFrame, block_bytes: int = BLOCK_BYTES, dtype: str = "<u2") -> DataFrame:
    """file, block, length: the blocks of each file named in files; sizes come from the folder's listing."""
    from pyarrow import fs as pafs

    fs, root = _filesystem(path)
    sizes = [(i.base_name, i.size) for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.is_file]
    listed = spark.createDataFrame(sizes, "file string, bytes long").join(files.select("file").distinct(), "file")
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width
    n = F.ceil(F.col("bytes") / block_bytes).cast("int")
    blocks = listed.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return blocks.select("file", F.col("block").cast("long").alias("block"), F.least(F.lit(block_bytes), F.col("bytes") - F.col("block") * block_bytes).alias("length"), F.lit(block_bytes).alias("step"))


def scan_token_files(blocks: DataFrame, path: str, eod: int = EOD, dtype: str = "<u2") -> DataFrame:
    """file, ordinal, start, n_tokens, terminated: every document of every file, in token offsets.

    The separator belongs to no document. Tokens after a file's last separator are a
    document that is not terminated; two adjacent separators hold an empty one. An
    empty file has no document.
    """
    width = np.dtype(dtype).itemsize

    def search(batches):
        fs, root = _filesystem(path)
        for batch in batches:
            for file, block, length, step in batch.itertuples(index=False):
                with fs.open_input_file(f"{root}/{file}") as f:
                    ids = np.frombuffer(f.read_at(int(length), int(block * step)), dtype)
                at = np.flatnonzero(ids == eod) + block * (step // width)
                yield pd.DataFrame({"file": [file], "block": [block], "end": [block * (step // width) + len(ids)], "separators": [at.tolist()]})

    spread = blocks.repartition(F.col("file"), F.col("block")).select("file", "block", "length", "step")
    found = materialise(spread.mapInPandas(search, "file string, block long, end long, separators array<long>"))
    brief = found.select("file", "block", "end", F.size("separators").alias("n"), F.array_max("separators").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = brief.select(
        F.col("file").alias("_file"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
        (F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()).alias("final"),
    )
    rows = found.join(stitched, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    tail = F.when(F.col("final") & (F.coalesce(F.array_max("separators"), F.col("carry")) + 1 < F.col("end")), F.array("end")).otherwise(F.array().cast("array<long>"))
    rows = rows.select("file", "base", "carry", "separators", F.posexplode(F.concat("separators", tail)).alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("separators", F.col("i") - 1)) + 1
    return rows.select("file", (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("i") < F.size("separators")).alias("terminated"))


def count_tokens(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens of every document, by writing token files and scanning them.

    Null or repeated ids keep their rows: documents are told apart by their place.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    path = shared_dir(spark)
    places = write_token_files(docs, path, ranks)
    counts = scan_token_files(list_blocks(spark, path, places), path)
    return places.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op1_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
