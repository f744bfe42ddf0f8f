"""Token counts from flat token files: a scan for end-of-document ids, stitched over blocks.

A token file is a run of fixed-width ids without an index; each document ends with a separator id. Files are
read in blocks. A vectorised search finds the separators of each block; a prefix scan
over the blocks of a file (running tokens and the last separator so far) says where the
first document of every block began.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelscope.llm.shared import written

#: Tokens in a block; blocks of a file in a slice of the prefix scan, so no window holds more.
BLOCK_TOKENS = 1 << 16
SLICE_BLOCKS = 1 << 12
#: Documents in a list.
LISTED = 1 << 14


def token_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, block, tokens`` of the flat token files at ``path``, of ``width`` bytes an id, lowest first.

    A file is one row of Spark's binary source, of 2 GB at most; larger sets of tokens are many files.
    """
    size = block_tokens * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_buffer()
                if data.size % width:
                    raise ValueError(f"{name} is not a whole number of tokens")
                for block, at in enumerate(range(0, data.size, size)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()]), pa.array([block], pa.int64()), pa.array([data.slice(at, min(size, data.size - at)).to_pybytes()], pa.binary())],
                        ["file", "block", "tokens"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block long, tokens binary")


def separator_scan(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """``file, document, start, n_tokens``: the documents of each file in order, without their separators.

    ``blocks`` has file, block (in order, gaps allowed) and tokens. What follows the last separator of a file is a
    document if it holds tokens; two separators in a row enclose a document of none. Null or empty blocks hold nothing.
    """
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, found = [], []
            for tokens in batch.column("tokens"):
                ids = np.frombuffer(tokens.as_buffer(), kind) if tokens.is_valid else np.zeros(0, kind)
                size.append(len(ids))
                found.append(np.flatnonzero(ids == separator))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            ends = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(size, pa.int64()), ends], ["file", "block", "size", "ends"]
            )

    scanned = written(
        blocks.select("file", F.col("block").cast("long"), "tokens").mapInArrow(run, "file string, block long, size long, ends array<long>"), "scanned"
    ).withColumn("slice", F.floor(F.col("block") / SLICE_BLOCKS))
    # totals of slices, scanned over a file; then the blocks of a slice from there
    before = Window.partitionBy("file").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        scanned.groupBy("file", "slice").agg(F.sum("size").alias("size"), F.sum(F.size("ends")).alias("found"))
        .select("file", "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"),
                F.coalesce(F.sum("found").over(before), F.lit(0)).alias("found_before"))
    )
    inner = Window.partitionBy("file", "slice").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = scanned.join(sums, ["file", "slice"]).withColumns({
        "base": F.col("size_before") + F.coalesce(F.sum("size").over(inner), F.lit(0)),
        "first": F.col("found_before") + F.coalesce(F.sum(F.size("ends")).over(inner), F.lit(0)),
    })
    last = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1))
    lasts = placed.withColumn("last", last)
    ahead = (
        lasts.groupBy("file", "slice").agg(F.max("last").alias("last"))
        .select("file", "slice", F.max("last").over(before).alias("last_before"))
    )
    stitched = lasts.join(ahead, ["file", "slice"]).withColumn(
        "open", F.coalesce(F.max("last").over(inner), F.col("last_before"), F.lit(-1)) + 1  # where the block's first document began
    )
    inside = stitched.select("file", "first", "base", "open", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("first") + F.col("i")).alias("document"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1).alias("start"),
        (F.col("base") + F.col("end")).alias("stop"),
    )
    rest = stitched.groupBy("file").agg(
        F.sum(F.size("ends")).alias("document"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"),
        F.sum("size").alias("stop"),
    ).filter("stop > start")
    return inside.unionByName(rest).select("file", "document", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))


def byte_pair_encoding(vocabulary: bytes, pattern: str):
    """An encoder of a vocabulary in rank format: lines of base64 bytes and rank."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: White space in a row from which a text is cut into pieces here: the encoder's own matcher runs out of stack on a million.
LONG_BLANK = 20_000
_LONG_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")


def encoded(encoder, pattern: regex.Pattern, text: str) -> list[int]:
    """The tokens of a text. One with a very long run of white space is cut by the same pattern, but by a matcher without recursion."""
    if not _LONG_BLANK.search(text):
        return encoder.encode_ordinary(text)
    return [token for piece in pattern.finditer(text) for token in encoder._encode_single_piece(piece[0])]


def packed(docs: DataFrame, vocabulary: bytes, pattern: str, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of ``docs`` (``doc_id``, ``text``) in blocks, and beside them lists of the documents of each file, in order.

    Each task writes one file: the tokens of its texts in a row, each followed by the separator, two bytes an id, cut
    wherever a block is full. A row ``file, at, tokens`` is block ``at``, which knows nothing of documents; a row ``file, at, ids`` lists
    documents from number ``at`` on. Null texts have no tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, cut_by = byte_pair_encoding(*shared.value), regex.compile(shared.value[1])
        file = f"part-{TaskContext.get().partitionId():08d}"
        block, listed, held = 0, 0, 0
        parts: list[np.ndarray] = []
        ids: list[int | None] = []

        def row(at: int, tokens: bytes | None, names: list[int | None] | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([at], pa.int64()), pa.array([tokens], pa.binary()), pa.array([names], pa.list_(pa.int64()))],
                ["file", "at", "tokens", "ids"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                rest = np.array([*encoded(encoder, cut_by, text.as_py() or ""), separator], dtype="<u2")
                ids.append(doc_id)
                while held + len(rest) >= block_tokens:
                    parts.append(rest[: block_tokens - held])
                    rest = rest[block_tokens - held :]
                    yield row(block, np.concatenate(parts).tobytes(), None)
                    block, parts, held = block + 1, [], 0
                if len(rest):
                    parts.append(rest)
                    held += len(rest)
                if len(ids) >= LISTED:
                    yield row(listed, None, ids)
                    listed, ids = listed + len(ids), []
        if held:
            yield row(block, np.concatenate(parts).tobytes(), None)
        if ids:
            yield row(listed, None, ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, at long, tokens binary, ids array<long>")


def token_counts(docs: DataFrame, vocabulary: bytes, pattern: str, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, n_tokens`` for each row of ``docs``, counted by the separators of flat token files written for them.

    Null and empty texts have 0 tokens; repeated rows are counted one by one; an empty table gives no rows. Ids
    may be null. Other columns are not read. A very long text is encoded whole by one task, at some tens of bytes of memory for each of its own;
    runs of millions of blanks, line ends or letters are encoded as the pattern cuts them.
    """
    table = written(packed(docs, vocabulary, pattern, separator, block_tokens), "token-blocks")
    blocks = table.filter("tokens IS NOT NULL").select("file", F.col("at").alias("block"), "tokens")
    counted = separator_scan(blocks, separator)
    ids = table.filter("ids IS NOT NULL").select("file", "at", F.posexplode("ids").alias("i", "doc_id")).select(
        "file", (F.col("at") + F.col("i")).alias("document"), "doc_id")
    return ids.join(counted, ["file", "document"]).select("doc_id", "n_tokens")
