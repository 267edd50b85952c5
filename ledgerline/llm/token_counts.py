"""Token counts from flat token files: a vectorised scan for separators, block by block, stitched by a prefix scan.

A flat file is nothing but token identifiers of a fixed width, little-endian, with a separator behind each document: no index, no
lengths. Identifiers are shifted by one so that the separator is 0.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ledgerline.llm.shared import send

SEPARATOR = 0
# Bytes of texts that are packed at once, of one batch of rows that Spark gives.
PACKED_BYTES = 1 << 20
# Tokens searched at once.
BLOCK_TOKENS = 1 << 20
# Characters given to the tokenizer at once; a longer text is cut before a space or line break, where its pattern cuts as well.
PIECE_CHARS = 1 << 16


class Tokenizer:
    """Byte-level BPE over a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.encoding = None

    @classmethod
    def read(cls, path: str, pattern: str) -> Tokenizer:
        """From a file of ranks where the job is started; the tasks get what was read."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def ids(self, text: str) -> np.ndarray:
        if self.encoding is None:
            import tiktoken

            self.encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        if len(text) <= PIECE_CHARS:
            return np.array(self.encoding.encode_ordinary(text), np.int64)
        return np.concatenate([np.array(self.encoding.encode_ordinary(x), np.int64) for x in pieces(text)])


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """A text in parts that end before a single space between two letters: the pattern always begins a token there."""
    out, start = [], 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]] if start < len(text) or not out else out


def write_flat(docs: DataFrame, folder: str, tokenizer: Tokenizer, text: str = "text", width: int = 2) -> None:
    """One flat file for each partition, its documents in the partition's order; a null or empty text is a separator alone.

    A vocabulary whose identifiers, moved on by one, do not all fit into ``width`` bytes is refused.
    """
    if max(tokenizer.ranks.values(), default=0) + 1 >= 1 << 8 * width:
        raise ValueError(f"identifiers up to {max(tokenizer.ranks.values())} do not fit into {width} bytes")
    at = docs.columns.index(text)
    made = send(docs.sparkSession, Tokenizer, ranks=tokenizer.ranks, pattern=tokenizer.pattern)
    kind = f"<u{width}"

    def pack(batches):
        for batch in batches:
            # In small parts, so that a task holds few texts and tokens beside the batch itself.
            rows = max(1, len(batch) * PACKED_BYTES // max(1, batch.nbytes))
            for start in range(0, len(batch), rows):
                texts = batch.column(at).slice(start, rows).to_pylist()
                flat = [(made().ids(t) + 1).astype(kind).tobytes() if t else b"" for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(flat, pa.binary())], names=["tokens"])

    packed = docs.mapInArrow(pack, "tokens binary")
    # The sink writes the bytes of a string as they are, and the separator behind each row.
    packed.select(F.col("tokens").cast("string")).write.option("lineSep", "\0" * width).text(folder)


def scan_blocks(spark: SparkSession, folder: str, width: int = 2, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, block, tokens, first_end, last_end, ends, inner) of every block of every flat file.

    first_end and last_end are the places of the block's first and last separator in the file (null if it has none), ends their
    number, and inner the lengths of the documents between them. A file is read by Spark and searched in blocks of
    ``block_tokens``; bytes behind its last whole token are ignored.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    kind = f"<u{width}"

    def search(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(content.as_buffer())
                tokens = np.frombuffer(raw[: len(raw) // width * width], kind)
                rows = []
                for block, start in enumerate(range(0, len(tokens), block_tokens)):
                    part = tokens[start : start + block_tokens]
                    at = np.flatnonzero(part == separator) + start
                    some = len(at) > 0
                    rows.append((path, block, len(part), int(at[0]) if some else None, int(at[-1]) if some else None, len(at), (np.diff(at) - 1)))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                columns = list(zip(*rows)) or [()] * len(kinds)
                names = ["path", "block", "tokens", "first_end", "last_end", "ends", "inner"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return files.mapInArrow(search, "path string, block long, tokens long, first_end long, last_end long, ends long, inner array<long>")


def count_tokens(spark: SparkSession, folder: str, width: int = 2, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, nth, n_tokens, complete) of every document of the flat files below ``folder``.

    The prefix scan over a file's blocks carries the place of the last separator and the number of separators so far, so a document
    that spans blocks is measured where it ends. What stands behind a file's last separator is a document that is not complete; an
    empty file has none.
    """
    blocks = scan_blocks(spark, folder, width, separator, block_tokens)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumns(
        {
            "since": F.coalesce(F.last("last_end", ignorenulls=True).over(before), F.lit(-1)),
            "done": F.coalesce(F.sum("ends").over(before), F.lit(0)),
            "seen": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
            "final": F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull(),
        }
    )
    stitched = F.when(F.col("ends") > 0, F.concat(F.array(F.col("first_end") - F.col("since") - 1), F.col("inner")))
    whole = carried.select("path", "done", F.posexplode(stitched).alias("i", "n_tokens")).select(
        "path", (F.col("done") + F.col("i")).alias("nth"), "n_tokens", F.lit(True).alias("complete")
    )
    rest = F.col("seen") + F.col("tokens") - F.coalesce("last_end", "since") - 1
    cut = carried.where("final").select("path", (F.col("done") + F.col("ends")).alias("nth"), rest.alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.union(cut.where("n_tokens > 0"))


def part_number() -> Column:
    """The number of the partition that wrote a file, from its name."""
    return F.regexp_extract("path", r"part-(\d+)", 1).cast("long")


def document_counts(docs: DataFrame, folder: str, tokenizer: Tokenizer, id: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """(id, n_tokens) of every row: the corpus is written to flat files below ``folder`` and counted there.

    The files hold no ids; the nth document of a file is the nth row of the partition that wrote it. A second pass over the same
    two columns numbers the rows; a table read from files, or any other plan that gives the same rows in the same order twice, is
    needed for that; where the numbers of rows differ, the query fails. Null and empty texts have 0 tokens, ids may be null or repeated, and an empty table gives an empty one.
    """
    chosen = docs.select(id, F.col(text).cast("string").alias("__text"))

    def number(batches):
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = [pa.array(np.full(len(batch), part, np.int64)), pa.array(np.arange(nth, nth + len(batch)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *places], names=[id, "part", "nth"])
            nth += len(batch)

    write_flat(chosen, folder, tokenizer, "__text", width)
    counts = count_tokens(docs.sparkSession, folder, width)
    rows = chosen.mapInArrow(number, T.StructType([docs.schema[id], T.StructField("part", T.LongType()), T.StructField("nth", T.LongType())]))
    # A row without a count, or a count without a row, means that the two passes did not read the same rows.
    both = rows.withColumn("__row", F.lit(True)).join(counts.withColumn("part", part_number()), ["part", "nth"], "full")
    met = F.col("__row").isNotNull() & F.col("n_tokens").isNotNull()
    lost = F.raise_error(F.lit("the table did not give the same rows twice")).cast("long")
    return both.select(id, F.when(met, F.col("n_tokens")).otherwise(lost).alias("n_tokens"))
