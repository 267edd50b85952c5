"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.llm.shared import send
from ledgerline.llm.words import raw_texts
from ledgerline.runtime import settle

WINDOW = 13
# Benchmark text in one automaton; a larger benchmark is searched in several passes, so the broadcast stays bounded.
BLOCK_BYTES = 16 << 20

# A-Z become a-z, digits, a-z and bytes from 0x80 on stay, everything else separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def normalised(data: bytes) -> bytes:
    """The words between single spaces, with one at either end; b" " if there are none."""
    return re.sub(rb"  +", b" ", b" " + data.translate(FOLD) + b" ")


class Matcher:
    """All windows of some items in one automaton, which is built once in each worker process."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.items = items
        self.automaton = None

    def build(self) -> None:
        self.names: list[str | None] = []
        owners: dict[str, tuple[int, set[int]]] = {}
        for name, data in self.items:
            words = data.translate(FOLD).split()
            if not words:
                continue
            number = len(self.names)
            self.names.append(name)
            length = min(self.window, len(words))
            for i in range(len(words) - length + 1):
                key = (b" " + b" ".join(words[i : i + length]) + b" ").decode("latin-1")
                owners.setdefault(key, (length, set()))[1].add(number)
        self.automaton = ahocorasick.Automaton()
        for key, value in owners.items():
            self.automaton.add_word(key, value)
        if owners:
            self.automaton.make_automaton()

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """Number of words, word ranges [first, last] that occurrences cover, and the names of the items found.

        The automaton runs over the normalised text once. Its offsets are those of the spaces behind each match; the spaces are
        counted to get word numbers, which are the same in the original text.
        """
        if self.automaton is None:
            self.build()
        text = normalised(data)
        n_words = text.count(b" ") - 1
        if n_words < 1 or not len(self.automaton):
            return max(n_words, 0), [], set()
        ends, lengths, found = [], [], set()
        for end, (length, owners) in self.automaton.iter(text.decode("latin-1")):
            ends.append(end)
            lengths.append(length)
            found |= owners
        if not ends:
            return n_words, [], found
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        last = np.searchsorted(spaces, ends) - 1
        return n_words, merged(list(zip((last - lengths + 1).tolist(), last.tolist()))), {self.names[i] for i in found}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges of whole numbers, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def word_offsets(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of ranges of words."""
    if not ranges:
        return []
    starts, ends = zip(*(m.span() for m in WORD.finditer(data.translate(FOLD))))
    # A byte that does not continue a code point begins a character.
    before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[starts[a]]), int(before[ends[b]])) for a, b in ranges]


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The benchmark in parts of at most about ``block_bytes`` text each, measured before anything is sent to the driver."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * size // block_bytes) if size > block_bytes else 1)
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i) for i in range(parts)]


RANGES = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
FOUND = T.StructType(
    [
        T.StructField("__n_words", T.LongType()),
        T.StructField("__ranges", RANGES),
        T.StructField("__items", T.ArrayType(T.StringType())),
        T.StructField("__spans", RANGES),
    ]
)


def _pass(docs: DataFrame, text: str, items: list[tuple[str | None, bytes]], window: int, offsets: bool) -> DataFrame:
    """Adds what one automaton finds to what earlier ones found, row by row, beside the columns of ``docs``."""
    matcher = send(docs.sparkSession, Matcher, items=items, window=window)
    first = "__items" not in docs.columns
    schema = T.StructType([f for f in docs.schema.fields if f.name not in FOUND.names] + FOUND.fields)
    kept = [n for n in docs.columns if n not in FOUND.names]
    kinds = to_arrow_schema(FOUND)

    def run(batches):
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            counts, ranges, items, spans = [], [], [], []
            for i, data in enumerate(raw_texts(column[text])):
                n, new, found = matcher().scan(data or b"")
                if not first:
                    new = merged(new + [(r["first"], r["last"]) for r in column["__ranges"][i].as_py()])
                    found |= set(column["__items"][i].as_py())
                counts.append(n)
                ranges.append([{"first": a, "last": b} for a, b in new])
                # Items without an id stand together as one null.
                items.append([*sorted(x for x in found if x is not None), *([None] if None in found else [])])
                spans.append([{"first": a, "last": b} for a, b in word_offsets(data, new)] if offsets and new else [])
            made = [pa.array(x, kinds.field(k).type) for k, x in enumerate((counts, ranges, items, spans))]
            yield pa.RecordBatch.from_arrays([column[n] for n in kept] + made, names=schema.names)

    return docs.mapInArrow(run, schema)


def judge(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    offsets: bool = True,
) -> DataFrame:
    """All columns of ``docs`` and ``__found``: (n_words, n_hit, n_items, items_sha256, contaminated, items, spans).

    A window is ``window`` consecutive words of an item, or all words of a shorter item. Words of a document inside an occurrence
    of any window are hit; it is contaminated if a twentieth of its words or more are hit. ``spans`` are the character ranges
    [first, last) of the hits in the original text (empty if ``offsets`` is off). A null or empty text has no words; items
    without words find nothing; items without an id count as one more item, which the digest of ids leaves out; rows are judged in place, so ids may be null or repeated; an empty table gives an
    empty one, and without a benchmark nothing is hit.
    """
    state = docs.withColumn("__text", F.col(text).cast("string")) if dict(docs.dtypes)[text] != "string" else docs
    searched = "__text" if state is not docs else text
    blocks = item_blocks(benchmark, item, item_text, block_bytes)
    for i, block in enumerate(blocks):
        rows = [(r.item, r.text.encode()) for r in block.collect()]
        state = _pass(state, searched, rows, window, offsets)
        if i + 1 < len(blocks):
            state = settle(state, "passages")
    n_hit = F.aggregate("__ranges", F.lit(0).cast("long"), lambda n, r: n + r.last - r.first + 1)
    found = state.withColumn("__n_hit", n_hit).select(
        *docs.columns,
        F.struct(
            F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
            F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
            ((F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))).alias("contaminated"),
            F.col("__items").alias("items"), F.col("__spans").alias("spans"),
        ).alias("__found"),
    )
    return found


def find_passages(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) of every row of ``docs``; see ``judge``."""
    return judge(docs.select(id, text), benchmark, text, **parameters).select(id, "__found.*")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    return judge(docs, benchmark, text, offsets=False).where(~F.col("__found.contaminated")).select(*docs.columns)
