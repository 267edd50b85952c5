"""Exact removal of repeated passages with a logarithmic family of sparse suffix arrays.

A passage is LENGTH bytes. Writing out every suffix of a corpus is many times its size, so an array holds the suffixes at places
that the content itself chooses: in each passage, the place of the smallest hash of SEED_BYTES bytes. Equal passages choose the
same place, so a chosen suffix stands for the run of all neighbouring passages that chose it. An array is in the order of the
suffixes' leading bytes, dealt out by them. A new batch is merged with the levels in that order, so that equal beginnings
meet: runs that agree as a whole are told at once, and for those that agree in part the bytes around the common place are
fetched and compared passage by passage.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.llm.sketches import member_test
from ledgerline.llm.words import raw_texts
from ledgerline.runtime import scratch_path, settle, small_batches, spent_shuffles_removed

LENGTH = 100
SEED_BYTES = 24
# Batches that a corpus is cut into: the least number that makes levels of one, two and four batches and merges them all.
BATCHES = 4
# Bytes that are hashed at once: many short texts together, or a part of a long one. Places within them take 20 bits.
CHUNK = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
CODES = np.random.default_rng(99).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RUN_BITS = np.uint64((1 << 64) - (1 << 20))
# Rows of one beginning, or of one block of passages, that a task holds at a time; what goes beyond is compared by other means.
GROUP_ROWS = 200_000
# Cells of each row of the sketch of documents that have something to remove or to compare; see ``sketches``.
MOST_CELLS = 1 << 24
# Bytes of rows with texts that a task works on at a time, of one batch that Spark gives.
PART_BYTES = 1 << 22
# Bytes of blocks whose passages are hashed at a time; an array of hashes is eight times as large.
BLOCK_BYTES = 1 << 18


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of about PART_BYTES."""
    for batch in batches:
        rows = max(1, -(-len(batch) // max(1, round(batch.nbytes / PART_BYTES))))
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any stretches of some bytes, from sums of powers modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        up = np.full(n, BASE, np.uint64)
        self.down = np.full(n + 1, BASE_BACK, np.uint64)
        up[:1] = self.down[:1] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(CODES[data] * np.cumprod(up), out=self.sums[1:])
        self.down = np.cumprod(self.down)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        """Of every stretch of ``length`` bytes."""
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


# A run's passages are told apart in blocks of those that begin close together before the chosen place.
BLOCKS = 3
NO_CORE = 63
START, PASSAGES, LEAD = 32, 25, 18


def _block(length: int) -> int:
    return -(-(length - SEED_BYTES + 1) // BLOCKS)


def packed(start: np.ndarray, passages: np.ndarray, lead: np.ndarray, cores: list[np.ndarray]) -> np.ndarray:
    """A run in one number that is ordered by its start: 31 bits of it, 7 of its passages, 7 of its lead, 6 for each core."""
    out = (start.astype(np.int64) << START) | (passages.astype(np.int64) << PASSAGES) | (lead.astype(np.int64) << LEAD)
    for i, core in enumerate(cores):
        out |= core.astype(np.int64) << (6 * i)
    return out


def unpacked(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, passages, lead, cores) of packed runs."""
    return run >> START, (run >> PASSAGES) & 127, (run >> LEAD) & 127, [(run >> (6 * i)) & 63 for i in range(BLOCKS)]


def chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, owner, offset, starts): texts put together, with the number and place in its text of each byte.

    A long text is cut into parts; ``starts`` marks the bytes where a passage of this part may begin, so that each passage belongs
    to one part.
    """
    parts: list[tuple[int, int, bytes, int]] = []
    size, step = 0, CHUNK - length + 1

    def joined():
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        owner = np.repeat(np.array([p[0] for p in parts]), [len(p[2]) for p in parts])
        offset = np.concatenate([np.arange(p[1], p[1] + len(p[2])) for p in parts])
        starts = np.concatenate([np.arange(p[1], p[1] + len(p[2])) < p[3] for p in parts])
        return data, owner, offset, starts

    for i, text in enumerate(texts):
        last = len(text) - length + 1
        for o in range(0, max(last, 0), step):
            end = min(o + step, last)
            part = text[o : end - 1 + length]
            if size + len(part) > CHUNK and parts:
                yield joined()
                parts, size = [], 0
            parts.append((i, o, part, end))
            size += len(part)
    if parts:
        yield joined()


def runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(owner, seed, whole, run): the chosen suffixes of some texts, one for each run of passages.

    ``seed`` has the first three bytes of the suffix in front of 40 bits of the hash of SEED_BYTES, so it is ordered as the suffixes
    are; whole is the hash of all bytes of the run. A run's passages are neighbours that chose one place, ``lead`` bytes behind the
    start of the first. Those that begin between _block * b and _block * (b + 1) bytes before the place form block b, and core b
    has 6 bits of the hash of the bytes that a whole block has in common.
    """
    choices, block = length - SEED_BYTES + 1, _block(length)
    for data, owner, offset, starts in chunks(texts, length):
        hashes = Hashes(data)
        seeds = hashes.windows(SEED_BYTES)
        ranked = (seeds & RUN_BITS) | np.arange(len(seeds), dtype=np.uint64)
        least, width = ranked, 1
        while width * 2 <= choices:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < choices:
            least = np.minimum(least[: len(least) - (choices - width)], least[choices - width :])
        chosen = (least & ~RUN_BITS).astype(np.int64)
        at = np.flatnonzero(starts[: len(chosen)])
        if not len(at):
            continue
        begins = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(chosen[at]) != 0) | (np.diff(owner[at]) != 0)))
        first = at[begins]
        count = np.diff(np.append(np.flatnonzero(begins), len(at)))
        place = chosen[first]
        lead = place - first
        cores = []
        for i in range(BLOCKS):
            # The run's passages begin lead - count + 1 to lead bytes before the place.
            filled = (lead >= block * i) & (lead - count + 1 < block * (i + 1))
            begin = np.where(filled, place - block * i, 0)
            end = np.where(filled, np.minimum(begin + length - block + 1, len(data)), 1)
            cores.append(np.where(filled, (hashes.of(begin, end) >> np.uint64(40)).astype(np.int64) % NO_CORE, NO_CORE))
        whole = hashes.of(first, first + count + length - 1)
        leading = sum(data[place + i].astype(np.uint64) << np.uint64(56 - 8 * i) for i in range(3))
        seed = (leading | (seeds[place] >> np.uint64(24))) ^ np.uint64(1 << 63)
        yield owner[first], seed.view(np.int64), whole.view(np.int64), packed(offset[first], count, lead, cores)


PLACE = ["late", "doc", "tie"]
# What a row is: a run of a level that stays or is merged, a new run, or one that stands earlier in the same batch of rows.
STAYS, MERGES, NEW, KNOWN = range(4)
# What a merge gives: a row of the new level, a run whose passages all stand earlier, a block of passages to be compared.
ROW, REPEATED, BLOCK = range(3)


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows as (late, doc, tie, text): the order of documents. Null ids come last; equal ids are told apart by their texts."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ids = docs.select(F.col(id).alias("doc"))
    repeated = ids.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null").limit(1).count() > 0
    tie = F.xxhash64(content) if repeated else F.lit(0).cast("long")
    zero = F.lit("" if dict(docs.dtypes)[id] == "string" else 0).cast(dict(docs.dtypes)[id])
    return docs.select(F.col(id).isNull().alias("late"), F.coalesce(F.col(id), zero).alias("doc"), tie.alias("tie"), content.alias("text"))


def _schema(docs: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    places = [T.StructField("late", T.BooleanType()), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("tie", T.LongType())]
    return T.StructType([*places, *(T.StructField(n, k) for n, k in more)])


def _changes(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Whether each row differs from the one before it in one of the columns."""
    out = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        out[1:] = False
        for n in names:
            column = table.column(n)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            out[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


def suffix_array(docs: DataFrame, length: int) -> DataFrame:
    """(late, doc, tie, seed, whole, run, state) of all chosen suffixes of keyed documents.

    Of equal runs in the rows that a task holds at a time only the first is compared with others; the rest is KNOWN already.
    """
    longs = [(n, T.LongType()) for n in ("seed", "whole", "run")]
    schema = _schema(docs, *longs, ("state", T.ByteType()))

    def run(batches):
        for batch in _parts(batches):
            made = list(runs(raw_texts(batch.column(3)), length))
            if not made:
                continue
            owner, seed, whole, run_ = (np.concatenate(x) for x in zip(*made))
            by_place = pc.sort_indices(batch.select(PLACE), sort_keys=[(n, "ascending") for n in PLACE])
            rank = np.empty(len(batch), np.int64)
            rank[by_place.to_numpy()] = np.cumsum(_changes(batch.select(PLACE).take(by_place), PLACE))
            order = np.lexsort((run_, rank[owner], whole, seed))
            owner, seed, whole, run_ = owner[order], seed[order], whole[order], run_[order]
            first = np.r_[True, (seed[1:] != seed[:-1]) | (whole[1:] != whole[:-1])]
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            # The rows of one document that is in the table twice are one place.
            again = (rank[owner] == rank[owner[lead]]) & (run_ == run_[lead]) & ~first
            owner, seed, whole, run_, first = (x[~again] for x in (owner, seed, whole, run_, first))
            state = np.where(first, NEW, KNOWN).astype(np.int8)
            places = [batch.column(i).take(pa.array(owner)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*places, *map(pa.array, (seed, whole, run_, state))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[pa.Table, bool]]:
    """Ordered rows in tables that end where ``by`` changes, and whether that is not so: a group of very many rows comes in parts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch.column(by).to_numpy()
        last = len(values) - int(np.argmin(values[::-1] == values[-1])) if values[0] != values[-1] else 0
        if last or (held and held[-1].column(by)[0].as_py() != int(values[0])):
            if held or last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held), False
            held = []
        held.append(batch.slice(last))
        if sum(map(len, held)) > GROUP_ROWS:
            yield pa.Table.from_batches(held), True
            held = []
    if held:
        yield pa.Table.from_batches(held), False


def _taken(table: pa.Table, at: np.ndarray, **columns: np.ndarray) -> list[pa.Array]:
    places = [table.column(n).combine_chunks().take(pa.array(at)) for n in PLACE]
    return [*places, *(pa.array(c) for c in columns.values())]


def merge_scan(rows: DataFrame, length: int, keep: bool, buckets: int) -> DataFrame:
    """(late, doc, tie, seed, whole, run, kind) from the runs of a batch and of the levels.

    The rows are dealt out by the suffixes' beginnings (those KNOWN by chance, so a passage that very many documents share comes
    together as few rows) and merged in their order, stored runs before new ones, then by place. A run
    whose beginning and bytes have been met before is REPEATED. Where a new run and another one begin alike but differ, those of
    their blocks whose cores agree are given as BLOCK, with a hash that stands for beginning, block and core in place of ``seed``.
    ``keep``: the rows of the new level are given as well.
    """
    step = _block(length)
    schema = _schema(rows, *((n, T.LongType()) for n in ("seed", "whole", "run")), ("kind", T.ByteType()))
    order = ["seed", "whole", "state", *PLACE, "run"]
    deal = F.when(F.col("state") == KNOWN, F.xxhash64("doc", "run")).otherwise(F.col("seed"))
    dealt = rows.repartition(buckets, deal).sortWithinPartitions(*order)

    def scanned(table: pa.Table, more: bool, before: tuple | None):
        seed, whole, run, state = (table.column(n).to_numpy() for n in ("seed", "whole", "run", "state"))
        local = state == KNOWN
        out = [_taken(table, np.flatnonzero(local), seed=seed[local], whole=whole[local], run=run[local], kind=np.full(local.sum(), REPEATED, np.int8))]
        at = np.flatnonzero(~local)
        if not len(at):
            return out, before
        seed, whole, run, state = (x[at] for x in (seed, whole, run, state))
        first = np.r_[True, (seed[1:] != seed[:-1]) | (whole[1:] != whole[:-1])]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        if before is not None and before[:2] == (seed[0], whole[0]):
            first[0] = False
        # A document that is in the table twice has met itself.
        places = table.select(PLACE).take(pa.array(at))
        same = np.ones(len(at), bool)
        for n in PLACE:
            column = places.column(n).combine_chunks()
            same &= pc.equal(column, column.take(pa.array(lead))).to_numpy(zero_copy_only=False)
        itself = ~first & same & (run == run[lead]) & (lead != np.arange(len(at)))
        found = ~first & ~itself & (state == NEW)
        out.append(_taken(table, at[found], seed=seed[found], whole=whole[found], run=run[found], kind=np.full(found.sum(), REPEATED, np.int8)))
        if keep:
            rows_ = first & (state != STAYS)
            out.append(_taken(table, at[rows_], seed=seed[rows_], whole=whole[rows_], run=run[rows_], kind=np.full(rows_.sum(), ROW, np.int8)))
        begins = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
        group = np.cumsum(np.r_[True, seed[1:] != seed[:-1]]) - 1
        different = np.add.reduceat(first.astype(np.int64), begins) > 1
        any_new = np.logical_or.reduceat(first & (state == NEW), begins)
        # What belongs to a group in parts is passed on as it is.
        parted = np.zeros(len(begins), bool)
        parted[-1] = more
        parted[0] |= before is not None and before[0] == seed[0]
        wanted = np.flatnonzero(first & ((different & any_new) | parted)[group])
        if len(wanted):
            start, count, ahead, cores = unpacked(run[wanted])
            block = np.concatenate([np.full(len(wanted), b) for b in range(BLOCKS)])
            core, row = np.concatenate(cores), np.tile(np.arange(len(wanted)), BLOCKS)
            filled = core != NO_CORE
            block, core, row = block[filled], core[filled], row[filled]
            code = (group[wanted][row] * BLOCKS + block) * 64 + core
            by_code = np.argsort(code, kind="stable")
            code, block, row = code[by_code], block[by_code], row[by_code]
            cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            size = np.diff(np.r_[cut, len(code)])
            new = np.logical_or.reduceat((state[wanted] == NEW)[row], cut)
            left = np.repeat((size > 1) & new, size) | parted[group[wanted]][row]
            code, block, row = code[left], block[left], row[left]
            # The block's passages begin lead - step * (b + 1) + 1 to lead - step * b bytes behind the run's start.
            low = np.maximum(ahead[row] - step * (block + 1) + 1, 0)
            high = np.minimum(ahead[row] - step * block, count[row] - 1)
            key = _mixed(seed[wanted][row].view(np.uint64) * np.uint64(4 * 64 + 1) + ((code % (BLOCKS * 64)) + 1).astype(np.uint64)).view(np.int64)
            part = ((start[row] + low) << START) | ((high - low + 1) << PASSAGES)
            zero, kind = np.zeros(len(row), np.int64), np.full(len(row), BLOCK, np.int8)
            out.append(_taken(table, at[wanted][row], seed=key, whole=zero, run=part, kind=kind))
        return out, (seed[-1], whole[-1])

    def run(batches):
        before = None
        for table, more in _groups(batches, "seed"):
            out, last = scanned(table, more, before)
            before = last if more else None
            for columns in out:
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return dealt.mapInArrow(run, schema)


@dataclass
class Level:
    """One array of the family, a row for each different run at its earliest place; ``batches`` is its size."""

    path: str
    batches: int


class Family:
    """Levels of sizes 1, 2, 4 and so on, in batches, below a shared folder; a batch may be added at any time, in any session.

    Each change writes its files first and then a new manifest; what no manifest names any more is removed after that.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH) -> None:
        self.spark, self.path, self.length = spark, path.rstrip("/"), length
        self.changes = 0
        self.levels: list[Level] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Family:
        """The family as its last manifest has it."""
        row = spark.read.json(f"{path.rstrip('/')}/manifest").orderBy(F.desc("change")).first()
        family = cls(spark, path, row.length)
        family.changes, family.levels = row.change, [Level(**x) for x in json.loads(row.levels)]
        return family

    def _commit(self) -> None:
        self.changes += 1
        levels = json.dumps([asdict(x) for x in self.levels])
        row = self.spark.createDataFrame([(self.changes, self.length, levels)], "change long, length long, levels string")
        row.coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _remove(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def rows(self, level: Level, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(level.path).where(F.col("kind") == ROW)

    def scan(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """Merges a batch of keyed documents with the levels: (late, doc, tie, seed, whole, run, kind), kinds REPEATED and BLOCK.

        With ``keep`` the batch becomes a level of size one, and levels of equal size become one of twice the size, until none are
        equal: all in the same pass, which has every row of them in order anyway.
        """
        joined, size = [], 1
        while keep and len(joined) < len(self.levels) and self.levels[-1 - len(joined)].batches == size:
            joined.append(self.levels[-1 - len(joined)])
            size *= 2
        rows = suffix_array(batch, self.length)
        stored = _schema(batch, *((n, T.LongType()) for n in ("seed", "whole", "run")), ("kind", T.ByteType()))
        for level in self.levels:
            state = F.lit(MERGES if level in joined else STAYS).cast("byte")
            rows = rows.unionByName(self.rows(level, stored).drop("kind").withColumn("state", state))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        path = f"{self.path}/{uuid.uuid4().hex}"
        with spent_shuffles_removed(self.spark), small_batches(self.spark, PART_BYTES):
            merge_scan(rows, self.length, keep, buckets).write.partitionBy("kind").parquet(path)
        if keep:
            self.levels = [x for x in self.levels if x not in joined] + [Level(path, size)]
            self._commit()
            for level in joined:
                self._remove(f"{level.path}/kind={ROW}")
        return self.spark.read.schema(stored).parquet(path).where(F.col("kind") != ROW)

    def add(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """(late, doc, tie, start, passages): what of a batch of keyed documents stands in an earlier batch, or earlier in its own.

        ``corpus`` has the keyed documents of all batches, this one included; of earlier ones only those are read further that
        share the beginning of a run with the batch. Earlier batches come first, whatever their ids.
        """
        found = self.scan(batch)
        new = batch.select(*PLACE).distinct().withColumn("new", F.lit(True))
        blocks = found.where(F.col("kind") == BLOCK).join(new, PLACE, "left").withColumn("new", F.coalesce("new", F.lit(False)))
        compared = compare_blocks(blocks, corpus, self.length).join(new.drop("new"), PLACE, "left_semi")
        return repeated_runs(found).unionByName(compared)

    def finish(self) -> None:
        """Removes the levels of a corpus that is complete; what the scans have found stays and can be read on."""
        for level in self.levels:
            self._remove(f"{level.path}/kind={ROW}")
        self.levels = []
        self._commit()

    def drop(self) -> None:
        """Removes the family with all its files."""
        self._remove(self.path)
        self.levels = []


def repeated_runs(found: DataFrame) -> DataFrame:
    """(late, doc, tie, start, passages) of the runs that a scan has found to stand earlier as a whole."""
    passages = F.shiftright("run", PASSAGES).bitwiseAND(127)
    return found.where(F.col("kind") == REPEATED).select(*PLACE, F.shiftright("run", START).alias("start"), passages.alias("passages"))


def passage_hashes(blocks: pa.ChunkedArray, count: np.ndarray, length: int) -> np.ndarray:
    """The hashes of the first ``count`` passages of each block, one behind the other; some blocks are hashed at a time."""
    size = count + length - 1
    upto = np.cumsum(size)
    cuts = np.flatnonzero(np.diff(upto // BLOCK_BYTES, prepend=0))
    out = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(count)]):
        if a < b:
            data = np.frombuffer(b"".join(blocks.slice(a, b - a).to_pylist()), np.uint8)
            first = np.repeat(upto[a:b] - size[a:b] - (upto[a] - size[a]) - (np.cumsum(count[a:b]) - count[a:b]), count[a:b])
            out.append(Hashes(data).windows(length)[first + np.arange(len(first))])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def compare_blocks(blocks: DataFrame, corpus: DataFrame, length: int) -> DataFrame:
    """(late, doc, tie, start, passages): the passages of blocks that stand in an earlier block with the same key.

    Only documents with blocks are dealt out, to meet them; each block's bytes then go to its key. Their passages are compared
    there in order of ``new`` (if there is such a column) and place. Keys with very many blocks are dealt out again, passage by passage.
    """
    if "new" not in blocks.columns:
        blocks = blocks.withColumn("new", F.lit(False))
    one = F.struct(F.col("seed").alias("key"), "run", "new")
    wanted = settle(blocks.select(*PLACE, one.alias("b")).groupBy(*PLACE).agg(F.collect_set("b").alias("blocks")), "blocks")
    has_blocks = member_test(wanted, PLACE, wanted.count(), MOST_CELLS)
    # Rows with one id and text are one document.
    met = corpus.where(has_blocks()).join(wanted, PLACE).select(*PLACE, "text", "blocks")
    longs = [(n, T.LongType()) for n in ("key", "run")]
    schema = _schema(corpus, *longs, ("new", T.BooleanType()), ("bytes", T.BinaryType()))

    def fetch(batches):
        for batch in _parts(batches):
            owner, key, run, new, parts = [], [], [], [], []
            for i, (data, found) in enumerate(zip(raw_texts(batch.column(3)), batch.column(4))):
                k, r, n = (found.values.field(x) for x in ("key", "run", "new"))
                start, count, _, _ = unpacked(r.to_numpy())
                parts += [data[a : a + m + length - 1] for a, m in zip(start.tolist(), count.tolist())]
                owner.append(np.full(len(r), i))
                key.append(k.to_numpy())
                run.append(r.to_numpy())
                new.append(n.to_numpy(zero_copy_only=False))
            places = [batch.column(j).take(pa.array(np.concatenate(owner))) for j in range(3)]
            made = [pa.array(np.concatenate(x)) for x in (key, run, new)]
            yield pa.RecordBatch.from_arrays([*places, *made, pa.array(parts, pa.binary())], names=schema.names)

    fetched = met.mapInArrow(fetch, schema).repartition("key").sortWithinPartitions("key", "new", *PLACE, "run")
    result = _schema(corpus, ("start", T.LongType()), ("passages", T.LongType()), ("key", T.LongType()), ("window", T.LongType()), ("new", T.BooleanType()))

    def compare(batches):
        in_parts = None
        for table, more in _groups(batches, "key"):
            key, run = table.column("key").to_numpy(), table.column("run").to_numpy()
            start, count, _, _ = unpacked(run)
            # A block that stands twice in the table of blocks, or in a document that does, is one.
            once = np.ones(len(run), bool)
            once[1:] = _changes(table, ["key", *PLACE, "run"])[1:]
            row = np.repeat(np.arange(len(run)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            window = passage_hashes(table.column("bytes"), count, length)
            parted = np.full(len(run), False)
            if more or in_parts == key[0]:
                parted = key == (key[-1] if more else key[0])
                if in_parts == key[0]:
                    parted |= key == key[0]
            in_parts = key[-1] if more else None
            use = once[row] & ~parted[row]
            r, s, w = row[use], step[use], window[use]
            # In order of place, so the first of equal passages is the earliest.
            order = np.lexsort((np.arange(len(r)), w, key[r]))
            later = np.zeros(len(r), bool)
            if len(r):
                later[order[1:]] = (w[order][1:] == w[order][:-1]) & (key[r][order][1:] == key[r][order][:-1])
            r, s = r[later], s[later]
            begins = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)][: len(r)]
            at = np.flatnonzero(begins)
            zero, none = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            yield pa.RecordBatch.from_arrays(
                _taken(table, r[at], start=start[r[at]] + s[at], passages=np.diff(np.r_[at, len(r)]), key=zero, window=zero, new=none), names=result.names
            )
            use = once[row] & parted[row]
            r, s, w = row[use], step[use], window[use]
            if len(r):
                new = table.column("new").to_numpy()[r]
                yield pa.RecordBatch.from_arrays(
                    _taken(table, r, start=start[r] + s, passages=np.zeros(len(r), np.int64), key=key[r], window=w, new=new), names=result.names
                )

    told = settle(fetched.mapInArrow(compare, result), "passages")
    spread = told.where("passages = 0")
    place = F.struct("new", *PLACE, "start")
    first = spread.groupBy("key", "window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = spread.join(first, ["key", "window"]).where(F.col("first") < place).select(*PLACE, "start", F.lit(1).cast("long").alias("passages"))
    return told.where("passages > 0").select(*PLACE, "start", "passages").union(later)


def batch_ranges(docs: DataFrame, batches: int) -> list[Column]:
    """Conditions that cut keyed documents into about equal batches in the order of their ids, whatever type these have."""
    drawn = docs.where("NOT late").select("doc").orderBy(F.xxhash64("doc")).limit(1000).collect() if batches > 1 else []
    ids = sorted((r.doc for r in drawn), key=lambda x: x.encode() if isinstance(x, str) else x)
    kind = docs.schema["doc"].dataType
    cuts = [F.lit(x).cast(kind) for x in dict.fromkeys(ids[len(ids) * i // batches] for i in range(1, batches) if ids)]
    ranges = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if low is None else F.col("late") | (F.col("doc") >= low)
        ranges.append(inside if high is None else inside & ~F.col("late") & (F.col("doc") < high))
    return ranges


def find_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """(late, doc, tie, start, passages): every passage of keyed documents that also starts earlier, in runs.

    Documents come in ``batches`` of about equal numbers in the order of their ids; each, the last one too, is merged with the
    family that the ones before it have made and becomes a level of it, levels of equal size becoming one. The last level goes when
    all batches are scanned, so that it does not lie beside the texts that are compared. What has to be compared by passages is compared once, for all batches.
    """
    spark = docs.sparkSession
    family = Family(spark, scratch_path(spark, "suffixes"), length)
    ranges = batch_ranges(docs, batches)
    found = [family.scan(docs.where(inside)) for inside in ranges]
    family.finish()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    with spent_shuffles_removed(spark), small_batches(spark, PART_BYTES):
        compared = compare_blocks(every.where(F.col("kind") == BLOCK), docs, length)
        return settle(repeated_runs(every).unionByName(compared), "repeated")


def strip(data: bytes, stretches: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of some bytes without the stretches [start, end), how many bytes go, and in how many separate runs."""
    kept, at, removed, count, end_before = [], 0, 0, 0, -1
    for start, end in sorted(stretches):
        if start > end_before:
            kept.append(data[at:start])
            count += 1
            removed += end - start
            end_before = end
        elif end > end_before:
            removed += end - end_before
            end_before = end
        at = max(at, end)
    kept.append(data[at:])
    return b"".join(kept), removed, count


RESULT = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.BinaryType())]


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept holds the bytes that are left.

    Every byte goes that lies in a passage of ``length`` bytes which also starts earlier: in a document with a smaller id, or further
    ahead in its own. Passages never cross documents and are judged on the texts given. A null text is an empty one; rows without
    an id come after all others; rows with one id but different texts are ordered by a hash of the text; rows that agree in both
    are judged alike; ids may be of any type that has an order; an empty table gives an empty one. Texts end at 2 GB, as Spark's do.

    Only documents that have something to remove are dealt out to meet it; the others are finished where they are read, without a
    worker that would hold their texts once more.
    """
    rows = keyed(docs, id, text)
    found = find_repeats(rows, length, batches)
    with spent_shuffles_removed(docs.sparkSession):
        spans = settle(found.groupBy(*PLACE).agg(F.collect_list(F.struct("start", "passages")).alias("runs")), "removed")
    has_spans = member_test(spans, PLACE, spans.count(), MOST_CELLS)
    shown = F.when(~F.col("late"), F.col("doc")).alias(id)
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType)] + [T.StructField(n, k) for n, k in RESULT])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in _parts(batches):
            made = []
            for data, runs_ in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                kept, removed, count = strip(data, [(r["start"], r["start"] + r["passages"] + length - 1) for r in runs_ or []])
                made.append((len(data), removed, count, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(zip(*made))]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    flagged = rows.withColumn("__met", has_spans())
    met = flagged.where("__met").join(spans, PLACE, "left").select(shown, "text", "runs")
    whole, zero = F.col("text").cast("binary"), F.lit(0).cast("long")
    made = [F.octet_length("text").cast("long"), zero, zero, F.sha2(whole, 256), whole]
    rest = flagged.where("NOT __met").select(shown, *[c.alias(n) for c, (n, _) in zip(made, RESULT)])
    return met.mapInArrow(run, schema).unionByName(rest)
