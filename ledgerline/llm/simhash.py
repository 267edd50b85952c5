"""SimHash near-duplicate groups: pigeonhole blocks find the pairs, their Hamming distance is verified."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerline.llm.components import components
from ledgerline.llm.words import raw_texts, shingles
from ledgerline.runtime import settle

SEED = 42
# Blocks beyond the distance: that many blocks agree between close fingerprints and form one join key together.
AGREEING = 3
# Fingerprints that share a join key are compared in pairs up to this many; larger sets are linked through their neighbourhoods.
CROWD = 16


def fingerprint(data: bytes | None, shingle: int) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if it is set in over half of the shingles' hashes. No words: 0."""
    ones, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for part in shingles((data or b"").lower(), shingle):
        hashes = np.fromiter((digest(x, SEED) for x in part), "<u8", len(part))
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
        total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, fingerprint, more columns) of every row, the fingerprint as a signed long. Lower-cases A-Z only. A null text has no words."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(x, shingle) for x in raw_texts(batch.column(1))]
            kept = [batch.column(i + 2) for i in range(len(more))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), *kept], names=[id, "fingerprint", *more])

    chosen = docs.select(id, F.col(text).cast("string").alias("__text"), *more)
    return chosen.mapInArrow(run, T.StructType([docs.schema[id], T.StructField("fingerprint", T.LongType()), *(docs.schema[c] for c in more)]))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _masks(distance: int) -> list[int]:
    """Bit masks of every choice of AGREEING blocks; two fingerprints within ``distance`` agree on one choice at least."""
    count = distance + AGREEING
    edges = [64 * i // count for i in range(count + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(blocks, AGREEING)]


def _flips(mask: int, radius: int) -> list[tuple[int, int]]:
    """(number of bits, bits) of every change of up to ``radius`` bits outside the mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [(n, sum(1 << i for i in x)) for n in range(radius + 1) for x in combinations(free, n)]


def _near(x: Column, y: Column, distance: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= distance


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(x, y): verified edges between distinct fingerprints (column ``fp``) that join all pairs within the distance.

    Pigeonhole: of distance + 3 blocks, close fingerprints differ in at most ``distance``, so they share the other three; each
    choice of three blocks is one join key of about 64 * 3 / (distance + 3) bits. A key that more than CROWD fingerprints share
    (copies of one text with small changes) is not paired out: two fingerprints are within the distance exactly if changes of
    half the distance each meet in one value, so the members of such a key are linked through those values, in a number of rows
    that is linear in the members. The pairs left out there are connected by the links that are returned.
    """
    masks = _masks(distance)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks))))
    keyed = prints.select("fp", keys.alias("k")).select("fp", "k.c", "k.v")
    shared = settle(keyed.join(keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1"), ["c", "v"]), "blocks")

    few = shared.where(F.col("n") <= CROWD)
    left, right = few.select("c", "v", F.col("fp").alias("x")), few.select("c", "v", F.col("fp").alias("y"))
    paired = left.join(right, ["c", "v"]).where((F.col("x") < F.col("y")) & _near(F.col("x"), F.col("y"), distance)).select("x", "y")

    far, close = (distance + 1) // 2, distance // 2
    changes = F.element_at(
        F.array(*(F.array(*(F.struct(F.lit(n).alias("bits"), F.lit(_signed(z)).alias("z")) for n, z in _flips(m, far))) for m in masks)),
        F.col("c") + 1,
    )
    met = (
        shared.where(F.col("n") > CROWD)
        .select("fp", F.explode(changes).alias("f"))
        .select("fp", "f.bits", F.col("fp").bitwiseXOR(F.col("f.z")).alias("z"))
        .distinct()
    )
    # All members of one value lie within the distance of those that needed at most ``close`` changes to get there.
    centre = met.groupBy("z").agg(F.min(F.when(F.col("bits") <= close, F.col("fp"))).alias("x"), F.count("*").alias("n")).where("n > 1")
    around = met.join(centre.where("x is not null").select("z", "x"), "z").select("x", F.col("fp").alias("y"))
    starred = around.where((F.col("x") != F.col("y")) & _near(F.col("x"), F.col("y"), distance))
    return paired.union(starred).distinct()


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Rows whose fingerprints differ in at most ``distance`` bits are linked, texts without words (null, empty) like any other with
    fingerprint zero; component_id is the smallest id that can be reached, the row's own included. Nulls among the ids never
    become a component_id unless a group has no other. Repeated rows give repeated results; an empty table gives an empty one.
    Equal fingerprints are merged before anything is compared, so a group of copies costs one row from there on.
    """
    prints = settle(fingerprints(docs, id, text, shingle), "prints")
    rooted = _rooted(prints, id, distance)
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(
        F.col("fp").alias("fingerprint"), "component_id"
    )
    return prints.join(named, "fingerprint").select(id, "fingerprint", "component_id")


def _rooted(prints: DataFrame, id: str, distance: int) -> DataFrame:
    """(fp, first, root) of every distinct fingerprint: its smallest id and the fingerprint that names its component."""
    groups = settle(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id).alias("first")), "groups")
    roots = components(links(groups.select("fp"), distance), "x", "y", "simhash")
    return groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def hex_fingerprint(column: str = "fingerprint") -> Column:
    """16 lower-case hexadecimal digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` with one row of each component_id left: that with the smallest id, then fingerprint, then hash of the row.

    Groups that have their smallest id in common have one component_id, so one of them is left. Rows without an id stay: nothing
    names them as a copy.
    """
    plain = [c for c, kind in docs.dtypes if c not in (id, text) and "map<" not in kind and kind != "variant"]
    keys = [id, "__text_hash", "__row_hash"]
    hashed = docs.withColumns({"__text_hash": F.xxhash64(F.col(text)), "__row_hash": F.xxhash64(*plain, F.col(text))})
    prints = settle(fingerprints(hashed, id, text, shingle, tuple(keys[1:])), "prints")
    # The smallest id stands at one of its group's fingerprints; of the rows with both, the one with the smallest hashes stays.
    named = _rooted(prints, id, distance).where("first is not null")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("first").alias(id), F.col("fp").alias("fingerprint"))).alias("best")).select("best.*")
    firsts = best.groupBy(id).agg(F.min("fingerprint").alias("fingerprint"))
    chosen = prints.join(firsts, [id, "fingerprint"], "left_semi").groupBy(id, "fingerprint").agg(F.min(F.struct(*keys[1:])).alias("h"))
    kept = hashed.join(chosen.select(id, "h.*"), keys, "left_semi").dropDuplicates(keys)
    return kept.select(*docs.columns).union(docs.where(F.col(id).isNull()))
