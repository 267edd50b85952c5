"""Prefix trie over conversations: a count-min sketch of prefix digests keeps what is surely unshared out of the shuffles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerline.llm.sketches import marked, screen, width_for
from ledgerline.runtime import settle

# Cells of each row of the sketch: eight for each prefix up to this bound. Beyond it more prefixes are taken for possibly shared and
# shuffled; the result is the same.
MOST_CELLS = 1 << 24
CHUNK_CHARS = 1 << 20


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, depth, t1, t2, bytes, part): every turn's place in its conversation from 1 on, 120 bits of its digest and its size.

    Turns are ordered by ``turn``, nulls first, then by digest; a null role or text counts as empty; rows without a conversation are
    left out. Turns are dealt to ranges of (conversation, turn), numbered inside each and moved on by the sizes of the ranges
    before, so that a conversation of any length is spread over tasks.
    """
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256)
    turns = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("bytes"),
        # Equal turns may hold a third of the table: their place in the input tells them apart.
        F.monotonically_increasing_id().alias("at"),
    )
    half = lambda i: F.conv(F.substring("digest", i, 15), 16, 10).cast("long")
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    narrow = turns.select("conv", "turn", half(1).alias("t1"), half(16).alias("t2"), "bytes", "at")
    dealt = narrow.repartitionByRange("conv", *order, "at").drop("at").withColumn("part", F.spark_partition_id())
    rows = settle(dealt, "turns")
    inside = rows.withColumn("nth", F.row_number().over(W.partitionBy("conv", "part").orderBy(*order)))
    return inside.join(_before(rows.groupBy("conv", "part").agg(F.count("*").alias("n")), {"n": F.sum}), ["conv", "part"]).select(
        "conv", (F.col("n") + F.col("nth")).alias("depth"), "t1", "t2", "bytes", "part"
    )


def _before(parts: DataFrame, totals: dict) -> DataFrame:
    """(conv, part, …): what the parts of a conversation before each one come to. There are at most as many as tasks wrote."""
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select("conv", "part", *(F.coalesce(how(c).over(earlier), F.lit(0)).alias(c) for c, how in totals.items()))


def rebuilt(turns: DataFrame, base, head) -> DataFrame:
    """Numbered turns of conversations that begin with the head of another one.

    ``base`` and ``head`` are columns over ``conv``: the conversation whose first turns each one takes over, and how many (a bounded
    number); its own turns follow after the first ``head``. Conversations that have no turn left are in the result with a row of
    depth 0, which belongs to the root.
    """
    # Written once: read for the lengths, the heads and the rows that stay.
    turns = settle(turns, "numbered")
    lengths = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("base", base).withColumn("head", head)
    others = lengths.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("head", F.coalesce("n_base", F.lit(0).cast("long")))
    plan = lengths.join(others, "base", "left").select("conv", "base", "head", taken.alias("taken"), "n")
    plan = settle(plan, "rebuild")
    own = turns.join(plan.select("conv", "head", "taken"), "conv").where("depth > head")
    own = own.withColumn("depth", F.col("depth") - F.col("head") + F.col("taken")).select(*turns.columns)
    most = plan.agg(F.max("head")).scalar()
    heads = turns.where(F.col("depth") <= most).withColumnRenamed("conv", "base").drop("part")
    copied = heads.join(plan.where("taken > 0"), "base").where("depth <= head").select("conv", "depth", "t1", "t2", "bytes", F.lit(-1).alias("part"))
    nothing = plan.where("taken = 0 AND n <= head").select(
        "conv", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "bytes")), F.lit(-1).alias("part")
    )
    return own.unionByName(copied).unionByName(nothing)


def _prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every prefix (conv, depth, k1, k2, p1, p2, before, last), and (conv, n_turns, total) for every conversation.

    The digest of a prefix is the exclusive or of its turns' hashes, each taken with its place: parts of a conversation are added up
    apart, and the parent's digest needs no other row. ``before`` are the bytes in front of the last turn.
    """
    mixed = [F.xxhash64(F.lit(i), "depth", "t1", "t2").alias(f"e{i}") for i in (1, 2)]
    rows = settle(turns.select("conv", "depth", "part", "bytes", *mixed), "rebuilt")
    convs = settle(rows.groupBy("conv").agg(F.max("depth").alias("n_turns"), F.sum("bytes").alias("total")), "conversations")
    rows = rows.where("depth > 0")
    running = W.partitionBy("conv", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.select("*", *(F.bit_xor(c).over(running).alias(f"x{c}") for c in ("e1", "e2")), F.sum("bytes").over(running).alias("upto"))
    parts = rows.groupBy("conv", "part").agg(F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"), F.sum("bytes").alias("b"))
    carried = _before(parts, {"b1": F.bit_xor, "b2": F.bit_xor, "b": F.sum}).join(convs.select("conv", "n_turns"), "conv")
    k1, k2 = F.col("xe1").bitwiseXOR(F.col("b1")), F.col("xe2").bitwiseXOR(F.col("b2"))
    return inside.join(carried, ["conv", "part"]).select(
        "conv", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("e1")).alias("p1"), k2.bitwiseXOR(F.col("e2")).alias("p2"),
        (F.col("upto") + F.col("b") - F.col("bytes")).alias("before"), (F.col("depth") == F.col("n_turns")).alias("last"),
    ), convs


def _flagged(prefixes: DataFrame, n: int) -> DataFrame:
    """Adds ``shared`` and ``parent_shared``: whether the sketch leaves open that other conversations have the prefix too."""
    width = width_for(n, MOST_CELLS)
    sent = prefixes.sparkSession.sparkContext.broadcast(screen(prefixes, width))
    names = [*prefixes.columns, "shared", "parent_shared"]

    def flag(batches):
        bits = np.frombuffer(sent.value, np.uint8)

        for batch in batches:
            k1, k2, p1, p2 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k1", "k2", "p1", "p2"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(marked(bits, *k, width)) for k in ((k1, k2), (p1, p2)))], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema.fields)
    return prefixes.mapInArrow(flag, f"{kinds}, shared boolean, parent_shared boolean")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the SHA-256 of each node's conversations in ascending order, joined by commas.

    Conversations are dealt to ranges of (node, conversation) and written as pieces of text by many tasks; a node's pieces then pass
    through one task, which holds one at a time.
    """
    kind = ends.schema["conv"].dataType.simpleString()

    def pieces(batches):
        key, first, texts, size = None, None, [], 0
        for batch in batches:
            made: list[tuple] = []
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != key or size > CHUNK_CHARS:
                    if texts:
                        made.append((*key, first, ",".join(texts)))
                    key, first, texts, size = (a, b), conv, [], 0
                texts.append(str(conv))
                size += len(texts[-1]) + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["k1", "k2", "first", "ids"])
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, first, ",".join(texts))], names=["k1", "k2", "first", "ids"])

    def digests(batches):
        key, digest = None, None
        for batch in batches:
            made = []
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != key:
                    if key:
                        made.append((*key, digest.hexdigest()))
                    key, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["k1", "k2", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=["k1", "k2", "ends_sha256"])

    order = ["k1", "k2", "conv"]
    dealt = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    written = dealt.mapInArrow(pieces, f"k1 long, k2 long, first {kind}, ids string")
    ordered = written.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return ordered.mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row for every different sequence of first turns (node) of the numbered ``turns``, the root without turns included.

    ``conv_id`` is the smallest conversation that begins so (a member), ``depth`` the number of turns, ``parent_conv_id`` that of the
    node one turn shorter (null at the root), ``n_convs`` the members, ``n_children`` the nodes one turn longer, ``n_leaves`` the
    childless nodes below (itself included), ``saved_bytes`` what storing each last turn below once saves, and ``ends_sha256`` the
    digest of the members that end there (``ends_digest``; of the empty text if there are none). Without turns there are no rows.

    Prefixes that the sketch proves to be of one conversation are written out where they are; only the others are grouped, exactly,
    by 128-bit digests. What a conversation saves ends where its first own node begins, and that node is its own from there on: so
    sums over subtrees are sums over members of one number for each conversation, without walking the trie.
    """
    prefixes, convs = _prefixes(turns)
    prefixes = settle(prefixes, "prefixes")
    rows = settle(_flagged(prefixes, prefixes.count()), "screened")
    shared, tails = rows.where("shared"), rows.where("NOT shared")
    # Tails whose parent may be shared begin a conversation's own branch.
    branches = tails.where("parent_shared OR depth = 1")
    by_node = [F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("p1").alias("p1"),
        F.min("p2").alias("p2"), F.min("before").alias("before"), F.count_if("last").alias("n_ends")]
    groups = settle(shared.groupBy("k1", "k2").agg(*by_node), "groups")

    none = F.lit(None).cast("long")
    told = convs.select("conv", "total", none.alias("before"), F.lit(0).alias("leaf"))
    told = told.unionByName(groups.select(F.col("conv_id").alias("conv"), none.alias("total"), "before", (F.col("n_ends") == F.col("n_convs")).cast("int").alias("leaf")))
    told = told.unionByName(branches.select("conv", none.alias("total"), "before", F.lit(0).alias("leaf")))
    told = told.unionByName(tails.where("last").select("conv", none.alias("total"), none.alias("before"), F.lit(1).alias("leaf")))
    # Bytes of each conversation that a smaller one holds as well, and whether it stands for the node it ends at as a leaf.
    facts = told.groupBy("conv").agg(F.coalesce(F.min("before"), F.max("total")).alias("held"), F.max("leaf").alias("leaf"))
    facts = settle(facts, "facts")

    empty = hashlib.sha256(b"").hexdigest()
    saved = F.col("sum_held") - F.col("own_held") - (F.col("n_convs") - 1) * F.col("before")
    sums = [F.sum("held").alias("sum_held"), F.min_by("held", "conv").alias("own_held"), F.sum("leaf").alias("n_leaves")]
    nodes = shared.join(facts, "conv").groupBy("k1", "k2").agg(*by_node, *sums)
    # The root's digest is that of no turns.
    zero = F.lit(0).cast("long")
    root = convs.join(facts, "conv").agg(
        zero.alias("depth"), F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), none.alias("p1"), none.alias("p2"),
        zero.alias("before"), F.count_if(F.col("n_turns") == 0).alias("n_ends"),
        F.sum("held").alias("sum_held"), F.min_by("held", "conv").alias("own_held"), F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"),
    ).where("n_convs > 0").select(zero.alias("k1"), zero.alias("k2"), "*")
    kids = groups.select("p1", "p2").union(branches.select("p1", "p2")).groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    kids = kids.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    ended = shared.where("last").select("k1", "k2", "conv").union(convs.where("n_turns = 0").select(zero, zero, "conv"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256"]
    known = nodes.union(root).join(kids, ["k1", "k2"], "left").join(ends_digest(ended), ["k1", "k2"], "left").select(
        "conv_id", "depth", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", saved.alias("saved_bytes"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "p1", "p2",
    )
    alone = [
        F.col("conv").alias("conv_id"), "depth", F.lit(1).cast("long").alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_bytes"),
        F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(empty).alias("ends_sha256"),
    ]
    # The parents that are not the root: of groups and branches by digest, of all other tails the conversation itself.
    parents = groups.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    deep = known.where("depth > 1").unionByName(branches.where("depth > 1").select(*alone, "p1", "p2"))
    below = deep.join(parents, ["p1", "p2"]).select(*columns, "parent_conv_id")
    high = known.where("depth <= 1").unionByName(branches.where("depth = 1").select(*alone, "p1", "p2"))
    smallest = convs.agg(F.min("conv")).scalar()
    top = high.select(*columns, F.when(F.col("depth") == 1, smallest).alias("parent_conv_id"))
    own = tails.where("NOT parent_shared AND depth > 1").select(*alone, F.col("conv").alias("parent_conv_id"))
    return below.unionByName(top).unionByName(own)


def prefix_trie(conversations: DataFrame, **columns) -> DataFrame:
    """The trie of the conversations as they are; see ``numbered`` for how turns are ordered and ``trie`` for the result."""
    return trie(numbered(conversations, **columns))
