"""The trie against one that is built in memory and walked."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerline.llm import prefix_trie, sketches

SCHEMA = "conv_id long, turn long, role string, text string, depth int, part string"


def plain(rows, heads):
    conv = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:30]
            conv[c].append((turn is not None, turn or 0, digest, role, text))
    conv = {c: [t[3:] for t in sorted(turns)] for c, turns in conv.items()}
    new = {}
    for c, turns in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = conv.get(c - c % 5, [])[:h] + turns[h:] if heads else turns
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out = {}

    def walk(node):
        below = [walk(x) for x in children[node]]
        held = members[node]
        leaves = sum(x[0] for x in below) or 1
        saved = sum(x[1] for x in below) + (len(held) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(held) if len(new[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        key = (min(held), len(node))
        out[key] = (parent, len(held), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if new:
        walk(())
    return out


def compare(df, heads):
    turns = prefix_trie.numbered(df)
    if heads:
        turns = prefix_trie.rebuilt(turns, F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string")) % 9)
    rows = prefix_trie.trie(turns).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_bytes, r.ends_sha256) for r in rows}
    assert len(found) == len(rows) and found == plain(df.collect(), heads)


def test_awkward_conversations(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, 0, 1, 2]), rng.choice(["a", None]), rng.choice(["x", "é", None, ""]), 1, "p") for _ in range(150)]
    # One conversation holds a third of the rows, all equal.
    df = spark.createDataFrame(rows + [(3, 1, "a", "x", None, None)] * 80, SCHEMA).repartition(6)
    compare(df, True)
    compare(df, False)
    compare(df.limit(0), True)


def test_shared_beginnings(spark):
    # A common first turn, equal conversations, turnless ones after rebuilding, and single ones.
    rows = [(c, t, "u", "hello" if t == 0 else str(c % 7) if c < 60 else str(c), 0, "") for c in range(90) for t in range(1 + c % 4)]
    compare(spark.createDataFrame(rows, SCHEMA).repartition(5), True)
    compare(spark.createDataFrame(rows, SCHEMA).repartition(5), False)


def test_turnless_conversations(spark):
    # Conversations whose own turns all lie within a head that the missing base does not have.
    short = [c for c in range(400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:5]
    compare(spark.createDataFrame([(c, 0, "u", "x", 0, "") for c in short], SCHEMA), True)


def test_sketch_proves_singletons(spark):
    """No prefix of several conversations is left out, and few single ones are let through."""
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, (3000, 2))
    keys[2000:2500] = keys[:500]
    df = spark.createDataFrame(pa.table({"k1": keys[:, 0], "k2": keys[:, 1]}).to_pandas()).repartition(3)
    width = 1 << 14
    left = sketches.marked(np.frombuffer(sketches.screen(df, width), np.uint8), keys[:, 0], keys[:, 1], width)
    assert left[:500].all() and left[2000:2500].all() and left[500:2000].mean() < 0.01


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_CHARS", 20)
    ends = [(k, -k, c) for k in range(3) for c in range(k, 200, k + 1)]
    found = prefix_trie.ends_digest(spark.createDataFrame(ends, "k1 long, k2 long, conv long").repartition(7)).collect()
    want = {k: hashlib.sha256(",".join(str(c) for c in range(k, 200, k + 1)).encode()).hexdigest() for k in range(3)}
    assert {r.k1: r.ends_sha256 for r in found} == want and len(found) == 3
