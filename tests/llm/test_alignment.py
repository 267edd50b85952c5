"""Alignment against a plain one: both libraries over the whole text, common ends by sets, counts by a dictionary."""

import collections
import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import alignment, queries

SCHEMA = "doc_id long, text string, n_a int, groups string"


@pytest.fixture(scope="module")
def known():
    return alignment.read_tokenizers(queries.BYTE_LEVEL, queries.PIECES)


def odd_texts():
    rng = random.Random(5)
    alphabet = [" ", "  ", "\n", "\t", "a", "B", "é", "你", "👍", "'s", "1", "-", ".", " ", "　", "▁", "\x1c", "ﬁ", "<s>", "<|endoftext|>", "the", " of"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return made + [None, "", " ", "word " * 3000, "x" * 20_000, "A tale of two cities, retold.", "A tale of two cities, retold."]


def plain(texts, known):
    byte_level = Tokenizer.from_file(queries.BYTE_LEVEL)
    byte_level.encode_special_tokens = True
    encoder = alignment.Encoder(**known)
    links, groups = [], []
    for text in texts:
        found, linked = [], []
        if text:
            a, b = byte_level.encode(" " + text, add_special_tokens=False).ids, encoder.pieces.encode(text)
            target = (" " + text).encode()
            if b"".join(encoder.bytes_a[i] for i in a) == target == b"".join(encoder.bytes_b[i] for i in b):
                ends_a, ends_b = np.cumsum(encoder.length_a[a]), np.cumsum(encoder.length_b[b])
                i = j = 0
                for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
                    x, y = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
                    found.append((a[i:x], b[j:y]))
                    linked.append((a[x - 1], b[y - 1]))
                    i, j = x, y
        groups.append(found)
        links.append(linked)
    counts = collections.Counter(p for x in links for p in x)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for found, linked in zip(groups, links):
        sizes = [sum(len(g[k]) for g in found) for k in (0, 1)]
        total = sum(counts[p] for p in linked)
        out.append((*sizes, len(found), len(linked), sum(counts[p] == best[p[1]] for p in linked), total, found))
    return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_against_plain(spark, known):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 1, "g") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    want = plain(texts, known)
    assert sum(w[0] > 0 for w in want) > 60
    rows = alignment.align(docs, known).collect()
    assert len(rows) == len(texts) and list(rows[0].asDict()) == [*docs.columns, "__aligned"]
    for r in rows:
        x = r["__aligned"]
        assert (*list(x)[:6], [(g.a, g.b) for g in x.groups]) == want[r.doc_id], r.text
    for r in alignment.align(docs, known, digest=True).collect():
        groups = want[r.doc_id][-1]
        assert r["__aligned"].groups == (hashlib.sha256(written(groups).encode()).hexdigest() if groups else "")
    assert alignment.align(docs.limit(0), known).count() == 0
    nothing = spark.createDataFrame([(None, None, None, None), (1, "", None, None)], SCHEMA)
    assert [list(r["__aligned"])[:6] for r in alignment.align(nothing, known).collect()] == [[0] * 6] * 2


def test_cuts_of_any_ends():
    rng = random.Random(8)
    for _ in range(200):
        ends = [sorted({rng.randint(1, 400) for _ in range(rng.randint(1, 150))} | {401 + 10 * rng.randint(0, 1)}) for _ in (0, 1)]
        ends[1][-1] = ends[0][-1] = 500
        a, b = (np.array(x) for x in ends)
        cuts = alignment.shared_cuts(a, b, [0, len(a)], [0, len(b)])
        common = sorted(set(ends[0]) & set(ends[1]))
        assert a[cuts[0]].tolist() == common == b[cuts[1]].tolist()


def test_query(spark, known):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").collect()
    want = dict(zip((r.doc_id for r in docs), plain([r.text for r in docs], known)))
    rows = queries.QUERIES["op13_tokenizer_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        *numbers, groups = want[r.doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(written(groups).encode()).hexdigest() if groups else "")
