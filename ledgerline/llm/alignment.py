"""Cross-tokenizer alignment: two tokenizations of each text are divided at byte offsets where tokens of both end."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.llm.shared import send
from ledgerline.runtime import settle

# Fixed value: the pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A single space between two other characters begins a token in both tokenizers, so long texts can be cut there.
CUT = re.compile(r"(?<=\S) (?=\S)")
# Characters that are encoded at once at least, and that texts have until they are aligned together.
PIECE_CHARS = 1 << 16
BLOCK_CHARS = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizers(byte_file: str, piece_file: str) -> dict:
    """Both vocabularies as plain data, read where the job is started and sent to the tasks.

    The byte-level file must list its merges in the order of their ids: then the lowest id is the next merge, and ids are ranks.
    """
    with open(byte_file, "rb") as f:
        spec = json.loads(f.read())
    letters = byte_letters()
    vocab = spec["model"]["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", ()) if t.get("special")}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) != ("ByteLevel", False, True):
        raise ValueError(f"{byte_file} is no plain byte-level vocabulary")
    if merged != sorted(merged):
        raise ValueError(f"{byte_file} does not list its merges in the order of their ids")
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    with open(piece_file, "rb") as f:
        model = f.read()
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    # A piece that goes on behind a space would cross the places where units are cut.
    if any(re.search("[^▁]▁", pieces.id_to_piece(i)) for i in range(pieces.get_piece_size())):
        raise ValueError(f"{piece_file} has pieces that cross a space")
    return {"ranks": ranks, "model": model}


def piece_bytes(pieces: sentencepiece.SentencePieceProcessor, i: int) -> bytes:
    if pieces.is_byte(i):
        return bytes([int(pieces.id_to_piece(i)[3:5], 16)])
    return b"" if pieces.is_control(i) else pieces.id_to_piece(i).replace("▁", " ").encode()


class Encoder:
    """Both tokenizations of texts as arrays of ids."""

    def __init__(self, ranks: dict[bytes, int], model: bytes) -> None:
        self.byte_level = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [piece_bytes(self.pieces, i) for i in range(self.pieces.get_piece_size())]
        self.length_a = np.array([len(t) for t in self.bytes_a])
        self.length_b = np.array([len(t) for t in self.bytes_b])
        self.names = np.array([str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)

    def text(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a space and the text in both; None if one of them does not give the bytes back."""
        a: list[int] = []
        b: list[int] = []
        for piece in pieces(" " + text):
            a += self.byte_level.encode_ordinary(piece)
            b += self.pieces.encode(piece[1:])
        joined_a, joined_b = b"".join(map(self.bytes_a.__getitem__, a)), b"".join(map(self.bytes_b.__getitem__, b))
        return (a, b) if joined_a == joined_b == (" " + text).encode() else None


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """A text that begins with a space in parts of at least ``size`` characters that do so, too: see CUT."""
    out, start = [], 0
    while len(text) - start > size and (found := CUT.search(text, start + size)):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a, first_b) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``ends_a`` and ``ends_b`` of the ends that both have, in order.

    ``ends`` are the growing byte offsets of several texts, one behind the other; ``first`` says where each text's tokens begin, with
    the total number last. Each text's last ends are equal. Every interval between known cuts looks for a common end near its
    middle, by bisection in the other tokenizer's ends from the middle outwards, and both halves go on, all intervals of a level
    together. An interval without one is a leaf.
    """
    la, ha = np.asarray(first_a[:-1]), np.asarray(first_a[1:])
    lb, hb = np.asarray(first_b[:-1]), np.asarray(first_b[1:])
    cuts_a, cuts_b = [ha - 1], [hb - 1]
    while len(la):
        inside = (ha - la > 1) & (hb - lb > 1)
        la, ha, lb, hb = la[inside], ha[inside], lb[inside], hb[inside]
        cut = np.full(len(la), -1)
        open_ = np.arange(len(la))
        reach = 0
        while len(open_):
            low, high = la[open_], ha[open_] - 2
            middle = (low + high) // 2
            left, right = np.maximum(low, middle - reach), np.minimum(high, middle + reach)
            size = right - left + 1
            start = np.cumsum(size) - size
            tried = np.arange(size.sum()) - np.repeat(start - left, size)
            value = ends_a[tried]
            away = np.where(ends_b[np.searchsorted(ends_b, value)] == value, np.abs(tried - np.repeat(middle, size)), len(ends_a))
            least = np.minimum.reduceat(away, start)
            hit = least < len(ends_a)
            # The smaller of two places equally far away.
            place = np.where(away == np.repeat(least, size), tried, len(ends_a))
            cut[open_[hit]] = np.minimum.reduceat(place, start)[hit]
            open_ = open_[~hit & ((left > low) | (right < high))]
            reach = 4 * reach + 1
        found = cut >= 0
        la, ha, lb, hb, cut = la[found], ha[found], lb[found], hb[found], cut[found]
        other = np.searchsorted(ends_b, ends_a[cut])
        cuts_a.append(cut)
        cuts_b.append(other)
        la, ha = np.concatenate([la, cut + 1]), np.concatenate([cut + 1, ha])
        lb, hb = np.concatenate([lb, other + 1]), np.concatenate([other + 1, hb])
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


class Block:
    """Some texts aligned together: ids of both sides, where each text begins, and the tokens at the shared cuts."""

    def __init__(self, encoder: Encoder, texts: list[str | None]) -> None:
        empty: tuple[list[int], list[int]] = ([], [])
        both = [(encoder.text(t) or empty) if t else empty for t in texts]
        self.n_a, self.n_b = (np.array([len(x[side]) for x in both], np.int64) for side in (0, 1))
        self.a, self.b = (np.fromiter(chain.from_iterable(x[side] for x in both), np.int32) for side in (0, 1))
        self.first_a, self.first_b = np.concatenate([[0], np.cumsum(self.n_a)]), np.concatenate([[0], np.cumsum(self.n_b)])
        filled = np.flatnonzero(self.n_a)
        if len(filled):
            starts_a, starts_b = np.append(self.first_a[filled], len(self.a)), np.append(self.first_b[filled], len(self.b))
            ends_a, ends_b = np.cumsum(encoder.length_a[self.a]), np.cumsum(encoder.length_b[self.b])
            self.cut_a, self.cut_b = shared_cuts(ends_a, ends_b, starts_a, starts_b)
        else:
            self.cut_a = self.cut_b = np.zeros(0, np.int64)
        # Groups of text i are first[i] to first[i + 1]; a group ends with the link of its last tokens.
        self.first = np.searchsorted(self.cut_a, self.first_a)

    def pairs(self, width: int) -> np.ndarray:
        """Both ids of each link as one number."""
        return self.a[self.cut_a].astype(np.int64) * width + self.b[self.cut_b]

    def written(self, names: np.ndarray) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``. ``names`` holds the decimal ids."""
        size_a, size_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)
        group_a, group_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
        # The tokens of group g on one side follow those of both sides before it.
        before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b)
        at_a = np.arange(len(self.a)) + (before_b - size_b)[group_a]
        at_b = np.arange(len(self.b)) + (before_a + size_a)[group_b]
        mark_a, mark_b = np.full(len(self.a), ",", object), np.full(len(self.b), ",", object)
        mark_a[self.cut_a], mark_b[self.cut_b] = "|", ";"
        out = np.empty(2 * (len(self.a) + len(self.b)), object)
        out[2 * at_a], out[2 * at_a + 1], out[2 * at_b], out[2 * at_b + 1] = names[self.a], mark_a, names[self.b], mark_b
        first = 2 * (self.first_a + self.first_b)
        return ["".join(out[i : j - 1]) if j > i else "" for i, j in zip(first[:-1], first[1:])]


def _blocks(texts: list[str | None]):
    """Ranges of rows that are aligned together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size > BLOCK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if texts:
        yield start, len(texts)


def _encoder(state: dict) -> Encoder:
    """The worker's encoder: a broadcast value is unpacked once in each worker process and keeps what is built from it."""
    if "encoder" not in state:
        state["encoder"] = Encoder(state["ranks"], state["model"])
    return state["encoder"]


GROUPS = "array<struct<a:array<int>,b:array<int>>>"
COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def _grouped(written: str) -> list[dict]:
    sides = (g.split("|") for g in written.split(";")) if written else ()
    return [{"a": [int(x) for x in a.split(",")], "b": [int(x) for x in b.split(",")]} for a, b in sides]


def encoded(docs: DataFrame, tokenizers: dict, text: str = "text", digest: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``__found``: (n_a, n_b, n_groups, n_links, groups, pairs, times), before corpus counts.

    ``pairs`` are the different links of the text, ``a * size of b + b``, and ``times`` how often each occurs in it.
    """
    made = send(docs.sparkSession, Encoder, **tokenizers)
    kind = T._parse_datatype_string(f"{COUNTS}, groups {'string' if digest else GROUPS}, pairs array<long>, times array<int>")
    schema = T.StructType([*docs.schema.fields, T.StructField("__found", kind)])
    searched = len(docs.columns)
    as_arrow = to_arrow_type(kind)

    def run(batches):
        encoder = made()

        def found(texts):
            block = Block(encoder, texts)
            written = block.written(encoder.names)
            if digest:
                groups = pa.array([hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written], pa.string())
            else:
                groups = pa.array([_grouped(w) for w in written], as_arrow.field("groups").type)
            size = np.diff(block.first)
            # The different links of each text, in the order of text and pair.
            owner, pair = np.repeat(np.arange(len(texts)), size), block.pairs(len(encoder.length_b))
            order = np.lexsort((pair, owner))
            owner, pair = owner[order], pair[order]
            begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])][: len(pair)])
            times = np.diff(np.r_[begin, len(pair)]).astype(np.int32)
            offsets = pa.array(np.searchsorted(owner[begin], np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pair[begin], times)]
            numbers = [pa.array(x, pa.int64()) for x in (block.n_a, block.n_b, size, size)]
            return pa.StructArray.from_arrays([*numbers, groups, *lists], fields=list(as_arrow))

        for batch in batches:
            texts = batch.column(searched).to_pylist()
            for i, j in _blocks(texts):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:searched]), found(texts[i:j])], names=schema.names)

    # The text again as the last column, so that its place is known whatever the others are called.
    return docs.select("*", F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def link_counts(found: DataFrame, tokenizers: dict) -> DataFrame:
    """(a, b, n): how many links of all texts hold the ids a and b, from ``encoded`` rows.

    Of two tokens that end together one is the ending of the other, so there are at most as many pairs as the tokens of both
    vocabularies have endings, about 500,000 for two of usual size, however many texts there are. Tasks add up their own first.
    """
    width = F.lit(sentencepiece.SentencePieceProcessor(model_proto=tokenizers["model"]).get_piece_size()).cast("long")
    links = found.select(F.explode(F.arrays_zip("__found.pairs", "__found.times")).alias("l")).select("l.pairs", "l.times")
    counted = links.groupBy("pairs").agg(F.sum("times").alias("n"))
    return counted.select(F.expr("pairs").alias("code"), (F.floor(F.col("code") / width)).alias("a"), F.pmod("code", width).alias("b"), "n")


def align(docs: DataFrame, tokenizers: dict, text: str = "text", digest: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``__aligned``: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups).

    A space and the text are encoded by both tokenizers, without special tokens. The tokens between two byte offsets where both
    have an end form a group: ``groups`` holds the ids of each, or with ``digest`` the SHA-256 of their written form (empty without
    tokens). A link is a pair of tokens that end together. ``count_sum`` adds up how often each link's pair of ids is linked in the
    whole table, ``n_best`` counts the links whose pair is the most frequent one of its second id, ties included.

    Null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens: zeros and no
    groups. Rows are judged in place, so repeated rows and null ids need nothing special; an empty table gives an empty one. Other
    columns keep their names, whatever these are (``__found``, ``__text`` and ``__aligned`` are reserved). A long text is
    encoded in parts between single spaces, which gives the same ids as encoding it whole; a stretch without one is not cut.

    The encoded rows are written to the shared folder and read twice: for the counts, and to mark the links with them. The counts
    are sent to every task; see ``link_counts`` for their bound.
    """
    found = settle(encoded(docs, tokenizers, text, digest), "aligned")
    counted = link_counts(found, tokenizers).toArrow()
    codes, b, counts = (counted[n].to_numpy() for n in ("code", "b", "n"))
    highest = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
    np.maximum.at(highest, b, counts)
    order = np.argsort(codes)
    table = docs.sparkSession.sparkContext.broadcast((codes[order], counts[order], (counts == highest[b])[order]))
    schema = T.StructType([T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    @F.pandas_udf(schema)
    def marked(pairs: pd.Series, times: pd.Series) -> pd.DataFrame:
        codes, counts, best = table.value
        size = np.array([len(p) for p in pairs])
        at = np.searchsorted(codes, np.concatenate([*pairs, np.zeros(0, np.int64)]).astype(np.int64))
        weight = np.concatenate([*times, np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        sums = np.zeros((2, len(size)), np.int64)
        np.add.at(sums[0], owner, weight * best[at])
        np.add.at(sums[1], owner, weight * counts[at])
        return pd.DataFrame({"n_best": sums[0], "count_sum": sums[1]})

    both = found.withColumn("__marked", marked("__found.pairs", "__found.times"))
    return both.select(
        *docs.columns, F.struct(*(f"__found.{n.split()[0]}" for n in COUNTS.split(", ")), "__marked.*", "__found.groups").alias("__aligned")
    )
