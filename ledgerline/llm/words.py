"""Words of a text as bytes, in pieces of bounded size, so that one very long text needs no more memory than a usual one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

PIECE_BYTES = 1 << 22


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each value, None for a null."""
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()


def pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """Consecutive parts of about ``size`` bytes, cut behind white space, so that no word is divided."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            while end < len(data) and data[end - 1] not in b" \t\n\v\f\r":
                end += 1
        yield data[start:end]
        start = end


def shingles(data: bytes, length: int) -> Iterator[list[bytes]]:
    """Lists of the text's shingles: ``length`` consecutive words joined by a space, repeats included.

    Words are separated by space, tab and the line breaks \\n \\v \\f \\r. A text with fewer words, but not none, has one shingle
    of all its words.
    """
    carried: list[bytes] = []
    made = False
    for piece in pieces(data):
        words = carried + piece.split()
        if len(words) >= length:
            made = True
            yield [b" ".join(x) for x in zip(*(words[i:] for i in range(length)))]
            carried = words[len(words) - length + 1 :] if length > 1 else []
        else:
            carried = words
    if carried and not made:
        yield [b" ".join(carried)]
