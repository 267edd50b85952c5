"""Licence scan: one Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.llm.decontamination import WORD, FOLD, normalised
from ledgerline.llm.words import raw_texts

# The phrases of the contract, by label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wordings of usual notices, by label.
NOTICES = {
    "all rights reserved": "proprietary",
    "affero general public license": "agpl",
    "apache software license": "apache",
    "boost software license": "boost",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "bsd license": "bsd",
    "bsd style license": "bsd",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "common development and distribution license": "cddl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "zlib license": "zlib",
}

# Words before a licence expression; a colon or an equals sign must follow.
TAGS = ("spdx license identifier", "license expression", "license")

# Beginnings of licence identifiers, their label, and whether the licence is permissive.
FAMILIES = (
    ("0bsd", "bsd", True),
    ("agpl-", "agpl", False),
    ("apache-", "apache", True),
    ("artistic-", "artistic", True),
    ("bsd-", "bsd", True),
    ("bsl-1.0", "boost", True),
    ("cc-by-nc-nd-", "cc-by-nc-nd", False),
    ("cc-by-nc-sa-", "cc-by-nc-sa", False),
    ("cc-by-nc-", "cc-by-nc", False),
    ("cc-by-nd-", "cc-by-nd", False),
    ("cc-by-sa-", "cc-by-sa", False),
    ("cc-by-", "cc-by", True),
    ("cc0-", "cc0", True),
    ("cddl-", "cddl", False),
    ("epl-", "epl", False),
    ("eupl-", "eupl", False),
    ("gpl-", "gpl", False),
    ("isc", "isc", True),
    ("lgpl-", "lgpl", False),
    ("licenseref-", "custom", False),
    ("mit", "mit", True),
    ("mpl-", "mpl", False),
    ("unlicense", "unlicense", True),
    ("zlib", "zlib", True),
)

# How sure a place makes of its label; a document's score is the chance that not all of its places mislead.
WEIGHT = {"tag": 0.95, "notice": 0.8, "phrase": 0.6}

STRENGTH = {"or": 1, "and": 2, "with": 3}
# An identifier may hold dots, hyphens and a plus; a full stop behind it belongs to the sentence.
TOKEN = re.compile(rb"[ \t]*(?:([()])|([A-Za-z0-9](?:[A-Za-z0-9.:+-]*[A-Za-z0-9+])?))")


def family(identifier: str) -> tuple[str, bool] | None:
    """Label of a licence identifier and whether it is permissive; None if it is unknown."""
    name = identifier.lower().removesuffix("+")
    for start, label, permissive in FAMILIES:
        if name == start or name.startswith(start if start.endswith("-") else f"{start}-"):
            return label, permissive
    return None


def postfix(tokens: list[str]) -> list[str] | None:
    """The tokens of an infix expression in postfix order by the shunting-yard method; None if it is not well-formed.

    ``with`` binds closer than ``and``, that closer than ``or``; operators of one strength group from the left.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        word = token.lower()
        if word in STRENGTH:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= STRENGTH[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: list[str]) -> tuple[set[str], bool] | None:
    """(labels, permissive) of a postfix expression; None if a licence is unknown or an exception is none.

    ``and`` asks for both sides, ``or`` leaves the choice, an exception behind ``with`` leaves its licence's label.
    """
    stack: list = []
    for token in expression:
        if token not in STRENGTH:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if not isinstance(left, str) or not isinstance(right, str) or "exception" not in right.lower():
                return None
            stack.append(left and family(left))
        else:
            left, right = (family(x) if isinstance(x, str) else x for x in (left, right))
            if left is None or right is None:
                return None
            named = [{x[0]} if isinstance(x[0], str) else x[0] for x in (left, right)]
            permissive = (left[1] and right[1]) if token == "and" else (left[1] or right[1])
            stack.append((named[0] | named[1], permissive))
        if stack[-1] is None:
            return None
    last = family(stack[0]) if isinstance(stack[0], str) else stack[0]
    if last is None:
        return None
    return ({last[0]} if isinstance(last[0], str) else set(last[0])), last[1]


def read_expression(data: bytes, at: int) -> tuple[list[str], int, set[str], bool] | None:
    """(postfix, end, labels, permissive) of the expression behind a tag that ends at ``at``; None if there is none.

    The longest well-formed beginning of the line counts, so words of a sentence or the end of a comment may follow it.
    """
    head = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?").match(data, at)
    if not head:
        return None
    tokens, ends, place = [], [], head.end()
    while found := TOKEN.match(data, place):
        tokens.append((found[1] or found[2]).decode())
        place = found.end()
        ends.append(place)
        # Two identifiers in a row: the sentence goes on.
        if len(tokens) > 1 and found[2] and tokens[-1].lower() not in STRENGTH and tokens[-2] != "(" and tokens[-2].lower() not in STRENGTH:
            break
    for n in range(len(tokens), 0, -1):
        ordered = postfix(tokens[:n])
        if ordered is not None and (value := evaluate(ordered)) is not None:
            return ordered, ends[n - 1], *value
    return None


class Scanner:
    """All phrases and tags in one automaton."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        kinds = {**{p: ("notice", label) for p, label in NOTICES.items()}, **{p: ("phrase", label) for p, label in BASE.items()}}
        kinds |= {p: ("tag", "") for p in TAGS}
        for phrase, (kind, label) in kinds.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase.split()), kind, label))
        self.automaton.make_automaton()

    def scan(self, data: bytes) -> tuple:
        """(n_words, first word of each base place, places); a place is (kind, label, first byte, last byte, expression, permissive).

        Every base place counts. Of the others, one inside a longer one does not, and a tag counts if a known expression follows.
        """
        text = normalised(data)
        n_words = max(text.count(b" ") - 1, 0)
        found = [(end, *value) for end, value in self.automaton.iter(text.decode("latin-1"))] if n_words else []
        if not found:
            return n_words, [], []
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        last = (np.searchsorted(spaces, [f[0] for f in found]) - 1).tolist()
        words = [(b - n + 1, b, kind, label) for b, (_, n, kind, label) in zip(last, found)]
        starts, ends = zip(*(m.span() for m in WORD.finditer(data.translate(FOLD))))
        base = [a for a, _, kind, _ in words if kind == "phrase"]
        places = []
        widest = -1
        # From the left, longer ones first: a place is inside another if one that began no later ends no earlier.
        for a, b, kind, label in sorted(words, key=lambda w: (w[0], -w[1])):
            inside, widest = b <= widest, max(widest, b)
            if kind == "tag":
                read = read_expression(data, ends[b])
                if read is not None:
                    ordered, end, labels, permissive = read
                    places += [("tag", x, starts[a], end, " ".join(ordered), permissive) for x in sorted(labels)]
            elif kind == "phrase" or not inside:
                places.append((kind, label, starts[a], ends[b], None, None))
        return n_words, base, places


PLACE = "kind string, label string, first long, last long, expression string, permissive boolean"
FOUND = f"""n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double,
    places array<struct<{PLACE.replace(' ', ':').replace(',:', ', ')}>>"""


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``__licenses``: (n_words, n_base, first_word, last_word, base_labels, labels, score, places).

    Words are runs of ASCII letters and digits and of bytes from 0x80 on, lower-cased in A-Z. ``n_base`` counts the places of the
    base phrases, overlaps included, ``first_word`` and ``last_word`` are their smallest and largest start (null without one).
    ``labels`` adds those of other notices and of licence expressions behind a tag, sorted. ``places`` holds each with its byte
    range [first, last) in the UTF-8 text, the expression in postfix order and whether it can be met by permissive licences alone.
    ``score`` is 0 without a place, else 1 less the product of what each different (kind, label) leaves open.

    A null or empty text has no words; a malformed expression or one with an unknown licence counts as far as its longest known
    beginning. Rows are judged in place, so ids may be null or repeated, other columns keep their names (``__text`` and
    ``__licenses`` are reserved), and an empty table gives an empty one. Texts are scanned whole, each once.
    """
    kind = T._parse_datatype_string(FOUND)
    as_arrow = to_arrow_type(kind)
    schema = T.StructType([*docs.schema.fields, T.StructField("__licenses", kind)])
    searched = len(docs.columns)
    names = [f.split()[0] for f in PLACE.split(", ")]

    def run(batches):
        scanner = Scanner()

        def row(data):
            n_words, base, places = scanner.scan(data or b"")
            open_ = 1.0
            for k, _ in sorted({p[:2] for p in places}):
                open_ *= 1 - WEIGHT[k]
            return {
                "n_words": n_words, "n_base": len(base),
                "first_word": min(base, default=None), "last_word": max(base, default=None),
                "base_labels": sorted({p[1] for p in places if p[0] == "phrase"}), "labels": sorted({p[1] for p in places}),
                "score": 1 - open_, "places": [dict(zip(names, p)) for p in places],
            }

        for batch in batches:
            made = pa.array([row(data) for data in raw_texts(batch.column(searched))], as_arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:searched], made], names=schema.names)

    # The text again as the last column, so that its place is known whatever the others are called.
    return docs.select("*", F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
