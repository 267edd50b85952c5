"""Licence scan against a plain search of words, and the expression parser against a recursive one."""

import random
import re

import pytest

from ledgerline.llm import licenses, queries

SCHEMA = "doc_id long, text string, n_words int, places string"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_base(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


def texts():
    rng = random.Random(4)
    parts = ["mit", "MIT", "license", "License,", "apache", "general", "public", "GNU", "Lesser", "é", "x1", "license:", "\n", "(", "GPL-2.0-only"]
    made = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    made += [None, "", " \n", "mit license" * 3, "MIT-License mit_license", "general public license " * 20_000, "a" * 100_000]
    return made + ["SPDX-License-Identifier: MIT OR Apache-2.0\n" * 2, "Licensed under CC BY-NC 4.0.", "GNU Lesser General Public License"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [(3, "the MIT license", 1, ""), (None, "apache license", None, None)] + rows[:2], SCHEMA).repartition(4)


def test_words_and_base_places(docs):
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count() and list(rows[0].asDict())[:4] == docs.columns
    for r in rows:
        x = r["__licenses"]
        n, base, first, last, labels = plain_base(r.text)
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (n, base, first, last, labels)
        assert set(labels) <= set(x.labels) and x.labels == sorted(set(x.labels)) and 0 <= x.score <= 1 and (x.score > 0) == bool(x.labels)
        for p in x.places:
            assert 0 <= p["first"] < p["last"] <= len(r.text.encode())
    assert licenses.scan(docs.limit(0)).count() == 0


def test_added_labels():
    scanner = licenses.Scanner()

    def labels(text):
        return sorted({p[1] for p in scanner.scan(text.encode())[2]})

    assert labels("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */") == ["apache", "gpl", "mit"]
    assert labels('"license": "BSD-3-Clause",') == ["bsd"] and labels("License = MPL-2.0.") == ["mpl"]
    assert labels("License: see the file") == [] and labels("no license here") == [] and labels("driver license 12") == []
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc"] and labels("under CC BY 4.0") == ["cc-by"]
    assert labels("GNU Lesser General Public License") == ["gpl", "lgpl"]
    text = "é\nSPDX-License-Identifier: MIT and Apache-2.0 or so"
    (place, _) = scanner.scan(text.encode())[2]
    assert text.encode()[place[2] : place[3]].decode() == "SPDX-License-Identifier: MIT and Apache-2.0"
    assert place[4:] == ("MIT Apache-2.0 and", True)


def plain_value(tokens):
    """Value of an expression by descent: or, and, with, atoms."""

    def either(i):
        value, i = both(i)
        while i < len(tokens) and tokens[i] == "or":
            other, i = both(i + 1)
            value = (value[0] | other[0], value[1] or other[1])
        return value, i

    def both(i):
        value, i = atom(i)
        while i < len(tokens) and tokens[i] == "and":
            other, i = atom(i + 1)
            value = (value[0] | other[0], value[1] and other[1])
        return value, i

    def atom(i):
        if tokens[i] == "(":
            value, i = either(i + 1)
            return value, i + 1
        label, free = licenses.family(tokens[i])
        return ({label}, free), i + 3 if tokens[i + 1 : i + 2] == ["with"] else i + 1

    return either(0)[0]


def test_expressions():
    rng = random.Random(9)

    def build(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(["MIT", "GPL-3.0-or-later", "Apache-2.0", "MPL-2.0", "ISC"])
            return [name, "with", "LLVM-exception"] if rng.random() < 0.2 else [name]
        made = [*build(depth - 1), rng.choice(["and", "or"]), *build(depth - 1)]
        return ["(", *made, ")"] if rng.random() < 0.5 else made

    for _ in range(300):
        tokens = build(4)
        assert licenses.evaluate(licenses.postfix(tokens)) == plain_value(tokens)
    for broken in (["MIT", "ISC"], ["and", "MIT"], ["(", "MIT"], ["MIT", ")"], ["MIT", "or"], [], ["(", ")"], ["MIT", "(", "ISC", ")"]):
        assert licenses.postfix(broken) is None
    assert licenses.evaluate(["Nothing-1.0"]) is None and licenses.evaluate(["MIT", "ISC", "with"]) is None
    assert licenses.evaluate(["MIT", "ISC", "and", "LLVM-exception", "with"]) is None


def test_query(spark):
    rows = queries.QUERIES["op11_license_scans"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (*plain_base(texts[r.doc_id])[:4], ",".join(plain_base(texts[r.doc_id])[4]))
