"""Cases that lose rows, links or records where an operator is careless, and columns with clashing names."""

import base64
import hashlib
import os
import random
import subprocess
import sys

import pytest

from ledgerline.llm import alignment, decontamination, language_id, pii, quality_rules, queries, token_counts, url_filters, warc

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make(n):
    return warc.record(n, f"http://h/{n}", f"payload {n} ".encode() * 20, None, "0")


def ids(found):
    return [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)]


def test_members_of_several_records():
    several = [make(i) for i in range(4)]
    data = warc.member(b"".join(several)) + b"\0" + warc.member(make(9))
    found = list(warc.salvage(data))
    assert ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 2, 3, 9)] and not any(isinstance(x, warc.Gap) for x in found)
    assert [x.inner for x in found[:4]] == [sum(map(len, several[:i])) for i in range(4)]
    # A damaged record inside a sound member: the others count, its bytes are logged.
    hurt = bytearray(b"".join(several))
    hurt[len(several[0]) + len(several[1]) - 20] ^= 1
    found = list(warc.salvage(warc.member(bytes(hurt))))
    assert ids(found) == [f"<urn:page:{i}>" for i in (0, 2, 3)]
    (gap,) = [x for x in found if isinstance(x, warc.Gap)]
    assert gap.reason == "wrong digest" and gap.inner == (len(several[0]), len(several[0]) + len(several[1]))
    # A first record that is damaged hides none behind it; junk behind the last one is logged.
    found = list(warc.salvage(warc.member(b"junk" + several[1] + several[2] + b"rest")))
    assert ids(found) == ["<urn:page:1>", "<urn:page:2>"] and [x.inner for x in found if isinstance(x, warc.Gap)][0] == (0, 4)
    assert sum(isinstance(x, warc.Gap) for x in found) == 2
    assert [x.reason for x in warc.salvage(warc.member(b""))] == ["no header"]


def test_records_in_front_of_a_break():
    rng = random.Random(1)
    noise = [warc.record(i, "http://h/", rng.randbytes(40_000), None, "0") for i in range(6)]
    packed = warc.member(b"".join(noise))
    found = list(warc.salvage(packed[: len(packed) // 2] + warc.member(make(7))))
    assert ids(found)[:2] == ["<urn:page:0>", "<urn:page:1>"] and ids(found)[-1] == "<urn:page:7>"
    assert any(isinstance(x, warc.Gap) for x in found)


@pytest.mark.parametrize("written", [lambda d: "sha1:" + base64.b32encode(d).decode(), lambda d: "SHA1:" + d.hex().upper()])
def test_other_digests_are_checked(written):
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Block-Digest: {}\r\nContent-Length: {}\r\n\r\n"
    sound = head.format(written(hashlib.sha1(block).digest()), len(block)).encode() + block + b"\r\n\r\n"
    assert [type(x) for x in warc.salvage(sound)] == [warc.Record]
    assert [x.reason for x in warc.salvage(sound.replace(b"body", b"bodx"))] == ["wrong digest"]


def test_items_without_an_id(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"start {passage} end"), (2, "nothing"), (3, f"{passage} {passage.replace('w', 'v')}")], "doc_id long, text string")
    items = [(None, passage), (None, passage + " more"), ("b", passage.replace("w", "v")), (None, None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc_id: r for r in decontamination.find_passages(docs, bench).collect()}
    assert (found[1].n_hit, found[1].n_items, found[1].items) == (13, 1, [None]) and found[1].contaminated
    assert found[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert (found[2].n_hit, found[2].n_items) == (0, 0)
    assert (found[3].n_hit, found[3].n_items, found[3].items_sha256) == (26, 2, hashlib.sha256(b"b").hexdigest())


def test_links_with_entities_and_dots(spark):
    link = '<link rel="canonical" href="{}">'
    cases = [
        ("http://a.b/x", link.format("/y?a=1&amp;b=2"), "http://a.b/y?a=1&b=2"),
        ("http://a.b/x", link.format("/y?a=1&#38;b=&#x32;&#x1F600;"), "http://a.b/y?a=1&b=2\U0001f600"),
        ("http://a.b/x", link.format("/y?t=&amp;lt;"), "http://a.b/y?t=&lt;"),
        ("http://a.b/p/q/r.html", link.format("../s.html"), "http://a.b/p/s.html"),
        ("http://a.b/p/q/r.html", link.format("./../../../s/./t/.."), "http://a.b/s/"),
        ("http://a.b/p/q/", link.format("."), "http://a.b/p/q/"),
        ("http://a.b/p", link.format("http://c.d/..?x=/../y"), "http://c.d/?x=/../y"),
        ("http://a.b/p", link.format("http://c.d/a..b/...c/."), "http://c.d/a..b/...c/"),
        ("http://a.b/p", '<meta http-equiv="refresh" content="0; url=/k?a&amp;b">', "http://a.b/k?a&b"),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(cases)], "page_id long, url string, html string")
    for i, (u, _, target) in enumerate(cases):
        assert [(r.a, r.b) for r in url_filters.page_links(pages.where(f"page_id = {i}")).collect()] == [(u, target)]
    rules = spark.createDataFrame([("c.d", "/k/", "block")], "host string, path string, verdict string")
    rows = [(1, "http://c.d/k/1?a=1&b=2", ""), (2, "http://e.f/k/l", link.format("http://c.d/j/../k/1?a=1&amp;b=2")), (3, "http://e.f/other", "")]
    judged = {r.page_id: r.verdict for r in url_filters.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert judged == {1: "block", 2: "block", 3: "allow"}


def test_identifiers_that_do_not_fit_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    wide = token_counts.Tokenizer({b"a": 0, b"b": 65_535}, queries.PATTERN)
    with pytest.raises(ValueError, match="do not fit"):
        token_counts.document_counts(docs, str(tmp_path / "a"), wide)
    assert token_counts.document_counts(docs, str(tmp_path / "b"), wide, width=4).first().n_tokens == 2


def test_a_table_that_changes_between_passes_fails(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string").coalesce(1)
    tokenizer = token_counts.Tokenizer({b"a": 0, b"b": 1, b" ": 2}, queries.PATTERN)
    real = token_counts.count_tokens
    monkeypatch.setattr(token_counts, "count_tokens", lambda *a: real(*a).where("nth != 3"))
    with pytest.raises(Exception, match="same rows twice"):
        token_counts.document_counts(docs, str(tmp_path / "c"), tokenizer).collect()


def test_clashing_columns(spark):
    rows = [(1, "a few words that stand here to be judged by all the rules", 5, "kept", "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_words int, kept string, lang_pred string, score double")
    judged = quality_rules.judge(docs)
    assert len({c.lower() for c in judged.columns}) == len(judged.columns)
    assert (judged.first().n_words, judged.first().kept, judged.first().lang_pred) == (13, True, "x")
    model = language_id.fit(docs.selectExpr("doc_id", "text", "'en' as lang"))
    named = language_id.identify(docs, model)
    assert named.columns == ["doc_id", "text", "N_words", "kept", "lang_pred", "score"] and named.first().lang_pred == "en"


def test_cost_grows_with_the_work_of_a_rule(spark):
    from pyspark.sql import functions as F

    sample = spark.range(0, 200, 1, 1).withColumn("text", F.repeat(F.concat("id", F.lit(" some words ")), 50))
    cheap = quality_rules.Rule("cheap", F.col("id") > 190)
    dear = quality_rules.Rule("dear", F.length(F.regexp_replace("text", "(?i)[aeiou]+(?=[a-z])", "x")) < 0)
    first, second = quality_rules.estimates(sample, [cheap, dear])
    assert second.seconds > 5 * first.seconds > 0 and 0 < second.share < first.share
    assert [r.name for r in quality_rules.ordered([second, first])] == ["cheap", "dear"]


@pytest.mark.parametrize(
    "spellings",
    [
        ["2020-01-15", "15.01.2020", "01/15/2020", "2020/01/15", "15 January 2020", "January 15, 2020", "15 Jan 2020"],
        ["2021-05-03", "03/05/2021", "3 May 2021", "May 3, 2021"],
    ],
)
def test_a_day_has_one_pseudonym(spellings):
    from datetime import datetime

    formats = ["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d %B %Y", "%B %d, %Y", "%d %b %Y"]

    def read(text):
        out = set()
        for f in formats:
            try:
                out.add(datetime.strptime(text, f))
            except ValueError:
                pass
        return out

    for n in range(20):
        forward, back = pii.Rewriter(b"k%d" % n), pii.Rewriter(b"k%d" % n, back=True)
        new = [forward(f"on {s} there")[0] for s in spellings]
        # A shortened month comes back in full where the pseudonym falls in May, whose name is short already.
        came = [back(x)[0] for x in new]
        assert came[:6] == [f"on {s} there" for s in spellings[:6]] and came[6:] in ([], ["on 15 Jan 2020 there"], ["on 15 January 2020 there"])
        assert set.intersection(*(read(x[3:-6]) for x in new))


def test_spellings_stay_linked():
    forward, back = pii.Rewriter(b"k"), pii.Rewriter(b"k", back=True)
    a, b = forward("John.D@Example.com")[0], forward("john.d@example.com")[0]
    assert a.lower() == b and a != b and back(a)[0] == "John.D@Example.com"
    long, short = forward("2001:0DB8:0000:0:0:FF00:0042:8329")[0], forward("2001:db8::ff00:42:8329")[0]
    import ipaddress

    assert ipaddress.ip_address(long) == ipaddress.ip_address(short) != ipaddress.ip_address("2001:db8::ff00:42:8329")
    assert back(long)[0] == "2001:0DB8:0000:0:0:FF00:0042:8329" and back(short)[0] == "2001:db8::ff00:42:8329"
    key = "ghp_abcdefghij0123456789ABCDEFGHIJ"
    assert forward(f"token = {key}")[0] == f"token = {forward(key)[0]}" and forward(key)[0] != key
    for v in ("+49 30 1234567", "+4930123456789", "+44 (20) 7946 0958", "+353 1 234 5678", "sk-proj-abcd0123456789abcdefgh"):
        new, spans = forward(f"at {v}, now")
        assert len(spans) == 1 and v not in new and back(new)[0] == f"at {v}, now"
    for v in ("10:15:30", "std::vector", "::1", "+1 2", "May 2020", "3 May", "a:b:c"):
        assert forward(f"at {v} now") == (f"at {v} now", [])


def test_long_texts_are_cut_where_both_tokenizers_begin():
    encoder = alignment.Encoder(**alignment.read_tokenizers(queries.BYTE_LEVEL, queries.PIECES))
    text = "Some words, \n  two  spaces and 'quotes' don't matter — é　你 好 end." * 30
    parts = alignment.pieces(" " + text, 10)
    assert "".join(parts) == " " + text and len(parts) > 50 and all(p[0] == " " for p in parts)
    whole = encoder.byte_level.encode_ordinary(" " + text), encoder.pieces.encode(text)
    assert [i for p in parts for i in encoder.byte_level.encode_ordinary(p)] == whole[0]
    assert [i for p in parts for i in encoder.pieces.encode(p[1:])] == whole[1]


def test_workers_need_no_package(tmp_path):
    """Queries whose tasks get models, automata and vocabularies, with a package that only the driver can import."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import functions as F
from ledgerline.llm import queries
from ledgerline.runtime import build_session
spark = build_session("apart", "local[2]", {{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {str(tmp_path)!r}}})
def lacks(x):
    try:
        import ledgerline
    except ImportError:
        return True
    return False
assert all(spark.sparkContext.parallelize([1, 2], 2).map(lacks).collect())
for name in ("op1_pii_pseudonyms", "op8_token_counts", "op9_decontamination", "op10_language_id", "op11_license_scans", "op13_tokenizer_alignment"):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200, name
print("DONE")
"""
    place = tmp_path / "apart.py"
    place.write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(place)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "DONE" in done.stdout, done.stderr[-2000:]
