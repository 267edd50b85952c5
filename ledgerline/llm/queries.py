"""One query for each operator, with its production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import (
    alignment,
    decontamination,
    language_id,
    licenses,
    mixing,
    pii,
    prefix_trie,
    quality_rules,
    simhash,
    suffix_index,
    token_counts,
    url_filters,
    warc,
)
from ledgerline.runtime import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# A deployment passes its own; pseudonyms stay linked as long as it stays the same.
PII_KEY = b"ledgerline example key"

# Fixed value: the pattern that belongs to the vocabulary; another place is a parameter of ``token_counts.Tokenizer.read``.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The two tokenizers of the alignment contract; a deployment passes other places to ``alignment.read_tokenizers``.
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"

# The rules of the URL contract (host, path, verdict).
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_pii_pseudonyms")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(table(spark, folder, "documents"), PII_KEY)


@query("op2_mixing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.words_taken(table(spark, folder, "documents"))


@query(
    "op3_url_filters",
    r"""
WITH RECURSIVE rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
split AS (
    SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS rest,
        CASE WHEN instr(url, '://') > 0 THEN translate(url[:instr(url, '://') + 2], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS scheme
    FROM pages),
page AS (
    SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        scheme || translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS address
    FROM split),
ruled AS (
    SELECT page_id, html, host, path, address,
        (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
        (SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS v
    FROM page),
-- Absolute canonical links between the pages themselves.
edge AS (
    SELECT address AS a, regexp_extract(html, '<link[^>]*rel="canonical"[^>]*href="([^"#]*)', 1) AS b FROM ruled WHERE html LIKE '%rel="canonical"%'),
both_ways AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
reach(a, b) AS (
    SELECT DISTINCT address, address FROM ruled WHERE v = 'block' AND address IS NOT NULL
    UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN address IN (SELECT b FROM reach) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_pages(table(spark, folder, "pages"), rules)


@query("op4_suffix_index")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_index.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query(
    "op5_warc",
    """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digested AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM page),
first AS (SELECT payload_digest, min(page_id) AS f FROM digested WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN f <> page_id THEN f END AS refers_to
FROM digested LEFT JOIN first USING (payload_digest)
""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query("op6_simhash")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, folder, "documents"), shingle=3, distance=2)
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query(
    "op7_quality_rules",
    r"""
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM doc, unnest(range(1, len(w) - 3)) AS r(i) WHERE len(w) >= 5),
again AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT j) AS n FROM win JOIN again USING (doc_id, k), unnest(range(i, i + 5)) AS r(j) GROUP BY doc_id),
measured AS (
    SELECT d.doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
    FROM doc d LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 3 * n_words
        OR word_chars > 10 * n_words OR 10 * n_dup_lines > 4 * n_lines
        OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > len(regexp_extract_all(text, '\p{L}'))
        OR 10 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > 3 * n_words
        OR 5 * len(regexp_extract_all(text, '(?i)https?://')) > n_words OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < n_words) AS kept
FROM measured
""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = token_counts.Tokenizer.read(RANKS, PATTERN)
    return token_counts.document_counts(table(spark, folder, "documents"), scratch_path(spark, "tokens"), tokenizer)


@query(
    "op9_decontamination",
    r"""
WITH item AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
    FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
lengths AS (SELECT DISTINCT k FROM windows),
place AS (
    SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
    FROM doc, lengths, unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k),
found AS (SELECT p.doc_id, p.k, p.i, n.item FROM place p JOIN windows n ON p.k = n.k AND p.words = n.words),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + k)) AS r(j) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"), offsets=False)
    return found.drop("items", "spans")


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score"
    )


@query("op11_license_scans")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "__licenses.*").drop("places")
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@query(
    "op12_prefix_trie",
    r"""
WITH RECURSIVE bit(i, c) AS (SELECT i, i FROM range(256) AS r(i)),
-- The table of the checksum: eight steps for each byte.
step(n, i, c) AS (
    SELECT 0, i, c FROM bit
    UNION ALL SELECT n + 1, i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM step WHERE n < 8),
crc(i, c) AS (SELECT i, c FROM step WHERE n = 8),
own AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        left(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 30)) AS d
    FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, CAST(c AS VARCHAR) AS s FROM own GROUP BY c),
hashed(c, s, n, v) AS (
    SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM conv
    UNION ALL SELECT h.c, h.s, h.n + 1, xor(crc.c, h.v // 256) FROM hashed h JOIN crc ON crc.i = xor(h.v % 256, CAST(ascii(h.s[h.n + 1]) AS BIGINT))
    WHERE h.n < length(h.s)),
head AS (SELECT c, c - c % 5 AS b, xor(v, 4294967295) % 9 AS h FROM hashed WHERE n = length(s)),
turn AS (
    SELECT h.c, 0 AS mine, o.d, o.role, o.text FROM head h JOIN own o ON o.c = h.b AND o.d <= h.h
    UNION ALL SELECT h.c, 1, o.d, o.role, o.text FROM head h JOIN own o ON o.c = h.c AND o.d > h.h),
rebuilt AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY mine, d) AS d, octet_length(encode(text)) AS bytes, sha256(octet_length(encode(role)) || ':' || role || text) AS t
    FROM turn),
prefix AS (
    SELECT c, d, bytes, sha256(string_agg(t, ',') OVER (PARTITION BY c ORDER BY d)) AS k FROM rebuilt
    UNION ALL SELECT c, 0, 0, '' FROM conv),
path AS (SELECT c, d, bytes, k, lag(k) OVER (PARTITION BY c ORDER BY d) AS pk, d = max(d) OVER (PARTITION BY c) AS last FROM prefix),
node AS (
    SELECT k, any_value(pk) AS pk, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
        sha256(coalesce(string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
    FROM path GROUP BY k),
kid AS (SELECT pk AS k, count(*) AS n FROM node WHERE pk IS NOT NULL GROUP BY pk),
below AS (
    SELECT p.k, sum(n.saved) AS saved, count(*) FILTER (WHERE kid.n IS NULL) AS leaves
    FROM node n JOIN path p ON p.c = n.conv_id AND p.d <= n.depth LEFT JOIN kid ON kid.k = n.k GROUP BY p.k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kid.n, 0) AS n_children,
    b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below b ON b.k = n.k LEFT JOIN node up ON up.k = n.pk LEFT JOIN kid ON kid.k = n.k
""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    base = F.col("conv") - F.col("conv") % 5
    head = F.crc32(F.col("conv").cast("string")) % 9
    turns = prefix_trie.rebuilt(prefix_trie.numbered(table(spark, folder, "conversations")), base, head)
    return prefix_trie.trie(turns).withColumnRenamed("saved_bytes", "saved_tokens")


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    tokenizers = alignment.read_tokenizers(BYTE_LEVEL, PIECES)
    found = alignment.align(table(spark, folder, "documents").select("doc_id", "text"), tokenizers, digest=True)
    return found.select("doc_id", "__aligned.*").withColumnRenamed("groups", "groups_sha256")
