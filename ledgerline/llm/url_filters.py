"""URL rules by host and path, and redirect equivalence: a block reaches every alias of a blocked address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.components import components
from ledgerline.runtime import settle

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator of one row, so that the optimiser does not copy their expressions into later steps."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is no ``://``."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALL)


def path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """The address that two spellings share: scheme and host in lower case, no fragment. Null where there is no ``://``."""
    site = F.translate(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), CAPITALS, SMALL)
    return F.nullif(F.concat(site, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)), F.lit(""))


def _attribute(tag: str, name: str) -> Column:
    """The value of an attribute, quoted either way or bare; empty if it is missing."""
    pattern = rf"(?is)(?<![\w-]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


# The named entities that attribute values need; ampersands come last, so that nothing is read twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def unescaped(value: Column) -> Column:
    """The value with its entities, named as in ENTITIES or numbered, replaced by their characters."""
    numbers = F.array_distinct(F.regexp_extract_all(value, F.lit("&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(0)))
    digits = lambda n: F.regexp_extract(n, "([0-9A-Fa-f]+);", 1)
    code = lambda n: F.when(n.rlike("[xX]"), F.conv(digits(n), 16, 10)).otherwise(digits(n)).cast("long")
    # Numbers beyond the code points, and those of halves of a character, stay as they are.
    sound = lambda n: (code(n) < 0x110000) & ~code(n).between(0xD800, 0xDFFF) & (code(n) != 38)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32")
    out = F.aggregate(numbers, value, lambda text, n: F.when(sound(n), F.replace(text, n, char(n))).otherwise(text))
    for name, c in ENTITIES[:-1]:
        out = F.replace(out, F.lit(name), F.lit(c))
    for name in ("&#38;", "&#x26;", "&#X26;", "&amp;"):
        out = F.replace(out, F.lit(name), F.lit("&"))
    return out


def without_dots(url: Column) -> Column:
    """An absolute address whose path has no ``.`` and ``..`` parts any more; ``..`` takes the part before it away, if there is one."""
    site, rest = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)
    parts = F.split(F.substr(rest, F.lit(2)), "/")
    kept = F.aggregate(
        parts, F.expr("cast(array() as array<string>)"),
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p))),
    )
    # A path that ends with such a part names a folder.
    folder = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    dotted = rest.rlike(r"/\.{1,2}(/|$)")
    return F.when(dotted, F.concat(site, F.lit("/"), F.array_join(kept, "/"), folder, query)).otherwise(url)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): the address of a page and the one that it names as canonical or redirects to by a refresh.

    A link may be absolute, scheme-relative, host-relative or relative to the page's folder; its entities are replaced and its dot
    parts resolved.
    """
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tagged = pages.where(F.col(html).rlike("(?i)canonical|refresh")).select(F.col(url).alias("u"), F.explode(tags).alias("tag"))
    read = _computed(tagged, rel=_attribute("tag", "rel"), href=_attribute("tag", "href"), equiv=_attribute("tag", "http-equiv"), content=_attribute("tag", "content"))
    refresh = F.regexp_extract("content", r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    target = F.when(F.col("rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), F.col("href")).when(F.lower("equiv") == "refresh", refresh)
    based = _computed(
        read, link=F.trim(unescaped(target)), scheme=F.regexp_extract("u", r"(?s)^(.*?:)//", 1), site=F.regexp_extract("u", r"(?s)^(.*?://[^/?#]*)", 1),
        page=path(F.col("u")), folder=F.regexp_extract("u", r"(?s)^.*?://[^/?#]*([^?#]*/)", 1),
    ).where("link != '' and site != ''")
    link = F.col("link")
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat("scheme", link))
        .when(link.startswith("/"), F.concat("site", link))
        .when(link.rlike(r"^[?#]"), F.concat("site", "page", link))
        .when(~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat("site", F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), link))
    )
    return _computed(based, full=full).select(address(F.col("u")).alias("a"), address(without_dots(F.col("full"))).alias("b")).where("a is not null and b is not null")


def ruled(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, rule and rule_verdict to rows of distinct addresses.

    ``rules`` has (host, path, verdict), one row for each host and path. A rule fits its host and all subdomains if the path
    begins with the rule's; the longest one (host and path together, then the host) decides. Each address is joined by equality on
    every suffix of its host and every prefix of its path that has the length of some rule's, so rules that share a host are not
    compared one by one.
    """
    lengths = sorted(r.n for r in rules.select(F.char_length("path").alias("n")).distinct().collect())
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(
        F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(n <= F.char_length("path"), F.substring("path", F.lit(1), n))), lambda x: x.isNotNull()
    )
    split = _computed(urls, host=host(F.col(url)), path=path(F.col(url)))
    if not lengths:
        return split.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_verdict", F.lit(None).cast("string"))
    tried = split.select(F.col(url).alias("__url"), F.explode(suffixes).alias("h"), "path").select("__url", "h", F.explode(prefixes).alias("p"))
    known = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict")
    rank = F.struct(F.char_length("h") + F.char_length("p"), F.char_length("h"), F.concat("h", "p").alias("rule"), F.col("verdict").alias("verdict"))
    best = tried.join(known, ["h", "p"]).groupBy("__url").agg(F.max(rank).alias("best"))
    return split.join(best.select("__url", F.col("best.rule"), F.col("best.verdict").alias("rule_verdict")), F.col(url) == F.col("__url"), "left").drop("__url")


def judge_pages(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    A rule's verdict holds for the address that it fits. The others follow their aliases: addresses that redirects, canonical links
    or equal spelling join are one thing, and if any of them is blocked by a rule, so are all that no rule fits; an explicit allow
    keeps its own address open. Everything else is allowed. ``redirects`` adds edges (a, b) known from elsewhere. A null url, and
    one without ``://``, has empty host and path, no rule and no alias, and is allowed; a null html has no links; repeated rows are
    judged alike; an empty table gives an empty one, and without rules everything is allowed.
    """
    edges = page_links(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("a")), address(F.col("b"))))
    edges = settle(edges.distinct(), "aliases")
    known = pages.select(address(F.col(url)).alias("url")).union(edges.select("a")).union(edges.select("b")).where("url is not null").distinct()
    judged = settle(ruled(known, rules), "url-rules")
    groups = components(edges, "a", "b", "aliases").withColumnRenamed("node", "url")
    blocked = (
        groups.join(judged.where("rule_verdict = 'block'").select("url"), "url", "left_semi").select("root").distinct().withColumn("hit", F.lit(True))
    )
    reached = groups.join(blocked, "root", "left_semi").select("url").withColumn("reached", F.lit(True))
    decided = judged.join(reached, "url", "left").select(
        F.col("url").alias("__address"), "rule", F.coalesce("rule_verdict", F.when(F.col("reached"), "block"), F.lit("allow")).alias("verdict")
    )
    rows = pages.select(id, F.col(url).alias("__url")).withColumn("__a", address(F.col("__url")))
    found = rows.join(decided, F.col("__a") == F.col("__address"), "left")
    return found.select(id, F.coalesce(host(F.col("__url")), F.lit("")).alias("host"), F.coalesce(path(F.col("__url")), F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
