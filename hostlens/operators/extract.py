"""Links and sitemaps out of tables of already fetched documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hostlens import fixed_values as V
from hostlens.functions import hosts, urls
from hostlens.functions.dates import first_date, looks_recent
from hostlens.functions.text import WHITESPACE, after_first, contains_any
from hostlens.functions.urls import resolve_reference
from hostlens.operators.dedup import keep_first
from hostlens.operators.joins import settled
from hostlens.operators.parse import host_parts
from hostlens.session import materialize
from hostlens.sources.suffix_rules import SuffixRules

# The "<" stands before the choice: text without one is passed over by a single test per character.
_HIDDEN = r"(?is)<(?:!--.*?-->|(script|style)\b.*?</\1\s*>)"
# Possessive runs: a group repeated per character would take a stack frame for each.
_ANCHOR = r"""(?is)<a(?=[\s/])[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
_ATTRIBUTE = r"""(?is)([^\s/>"'=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""

_SPACE = " \t\n\x0b\f\r"  # as \s has it


def unescape(text: Column) -> Column:
    """Character references decoded in one pass, by the text library on Spark's own class path.

    Most links hold none and skip the call.
    """
    plain = F.replace(text, F.lit("&apos;"), F.lit("'"))
    decoded = F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), plain)
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def page_links(html: Column) -> Column:
    """Values of every `href` of every `<a>` tag, in document order, as an array."""
    visible = F.regexp_replace(html, _HIDDEN, "")
    anchors = F.regexp_extract_all(visible, F.lit(_ANCHOR), F.lit(0))

    def hrefs(tag: Column) -> Column:
        # One pass a tag: a name holds no "=", so the first one parts it from its value.
        pairs = F.regexp_extract_all(F.substr(tag, F.lit(3)), F.lit(_ATTRIBUTE), F.lit(0))
        wanted = F.filter(pairs, lambda a: F.lower(F.rtrim(F.substring_index(a, "=", 1), F.lit(_SPACE))) == "href")
        values = F.transform(wanted, lambda a: F.ltrim(after_first(a, "="), F.lit(_SPACE)))
        return F.transform(values, lambda v: unescape(F.regexp_replace(v, r"""^["']|["']\z""", "")))

    return F.filter(F.flatten(F.transform(anchors, hrefs)), lambda h: h != "")


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per link: page columns, position, raw href, resolved URL."""
    rest = [c for c in pages.columns if c != html]
    links = pages.select(*rest, F.posexplode(page_links(F.col(html))).alias("position", "href"))
    trimmed = F.btrim(F.col("href"), F.lit(WHITESPACE))
    resolved = links.withColumn("link", resolve_reference(F.col(url), trimmed))
    return settled(resolved, rest, ["position", "href", "link"])


def robots_sitemaps(docs: DataFrame, body: str = "body") -> DataFrame:
    """Sitemap lines of robots files."""
    rest = [c for c in docs.columns if c != body]
    lines = docs.select(*rest, F.posexplode(F.split(F.col(body), r"\r\n|[\r\n]")).alias("position", "line"))
    key = F.lower(F.btrim(F.substring_index("line", ":", 1), F.lit(WHITESPACE)))
    value = F.btrim(F.regexp_replace("line", r"^[^:]*:", ""), F.lit(WHITESPACE))
    return (
        lines.where(F.contains("line", F.lit(":")) & (key == "sitemap"))
        .select(*rest, "position", value.alias("sitemap_url"))
        .where("sitemap_url <> ''")
    )


def default_sitemaps(sites: DataFrame, home: str, paths=V.NEWS_SITEMAP_PATHS, below: bool = True) -> DataFrame:
    """Fallback sitemap addresses of every site: a fixed short list exploded per row.

    ``below``: under the home address, path included, as for news sites; else at the root of its host, as for seeds.
    """
    listed = F.array(*[F.lit(p.lstrip("/") if below else p) for p in paths])
    base = F.concat(F.regexp_replace(F.col(home), "/+$", ""), F.lit("/"))
    out = sites.select("*", F.posexplode(listed).alias("position", "__path"))
    return out.withColumn("sitemap_url", resolve_reference(base, F.col("__path"))).drop("__path")


def root_sitemaps(sites: DataFrame, robots: DataFrame, key: str, home: str, always: bool, paths, below: bool = True) -> DataFrame:
    """Starting sitemaps per site: robots lines first, then fallbacks (only when robots named
    none, unless `always`), each address once at its first position."""
    named = robots.select(key, "position", "sitemap_url")
    fallback = default_sitemaps(sites, home, paths, below)
    if not always:
        fallback = fallback.join(named.select(key).distinct(), key, "left_anti")
    both = named.withColumn("__late", F.lit(0)).unionByName(
        fallback.select(key, "position", "sitemap_url").withColumn("__late", F.lit(1))
    )
    first = both.groupBy(key, "sitemap_url").agg(F.min(F.struct("__late", "position")).alias("__at"))
    place = F.row_number().over(W.partitionBy(key).orderBy("__at", "sitemap_url")) - 1
    return first.select(key, "sitemap_url", place.alias("position"))


#: Stands for a "<" of the text while tags are told apart by it.
_LESS = "\ue000\uf8ff"


def _shielded(xml: Column) -> Column:
    """XML text whose only "<" are those of markup: references and CDATA sections give way to a mark."""
    def plain(part: Column) -> Column:
        inner = F.substring_index(part, "]]>", 1)
        outer = F.substr(part, F.length(inner) + 4)
        return F.concat(F.replace(F.replace(inner, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit(_LESS)), outer)

    pieces = F.split(xml, r"<!\[CDATA\[")
    opened = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), plain), ""))
    whole = F.when(F.contains(xml, F.lit("<![CDATA[")), opened).otherwise(xml)
    return F.regexp_replace(whole, "(?i)&lt;|&#0*60;|&#x0*3c;", _LESS)


def _first_text(fragment: Column, name: str) -> Column:
    """Text of the first descendant of that local name, at any depth and in any namespace, that has text of its own."""
    text = F.regexp_extract(fragment, rf"<(?:[^\s<>/:]+:)?{name}(?:\s[^<>]*)?>([^<]+)", 1)
    return F.btrim(F.replace(text, F.lit(_LESS), F.lit("<")), F.lit(WHITESPACE))


def sitemap_entries(docs: DataFrame, body: str = "body") -> DataFrame:
    """Entries of sitemap documents: doc_type (index / urlset), position, loc, dates, title.

    Documents that are no well-formed XML, or have another root, give no rows.  An entry's fields are looked for among all
    its descendants; the parser hands out entries as they are written, since a schema names one depth only.
    """
    text = F.regexp_replace(F.col(body), "^\ufeff+", "")
    text = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"(?s)^[^<]+", "")).otherwise(text)
    text = _shielded(F.regexp_replace(text, V.BARE_AMPERSAND, "&amp;"))
    prolog = r"(?s)^(?:\s++|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*+>)*+<(?:[\w.\-]+:)?([\w.\-]+)"
    rest = [c for c in docs.columns if c != body]
    schema = "struct<url:array<string>,sitemap:array<string>,broken:string>"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreNamespace": "true"}
    read = docs.select(
        *rest,
        F.regexp_extract(text, prolog, 1).alias("__root"),
        F.from_xml(text, schema, options).alias("__x"),
    ).where(F.col("__x.broken").isNull())
    doc_type = F.when(F.col("__root") == "sitemapindex", "index").when(F.col("__root") == "urlset", "urlset")
    entries = F.when(F.col("__root") == "sitemapindex", F.col("__x.sitemap")).otherwise(F.col("__x.url"))
    rows = read.where(doc_type.isNotNull()).select(*rest, doc_type.alias("doc_type"), F.posexplode(entries).alias("position", "__e"))
    entry = F.coalesce(F.col("__e"), F.lit(""))
    dated = {c: F.when(F.col("doc_type") == "urlset", _first_text(entry, c)).otherwise(F.lit("")) for c in ("publication_date", "title")}
    return rows.select(
        *rest, "doc_type", "position", _first_text(entry, "loc").alias("loc"), _first_text(entry, "lastmod").alias("lastmod"),
        *[c.alias(n) for n, c in dated.items()],
    )


def child_score(loc: Column, lastmod: Column, today, lookback_days: int) -> Column:
    text = F.lower(loc)
    return (
        F.contains(text, F.lit("news")).cast("int") * 4
        + contains_any(text, ("article", "post")).cast("int") * 2
        + looks_recent(lastmod, today=today, lookback_days=lookback_days).cast("int")
    )


def select_child_sitemaps(
    entries: DataFrame, doc: list[str], today, lookback_days: int = V.NEWS_LOOKBACK_DAYS, max_items: int | None = None
) -> DataFrame:
    """Child sitemaps per index document, best first: scored ones, or all when none scores.

    `max_items` is a fetching budget per document; `V.NEWS_MAX_SITEMAPS` is that of news sites.
    """
    scored = entries.where("loc <> ''").withColumn(
        "score", child_score(F.col("loc"), F.col("lastmod"), today, lookback_days)
    )
    w = W.partitionBy(*doc).orderBy(F.col("score").desc(), F.col("loc").desc())
    ranked = scored.withColumn("rank", F.row_number().over(w))
    ranked = ranked if max_items is None else ranked.where(F.col("rank") <= max_items)
    best = F.max("score").over(W.partitionBy(*doc))
    kept = ranked.withColumn("__best", best).where((F.col("score") > 0) | (F.col("__best") == 0)).drop("__best")
    return keep_first(kept, [*doc, "loc"], [F.col("rank")])


def _site_parts(df: DataFrame, url: str, rules: SuffixRules | None) -> DataFrame:
    """Scheme, host, path and site of a URL by its split alone: neither labels nor port have to be valid."""
    keep = df.columns
    work = df.withColumn("__tidy", urls.tidy(F.col(url)))
    work = work.withColumn("__scheme", urls.scheme_of(F.col("__tidy")))
    pieces = urls.split_rest(after_first(F.col("__tidy"), ":"))
    work = work.withColumns({"__path": pieces["path"], "__netloc": pieces["netloc"]})
    work = work.withColumn("__text", hosts.host_text(urls.host_and_port(F.col("__netloc"))[0]))
    work = work.withColumn("__host", F.coalesce(hosts.encoded_host("__text"), F.lit("")))
    work = host_parts(settled(work, keep, ["__scheme", "__host", "__path"]), "__host", rules)
    site = F.coalesce(F.nullif(F.col("registered_domain"), F.lit("")), F.col("__host"))
    return work.select(*keep, "__scheme", "__host", "__path", site.alias("__site"))


_PLAIN_HOST = r"^https?://([a-z0-9_\-]+(?:\.[a-z0-9_\-]+)*)(?::\d*)?(?:[/?#]|\z)"


def _near(df: DataFrame, url: str, homes: DataFrame) -> DataFrame:
    """Rows whose host ends like a publisher's site, before anything is split: a host of a site shares its last two labels.

    Only plain addresses are judged; any other goes on to the full split.
    """
    host = F.regexp_extract(F.lower(F.col(url)), _PLAIN_HOST, 1)
    tails = homes.select(F.substring_index("__site", ".", -2).alias("__tail")).distinct().unionAll(df.sparkSession.createDataFrame([("",)], "__tail string"))
    return df.withColumn("__tail", F.substring_index(host, ".", -2)).join(tails, "__tail", "left_semi").drop("__tail")


def allowed_news(df: DataFrame, url: str, publishers: DataFrame, rules: SuffixRules | None = None) -> DataFrame:
    """News pages of the publishers' own domains, without section, account and file addresses.

    `publishers`: publisher, publisher_base_url.  The cheap text tests run before the split.
    """
    lowered = settled(df.withColumn("__low", F.lower(F.col(url))), df.columns, ["__low"])
    low = F.col("__low")
    kept = lowered.where(low.rlike(r"^\s*https?:") & ~contains_any(low, V.NEWS_BLOCKED_TOKENS)).drop("__low")
    homes = _site_parts(publishers.select("publisher", "publisher_base_url"), "publisher_base_url", rules)
    homes = homes.where("__host <> ''").select("publisher", "publisher_base_url", "__site")
    parsed = _site_parts(_near(kept, url, homes), url, rules)
    path = F.lower("__path")
    tail = "(" + "|".join(e.replace(".", r"\.") for e in V.NEWS_BLOCKED_ENDINGS) + r")\z"
    pages = parsed.where(F.col("__scheme").isin("http", "https") & (F.col("__host") != "") & ~F.col("__path").isin("", "/") & ~path.rlike(tail))
    on = ["publisher", "__site"] if "publisher" in df.columns else ["__site"]
    joined = pages.join(homes, on).withColumn("registered_domain", F.col("__site"))
    return joined.select(*df.columns, *[c for c in ("publisher", "publisher_base_url", "registered_domain") if c not in df.columns])


def expand_sitemaps(
    roots: DataFrame,
    docs: DataFrame,
    key: str,
    today: str,
    lookback_days: int = V.NEWS_LOOKBACK_DAYS,
    max_sitemaps: int | None = None,
) -> DataFrame:
    """Sitemap addresses per site in reading order: roots, then children, level by level.

    `roots`: key, sitemap_url, position.  `docs`: doc_url, body.  Documents are parsed once, and only
    their index entries are kept.  Each level's frontier is written, so no level runs those
    before it again; the levels end when nothing new is named.  `max_sitemaps` is a fetching
    budget per site, `V.NEWS_MAX_SITEMAPS` that of news sites.
    """
    entries = sitemap_entries(docs.select("doc_url", "body")).where("doc_type = 'index'")
    children = materialize(select_child_sitemaps(entries, ["doc_url"], today, lookback_days, max_sitemaps).select("doc_url", "loc", "rank"), "children")
    w = W.partitionBy(key).orderBy("at")
    visited = None
    frontier = roots.select(key, "sitemap_url", F.array(F.lit(0), F.col("position").cast("int")).alias("at"))
    level = 0
    while True:
        frontier = keep_first(frontier, [key, "sitemap_url"], [F.col("at")])
        if visited is not None:
            frontier = frontier.join(visited, [key, "sitemap_url"], "left_anti")
        if max_sitemaps is not None:
            frontier = frontier.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max_sitemaps).drop("__rn")
        frontier = materialize(frontier, "frontier")
        if visited is not None and frontier.isEmpty():
            break
        visited = frontier if visited is None else visited.unionByName(frontier)
        level += 1
        parent = F.slice("at", 2, F.size("at"))
        frontier = frontier.withColumnRenamed("sitemap_url", "doc_url").join(children, "doc_url").select(
            key, F.col("loc").alias("sitemap_url"), F.concat(F.array(F.lit(level)), parent, F.array(F.col("rank"))).alias("at"),
        )
    ranked = visited.withColumn("read_order", F.row_number().over(w))
    kept = ranked if max_sitemaps is None else ranked.where(F.col("read_order") <= max_sitemaps)
    return kept.select(key, "sitemap_url", "read_order")


def news_rows(
    sitemaps: DataFrame,
    docs: DataFrame,
    publishers: DataFrame,
    today: str,
    lookback_days: int = V.NEWS_LOOKBACK_DAYS,
    max_urls: int | None = None,
    rules: SuffixRules | None = None,
) -> DataFrame:
    """Recent, allowed news pages, first seen per publisher.

    `max_urls` is a budget per publisher, `V.NEWS_MAX_URLS` that of a collection run.
    """
    read = docs.select(F.col("doc_url").alias("sitemap_url"), "body").join(sitemaps, "sitemap_url")
    items = sitemap_entries(read).where("doc_type = 'urlset' and loc <> ''").withColumnRenamed("loc", "url")
    recent = items.where(looks_recent("publication_date", "lastmod", today=today, lookback_days=lookback_days))
    allowed = allowed_news(recent, "url", publishers, rules)
    firsts = keep_first(allowed, [F.col("publisher"), F.col("url")], [F.col("read_order"), F.col("position")])
    w = W.partitionBy("publisher").orderBy("read_order", "position")
    capped = firsts if max_urls is None else firsts.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max_urls)
    return capped.select(
        "url", "publisher", "publisher_base_url", "sitemap_url", "publication_date", "lastmod", "title",
        F.coalesce(first_date("publication_date", "lastmod"), F.lit(today)).alias("collected_at"),
    )

