"""Crawl tables: canonical URLs, titles, links, text, staging and change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.text import suffix
from ..operators import crawl as C
from ..session import spread, staged
from ..sources.tables import crawl, documents, table
from . import sqlbits as S
from .registry import query

POLICY, MIN_CHARS = "balanced", 600


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_sql(column: str, policy: str) -> str:
    for pattern, new in H.steps(policy):
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(new)}, 'g')"
    column = unescape_sql(column)
    for pattern, new in H.TIDY:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return column


def unescape_sql(column: str) -> str:
    for entity, char in H.ENTITIES:
        column = f"replace({column}, {quoted(entity)}, {quoted(char)})"
    return column


NET = r"'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)'"
PATH = r"'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)'"


def path_sql(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, {PATH}, 1), ';[^/]*$', '')"


def web_sql(url: str) -> str:
    tracking = ", ".join(quoted(t) for t in U.TRACKING)
    q = rf"regexp_extract({url}, '^[^?#]*\?([^#]*)', 1)"
    params = f"""array_to_string(list_transform(list_sort(list_filter(list_transform(list_filter(string_split({q}, '&'), lambda p: p <> ''),
      lambda p, i: {{'k': url_decode(regexp_extract(p, '^([^=]*)', 1)), 'i': i, 'v': url_decode(regexp_extract(p, '^[^=]*=(.*)$', 1))}}),
      lambda s: s.k NOT IN ({tracking}))), lambda s: url_encode(s.k) || '=' || url_encode(s.v)), '&')"""
    path = f"regexp_replace(nfc_normalize(url_decode(replace({path_sql(url)}, '+', '%2B'))), '/+$', '')"
    return (f"('https://' || lower(regexp_extract({url}, {NET}, 1)) || CASE WHEN {path} = '' THEN '/' ELSE {path} END"
            f" || CASE WHEN {params} = '' THEN '' ELSE '?' || {params} END)")


def paged(url: str) -> str:
    return rf"(regexp_matches({path_sql(url)}, '(?i)/page/\d+(/|$)') OR regexp_matches(regexp_extract({url}, '^[^?#]*\?([^#]*)', 1), '(^|&)(page|p)=\d+'))"


LAST = r"regexp_extract(" + path_sql("{u}") + r", '([^/]+)/*$', 1)"


def title_sql(fallback: str) -> str:
    tag = unescape_sql(r"regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)")
    return f"CASE WHEN {tag} <> '' THEN trim({tag}) ELSE {fallback} END"


def last_sql(url: str) -> str:
    seg = f"regexp_extract({path_sql(url)}, '([^/]+)/*$', 1)"
    return f"CASE WHEN {seg} <> '' THEN {seg} ELSE regexp_extract({url}, {NET}, 1) END"


def pages_of(spark, sf):
    return spread(crawl(spark, sf), "page_id")


@query("normalize_web_uri", f"SELECT page_id, {web_sql('url')} AS uri FROM pages")
def normalize_web_uri(spark, sf):
    return crawl(spark, sf).select("page_id", U.normalize_web_uri(F.col("url")).alias("uri"))


# Repository addresses: the host of the page is the owner, the rest its path.
_REPO = f"('https://GitHub.com/' || upper(split_part(regexp_extract(url, {NET}, 1), '.', 2)) || regexp_extract(url, '^[^/]*//[^/]*(.*)$', 1))"


def repo_url():
    return F.concat(F.lit("https://GitHub.com/"), F.upper(F.split_part(U.netloc(F.col("url")), F.lit("."), F.lit(2))),
                    F.regexp_extract("url", r"^[^/]*//[^/]*(.*)$", 1))


def repo_sql(url: str) -> str:
    p = f"string_split(regexp_replace({path_sql(url)}, '^/+', ''), '/')"
    return (f"CASE WHEN len({p}) >= 2 THEN 'https://' || lower(regexp_extract({url}, {NET}, 1)) || '/' || lower({p}[1]) || '/' || lower({p}[2])"
            f" || CASE WHEN len({p}) > 2 THEN '/' || array_to_string({p}[3:], '/') ELSE '' END ELSE {url} END")


@query("normalize_repo_uri", f"SELECT page_id, {repo_sql('u')} AS uri FROM (SELECT page_id, {_REPO} AS u FROM pages)")
def normalize_repo_uri(spark, sf):
    return crawl(spark, sf).select("page_id", U.normalize_repo_uri(repo_url()).alias("uri"))


_KIND = "CASE WHEN contains(url, '/en') THEN 'web' WHEN contains(url, '/fr') THEN 'github' WHEN contains(url, '/de') THEN 'confluence' ELSE 's3' END"


@query("normalize_source_uri", f"SELECT page_id, kind, CASE WHEN kind IN ('web', 'confluence') THEN {web_sql('url')} WHEN kind = 'github' THEN {repo_sql('url')} ELSE url END AS uri FROM (SELECT *, {_KIND} AS kind FROM pages)")
def normalize_source_uri(spark, sf):
    url = F.col("url")
    kind = F.when(url.contains("/en"), "web").when(url.contains("/fr"), "github").when(url.contains("/de"), "confluence").otherwise("s3")
    return crawl(spark, sf).select("page_id", "url", kind.alias("kind")).select(
        "page_id", "kind", U.normalize_source_uri(F.col("kind"), url).alias("uri"))


@query("is_pagination_url", f"SELECT page_id, {paged('url')} AS paged FROM pages")
def is_pagination_url(spark, sf):
    return crawl(spark, sf).select("page_id", U.is_pagination(F.col("url")).alias("paged"))


SEEDS = ["https://www.therti.example.org/", "https://www.cheap-pills.example.com/en", "https://blog.ththan.example.net/"]


@query("crawl_scope_filter", f"""WITH u AS (SELECT page_id, {web_sql('url')} AS uri FROM pages), b AS (SELECT *, regexp_extract(uri, '^([^?#]*)', 1) AS base FROM u)
  SELECT page_id, uri, (base = 'https://www.therti.example.org' OR starts_with(base, 'https://www.therti.example.org/') OR base = 'https://www.cheap-pills.example.com/en' OR starts_with(base, 'https://www.cheap-pills.example.com/en/')
    OR base = 'https://blog.ththan.example.net' OR starts_with(base, 'https://blog.ththan.example.net/')) AND NOT regexp_matches(uri, '^.*/fr/.*$') AND regexp_matches(uri, '^https://.*[0-9].*$') AS restricted,
   regexp_extract(uri, {NET}, 1) IN ('www.therti.example.org', 'www.cheap-pills.example.com', 'blog.ththan.example.net') AND NOT regexp_matches(uri, '^.*/fr/.*$') AS unrestricted FROM b""")
def crawl_scope_filter(spark, sf):
    u = crawl(spark, sf).select("page_id", U.normalize_web_uri(F.col("url")).alias("uri"))
    return u.select("page_id", "uri",
                    U.in_scope(F.col("uri"), SEEDS, ["https://*[0-9]*"], ["*/fr/*"]).alias("restricted"),
                    U.in_scope(F.col("uri"), SEEDS, exclude=["*/fr/*"], unrestricted=True).alias("unrestricted"))


@query("page_title", f"SELECT page_id, {title_sql(last_sql('url'))} AS title, {last_sql('url')} AS segment FROM pages")
def page_title(spark, sf):
    seg = U.last_segment(F.col("url"))
    return crawl(spark, sf).select("page_id", H.page_title(F.col("html"), seg).alias("title"), seg.alias("segment"))


# Links of the pages are all root-relative.
LINKS = f"""li AS (SELECT page_id, uri AS source, CAST(generate_subscripts(hs, 1) - 1 AS INTEGER) AS pos, unnest(hs) AS href FROM (
  SELECT page_id, {web_sql('url')} AS uri, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1), lambda h: trim({unescape_sql('h')})), lambda h: h <> '' AND NOT starts_with(h, '#')) AS hs FROM pages)),
lk AS (SELECT page_id, source, pos, {web_sql("('https://' || regexp_extract(source, " + NET + ", 1) || href)")} AS target FROM li)"""


@query("discover_links", f"WITH {LINKS} SELECT source, pos, target FROM lk")
def discover_links(spark, sf):
    return C.link_table(pages_of(spark, sf))


@query("crawl_frontier", f"""WITH {LINKS}, s0 AS (SELECT {web_sql('url')} AS uri, min(page_id) AS ord FROM pages WHERE contains(url, '//blog.') GROUP BY 1),
  d0 AS (SELECT uri, ord, 0 AS depth, 0 AS p FROM s0 WHERE NOT contains(uri, '/en/9')),
  d1 AS (SELECT target AS uri, min({{'o': ord, 'p': pos}}) AS k FROM d0 JOIN lk ON source = uri WHERE target NOT IN (SELECT uri FROM s0) GROUP BY target),
  f1 AS (SELECT uri, k.o AS ord, 1 AS depth, k.p AS p FROM d1 WHERE NOT regexp_matches(uri, '^.*/en/9.*$')),
  allp AS (SELECT * FROM d0 UNION ALL SELECT uri, ord, depth, p FROM f1)
  SELECT uri, CAST(depth AS INTEGER) AS depth FROM (SELECT * FROM allp ORDER BY depth, ord, p LIMIT 400)""")
def crawl_frontier(spark, sf):
    pages = pages_of(spark, sf)
    seeds = pages.filter(F.col("url").contains("//blog.")).select(
        U.normalize_web_uri(F.col("url")).alias("uri"), F.col("page_id").alias("ord"))
    return C.crawl_frontier(seeds, C.link_table(pages), 1, 400, ~F.col("uri").rlike(U.glob_regex("*/en/9*")))


@query("html_to_text", f"SELECT page_id, {text_sql('html', 'lenient')} AS lenient, {text_sql('html', 'strict')} AS strict FROM pages")
def html_to_text(spark, sf):
    return pages_of(spark, sf).select("page_id", H.html_to_text(F.col("html"), "lenient").alias("lenient"),
                                      H.html_to_text(F.col("html"), "strict").alias("strict"))


@query("sufficient_content", f"SELECT page_id, length({text_sql('html', POLICY)}) >= {MIN_CHARS} AS enough FROM pages")
def sufficient_content(spark, sf):
    return pages_of(spark, sf).select(
        "page_id", (F.length(H.html_to_text(F.col("html"), POLICY)) >= MIN_CHARS).alias("enough"))


@query("content_version", f"SELECT page_id, CASE WHEN length(html) % 4 = 0 THEN 'tag' || page_id ELSE md5(coalesce(nullif({text_sql('html', POLICY)}, ''), html)) END AS version FROM pages")
def content_version(spark, sf):
    etag = F.when(F.length("html") % 4 == 0, F.concat(F.lit('"tag'), "page_id", F.lit('"')))
    return pages_of(spark, sf).select(
        "page_id", H.content_version(etag, H.html_to_text(F.col("html"), POLICY), F.col("html")).alias("version"))


# File names of the documents: the source number chooses the type.
_EXT = "['.pdf','.MD','.docx','.exe','.py','.go','.yaml','.zip','.txt','.cc','','.html','.kt','.json','.tar.gz','.rs','.csv','.sh','.xyz','.eml']"
_NAME = f"('dir.v1/file' || doc_id || {_EXT}[CAST(substr(source, 4) AS INTEGER) + 1])"
EXTS = [".pdf", ".MD", ".docx", ".exe", ".py", ".go", ".yaml", ".zip", ".txt", ".cc", "", ".html", ".kt", ".json",
        ".tar.gz", ".rs", ".csv", ".sh", ".xyz", ".eml"]
_SUF = "lower(regexp_extract(regexp_extract(name, '([^/]*)$', 1), '[^.].*?(\\.[^.]+)$', 1))"


def named_files(spark, sf):
    """(doc_id, name, size)"""
    exts = F.array(*[F.lit(e) for e in EXTS])
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("dir.v1/file"), "doc_id", F.get(exts, F.substring("source", 4, 9).cast("int"))).alias("name"),
        (F.col("n_chars") * 1000).alias("size"))


def in_list(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


_FILES = f"f AS (SELECT doc_id, {_NAME} AS name, n_chars * 1000 AS size FROM documents), g AS (SELECT *, {_SUF} AS ext FROM f)"


@query("file_gate", f"WITH {_FILES} SELECT doc_id, CASE WHEN ext NOT IN {in_list(C.SUPPORTED)} THEN 'Unsupported file format: ' || ext WHEN size > 0 AND size > 2 * 1024 * 1024 THEN 'File too large' END AS reason FROM g")
def file_gate(spark, sf):
    return named_files(spark, sf).select("doc_id", C.file_gate(F.col("name"), F.col("size"), 2).alias("reason"))


@query("doc_category", f"WITH {_FILES} SELECT doc_id, CASE WHEN ext IN {in_list(C.DOCUMENT_TYPES)} THEN 'document' WHEN ext IN {in_list(C.CODE_TYPES)} THEN 'code' WHEN ext IN {in_list(C.CONFIG_TYPES)} THEN 'config' ELSE 'other' END AS category FROM g")
def doc_category(spark, sf):
    return named_files(spark, sf).select("doc_id", C.category(suffix(F.col("name"))).alias("category"))


@query("code_language", f"WITH {_FILES} SELECT doc_id, CASE ext {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in C.CODE_LANGUAGE.items())} ELSE 'python' END AS language FROM g")
def code_language(spark, sf):
    return named_files(spark, sf).select("doc_id", C.code_language(suffix(F.col("name"))).alias("language"))


# The catalog before this crawl, derived from the pages: some unchanged, some older, some gone.
_OLD = f"""cur AS (SELECT page_id, url, html, contains(html, '</html>') AS fetched, {web_sql('url')} AS source, {text_sql('html', POLICY)} AS text FROM pages),
ver AS (SELECT *, md5(coalesce(nullif(text, ''), html)) AS version, {title_sql(last_sql('source'))} AS title FROM cur),
cat AS (SELECT source, any_value(CASE WHEN length(html) % 3 = 0 THEN version ELSE 'older' END ORDER BY page_id) AS content_version, any_value(CASE length(html) % 7 WHEN 0 THEN 'deleted' WHEN 1 THEN 'failed' ELSE 'indexed' END ORDER BY page_id) AS status,
  any_value(CASE WHEN length(html) % 2 = 0 THEN 'Aborted' ELSE 'timeout' END ORDER BY page_id) AS last_error, any_value(CASE WHEN length(html) % 5 = 0 THEN 'old title' ELSE title END ORDER BY page_id) AS old_title FROM ver WHERE length(html) % 4 <> 0 GROUP BY source)"""
_ACT = """CASE WHEN cat.status IS NULL THEN 'new' WHEN version = content_version AND (cat.status = 'deleted' OR (cat.status = 'failed' AND contains(last_error, 'Aborted'))) THEN 'restage' WHEN version <> content_version THEN 'changed' WHEN title <> old_title THEN 'retitle' ELSE 'unchanged' END"""


def versions(spark, sf):
    """(page_id, source, version, title, n, fetched): what the change queries use of a page, written once. A page is parsed once for
    both sides of the comparison, and the pages themselves stay where they are."""
    pages = pages_of(spark, sf).withColumn("source", U.normalize_web_uri(F.col("url")))
    return staged(pages.select(
        "page_id", "source", H.content_version(F.lit(None).cast("string"), H.html_to_text(F.col("html"), POLICY), F.col("html")).alias("version"),
        H.page_title(F.col("html"), U.last_segment(F.col("source"))).alias("title"),
        F.length("html").alias("n"), F.col("html").contains("</html>").alias("fetched")))


def old_catalog(pages):
    """The catalog before this crawl, from the rows of :func:`versions`."""
    n = F.col("n")
    row = F.struct("page_id", F.when(n % 3 == 0, F.col("version")).otherwise("older").alias("content_version"),
                   F.when(n % 7 == 0, "deleted").when(n % 7 == 1, "failed").otherwise("indexed").alias("status"),
                   F.when(n % 2 == 0, "Aborted").otherwise("timeout").alias("last_error"),
                   F.when(n % 5 == 0, "old title").otherwise(F.col("title")).alias("old_title"))
    return pages.filter(n % 4 != 0).groupBy("source").agg(F.min(row).alias("r")).select(
        "source", "r.content_version", "r.status", "r.last_error", "r.old_title")


@query("stage_pages", f"""WITH {_OLD}, a AS (SELECT page_id, source, title, version, CASE WHEN NOT fetched THEN 'failed' WHEN {paged('source')} THEN 'skip_pagination' WHEN length(text) < {MIN_CHARS} THEN 'skip_thin' ELSE {_ACT} END AS action,
    CAST(octet_length(encode(html)) AS INTEGER) AS size FROM ver LEFT JOIN cat USING (source))
  SELECT page_id, source, action, CASE WHEN action IN ('new', 'changed', 'restage', 'retitle') THEN title END AS title, CASE WHEN action IN ('new', 'changed', 'restage') THEN version END AS content_version,
   CASE WHEN action IN ('new', 'changed', 'restage') THEN size END AS file_size, CASE WHEN action IN ('new', 'changed', 'restage') THEN 'pending' WHEN action = 'failed' THEN 'failed' END AS new_status FROM a""")
def stage_pages(spark, sf):
    pages = pages_of(spark, sf).withColumn("fetched", F.col("html").contains("</html>"))
    return C.stage_pages(pages, old_catalog(versions(spark, sf)), MIN_CHARS, POLICY)


@query("change_detection", f"WITH {_OLD} SELECT source, page_id, {_ACT} AS action FROM ver LEFT JOIN cat USING (source) UNION ALL SELECT source, NULL, 'gone' FROM cat WHERE source NOT IN (SELECT source FROM ver WHERE fetched) AND status <> 'deleted'")
def change_detection(spark, sf):
    now = versions(spark, sf)
    old = old_catalog(now)
    seen = now.join(old, "source", "left").select("source", "page_id", C.change_action(
        F.col("version"), F.col("content_version"), F.col("status"), F.col("last_error"), F.col("title"), F.col("old_title")).alias("action"))
    fetched = now.filter("fetched").select("source")
    gone = old.filter(F.col("status") != "deleted").join(fetched, "source", "left_anti").select(
        "source", F.lit(None).cast("bigint").alias("page_id"), F.lit("gone").alias("action"))
    return seen.unionByName(gone)


@query("stage_repo_files", f"""WITH {_FILES}, t AS (SELECT * FROM g WHERE starts_with(name, 'dir.v1/') AND ext IN {in_list(C.SUPPORTED)} ORDER BY name LIMIT 300)
  SELECT name AS path, 'https://github.com/my-org/repo/blob/main/' || name AS source, md5(name) AS content_version, size AS file_size FROM t WHERE size <= 3000000""")
def stage_repo_files(spark, sf):
    tree = named_files(spark, sf).select(
        F.col("name").alias("path"), F.lit("blob").alias("type"), F.md5("name").alias("sha"), "size",
        F.lit("My-Org").alias("owner"), F.lit("Repo").alias("repo"), F.lit("main").alias("branch"))
    return C.stage_repo_files(tree, "dir.v1/", 300, 3_000_000)


@query("stage_wiki_pages", f"""WITH w AS (SELECT page_id, {title_sql(last_sql('url'))} AS title, url, length(html) AS version, CASE length(html) % 3 WHEN 0 THEN ['Draft', 'x'] WHEN 1 THEN ['Public'] ELSE []::VARCHAR[] END AS labels, length(html) % 6 AS depth FROM pages ORDER BY page_id LIMIT 200)
  SELECT page_id, title, {web_sql('url')} AS source, CAST(version AS VARCHAR) AS content_version FROM w WHERE depth <= 3 AND NOT list_contains(list_transform(labels, lambda x: lower(x)), 'draft')""")
def stage_wiki_pages(spark, sf):
    n = F.length("html")
    pages = crawl(spark, sf).select(
        "page_id", H.page_title(F.col("html"), U.last_segment(F.col("url"))).alias("title"), "url", n.alias("version"),
        F.when(n % 3 == 0, F.array(F.lit("Draft"), F.lit("x"))).when(n % 3 == 1, F.array(F.lit("Public"))).otherwise(
            F.array().cast("array<string>")).alias("labels"),
        F.array_repeat(F.lit("a"), n % 6).alias("ancestors"))
    return C.stage_wiki_pages(pages, 3, ["DRAFT"], 200)


@query("before_doc_create", f"WITH {S.DOCS} SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'blocked by hook: toxic' WHEN l.quality = 0 THEN 'blocked by hook: quality' END AS rejected FROM docs d LEFT JOIN labels l USING (doc_id)")
def before_doc_create(spark, sf):
    from ..operators.lifecycle import apply_hooks
    rows = documents(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return apply_hooks(rows, [("toxic", F.coalesce(F.col("toxic") == 1, F.lit(False))),
                              ("quality", F.coalesce(F.col("quality") == 0, F.lit(False)))]).select("doc_id", "rejected")
