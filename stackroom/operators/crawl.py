"""Crawl snapshots, repository trees and wiki exports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.text import suffix
from ..session import staged

# Accepted file types and the language of code files.
DOCUMENT_TYPES = (".pdf", ".md", ".docx", ".doc", ".txt", ".hwp", ".html", ".htm", ".rst", ".eml",
                  ".csv", ".tsv", ".json", ".epub", ".xlsx", ".xls", ".pptx", ".ppt")
CODE_TYPES = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".java", ".rs", ".cpp", ".cc", ".c", ".cs",
              ".rb", ".php", ".swift", ".kt", ".scala", ".sh")
CONFIG_TYPES = (".yaml", ".yml", ".properties")
CODE_LANGUAGE = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".go": "go", ".java": "java", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".c": "c", ".cs": "c_sharp",
    ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "bash",
}
SUPPORTED = DOCUMENT_TYPES + CODE_TYPES + CONFIG_TYPES


def file_gate(name: Column, size: Column, max_mb: float) -> Column:
    """Null for an accepted file, else why it is refused."""
    return F.when(~suffix(name).isin(*SUPPORTED), F.concat(F.lit("Unsupported file format: "), suffix(name))).when(
        (F.coalesce(size, F.lit(0)) > 0) & (size > max_mb * 1024 * 1024), "File too large")


def category(extension: Column) -> Column:
    """document, code, config or other; a missing type counts as a document."""
    return F.when(extension.isNull() | extension.isin(*DOCUMENT_TYPES), "document").when(
        extension.isin(*CODE_TYPES), "code").when(extension.isin(*CONFIG_TYPES), "config").otherwise("other")


def code_language(extension: Column) -> Column:
    pairs = [F.lit(x) for kv in CODE_LANGUAGE.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension), F.lit("python"))


def change_action(version: Column, old_version: Column, old_status: Column, old_error: Column,
                  title: Column | None = None, old_title: Column | None = None) -> Column:
    """new, changed, unchanged, restage (deleted or aborted before) or retitle, against the catalog."""
    aborted = (old_status == "failed") & F.coalesce(old_error, F.lit("")).contains("Aborted")
    equal = F.coalesce(version == old_version, F.lit(False))
    moved = F.lit(False) if title is None else ~title.eqNullSafe(old_title)
    return F.when(old_status.isNull(), "new").when(equal & ((old_status == "deleted") | aborted), "restage").when(
        ~equal, "changed").when(moved, "retitle").otherwise("unchanged")


def stage_pages(pages: DataFrame, catalog: DataFrame, min_chars: int = 200, policy: str = "balanced") -> DataFrame:
    """One row per fetched page with what to do about it.

    pages (page_id, url, html, fetched), catalog (source, content_version, status, last_error, old_title).
    """
    uri = U.normalize_web_uri(F.col("url"))
    p = pages.select("page_id", "html", "fetched", uri.alias("source")).withColumn(
        "text", H.html_to_text(F.col("html"), policy))
    p = p.select(
        "page_id", "source", "fetched", H.page_title(F.col("html"), U.last_segment(F.col("source"))).alias("title"),
        H.content_version(F.lit(None).cast("string"), F.col("text"), F.col("html")).alias("version"),
        F.length("text").alias("n_text"), F.octet_length("html").alias("file_size"))
    j = p.join(catalog, "source", "left")
    action = F.when(~F.col("fetched"), "failed").when(U.is_pagination(F.col("source")), "skip_pagination").when(
        (F.lit(min_chars) > 0) & (F.col("n_text") < min_chars), "skip_thin").otherwise(change_action(
            F.col("version"), F.col("content_version"), F.col("status"), F.col("last_error"), F.col("title"), F.col("old_title")))
    j = j.withColumn("action", action)
    staged_now = F.col("action").isin("new", "changed", "restage")
    return j.select(
        "page_id", "source", "action", F.when(staged_now | (F.col("action") == "retitle"), F.col("title")).alias("title"),
        F.when(staged_now, F.col("version")).alias("content_version"), F.when(staged_now, F.col("file_size")).alias("file_size"),
        F.when(staged_now, "pending").when(F.col("action") == "failed", "failed").alias("new_status"))


def link_table(pages: DataFrame) -> DataFrame:
    """(source, pos, target): canonical http links of every page, in page order.

    The steps are written out in between: each uses the value of the one before many times, and the
    optimizer would repeat its whole expression at every use.
    """
    found = staged(pages.select(U.normalize_web_uri(F.col("url")).alias("source"),
                                F.posexplode(H.links(F.col("html"))).alias("pos", "href")))
    absolute = staged(found.select("source", "pos", U.resolve_link(F.col("source"), F.col("href")).alias("link")))
    return absolute.filter(F.col("link").startswith("http")).select(
        "source", "pos", U.normalize_web_uri(F.col("link")).alias("target"))


def crawl_frontier(seeds: DataFrame, links: DataFrame, depth: int, max_pages: int, scope: Column) -> DataFrame:
    """(uri, depth) of the pages a breadth-first crawl processes, at most ``max_pages``.

    seeds (uri, ord), links (source, pos, target). Every level is one join with the link table; a page
    reached several times keeps its first position. ``scope`` tests the column ``uri``.
    """
    links = staged(links)
    level = seeds.groupBy("uri").agg(F.min(F.array(F.col("ord").cast("long"))).alias("ord"))
    queued = level.select("uri")
    reached = None
    for d in range(depth + 1):
        level = staged(level.filter(scope))
        found = level.select("uri", F.lit(d).alias("depth"), "ord")
        reached = found if reached is None else reached.unionByName(found)
        if d == depth:
            break
        nxt = level.join(links, F.col("uri") == F.col("source")).select(
            F.col("target").alias("uri"), F.concat("ord", F.array(F.col("pos").cast("long"))).alias("ord"))
        level = nxt.groupBy("uri").agg(F.min("ord").alias("ord")).join(queued, "uri", "left_anti")
        queued = staged(queued.unionByName(level.select("uri")))
    return reached.orderBy("depth", "ord").limit(max_pages).select("uri", "depth")


def stage_repo_files(tree: DataFrame, prefix: str, max_files: int, max_bytes: int) -> DataFrame:
    """Blobs under a prefix with a supported type, the first ``max_files`` by path, sized; large ones skipped.

    tree (path, type, sha, size, owner, repo, branch)
    """
    first = tree.filter((F.col("type") == "blob") & F.col("path").startswith(prefix)
                        & suffix(F.col("path")).isin(*SUPPORTED)).orderBy("path").limit(max_files)
    url = F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "repo", F.lit("/blob/"), "branch", F.lit("/"), "path")
    return first.filter(F.col("size") <= max_bytes).select(
        "path", U.normalize_repo_uri(url).alias("source"), F.col("sha").alias("content_version"), F.col("size").alias("file_size"))


def stage_wiki_pages(pages: DataFrame, depth: int, excluded: list[str], max_pages: int) -> DataFrame:
    """First ``max_pages`` pages of a space export without those too deep or with an excluded label.

    pages (page_id, title, url, version, labels array, ancestors array)
    """
    barred = F.array(*[F.lit(x.lower()) for x in excluded])
    return pages.orderBy("page_id").limit(max_pages).filter(
        (F.size("ancestors") <= depth)
        & ~F.arrays_overlap(F.transform("labels", F.lower), barred)).select(
        "page_id", "title", U.normalize_web_uri(F.col("url")).alias("source"), F.col("version").cast("string").alias("content_version"))
