"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from .text import contains_any, first_hit

PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def raw_host(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def host(url: Column) -> Column:
    return F.lower(raw_host(url))


def bare_host(url: Column) -> Column:
    """Lower-case host without a leading 'www.'."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def _rstrip_slash(c: Column) -> Column:
    return F.rtrim(c, F.lit("/"))


#: Scheme, host and path of the url grammar, each of them optional.
GRAMMAR = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, no params, query or fragment.

    A url without scheme or host keeps what it has, so relative urls stay apart.
    """
    kind, place, rest = (F.regexp_extract(url, GRAMMAR, i) for i in (1, 2, 3))
    return F.concat(
        F.when(kind != "", F.concat(F.lower(kind), F.lit(":"))).otherwise(F.lit("")),
        F.when(place != "", F.concat(F.lit("//"), F.lower(place))).otherwise(F.lit("")),
        _rstrip_slash(F.regexp_replace(rest, r";[^/]*$", "")),
    )


def with_query(url: Column) -> Column:
    """As canonical, but params and query stay; NULL without scheme or host."""
    no_fragment = F.substring_index(url, "#", 1)
    query = F.regexp_extract(no_fragment, r"(\?.+)$", 1)
    full_path = path(no_fragment)
    params = F.regexp_extract(full_path, r"(;[^/]*)$", 1)
    plain_path = F.regexp_replace(full_path, r";[^/]*$", "")
    built = F.concat(scheme(url), F.lit("://"), host(url), _rstrip_slash(plain_path), params, query)
    return F.when((scheme(url) != "") & (host(url) != ""), built)


def without_query(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def canonical_by_mode(url: Column, mode: str) -> Column:
    return {"crawl": canonical, "keep_query": with_query, "cut": without_query}[mode](url)


def host_by_mode(url: Column, mode: str) -> Column:
    return {"raw": raw_host, "lower": host, "bare": bare_host}[mode](url)


def _resolve_dots(p: Column) -> Column:
    segments = F.split(p, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    joined = F.array_join(kept, "/")
    return F.when(last.isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(joined)


def absolute(url: Column, base: Column) -> Column:
    """Resolve a link against the page it stands on."""
    root = F.concat(scheme(base), F.lit("://"), raw_host(base))
    base_path = path(base)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    link_path = F.regexp_extract(url, r"^([^?#]*)", 1)
    tail = F.regexp_extract(url, r"^[^?#]*([?#].*)$", 1)
    full_path = F.when(url.startswith("/"), link_path).otherwise(F.concat(folder, link_path))
    clean_path = F.when(full_path.rlike(r"/\.\.?(/|$)"), _resolve_dots(full_path)).otherwise(full_path)
    return (
        F.when(url.startswith("http"), url)
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme(base), F.lit(":"), url))
        .when(url == "", base)
        .when(url.startswith("?"), F.concat(root, base_path, url))
        .when(url.startswith("#"), F.concat(F.substring_index(base, "#", 1), url))
        .otherwise(F.concat(root, clean_path, tail))
    )


def _extension(c: Column, extensions: list[str]) -> Column:
    pattern = "(" + "|".join(e.replace(".", r"\.") for e in extensions) + r")\z"
    return F.regexp_extract(c, pattern, 1)


def crawl_skip_reason(url: Column) -> Column:
    """Skip reason of the page crawler; empty when the url may be crawled."""
    low = F.lower(url)
    image = _extension(low, lex.IMAGE_EXTENSIONS)
    media = _extension(low, lex.CRAWL_MEDIA_EXTENSIONS)
    rules = [
        (image != "", F.concat(F.lit("image_file_"), image)),
        (media != "", F.concat(F.lit("media_file_"), media)),
        (F.contains(low, F.lit(lex.UPLOAD_DIR)), F.lit("wordpress_upload")),
    ]
    rules += [(F.contains(low, F.lit(p)), F.lit(reason)) for p, reason in lex.CRAWL_SKIP_PATTERNS]
    rules += [
        (low.rlike(lex.PAGINATION_PATTERN) | F.contains(low, F.lit(lex.PAGINATION_QUERY)), F.lit("pagination")),
        (contains_any(low, lex.ARCHIVE_PATTERNS), F.lit("archive_page")),
    ]
    return first_hit(rules, F.lit(""))


def site_skip_reason(url: Column, base: Column) -> Column:
    """Skip reason of the whole-site crawler, which also stays on one domain."""
    low = F.lower(url)
    rules = [
        (_extension(low, lex.IMAGE_EXTENSIONS) != "", F.lit("image_file")),
        (_extension(low, lex.SITE_MEDIA_EXTENSIONS) != "", F.lit("media_file")),
        (F.contains(low, F.lit(lex.UPLOAD_DIR)), F.lit("wordpress_upload")),
    ]
    rules += [(F.contains(low, F.lit(p)), F.lit(reason)) for p, reason in lex.SITE_SKIP_PATTERNS]
    rules += [(bare_host(url) != bare_host(base), F.lit("external_domain"))]
    return first_hit(rules, F.lit(""))


def fetch_blocked(url: Column) -> Column:
    return contains_any(F.lower(url), lex.FETCH_BLOCKLIST)


def is_page_link(url: Column) -> Column:
    """An absolute link that may lead to a page: no media, no feed or admin path."""
    low_path = F.lower(path(url))
    return (
        ~url.startswith("#")
        & ~url.startswith("mailto:")
        & (_extension(low_path, lex.LINK_SKIP_EXTENSIONS) == "")
        & ~contains_any(F.lower(url), lex.LINK_SKIP_PATHS)
    )


def first_path_segment(url: Column) -> Column:
    """First path segment as '/segment/', NULL for a link without a path."""
    without = F.regexp_replace(without_query(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?|^//[^/]*", "")
    segment = F.regexp_extract(without, r"^/*([^/]+)", 1)
    return F.when(segment != "", F.concat(F.lit("/"), segment, F.lit("/")))


def path_segment(url: Column, index: int = -1) -> Column:
    """Path segment by position (negative counts from the end), empty if absent."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    at = index + 1 if index >= 0 else index
    return F.coalesce(F.try_element_at(segments, F.lit(at)), F.lit(""))
