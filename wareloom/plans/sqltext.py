"""Small builders for the check SQL (DuckDB dialect)."""

from __future__ import annotations

from ..functions import lexicons as lex

BLANKS = r"chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def strip_tags(x: str) -> str:
    return strip(squeeze(f"regexp_replace({x}, '<[^>]+>', '', 'g')"))


def rx(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def rx_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def has_rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def any_contained(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def any_rx(x: str, patterns) -> str:
    return has_rx(x, "|".join(f"(?:{p})" for p in patterns))


def n_contained(x: str, words) -> str:
    return "(" + " + ".join(f"contains({x}, {q(w)})::INT" for w in words) + ")"


def n_matching(x: str, patterns) -> str:
    return "(" + " + ".join(f"{has_rx(x, p)}::INT" for p in patterns) + ")"


def n_rx(x: str, pattern: str) -> str:
    return f"len({rx_all(x, pattern)})"


def cases(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in pairs) + f" ELSE {default} END"


def scheme(u: str) -> str:
    return f"lower({rx(u, PARTS, 1)})"


def raw_host(u: str) -> str:
    return rx(u, PARTS, 2)


def host(u: str) -> str:
    return f"lower({rx(u, PARTS, 2)})"


def bare_host(u: str) -> str:
    return rf"regexp_replace({host(u)}, '^www\.', '')"


def path(u: str) -> str:
    return rx(u, PARTS, 3)


def canonical(u: str) -> str:
    start = "^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"
    kind, place, rest = (rx(u, start, i) for i in (1, 2, 3))
    return (
        f"(CASE WHEN {kind} <> '' THEN lower({kind}) || ':' ELSE '' END"
        f" || CASE WHEN {place} <> '' THEN '//' || lower({place}) ELSE '' END"
        f" || rtrim(regexp_replace({rest}, ';[^/]*$', ''), '/'))"
    )


def no_query(u: str) -> str:
    return f"split_part(split_part({u}, '#', 1), '?', 1)"


def absolute(u: str, base: str) -> str:
    """Links of the given tables are absolute or rooted, so no dot segments arise."""
    return (
        f"CASE WHEN starts_with({u}, 'http') THEN {u} "
        f"WHEN starts_with({u}, '/') THEN {scheme(base)} || '://' || {raw_host(base)} || {u} "
        f"ELSE {scheme(base)} || '://' || {raw_host(base)} || regexp_replace({path(base)}, '[^/]*$', '') || {u} END"
    )


def extension(x: str, extensions) -> str:
    return rx(x, "(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$", 1)


def crawl_skip(u: str) -> str:
    low = f"lower({u})"
    image, media = extension(low, lex.IMAGE_EXTENSIONS), extension(low, lex.CRAWL_MEDIA_EXTENSIONS)
    pairs = [
        (f"{image} <> ''", f"'image_file_' || {image}"),
        (f"{media} <> ''", f"'media_file_' || {media}"),
        (f"contains({low}, {q(lex.UPLOAD_DIR)})", "'wordpress_upload'"),
    ]
    pairs += [(f"contains({low}, {q(p)})", q(r)) for p, r in lex.CRAWL_SKIP_PATTERNS]
    pairs += [
        (f"{has_rx(low, lex.PAGINATION_PATTERN)} OR contains({low}, {q(lex.PAGINATION_QUERY)})", "'pagination'"),
        (any_contained(low, lex.ARCHIVE_PATTERNS), "'archive_page'"),
    ]
    return cases(pairs, "''")


def site_skip(u: str, base: str) -> str:
    low = f"lower({u})"
    pairs = [
        (f"{extension(low, lex.IMAGE_EXTENSIONS)} <> ''", "'image_file'"),
        (f"{extension(low, lex.SITE_MEDIA_EXTENSIONS)} <> ''", "'media_file'"),
        (f"contains({low}, {q(lex.UPLOAD_DIR)})", "'wordpress_upload'"),
    ]
    pairs += [(f"contains({low}, {q(p)})", q(r)) for p, r in lex.SITE_SKIP_PATTERNS]
    pairs += [(f"{bare_host(u)} <> {bare_host(base)}", "'external_domain'")]
    return cases(pairs, "''")


def page_link_ok(u: str) -> str:
    return (
        f"({extension(f'lower({path(u)})', lex.LINK_SKIP_EXTENSIONS)} = '' "
        f"AND NOT {any_contained(f'lower({u})', lex.LINK_SKIP_PATHS)})"
    )
