"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsluice.functions import text as tx


_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(?://([^/?#\\]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host without port, user and a leading ``www.``."""
    authority = F.regexp_replace(F.lower(_part(url, 2)), r"^[^@]*@|:\d+$", "")
    return F.regexp_replace(authority, r"^www\.", "")


def path(url: Column) -> Column:
    return _part(url, 3)


def search(url: Column) -> Column:
    return _part(url, 4)


def on_host(url_host: Column, site: str) -> Column:
    """The host is the site or below it."""
    return (url_host == site) | url_host.endswith("." + site)


def _without_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments."""
    segments = F.split(p, "/")
    last = F.element_at(segments, -1)

    def step(acc: Column, s: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(F.slice(segments, 2, 100_000), F.array(F.lit("")), step)
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), F.array_join(closed, "/")).otherwise(p)


def _escaped(c: Column) -> Column:
    """Percent-encode blanks, non-ASCII and the few ASCII characters a URL must not hold."""
    odd = F.array_distinct(F.regexp_extract_all(c, F.lit(r"[^\x21-\x7E]|[\"<>`{}]"), F.lit(0)))
    put = lambda acc, ch: F.replace(acc, ch, F.when(ch == " ", "%20").otherwise(F.url_encode(ch)))
    return F.when(F.size(odd) > 0, F.aggregate(odd, c, put)).otherwise(c)


def resolve_url(base: Column, href: Column) -> Column:
    """Join a link to its page address; NULL when the result is no hierarchical URL."""
    origin = F.concat(scheme(base), F.lit("://"), F.lower(_part(base, 2)))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    base_path = F.when(path(base) == "", "/").otherwise(path(base))
    joined = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, base_path, href))
        .when(href.startswith("#") | (href == ""), F.concat(origin, base_path, search(base), href))
        .otherwise(F.concat(origin, folder, href))
    )
    return tx.let(joined, _normalized)


def _normalized(url: Column) -> Column:
    p = path(url)
    whole_path = F.when(p == "", "/").otherwise(_without_dots(p))
    authority = F.regexp_replace(F.lower(_part(url, 2)), r":(80|443)$", "")
    out = F.concat(scheme(url), F.lit("://"), authority, whole_path, search(url), _part(url, 5))
    return F.when(authority != "", tx.let(out, _escaped))


def view_ids(text: Column, view_url: str) -> Column:
    """Distinct ids of card addresses in a text, in order; ``view_url`` is the address up to the id, without scheme."""
    body = view_url.replace(".", r"\.")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?i)(?<![\w/.])(?:https?://)?(?:www\.)?{body}(\d+)"), F.lit(1)))


def drive_id(c: Column) -> Column:
    """Id of a stored file or folder from an id, a link or NULL."""
    s = F.trim(c)
    h, p = host(s), path(s)
    in_drive = F.coalesce(
        F.nullif(F.regexp_extract(p, r"^/+drive/+folders/+([^/]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(p, r"^/+file/+d/+([^/]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(search(s), r"[?&]id=([^&]+)", 1), F.lit("")),
    )
    in_docs = F.nullif(F.regexp_extract(p, r"/d/+([^/]+)", 1), F.lit(""))
    return (
        F.when(s.rlike(r"^[-A-Za-z0-9_]{10,}$"), s)
        .when(h == "drive.google.com", in_drive)
        .when(h.isin("docs.google.com", "spreadsheets.google.com", "presentation.google.com"), in_docs)
    )


def distinct_ids(c: Column, pattern: str = r"\d+") -> Column:
    """Every id a text names, in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def alternate_ids(c: Column, pattern: str = r"\d+") -> Column:
    """The ids besides the first one, in order of first sight."""
    return tx.let(distinct_ids(c, pattern), lambda ids: F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))))
