"""Attachment links of a page, platform manuals, login walls, and file addresses in any text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import html as hx
from docsluice.functions import text as tx
from docsluice.functions import urls
from docsluice.functions.patterns import matches
from docsluice.operators.cards import DOCS_HEADER, Site, document_section

# What makes a link an attachment, a manual or a login form.
ATTACHMENT_EXT = r"\.(pdf|docx?|zip|rar|7z|xlsx?|csv|txt|pptx?)(\?|#|$)"
ATTACHMENT_WORDS = r"(download|attach|file|upload|storage|docs)"
NUMBERED_FILE = r"_[0-9]{8,14}\.(pdf|docx?|zip|rar|7z|xlsx?)(\?|#|$)"
FILE_PATHS = r"/(file|files|download|attachment|attachments|storage|get-file|getdoc|document|doc_download)"
FILE_QUERY = r"(?<![a-z0-9_])(id|fid|file|doc|tid|did|aid)=[^&\s\"']+"
FILE_TEXT = r"\.(pdf|docx?|zip|rar|7z|xlsx?)(?![A-Za-z0-9_])"
NAME_TEXT = r"\.(pdf|docx?|zip|rar|7z|xlsx?|csv|txt)(?![A-Za-z0-9_])"
GET_FILE = r"/auction/getfile/"
REGISTRY_GET_FILE = r"/(auction/)?get-file/\d+"
MANUAL_NAMES = (
    r"edge_browser|mozilla_browser|chrome_browser|safari_browser|ice_browser|browser_settings|"
    r"ice_account.*settings|account_settings"
)
MANUAL_EXACT = r"^personal_data(?:[\s_-]*(policy|notice)?)$"
MANUAL_FILES = ("preiskurant", "reglament_os")
MANUAL_PATHS = r"/(help|support|instruction)(?![A-Za-z0-9_])"
URL_CHARS = r"[-a-zA-Z0-9+&@#/%?=~_|!:,.;]"


def is_attachment_link(url: Column, link_text: Column, relaxed: Column, site: Site) -> Column:
    """Whether an absolute link is a file; some signs count only inside the documents section or on a known host."""
    h, p = urls.host(url), F.lower(urls.path(url))
    portal, registry = urls.on_host(h, site.portal), urls.on_host(h, site.registry)
    named = F.coalesce(link_text, F.lit("")).rlike("(?i)" + FILE_TEXT)
    anywhere = url.rlike("(?i)" + ATTACHMENT_EXT) | p.rlike(ATTACHMENT_WORDS) | (registry & p.rlike(REGISTRY_GET_FILE))
    on_portal = (
        p.contains(GET_FILE) | url.rlike("(?i)" + NUMBERED_FILE) | p.rlike(FILE_PATHS)
        | F.lower(urls.search(url)).rlike(FILE_QUERY) | named
    )
    return anywhere | (relaxed & portal & on_portal)


def host_allowed(url: Column, page_url: Column, site: Site) -> Column:
    h = urls.host(url)
    return (h == urls.host(page_url)) | urls.on_host(h, site.portal) | urls.on_host(h, site.registry)


def is_platform_help(url: Column, link_text: Column, view_id: Column | None, site: Site) -> Column:
    """Manuals of the platform; not on the registry, and not when the address holds the card's id as a whole number."""
    p, s = urls.path(url), urls.search(url)
    segment = F.regexp_extract(p, r"([^/]*)$", 1)
    without_ext = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?i)\.[a-z0-9]{1,8}$", "")))
    by_url = without_ext(F.coalesce(F.try_url_decode(segment), segment))
    by_text = without_ext(tx.js_trim(F.coalesce(link_text, F.lit(""))))
    both = F.trim(F.concat_ws(" ", by_url, by_text))
    plain = lambda c: F.regexp_replace(c, r"\s+", "_").isin(*MANUAL_FILES)
    manual = both.rlike(MANUAL_NAMES) | both.rlike(MANUAL_EXACT) | plain(by_url) | plain(by_text) | F.lower(p).rlike(MANUAL_PATHS)
    out = manual & ~urls.on_host(urls.host(url), site.registry)
    if view_id is None:
        return out
    token = F.concat(F.lit("(^|[^0-9])"), view_id, F.lit("([^0-9]|$)"))
    mentions = F.coalesce(view_id.rlike(r"^\d+$") & F.regexp_like(F.concat(p, s), token), F.lit(False))
    return out & ~mentions


def is_login_wall(html: Column) -> Column:
    """A login form came back instead of the card."""
    def has(p: str) -> Column:
        return matches(html, p)

    card = has(DOCS_HEADER) | (
        has(r"Подача\s+предложений|приглашени[ея]\s+к\s+участию") & has(r"\.(pdf|docx?)(\?|\"|'|>|$|\s)")
    )
    form = has(r"name\s*=\s*[\"']llogin[\"']") & (
        has(r"name\s*=\s*[\"']lPassword[\"']") | has(r"id\s*=\s*[\"']pass[\"'][^>]*type\s*=\s*[\"']password[\"']")
    )
    submit = has(r"<input[^>]+type\s*=\s*[\"']submit[\"'][^>]*value\s*=\s*[\"']Войти[\"']") | has(
        r"value\s*=\s*[\"']Войти[\"'][^>]*type\s*=\s*[\"']submit[\"']"
    )
    other = has(r"id\s*=\s*[\"']login[\"'][^>]*name\s*=\s*[\"']llogin[\"']") & has("l-pass") & has("Войти")
    return F.coalesce((F.length(html) >= 800) & ~card & ((form & submit) | other), F.lit(False))


def _raw_links(html: Column, site: Site) -> Column:
    """(href, text) of one pass over a piece of HTML: anchors, bare hrefs, file addresses, getFile and get-file links."""
    anchors = F.transform(
        hx.anchors(html),
        lambda a: F.struct(
            a["href"].alias("href"),
            F.nullif(F.trim(hx.decode_entities(hx.strip_tags(a["inner"]))), F.lit("")).alias("text"),
        ),
    )
    portal, registry = site.portal_rx, site.registry.replace(".", r"\.")
    ext = r"\.(?:pdf|docx?|zip|rar|7z|xlsx?|csv|txt)"
    patterns = [
        (r"href\s*=\s*[\"']([^\"']+)[\"']", 1),
        (r"(?<![A-Za-z0-9_])href\s*=\s*([^\s<>\"']+)", 1),
        (rf"https?://(?:www\.)?{portal}{URL_CHARS}*{ext}(?:\?{URL_CHARS}*)?", 0),
        (rf"https?://(?:www\.)?{portal}/auction/getFile/[^\s\"'<>]+", 0),
        (r"[\"'](/auction/getFile/[^\"']+)[\"']", 1),
        (rf"https?://(?:www\.)?{registry}/auction/get-file/\d+{URL_CHARS}*", 0),
    ]
    bare = F.flatten(F.array(*[hx.fragments(html, p, g) for p, g in patterns]))
    plain = F.transform(bare, lambda h: F.struct(h.alias("href"), F.lit(None).cast("string").alias("text")))
    return F.concat(anchors, plain)


def attachment_links(
    pages: DataFrame, site: Site, key: str = "page_id", url: str = "url", html: str = "html", section_only: bool = False,
    header: str | None = None, end: str | None = None,
) -> DataFrame:
    """(key, ord, url, link_text): distinct file links of each page, in order of discovery.

    The documents section goes first and is read generously, then the page strictly.  Links of a page are deduplicated
    inside its row, so nothing is shuffled.
    """
    bounds = [x for x in (header, end) if x is not None]
    section = document_section(F.col(html), *bounds)
    tagged = lambda piece, relaxed: F.transform(
        _raw_links(piece, site), lambda r: F.struct(r["href"].alias("href"), r["text"].alias("text"), F.lit(relaxed).alias("relaxed"))
    )
    none = F.array().cast("array<struct<href:string,text:string,relaxed:boolean>>")
    first = F.when(section.isNotNull(), tx.let(section, lambda s: tagged(s, True))).otherwise(none)
    whole = tagged(F.col(html), False)
    if section_only:
        whole = F.when(section.isNull(), whole).otherwise(none)
    base = F.col(url)

    def cleaned(r: Column) -> Column:
        return hx.decode_entities(F.regexp_replace(tx.js_trim(r["href"]), "^[\"']|[\"']$", ""))

    def usable(h: Column) -> Column:
        return (h != "") & ~h.startswith("#") & ~F.lower(h).startswith("javascript:")

    def link(r: Column) -> Column:
        return F.struct(
            tx.let(cleaned(r), lambda h: F.when(usable(h), urls.resolve_url(base, h))).alias("url"),
            r["text"].alias("text"),
            r["relaxed"].alias("relaxed"),
        )

    def kept(r: Column) -> Column:
        ok = is_attachment_link(r["url"], r["text"], r["relaxed"], site) & host_allowed(r["url"], base, site)
        return r["url"].isNotNull() & ok

    # Links repeat within a page; equal ones are resolved and judged once.
    distinct = F.array_distinct(F.concat(first, whole))
    links = F.filter(F.transform(distinct, link), kept)
    rows = pages.select(key, links.alias("links")).select(key, "links", F.array_distinct(F.transform("links", lambda r: r["url"])).alias("urls"))
    rows = rows.select(key, "links", F.posexplode("urls").alias("ord", "url"))
    text = F.filter("links", lambda r: r["url"] == F.col("url"))[0]["text"]
    named = (F.length(text) > 2) & (F.length(text) < 220) & text.rlike("(?i)" + NAME_TEXT)
    out = rows.select(key, "ord", "url", F.when(named, text).alias("link_text"))
    return out.where(~is_platform_help(F.col("url"), F.col("link_text"), None, site))


def union_file_urls(text: Column, site: Site) -> Column:
    """Sorted distinct file addresses in a text: absolute, registry downloads, and rooted ones put below the portal."""
    portal, registry = site.portal_rx, site.registry.replace(".", r"\.")
    ext = r"\.(?:pdf|docx?|zip|rar|7z|xlsx?|csv|txt)"
    absolute = hx.fragments(text, rf"https?://(?:www\.)?{portal}{URL_CHARS}*{ext}(?:\?{URL_CHARS}*)?", 0)
    downloads = hx.fragments(text, rf"https?://(?:www\.)?{registry}/auction/get-file/\d+{URL_CHARS}*", 0)
    rooted = hx.fragments(text, rf"[\"'](/{URL_CHARS}*{ext}(?:\?[^\"'\\]*)?)[\"']", 1)
    origin = F.lit(f"https://{site.portal}")
    joined = F.transform(rooted, lambda r: urls.resolve_url(origin, r))
    return F.array_sort(F.array_distinct(F.concat(absolute, downloads, joined)))
