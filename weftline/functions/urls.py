"""URL and file-name expressions of the open-directory index."""

from __future__ import annotations

import posixpath
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions of each file type, aliases of types, extensions of page assets.
EXTENSIONS = {
    "Video": ".mp4 .m4v .mkv .avi .mov .webm .mpg .mpeg .ts .flv .wmv .3gp",
    "Audio": ".mp3 .wav .flac .aac .ogg .opus .m4a .wma .mid .midi",
    "Document": ".pdf .epub .mobi .azw .azw3 .doc .docx .txt .rtf .odt .xls .xlsx .csv .ppt .pptx .md .djvu",
    "Archive": ".zip .rar .7z .tar .gz .tar.gz .tgz .bz2 .tar.bz2 .xz .tar.xz .zst .tar.zst .iso .dmg .cab",
    "Executable": ".exe .msi .apk .deb .rpm .jar .sh .bash .bat .cmd .ps1 .appimage .bin",
}
ALIASES = {
    "Video": "video,videos",
    "Audio": "audio,audios,sound,music",
    "Document": "document,documents,doc,docs,ebook,ebooks,book,books",
    "Archive": "archive,archives,compressed,archive software",
    "Executable": "executable,executables,software,application,applications,app,apps,binary",
    "Other": "other",
}
ASSETS = ".html .htm .xhtml .shtml .mhtml .css .js .mjs .cjs .svg .png .jpg .jpeg .gif .ico .webp .bmp .tif .tiff .php .asp .aspx .jsp .cgi .pl .py .rb .cfm .xml .json".split()
SAFE = "%/:=&?~#+!$,;'@()*[]"


def _lookup(table: dict[str, str], sep: str | None) -> Column:
    return F.create_map(*(F.lit(x) for kind, names in table.items() for name in names.split(sep) for x in (name, kind)))


def resolved(base: str | None, href: str) -> str:
    """href against base (RFC 3986), other than ASCII percent-encoded; the base itself if href can't be parsed."""
    if base is None:
        return href
    try:
        return quote(urljoin(base, href), safe=SAFE)
    except ValueError:
        return base


def normalised(base: str, href: str) -> str | None:
    """An absolute http(s) URL with a tidy path and no fragment; null for what isn't a link to follow."""
    href = href.strip()
    if not href or href.lower().startswith(("mailto:", "javascript:", "tel:", "ftp:", "data:", "#")):
        return None
    try:
        scheme, host, path, query, _ = urlsplit(urljoin(base, href))
    except ValueError:
        return None
    if scheme not in ("http", "https") or not host:
        return None
    tidy = posixpath.normpath("/" + path.lstrip("/"))
    return urlunsplit((scheme, host.lower(), tidy if tidy == "/" or not path.endswith("/") else tidy + "/", query, ""))


@F.pandas_udf(T.StringType())
def normalize_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else normalised(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def is_http_url(url: Column) -> Column:
    """Whether a fetch would accept it: parsable, http or https, with a host."""
    u = F.btrim(url)
    return F.coalesce(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(u, F.lit("HOST")).isNotNull(), F.lit(False))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def canonical_directory(url: Column) -> Column:
    """Without query and fragment; a slash after a last segment that has no extension."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    bare = F.when(F.regexp_like(bare, F.lit(r"^[a-z]+://[^/]*$")), F.concat(bare, F.lit("/"))).otherwise(bare)
    last = F.regexp_extract(bare, r"([^/]*)$", 1)
    return F.when((last != "") & ~F.contains(last, F.lit(".")), F.concat(bare, F.lit("/"))).otherwise(bare)


def is_directory_url(url: Column) -> Column:
    return F.endswith(path_of(url), F.lit("/"))


def is_within(root: Column, target: Column) -> Column:
    """Same scheme and host, and the target's path below the root's."""
    closed = lambda u: F.concat(F.regexp_replace(canonical_directory(u), "/+$", ""), F.lit("/"))
    return F.startswith(closed(target), closed(root))


def file_name(url: Column) -> Column:
    """The last path segment, percent-decoded (a plus stays a plus); a slash at the end doesn't count."""
    last = F.regexp_extract(F.regexp_replace(path_of(url), "/+$", ""), r"([^/]*)$", 1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def extension(name: Column) -> Column:
    """Lower-cased, with its dot; a compound of tar first; none for a leading or trailing dot."""
    low = F.lower(F.btrim(name))
    compound = F.regexp_extract(low, r"(\.tar\.(?:gz|bz2|xz|zst))$", 1)
    return F.when(compound != "", compound).otherwise(F.regexp_extract(low, r"(?s)^.+(\.[^.]+)$", 1))


def file_type(name: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(EXTENSIONS, None), extension(name)), F.lit("Other"))


def normal_type(name: Column) -> Column:
    """The type that a user's word for it names, or null."""
    return F.try_element_at(_lookup(ALIASES, ","), F.btrim(F.regexp_replace(F.lower(name), r"[_/\s-]+", " ")))


def is_indexable(url: Column) -> Column:
    """A file, not a directory, system file or page asset."""
    name = file_name(url)
    low = F.lower(name)
    return ~is_directory_url(url) & (name != "") & ~low.isin(".", "..", "parent directory", ".ds_store", "thumbs.db") & ~extension(name).isin(ASSETS)


def without_tracking(url: Column) -> Column:
    """Without the query parameters utm_*, fbclid and gclid."""
    base, query, fragment = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(r"^(utm_[^=]*|fbclid|gclid)(=|$)"))), "&")
    return F.concat(base, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)), fragment)
