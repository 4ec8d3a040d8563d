"""Scalar functions as column expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c) -> Column:
    """ASCII capitals in lower case, all else as it is; used alike for texts and queries, so any text can be found."""
    return F.translate(c, _UPPER, _LOWER)


def mime_group(mime) -> Column:
    """html, css, js, svg, image or other, without parameters after a semicolon."""
    bare = F.trim(F.split_part(mime, F.lit(";"), F.lit(1)))
    return (
        F.when(bare == "text/html", "html").when(bare == "text/css", "css").when(bare.isin("application/javascript", "text/javascript"), "js")
        .when(bare == "image/svg+xml", "svg").when(bare.startswith("image/"), "image").otherwise("other")
    )


def chunk_key(mime, size) -> Column:
    """The group content is packed with: small entries apart from large ones, images together."""
    group = mime_group(mime)
    return F.when((group != "image") & (size < 4096), F.concat(group, F.lit("-small"))).otherwise(group)


def archive_slug(path, suffix: str) -> Column:
    """File name without suffix and without trailing parts like _2024-05 that begin with a digit."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    base = F.when(base.endswith(suffix), F.substring(base, F.lit(1), F.length(base) - len(suffix))).otherwise(base)
    return F.regexp_replace(base, r"(?<=.)(_[0-9][^_]{3,})+$", "")


def book_slug(title) -> Column:
    dashed = F.regexp_replace(F.lower(title), r"[ _.\-]+", "-")
    kept = F.regexp_replace(F.regexp_replace(dashed, r"[^a-z0-9\-]", ""), r"-+", "-")
    return F.regexp_replace(kept, r"^-|-$", "")


def numbered(slug: str, nth: str, mark: str = "_") -> Column:
    """slug, slug_2, slug_3 by the place among equal slugs."""
    return F.when(F.col(nth) > 1, F.concat(F.col(slug), F.lit(mark), F.col(nth).cast("string"))).otherwise(F.col(slug))


def etag(uuid, path) -> Column:
    return F.concat(F.lit('"'), F.substring(F.sha2(F.concat(uuid, path), 256), 1, 32), F.lit('"'))


def html_escape(c) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def entry_uri(archive, entry_id, scheme: str = "archive") -> Column:
    return F.concat(F.lit(f"{scheme}://"), archive, F.lit("/entry/"), entry_id.cast("string"))


def parse_uri(uri) -> Column:
    """archive and entry_id of an entry's URI; nulls if it isn't one."""
    pattern = r"^[a-z]+://([^/]+)/entry/([0-9]+)$"
    ok = uri.rlike(pattern)
    return F.struct(F.when(ok, F.regexp_extract(uri, pattern, 1)).alias("archive"), F.when(ok, F.regexp_extract(uri, pattern, 2).cast("long")).alias("entry_id"))


def is_binary_text(c) -> Column:
    """True if there is any character but printable ASCII, tab and line ends."""
    return ~c.rlike(r"^[\t\n\r\x20-\x7e]*$")


def is_binary_mime(mime) -> Column:
    return ~(mime.startswith("text/") | mime.isin("application/javascript", "application/json", "application/xml", "application/xhtml+xml"))


def namespace_path(ns, path) -> Column:
    """Where an entry of a namespaced archive goes; null for metadata and skipped namespaces."""
    return (
        F.when((ns == "C") & path.startswith("_mw_/"), F.concat(F.lit("chrome/"), path)).when(ns.isin("C", "-"), path)
        .when(ns == "W", F.concat(F.lit("_well_known/"), path)).when(ns.isin("M", "X"), None).otherwise(F.concat(F.lit("_other/"), ns, F.lit("/"), path))
    )


def path_tokens(c, delimiter: str = "/") -> Column:
    """Parts that keep the delimiter at their end; a trailing delimiter is followed by an empty part; none for an empty string."""
    parts = F.split(c, delimiter)
    kept = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit(delimiter))).otherwise(x))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(kept)


def human_bytes(n) -> Column:
    return (
        F.when(n >= 1 << 30, F.format_string("%.1f GB", n / (1 << 30))).when(n >= 1 << 20, F.format_string("%.1f MB", n / (1 << 20)))
        .when(n >= 1 << 10, F.format_string("%.1f KB", n / (1 << 10))).otherwise(F.format_string("%d B", n.cast("long")))
    )


def percent_bar(share, width: int = 20) -> Column:
    full = F.least(F.lit(width), F.greatest(F.lit(0), F.round(share * width))).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def short_bytes(n) -> Column:
    """Like human_bytes without blank or fraction: 12K, 3M."""
    return (
        F.when(n >= 1 << 30, F.format_string("%dG", (n / (1 << 30)).cast("long"))).when(n >= 1 << 20, F.format_string("%dM", (n / (1 << 20)).cast("long")))
        .when(n >= 1 << 10, F.format_string("%dK", (n / (1 << 10)).cast("long"))).otherwise(F.format_string("%dB", n.cast("long")))
    )


def comma_number(n) -> Column:
    return F.format_number(n.cast("long"), 0)


def uptime(seconds) -> Column:
    """2d 3h, 3h 4m, 4m 5s or 5s."""
    s = seconds.cast("long")
    two = lambda a, b, c, d: F.format_string(f"%d{c} %d{d}", (s / a).cast("long"), (s % a / b).cast("long"))
    return F.when(s >= 86400, two(86400, 3600, "d", "h")).when(s >= 3600, two(3600, 60, "h", "m")).when(s >= 60, two(60, 1, "m", "s")).otherwise(F.format_string("%ds", s))


def dashed_uuid(raw) -> Column:
    """32 hexadecimal digits as 8-4-4-4-12."""
    return F.regexp_replace(F.lower(raw), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def flags_line(options: dict[str, Column]) -> Column:
    """--name=value for each option that is set, --name for true, in the order of the names; nothing for nulls and false."""
    parts = []
    for name, value in sorted(options.items()):
        text = value.cast("string")
        parts.append(F.when(text == "true", F.lit(f"--{name}")).when(text.isNotNull() & (text != "false"), F.concat(F.lit(f"--{name}="), text)))
    return F.concat_ws(" ", *parts)
