"""Archive entries, links and keys as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of pages and of books.
PAGE_SUFFIX = r"(?i)\.(jpe?g|png|webp|gif|avif|bmp)$"
BOOK_SUFFIX = r"(?i)^(cbza|cbz|cbr|zip|rar)$"
# browsers' messages for a part of a program that is gone.
STALE_MESSAGES = ("ChunkLoadError", "Failed to load chunk", r"Loading chunk [\w-]+ failed", "Failed to fetch dynamically imported module", "Importing a module script failed")
DRIVE_HOSTS = ("drive.google.com", "docs.google.com", "drive.usercontent.google.com")


def base_name(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def extension(name: Column) -> Column:
    """What follows the last dot of the last segment, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(name), r"\.([^.]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(base_name(name), r"\.[^.]*$", "")


def is_junk(name: Column) -> Column:
    """What file managers leave in archives."""
    base = base_name(name)
    return name.startswith("__MACOSX/") | base.startswith("._") | base.isin(".DS_Store", "Thumbs.db")


def is_page(name: Column, is_dir: Column) -> Column:
    return ~is_dir & name.rlike(PAGE_SUFFIX) & ~is_junk(name)


def openable(name: Column) -> Column:
    """A book's suffix, or none at all."""
    suffix = extension(name)
    return (suffix == "") | suffix.rlike(BOOK_SUFFIX)


def natural_key(name: Column, width: int = 20) -> Column:
    """A key that sorts digit runs by value and letters without case; runs of
    more than ``width`` digits sort by their length behind the shorter ones."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def digits(run: Column) -> Column:
        value = F.regexp_replace(run, "^0+(?=.)", "")
        longer = F.concat(F.lit(":"), F.lpad(F.length(value).cast("string"), 10, "0"), value)
        return F.when(F.length(value) <= width, F.lpad(value, width, "0")).otherwise(longer)

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]+$"), digits(r)).otherwise(F.lower(r))), "")


def resolve_link(text: Column) -> Column:
    """A shared link as a struct of url and error; one of them is null.

    Scheme and host come out in lower case, without a default port, with a
    path, and with spaces encoded; dot segments stay.
    """
    trimmed = F.trim(text)
    url = F.when(trimmed.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z0-9+.-]+)://", 1))
    authority = F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, "^(?:.*@)?([^@:]*)", 1))
    port = F.regexp_extract(authority, ":([0-9]+)$", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    port = F.when(usual, "").otherwise(F.concat(F.lit(":"), port))
    encoded = lambda part: F.replace(part, F.lit(" "), F.lit("%20"))
    path = encoded(F.regexp_extract(url, r"^[^:]+://[^/?#]+(/[^?#]*)", 1))
    path = F.when(path == "", "/").otherwise(path)
    query, fragment = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), encoded(F.regexp_extract(url, "(#.*)$", 1))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(dl|raw)(=|$)") & (p != "")), "&")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    invalid = ~scheme.isin("http", "https") | (host == "") | host.rlike(r"[\s<>^|%\\]")
    error = F.when(trimmed == "", "linkEmpty").when(invalid, "linkInvalid").when(host.isin(*DRIVE_HOSTS), "linkDrive")
    dropbox = F.concat(scheme, F.lit("://dl.dropboxusercontent.com"), port, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), fragment)
    code = (F.size(parts) >= 5) & F.get(parts, F.lit(2)).isin("blob", "raw")
    raw = F.concat(F.lit("https://raw.githubusercontent.com/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit("/"), F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "/"))
    plain = F.concat(scheme, F.lit("://"), F.regexp_extract(authority, "^(.*@)", 1), host, port, path, encoded(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)), fragment)
    direct = F.when(host.isin("www.dropbox.com", "dropbox.com"), dropbox).when((host == "github.com") & code, raw).otherwise(plain)
    return F.struct(F.when(error.isNull(), direct).alias("url"), error.alias("error"))


def file_name(url: Column, disposition: Column) -> Column:
    """The name the server gives, or the link's last segment; ``tomo`` without either."""
    star = F.regexp_extract(disposition, r"filename\*\s*=\s*(?:UTF-8|utf-8)?''([^;]+)", 1)
    encoded = F.when(star != "", F.try_url_decode(F.regexp_replace(F.regexp_replace(F.trim(star), '^"|"$', ""), r"\+", "%2B")))
    plain = F.nullif(F.trim(F.regexp_extract(disposition, r'filename\s*=\s*"?([^";]+)"?', 1)), F.lit(""))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]+(/[^?#]*)", 1)
    last = F.get(F.reverse(F.filter(F.split(path, "/"), lambda p: p != "")), F.lit(0))
    return F.coalesce(encoded, plain, F.try_url_decode(F.regexp_replace(last, r"\+", "%2B")), F.lit("tomo"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the text's UTF-16 units, as a long."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.filter(F.sequence(F.lit(0), F.length(raw) - 1, F.lit(4)), lambda i: i < F.length(raw))
    codes = F.when(F.length(raw) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(units, lambda i: F.conv(F.substr(raw, i + 1, F.lit(4)), 16, 10).cast("long")))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def folder_name(key: Column) -> Column:
    """A key's folder: ``t`` and its hash in base 36."""
    return F.concat(F.lit("t"), F.lower(F.conv(fnv1a(key).cast("string"), 10, 36)))


def page_of_sprite(path: Column) -> Column:
    """The page, from 0, in names like ``p012.b3.png``; null in others."""
    return F.regexp_extract(path, r"p(\d+)\.", 1).try_cast("int") - 1


def page_id(index: Column) -> Column:
    return F.format_string("p%03d", index + 1)


def eta_text(ms: Column) -> Column:
    """Minutes and seconds left, at least one second."""
    seconds = F.greatest(F.floor(ms / 1000 + 0.5), F.lit(1))
    return F.when(seconds < 60, F.format_string("%d s", seconds)).otherwise(F.format_string("%d min %d s", F.floor(seconds / 60), seconds % 60))


def is_stale(message: Column) -> Column:
    """Errors of a program whose parts have been replaced meanwhile."""
    return message.rlike("(?i)" + "|".join(STALE_MESSAGES))
