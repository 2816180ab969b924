"""Articles: links, keys, ages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from hustings.functions.base import col, let, squeeze

#: Query parameters that only track (fixed values): prefixes and whole names.
TRACKING = r"(?i)^(?:utm_|mc_|(?:gclid|fbclid|ref|src)$)"


@pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def strip_html(c, closed: bool = False) -> Column:
    """Tags out, entities as characters, white space squeezed.

    Only texts with an ampersand can hold an entity; the others stay out of Python.
    With ``closed`` an entity needs its semicolon: what a cut text left of one stays.
    """
    bare = F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " ")
    if closed:
        bare = F.regexp_replace(bare, "&(?!(?:[0-9A-Za-z]+|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")
    return squeeze(F.when(F.contains(bare, F.lit("&")), _unescape(bare)).otherwise(bare))


#: Schemes that are written with slashes also where no host follows (fixed values).
SLASHED = (
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu",
    "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
)


def _decoded(c: Column) -> Column:
    """Percent signs and pluses of a query as characters; broken escapes stay as they are."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(c: Column) -> Column:
    """The other way round; letters, digits and ``_.-~`` stay."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(c: Column) -> Column:
    """Parameters in order of name and value, without those that only track."""
    split = lambda p: let(F.instr(p, "="), lambda at: F.when(at > 0, F.array(F.substring(p, F.lit(1), at - 1), F.substring(p, at + 1, F.length(p)))).otherwise(F.array(p, F.lit(""))))
    given = F.transform(F.filter(F.split(c, "&"), lambda p: p != ""), split)
    pairs = F.transform(given, lambda p: F.struct(_decoded(p[0]).alias("k"), _decoded(p[1]).alias("v")))
    kept = F.sort_array(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def canonical_url(c) -> Column:
    """Scheme and host in lower case, parameters sorted and without tracking, no fragment.

    Column functions only.  Control characters and blanks in front, tabs and line ends
    anywhere go; a link whose host has one square bracket without the other stays.
    """
    text = F.regexp_replace(F.regexp_replace(col(c), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    at = lambda n: F.regexp_extract(text, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?", n)
    parts = F.struct(F.lower(at(1)).alias("scheme"), F.lower(at(2)).alias("host"), at(3).alias("path"), F.substring(at(4), 2, 1 << 30).alias("query"))

    def joined(p: Column) -> Column:
        has_host = F.length(p["host"]) > 2
        host = F.when(has_host, p["host"]).when(F.startswith(p["path"], F.lit("//")), "//").when((p["path"] == "") | F.startswith(p["path"], F.lit("/")), F.when(p["scheme"].isin(*SLASHED), "//").otherwise("")).otherwise("")
        query = F.when(p["query"] == "", "").otherwise(_query(p["query"]))
        odd = F.contains(p["host"], F.lit("[")) != F.contains(p["host"], F.lit("]"))
        whole = F.concat(F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""), host, p["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
        return F.when(odd, col(c)).otherwise(whole)

    return F.when(col(c).isNotNull(), let(parts, joined))


def title_key(c) -> Column:
    """A-z and digits of the lower-cased title (nothing of other scripts)."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "")


def dedupe_key(url, title) -> Column:
    """SHA-1 of the canonical link, a bar, and the title's key."""
    return F.sha1(F.concat(canonical_url(url), F.lit("|"), title_key(title)))


def _times32(c: Column, factor: int) -> Column:
    """The last 32 bits of a product; the upper half first, so nothing leaves 64 bits."""
    low = F.lit(0xFFFF)
    upper = (F.shiftright(c, 16) * factor).bitwiseAND(low)
    return (F.shiftleft(upper, 16) + c.bitwiseAND(low) * factor).bitwiseAND(F.lit(0xFFFFFFFF))


def hash53(c) -> Column:
    """A 53-bit hash of a text: two 32-bit values that each UTF-16 unit multiplies, folded at the end."""
    units = F.hex(F.encode(col(c), "UTF-16BE"))
    unit = lambda i: F.conv(F.substring(units, i, F.lit(4)), 16, 10).cast("long")
    start = F.struct(F.lit(0xDEADBEEF).alias("a"), F.lit(0x41C6CE57).alias("b")).cast("struct<a:bigint,b:bigint>")
    step = lambda h, x: F.struct(_times32(h["a"].bitwiseXOR(x), 2654435761).alias("a"), _times32(h["b"].bitwiseXOR(x), 1597334677).alias("b"))
    listed = F.when(units == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(units), F.lit(4)), unit))
    shifted = lambda h, n, factor: _times32(h.bitwiseXOR(F.shiftright(h, n)), factor)
    fold = lambda h, other: shifted(h, 16, 2246822507).bitwiseXOR(shifted(other, 13, 3266489909))
    ends = let(F.aggregate(listed, start, step), lambda h: F.struct(fold(h["a"], h["b"]).alias("a"), h["b"].alias("b")))
    return let(ends, lambda h: F.shiftleft(fold(h["b"], h["a"]).bitwiseAND(F.lit(2097151)), 32) + h["a"])


def article_id(c) -> Column:
    """Stable id of a link, in small hexadecimal digits; null for none."""
    return F.when(col(c) != "", F.concat(F.lit("nr_"), F.lower(F.hex(hash53(c)))))


def safe_href(c) -> Column:
    """The trimmed link if it is http, https or mailto, else null."""
    text = F.trim(col(c))
    return F.when(text.rlike(r"(?i)^(?:https?://|mailto:)\S"), text)


#: Upper bound in seconds, seconds a unit, and name of each age (fixed values).
AGES = ((60, 1, "second"), (3600, 60, "minute"), (86400, 3600, "hour"), (7 * 86400, 86400, "day"), (30 * 86400, 7 * 86400, "week"), (365 * 86400, 30 * 86400, "month"))


def relative_age(c, now) -> Column:
    """(amount, unit, stale) of a time before ``now``; amounts are negative in the past.

    Halves are rounded up, as times ago are counted; null for what is no time.
    """
    at = F.try_to_timestamp(col(c)) if isinstance(c, str) else c
    delta = (F.unix_seconds(at) - F.unix_seconds(col(now))).cast("double")
    amount = lambda unit: F.floor(delta / unit + 0.5)
    value, name = amount(365 * 86400), F.lit("year")
    for bound, unit, label in reversed(AGES):
        inside = F.abs(delta) < bound
        value, name = F.when(inside, amount(unit)).otherwise(value), F.when(inside, F.lit(label)).otherwise(name)
    return F.when(delta.isNotNull(), F.struct(value.alias("amount"), name.alias("unit"), (-delta > 7200).alias("stale")))


def relevance_kind(title, snippet, name, constituency, aliases: Column) -> Column:
    """J21 for one pair: name, constituency, party or loose, the first that holds.

    Words of four letters or more are compared as whole words; aliases as they stand.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(snippet), F.lit(""))))
    words = F.split(text, "[^a-z0-9_]+")

    def mentions(c: Column) -> Column:
        own = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
        return F.arrays_overlap(own, words)

    who = F.regexp_replace(F.coalesce(col(name), F.lit("")), r"\s+[sSwWdD]/[oO]\s+.*$", "")
    seat = F.trim(F.regexp_replace(F.coalesce(col(constituency), F.lit("")), r"\s*\([^)]*\)\s*$", ""))
    return (
        F.when(mentions(who), "name")
        .when(mentions(seat), "constituency")
        .when(F.exists(aliases, lambda a: F.contains(text, a)), "party")
        .otherwise("loose")
    )
