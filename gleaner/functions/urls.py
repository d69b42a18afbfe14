"""URL canonicalization: as a Column for tables of absolute URLs, and for single URLs with a base.

Scheme and host are lower-cased, default ports and trailing dots dropped, unreserved percent-escapes decoded and the others
upper-cased, dot segments removed, trailing slashes stripped but for the root, tracking parameters dropped, the rest of the
query sorted, the fragment dropped. http and https, and hosts with and without www, stay apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that name a campaign or a click, and the ports that schemes imply.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "gclsrc", "dclid", "fbclid",
    "msclkid", "mc_cid", "mc_eid", "yclid", "igshid", "ref", "ref_src", "_ga",
)
PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")
_UNRESERVED = re.compile(r"[A-Za-z0-9._~-]")
#: 1 scheme, 2 whether there is an authority, 3 authority, 4 path, 5 query
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


# -- single URLs --


def _authority(netloc: str, scheme: str) -> str:
    user, at, place = netloc.rpartition("@")
    if place.startswith("["):
        host, _, rest = place.partition("]")
        host, port = host.lower() + ("]" if "]" in place else ""), rest[1:] if rest.startswith(":") else ""
    else:
        host, _, port = place.rpartition(":") if ":" in place else (place, "", "")
        host = host.lower().rstrip(".")
    return user + at + host + (f":{port}" if port and port != PORTS.get(scheme) else "")


def _path(path: str) -> str:
    def escape(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if _UNRESERVED.fullmatch(c) else m[0].upper()

    pieces = [p for p in re.findall(r"/?[^/]*", _ESCAPE.sub(escape, path)) if p]
    while pieces and pieces[0] in (".", ".."):  # a relative path that begins with dots
        pieces = pieces[1:]
        if pieces:
            pieces[0] = pieces[0].removeprefix("/")
            pieces = pieces if pieces[0] else pieces[1:]
    kept: list[str] = []
    for i, piece in enumerate(pieces):
        if piece == "/..":
            del kept[-1:]
        if piece in ("/.", "/.."):
            if i == len(pieces) - 1:
                kept.append("/")
        else:
            kept.append(piece)
    return "".join(kept)


def canonicalize(url: str, base: str | None = None) -> str:
    parts = urlsplit((urljoin(base, url) if base else url).strip())
    scheme = parts.scheme.lower()
    netloc = _authority(parts.netloc, scheme)
    path = _path(parts.path)
    path = (path.rstrip("/") or "/") if path else "/" if netloc else ""
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING)
    return urlunsplit((scheme, netloc, path, urlencode(query), ""))


# -- Columns --


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def _authority_column(netloc: Column, scheme: Column) -> Column:
    return F.concat(F.regexp_extract(netloc, r"^(.*@)?", 1), _let(F.regexp_extract(netloc, r"([^@]*)$", 1), lambda p: _place_column(p, scheme)))


def _place_column(place: Column, scheme: Column) -> Column:
    literal = place.startswith("[")
    host = F.when(literal, F.lower(F.regexp_extract(place, r"^\[[^\]]*\]?", 0))).otherwise(F.rtrim(F.lower(F.regexp_extract(place, r"^(.*?)(?::([^:]*))?$", 1)), F.lit(".")))
    port = F.when(literal, F.regexp_extract(place, r"^\[[^\]]*\]:(.*)$", 1)).otherwise(F.regexp_extract(place, r"^(.*?)(?::([^:]*))?$", 2))
    implied = F.lit(None).cast("string")
    for k, v in PORTS.items():
        implied = F.when(scheme == k, v).otherwise(implied)
    return _let(port, lambda port: F.concat(host, F.when((port == "") | F.coalesce(port == implied, F.lit(False)), "").otherwise(F.concat(F.lit(":"), port))))


def _escapes(path: Column) -> Column:
    def one(piece: Column) -> Column:
        code = F.conv(F.substring(piece, 2, 2), 16, 10).cast("int")
        c = F.chr(code)
        return F.when(F.length(piece) == 1, piece).when(c.rlike(r"^[A-Za-z0-9._~-]$"), c).otherwise(F.upper(piece))

    pieces = F.regexp_extract_all(path, F.lit("(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    return F.when(path.contains("%"), F.array_join(F.transform(pieces, one), "")).otherwise(path)


def _dots(path: Column) -> Column:
    """Of an absolute path; a trailing slash may go, as it is stripped anyway."""

    def step(kept: Column, piece: Column) -> Column:
        popped = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(piece == "..", popped).when(piece == ".", kept).otherwise(F.concat(kept, F.array(piece)))

    pieces = F.split(F.substring(path, 2, 2**30), "/")
    kept = F.aggregate(pieces, F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)") & path.startswith("/"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def _query(query: Column) -> Column:
    def decoded(x: Column) -> Column:
        return F.url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"))

    def encoded(x: Column) -> Column:
        return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(decoded(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "(?s)^[^=]*=?(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")


def canonical(url: Column) -> Column:
    """Of an absolute URL. One without an authority keeps its path as it is."""

    def whole(url: Column, scheme: Column, netloc: Column) -> Column:
        head = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""))
        empty = F.when(netloc != "", "/").otherwise("")
        path = _let(
            _let(_let(_part(url, 4), _escapes), _dots),
            lambda p: F.when(p == "", empty).when(p.rlike("^/+$"), "/").otherwise(F.rtrim(p, F.lit("/"))),
        )
        query = _let(_query(_part(url, 5)), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        return F.concat(head, path, query)

    def from_scheme(url: Column, scheme: Column) -> Column:
        return _let(_let(_part(url, 3), lambda n: _authority_column(n, scheme)), lambda n: whole(url, scheme, n))

    return _let(F.trim(url), lambda u: _let(F.lower(_part(u, 1)), lambda s: from_scheme(u, s)))


def resolved(base: Column, reference: Column) -> Column:
    """The reference as an absolute URL, seen from ``base``; dot segments stay for ``canonical``."""
    ref, authority = F.trim(reference), F.when(netloc(base) != "", F.concat(F.lit("//"), netloc(base))).otherwise("")
    site = F.concat(scheme(base), F.lit(":"), authority)
    folder = F.regexp_extract(_part(base, 4), r"^(.*/)?", 0)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref)).when(ref.startswith("/"), F.concat(site, ref))
        .when(ref.startswith("?"), F.concat(site, _part(base, 4), ref)).when((ref == "") | ref.startswith("#"), F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), ref))
    )


def host(url: Column) -> Column:
    """Host of a URL without port, in lower case."""
    place = F.regexp_extract(_part(url, 3), r"([^@]*)$", 1)
    return F.lower(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1)))


def path_and_query(url: Column) -> Column:
    query = _part(url, 5)
    return F.concat(_part(url, 4), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def netloc(url: Column) -> Column:
    return _part(url, 3)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host_allowed(host: Column, allowed: list[str]) -> Column:
    """The host is listed or lies below a listed one; nothing is allowed by an empty list."""
    h = F.lower(F.coalesce(host, F.lit("")))
    out = F.lit(False)
    for a in {a.strip().lower() for a in allowed} - {""}:
        out = out | (h == a) | h.endswith(f".{a}")
    return out & (h != "")
