"""Links: normal form, publisher by domain, date in the path, identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track (fixed values).
TRACKING = "^(utm_.*|fbclid)$"
#: Named character references (fixed values); numeric ones are decoded by their number.
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


def unescape(text: Column) -> Column:
    """Character references, named or numeric, replaced in one pass."""

    def decoded(piece: Column) -> Column:
        head = F.regexp_extract(piece, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-z]{2,4});", 1)
        rest = F.substr(piece, F.length(head) + 2)
        code = F.when(head.rlike("^#[0-9]"), F.substr(head, F.lit(2)).cast("int")).when(head.rlike("^#[xX]"), F.conv(F.substr(head, F.lit(3)), 16, 10).cast("int"))
        known = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))
        for name, character in REFERENCES.items():
            known = F.coalesce(known, F.when(head == name, character))
        return F.coalesce(F.concat(known, rest), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), decoded), ""))


def form_encoded(text: Column) -> Column:
    """A name or value of a query, decoded and encoded again: blanks as +, unreserved characters as they are."""
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_link(link: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters; the other parameters in order, encoded anew."""
    plain = unescape(link)
    address = F.regexp_replace(plain, "(?s)#.*$", "")
    head = F.regexp_extract(address, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substr(address, F.length(head) + 1)
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p: F.struct(form_encoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("n"), form_encoded(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    kept = F.filter(named, lambda p: ~F.lower(p["n"]).rlike(TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["n"], F.lit("="), p["v"])), "&")
    whole = F.concat(F.lower(head), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.contains(plain, F.lit("://")), whole).otherwise(plain)


def host(link: Column) -> Column:
    """Host in lower case without a port."""
    return F.lower(F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def url_date(link: Column) -> Column:
    """ISO date from /yyyy/mm/dd/ or yyyy-mm-dd in a link; null without one."""
    slashed = F.regexp_extract(link, r"/((?:19|20)\d\d)/(\d\d)/(\d\d)(?:/|$)", 0)
    dashed = F.regexp_extract(link, r"((?:19|20)\d\d-\d\d-\d\d)", 1)
    return F.when(slashed != "", F.replace(F.substring(slashed, 2, 10), F.lit("/"), F.lit("-"))).when(dashed != "", dashed)


def short_id(prefix: str, basis: Column, digits: int = 16) -> Column:
    """Prefix and the first digits of the SHA-256 of the basis."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(basis, 256), 1, digits))
