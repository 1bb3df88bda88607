"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import once


def path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def is_event_detail(url: Column) -> Column:
    """A numbered page below /event/, neither a category nor a list page; what is not a URL is not one."""
    p = path(url)
    return F.coalesce(p.contains("/event/") & ~p.contains("/event_cat/") & ~p.contains("/event/page/") & ~p.endswith("/event/") & p.rlike(r"/\d+/?$"), F.lit(False))


# Paths of detail pages of some sources, and what is none.
DETAIL_PATHS = {
    "named": (r"/event/event-[^/]+", None),
    "folder": (r"07event", r"#|^mailto:|^tel:|index\.html?$"),
    "museum": (r"/(?:detail|exhibition)/", None),
    "numbered": (r"/event/\d+", r"/feed/?$|/date/"),
}


def is_detail(url: Column, kind: str) -> Column:
    """Whether a URL is a detail page of a kind of source."""
    yes, no = DETAIL_PATHS[kind]
    out = url.rlike(yes)
    return F.coalesce(out & ~url.rlike(no) if no else out, F.lit(False))


def month_url(url: Column, host: str) -> Column:
    """``https://host/YYYY/MM/`` of a URL whose path is exactly a year and a month, null otherwise."""
    p = F.coalesce(path(url), F.regexp_extract(url, r"^(/[^?#]*)", 1))
    y, m = (F.regexp_extract(p, r"^(?:/event)?/(\d{4})/(\d{1,2})/?$", i) for i in (1, 2))
    return F.when(y != "", F.concat(F.lit(f"https://{host}/"), y, F.lit("/"), F.lpad(m, 2, "0"), F.lit("/")))


def month_page(url: Column) -> Column:
    """``struct(url, month)`` of the page of a month's events, ``/event/date/YYYY/M/`` below its host without query and
    fragment, and the first of that month; null for all other URLs."""
    host = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    y, m = (F.regexp_extract(path(url), r"^/event/date/(\d{4})/(\d{1,2})/?$", i) for i in (1, 2))
    first = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lit("01")), "yyyy-MM-dd")
    return F.when(first.isNotNull(), F.struct(F.concat(host, F.lit("/event/date/"), y, F.lit("/"), F.lpad(m, 2, "0"), F.lit("/")).alias("url"), first.alias("month")))


def normalise(url: Column) -> Column:
    """Without fragment, query and trailing slash; host in lower case."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    host = F.regexp_extract(bare, r"^([a-z]+://[^/]+)", 1)
    return F.regexp_replace(F.concat(F.lower(host), F.substr(bare, F.length(host) + 1)), "/$", "")


def public_url(file_path: Column, base: str) -> Column:
    """A file's public address; index.html stands for its folder."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(F.regexp_replace(file_path, "^/", ""), "(^|/)index\\.html$", "$1"))


def category(p: Column) -> Column:
    return F.when(p.startswith("date/"), "date").when(p.startswith("spot/"), "spot").when(p.startswith("facility/") | p.startswith("facility-name/"), "facility").otherwise("other")


def prefix_join(url: Column, base: str) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(base), url))


def month_of(url: Column) -> Column:
    """``struct(year, month)`` from /YYYY/M/ or YYYY-MM in a URL."""
    y, m = (F.regexp_extract(url, r"(\d{4})[/-](\d{1,2})(?:/|$|\D)", i) for i in (1, 2))
    return F.when(y != "", F.struct(y.cast("int").alias("year"), m.cast("int").alias("month")))


# Signs that a browser leaves as they are, and a form does not.
LEFT_ALONE = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def encode_component(text: Column) -> Column:
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, sign in LEFT_ALONE.items():
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def maps_link(lat: Column, lng: Column, name: Column) -> Column:
    at = F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), lat.cast("string"), F.lit(","), lng.cast("string"))
    by_name = F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), encode_component(name))
    return F.when(lat.isNotNull() & lng.isNotNull(), at).otherwise(by_name)


def resolve(url: Column, base: Column) -> Column:
    """Addresses against that of the page they stand on, which has a scheme and a host; null without either.

    Addresses with a scheme stay as they are; an empty one is the page's own; what is relative loses its dots.
    """
    part = lambda of, pattern, name, i=1: F.regexp_extract(of, pattern, i).alias(name)
    place, pieces = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)([^?#]*)(\?[^#]+)?", r"^([^?#]*)(\?[^#]*)?(#.*)?$"
    absolute = lambda u: u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")

    def parts(u: Column, b: Column) -> Column:
        origin = [part(b, place, name, i) for i, name in ((1, "origin"), (2, "path"), (3, "query"))]
        return F.struct(*origin, *(part(u, pieces, name, i) for i, name in ((1, "to"), (2, "asked"), (3, "fragment"))))

    def whole(x: Column) -> Column:
        query, fragment = (F.when(F.length(x[c]) > 1, x[c]).otherwise("") for c in ("asked", "fragment"))
        folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(x["path"], "[^/]*$", ""), "^/", ""))
        steps = F.split(F.when(x["to"].startswith("/"), x["to"]).otherwise(F.regexp_replace(F.concat(folder, x["to"]), "/{2,}", "/")), "/")
        up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))  # noqa: E731  never above the root
        walk = lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
        walked = once(steps, lambda s: F.array_join(F.aggregate(F.slice(s, 2, 1 << 30), F.array(F.get(s, 0)), walk), "/"))
        full = once(walked, lambda w: F.concat(w, F.when((w == "") | (x["to"].rlike(r"(^|/)\.{1,2}$") & ~w.endswith("/")), "/").otherwise("")))
        same_page = F.concat(x["origin"], x["path"], F.coalesce(F.when(query != "", query), x["query"]), fragment)
        return F.when(x["to"] == "", same_page).otherwise(F.concat(x["origin"], full, query, fragment))

    def joined(u: Column, b: Column) -> Column:
        scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
        below = once(parts(u, b), lambda x: F.when(x["origin"] != "", F.when(u == "", b).when(u.startswith("//"), F.concat(scheme, u)).otherwise(whole(x))))
        return F.when(b.isNotNull(), F.when(absolute(u), u).otherwise(below))

    return once(F.struct(url.alias("u"), base.alias("b")), lambda x: joined(x["u"], x["b"]))


def spot_id(url: Column) -> Column:
    """The spot that an address means: its parameter spot_id, else the segment after /spot/ at the start of its path; '' if
    neither is there."""
    asked = F.regexp_extract(url, r"^[^#]*?[?&]spot_id=([^&#]*)", 1)
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?/+spot/+([^/?#]+)", 1)
    return F.coalesce(F.nullif(F.try_url_decode(asked), F.lit("")), path)
