"""URLs: hosts, images and their renditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import patterns as P
from shelfmark.functions.binding import let
from shelfmark.functions.text import strip


def domain_of(url: Column) -> Column:
    """The host without ``www.``; of what is no URL, the part before the first slash."""
    host = F.try_parse_url(url, F.lit("HOST"))
    rough = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"^www\.", "")
    return F.coalesce(F.regexp_replace(F.lower(host), r"^www\.", ""), F.split_part(rough, F.lit("/"), F.lit(1)))


def is_image_url(url: Column) -> Column:
    """Whether a string is the address of an image; ``data:`` URIs are not."""

    def fits(u: Column) -> Column:
        low = F.lower(u)
        shaped = u.rlike(P.IMAGE_EXTENSION) | low.contains("/image") | low.contains("/img") | low.contains("cdn")
        return (F.length(u) >= 8) & (u.startswith("http") | u.startswith("//")) & shaped

    return let(url, fits)


def is_video_url(url: Column) -> Column:
    return (F.length(url) > 8) & (F.length(url) < 2000) & (url.startswith("http") | url.startswith("//")) & url.rlike(P.VIDEO_EXTENSION)


def absolute(url: Column, base: Column | None = None) -> Column:
    """``//host`` with a scheme and, given a base, relative addresses resolved against it."""
    return let(strip(url), lambda plain: _absolute(plain, base))


def _absolute(plain: Column, base: Column | None) -> Column:
    out = F.when(plain.startswith("//"), F.concat(F.lit("https:"), plain))
    if base is not None:
        origin = F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://[^/?#]*", 0)
        folder = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
        folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
        relative = ~plain.rlike(r"^[a-zA-Z][\w+.-]*:") & ~plain.startswith("http") & (base != "")
        joined = (
            F.when(plain == "", base).when(plain.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), plain)).when(plain.startswith("?"), F.concat(F.regexp_extract(base, "^[^?#]*", 0), plain))
            .when(plain.startswith("/"), F.concat(origin, plain)).otherwise(F.concat(folder, plain))
        )
        out = out.when(relative, let(joined, lambda url: F.when(url.rlike(_DOTS), _without_dots(url)).otherwise(url)))
    return out.otherwise(plain)


_DOTS = r"^[^?#]*/\.\.?(?:/|$|[?#])"


def _without_dots(url: Column) -> Column:
    """A URL whose path has no ``.`` and ``..`` segments; what leads above the root is dropped."""
    origin = F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*", 0)
    path, rest = F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"[?#].*$", 0)

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    tail = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(origin, F.lit("/"), F.array_join(kept, "/"), tail, rest)


def split_srcset(value: Column) -> Column:
    """The addresses of a ``srcset``-shaped string, or the string itself."""
    many = (F.length(value) - F.length(F.replace(value, F.lit("http"), F.lit("")))) / 4 > 1
    listed = F.filter(F.transform(F.split(value, ","), lambda p: F.regexp_extract(strip(p), rf"\A[^{P.WS}]+", 0)), lambda p: p != "")
    return F.when(many | value.rlike(rf"[{P.WS}]\d+[wx][{P.WS}]*(?:,|$)"), listed).otherwise(F.array(value))


def dimensions(url: Column) -> Column:
    """The largest pixel number that a URL itself states, 0 without one."""
    found = F.concat(
        F.regexp_extract_all(url, F.lit(r"[?&](?:w|wid|width|hei|height|sz)=(\d{2,5})"), F.lit(1)),
        *[F.regexp_extract_all(url, F.lit(r"/(\d{3,5})x(\d{3,5})/"), F.lit(g)) for g in (1, 2)],
        *[F.regexp_extract_all(url, F.lit(r"[-_](\d{3,5})x(\d{1,5})(?:\.|$|[-_])"), F.lit(g)) for g in (1, 2)],
    )
    # One search settles the many URLs without any such number.
    return F.when(url.rlike(r"=\d\d|\dx\d"), F.coalesce(F.array_max(F.transform(found, lambda x: x.cast("int"))), F.lit(0))).otherwise(0)


def identity_key(url: Column) -> Column:
    """One key for all renditions of an image."""
    return let(F.split_part(url, F.lit("?"), F.lit(1)), _key_of_path)


def _key_of_path(path: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(path, P.RENDITION_SUFFIX, ""), P.RENDITION_WORD, "")
    return F.when(path.rlike(P.ASSET_UUID), F.concat_ws("/", F.regexp_extract(path, P.ASSET_UUID, 1), F.regexp_extract(path, P.ASSET_UUID, 2))).otherwise(plain)


def identity_tokens(url: Column) -> Column:
    """Path segments with a digit, distinct, eight at most."""
    parts = F.split(F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", ""), "/")
    kept = F.filter(parts, lambda s: s.rlike(r"\d") & ~F.lower(s).isin("p", "product", "products"))
    return F.slice(F.array_distinct(kept), 1, 8)


def _in(word: Column, words: tuple[str, ...]) -> Column:
    return F.lower(word).isin(*words)


def path_tokens(path: Column) -> Column:
    """``media[0].sources.max`` as ``media``, ``[0]``, ``sources``, ``max``."""
    return F.regexp_extract_all(path, F.lit(r"([^.\[\]]+|\[\d+\])"), F.lit(1))


_RENDITION_END = r"(?i)(?:(?:^|\.|(?<=\]))(?:" + "|".join((*P.LADDER, *P.CONTAINERS)) + r")(?:\[\d+\])?)+$"


def asset_boundary(path: Column) -> Column:
    """The list element that is one asset, without what only names its renditions; null without one.

    Trailing rendition words go, and so does an index right after such a word.
    """
    return let(F.regexp_replace(path, _RENDITION_END, ""), lambda p: F.when(p.rlike(r"\[\d+\]$"), p))


def container_of(path: Column) -> Column:
    return F.regexp_replace(asset_boundary(path), r"\[\d+\]$", "")


_UNNAMED_END = r"(?i)(?:(?<![^.\[\]])(?:\d+|" + "|".join(w for w in P.CONTAINERS if w not in P.CROPS and w not in P.LADDER) + r")(?:[.\[\]]+|\z))+\z"


def ladder_rank(path: Column) -> Column:
    """Place of the last size word in the ladder of renditions; -1 for crops and without one.

    Numbers and container words at the end say nothing; the last other word decides.
    """
    rungs = F.array(*[F.lit(w) for w in P.LADDER])
    last = F.lower(F.regexp_extract(F.regexp_replace(path, _UNNAMED_END, ""), r"([^.\[\]]+)[.\[\]]*\z", 1))
    return let(last, lambda w: F.when(w.isNull() | w.isin(*P.CROPS), -1).otherwise(F.array_position(rungs, w).cast("int") - 1))
