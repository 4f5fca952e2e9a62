"""URL columns: canonical form, hosts, kinds, keys and links in pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and hosts of a kind.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_name", "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "referrer", "source", "output"]
AGGREGATORS = ["news.google.com", "google.com", "googleusercontent.com", "gstatic.com"]
SOCIAL = ["facebook.com", "fb.com", "fbcdn.net", "x.com", "twitter.com", "twimg.com", "youtube.com", "youtu.be", "tiktok.com", "instagram.com", "telegram.me", "t.me"]
TRACKERS = ["doubleclick.net", "google-analytics.com", "googletagmanager.com", "scorecardresearch.com"]
VIDEO_SUFFIXES = ["mp4", "webm", "mov", "m4v"]
ASSET_SUFFIXES = ["jpg", "jpeg", "png", "gif", "webp", "svg", "css", "js", "ico", "woff2"]


def scheme(url: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")), F.lit("https")))


def _rest(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")


def host(url: Column) -> Column:
    """Lower-case host without user, port and a leading www."""
    net = F.lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(net, r"^.*@", ""), r":[0-9]*$", ""), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """Lower scheme and host, no www, no closing slash but the root's, tracking parameters out, the rest sorted, no fragment."""
    names = F.array(*[F.lit(t) for t in tracking])
    kept = F.array_sort(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.array_contains(names, F.lower(F.substring_index(p, "=", 1)))))
    trimmed = F.regexp_replace(path(url), "/+$", "")
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(trimmed == "", "/").otherwise(trimmed), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def host_in(url_host: Column, hosts: Sequence[str]) -> Column:
    """Whether a host is one of the hosts or below one of them."""
    return F.exists(F.array(*[F.lit(h) for h in hosts]).cast("array<string>"), lambda h: (url_host == h) | url_host.endswith(F.concat(F.lit("."), h)))


def host_suffixes(url_host: Column) -> Column:
    parts = F.split(url_host, r"\.")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))


def suffix(url: Column) -> Column:
    """The file name's ending; a link without a host is all path."""
    place = F.when(url.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//"), path(url)).otherwise(F.regexp_replace(url, "[?#].*$", ""))
    return F.lower(F.regexp_extract(place, r"\.([A-Za-z0-9]{1,5})$", 1))


def kinds(url: Column) -> Column:
    """struct of flags: aggregator, social, tracker, video, stream, asset."""
    h = host(url)
    return F.struct(
        host_in(h, AGGREGATORS).alias("aggregator"), host_in(h, SOCIAL).alias("social"), host_in(h, TRACKERS).alias("tracker"),
        suffix(url).isin(*VIDEO_SUFFIXES).alias("video"), (suffix(url) == "m3u8").alias("stream"), suffix(url).isin(*ASSET_SUFFIXES).alias("asset"),
    )


def absolute(link: Column, base: Column) -> Column:
    """A link made absolute by its page's URL; './' and '../' steps are resolved for up to four levels."""
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(_rest(base), r"^([^/?#]*)", 1))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), link)
    for _ in range(4):
        joined = F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"/[^/.][^/]*/\.\./", "/")
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link)).when(link == "", base).otherwise(F.concat(root, joined))


def history_key(title: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(F.trim(F.regexp_replace(title, r"(?U)\s+", " "))), canonical(url)), 256)


def candidate_id(ids: Sequence[Column], links: Sequence[Column]) -> Column:
    """The first non-empty id, else the last path segment of the first non-empty link without .html."""
    given = [F.nullif(F.trim(c), F.lit("")) for c in ids]
    cut = [F.nullif(F.regexp_replace(F.regexp_extract(path(c), r"([^/]+)/*$", 1), r"\.html?$", ""), F.lit("")) for c in links]
    return F.coalesce(*given, *cut)


def page_links(html: Column) -> Column:
    """Links of a page in the order in which a publisher's own address is looked for: canonical, og:url, twitter:url, anchors."""
    one = lambda p: F.regexp_extract_all(html, F.lit(p), F.lit(1))
    return F.concat(
        one(r"""(?is)<link[^>]+rel=["']canonical["'][^>]*href=["']([^"']+)["']"""),
        one(r"""(?is)<meta[^>]+(?:property|name)=["']og:url["'][^>]*content=["']([^"']+)["']"""),
        one(r"""(?is)<meta[^>]+(?:property|name)=["']twitter:url["'][^>]*content=["']([^"']+)["']"""),
        one(r"""(?is)<a\b[^>]*href=["']([^"'#][^"']*)["']"""),
    )


def publisher_link(html: Column, page_url: Column) -> Column:
    """The first link of a page that is no aggregator, social or tracker address, made absolute."""
    ok = lambda u: ~host_in(host(u), AGGREGATORS) & ~host_in(host(u), SOCIAL) & ~host_in(host(u), TRACKERS)
    return F.get(F.filter(F.transform(page_links(html), lambda u: absolute(u, page_url)), ok), 0)


def image_link(html: Column) -> Column:
    """og:image, then twitter:image, then the first image of 500 by 300 or more, then the first image."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    src = lambda t: F.regexp_extract(t, r"""(?is)\bsrc=["']([^"']+)["']""", 1)
    size = lambda t, k: F.coalesce(F.regexp_extract(t, rf"""(?is)\b{k}=["']?([0-9]{{1,5}})""", 1).try_cast("int"), F.lit(0))
    large = F.filter(tags, lambda t: (size(t, "width") >= 500) | (size(t, "height") >= 300))
    metas = [F.nullif(F.regexp_extract(html, rf"""(?is)<meta[^>]+(?:property|name)=["']{k}["'][^>]*content=["']([^"']+)["']""", 1), F.lit("")) for k in ("og:image", "og:image:secure_url", "og:image:url", "twitter:image", "twitter:image:src")]
    return F.coalesce(*metas, F.get(F.transform(large, src), 0), F.get(F.transform(tags, src), 0))


def video_link(html: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (r"""(?is)<meta[^>]+property=["']og:video(?::url|:secure_url)?["'][^>]*content=["']([^"']+)["']""", r"""(?is)<(?:video|source)\b[^>]*src=["']([^"']+)["']""", r'"(?:contentUrl|embedUrl)"\s*:\s*"([^"]+)"')])
    return F.get(F.filter(found, lambda u: suffix(u).isin(*VIDEO_SUFFIXES, "m3u8")), 0)
