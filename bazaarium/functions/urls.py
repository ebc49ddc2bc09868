"""Links: hosts, storage shards, link builders, region parameters and cache keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarium import values as V


def host(url: Column) -> Column:
    """Host of a link in lower case; null if it is no link."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def below(h: Column, names: tuple[str, ...]) -> Column:
    """Whether a host is one of ``names`` or lies below one; false for null.  The host stands in it once, so it is found once a row."""
    return F.coalesce(h.rlike(rf"(^|\.)({'|'.join(re.escape(n) for n in names)})\z"), F.lit(False))


def excluded_host(url: Column) -> Column:
    """Whether the host is one that other sources cover, or lies below one."""
    return below(host(url), V.EXCLUDED_HOSTS)


def shard(nm_id: Column) -> Column:
    """Two-digit storage shard of an article: the first whose last volume is not below, and beyond the table one for each step."""
    volume = F.floor(nm_id / 100_000).cast("long")
    bounds = F.array(*[F.lit(v).cast("long") for v in V.SHARD_VOLUMES])
    inside = F.size(F.filter(bounds, lambda b: b < volume)) + 1
    last = V.SHARD_VOLUMES[-1]
    beyond = len(V.SHARD_VOLUMES) + 1 + F.floor((volume - last) / V.SHARD_STEP)
    number = F.when(volume <= last, inside.cast("long")).otherwise(beyond.cast("long"))
    return F.lpad(number.cast("string"), F.greatest(F.lit(2), F.length(number.cast("string"))), F.lit("0"))


def _basket(nm_id: Column, at: Column | None = None) -> Column:
    base = F.concat(F.lit("https://basket-"), at if at is not None else shard(nm_id), F.lit(".wbbasket.ru/vol"))
    return F.concat(base, F.floor(nm_id / 100_000).cast("string"), F.lit("/part"), F.floor(nm_id / 1000).cast("string"), F.lit("/"), nm_id.cast("string"))


def card_url(nm_id: Column, at: Column | None = None) -> Column:
    """Where an article's card is kept."""
    return F.concat(_basket(nm_id, at), F.lit("/info/ru/card.json"))


def image_url(nm_id: Column, number: int = 1, size: str = "big", at: Column | None = None) -> Column:
    """Where an article's picture is kept."""
    return F.concat(_basket(nm_id, at), F.lit(f"/images/{size}/{number}.webp"))


def history_url(nm_id: Column) -> Column:
    """Where an article's price history is kept."""
    return F.concat(_basket(nm_id), F.lit("/info/price-history.json"))


def _crc_of(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (byte & 1) * 0xA001
    return byte


#: CRC-16 of each byte.
_CRC = [_crc_of(n) for n in range(256)]


def crc16(value: Column) -> Column:
    """CRC-16 (reflected 0xA001, start 0) of the 8 little-endian bytes of a long, a byte at a time by table."""
    table = F.lit(_CRC)

    def fold(crc: Column, i: Column) -> Column:
        low = crc.bitwiseXOR(F.call_function("shiftrightunsigned", value, (i * 8).cast("int"))).bitwiseAND(255)
        return F.shiftright(crc, 8).bitwiseXOR(F.get(table, low.cast("int")).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), fold)


def feedback_shard(imt_id: Column) -> Column:
    """1 or 2: which host keeps the reviews of a card."""
    return F.when(crc16(imt_id.cast("long")) % 100 >= 50, 2).otherwise(1)


def with_region(url: Column, region: Column) -> Column:
    """The link with its ``lr`` parameter set where it stands, or put last."""
    value = region.cast("string")
    replaced = F.regexp_replace(url, F.lit(r"([?&]lr=)[^&#]*"), F.concat(F.lit("$1"), value))
    joined = F.concat(url, F.when(F.contains(url, F.lit("?")), "&lr=").otherwise("?lr="), value)
    return F.when(url.rlike(r"[?&]lr="), replaced).otherwise(joined)


def geo_query(query: Column, region: Column) -> Column:
    """The query with the city where to buy, for regions that have one."""
    cities = F.create_map(*[F.lit(x) for k, v in V.REGION_CITIES.items() for x in (k, v)])
    city = F.try_element_at(cities, region.cast("int"))
    return F.when(city.isNull(), query).otherwise(F.concat(query, F.lit(" купить в "), city))


def seller_link(seller: Column, query: Column) -> Column:
    """A shop's search page for a query: by a known part of its name, or by its domain; null if neither is known."""
    q, low = F.url_encode(F.trim(query)), F.lower(F.trim(seller))
    out = F.lit(None).cast("string")
    bare = F.ltrim(F.trim(seller), F.lit("@"))
    domain = bare.rlike(r"(?i)^[a-z0-9][a-z0-9\-]+(\.[a-z]{2,})+$")
    out = F.when(domain, F.concat(F.lit("https://"), bare, F.replace(F.lit(V.GENERIC_SEARCH), F.lit("{q}"), q)))
    for part, page in reversed(V.SHOPS):
        out = F.when(F.contains(low, F.lit(part)), F.replace(F.lit(page), F.lit("{q}"), q)).otherwise(out)
    return out


def item_id(source: Column, url: Column) -> Column:
    """Article number of a catalogue link where the source has them, else the link itself."""
    number = F.regexp_extract(url, r"catalog/(\d+)", 1)
    return F.when((source == "wb") & (number != ""), number).otherwise(url)


def absolute_image(url: Column, base: str = "https:") -> Column:
    """A picture's link with its scheme; null if it is no link."""
    trimmed = F.trim(url)
    return F.when(F.startswith(trimmed, F.lit("//")), F.concat(F.lit(base), trimmed)).when(trimmed.rlike("^https?://"), trimmed)


def cache_key(*parts: Column) -> Column:
    """SHA-1 of the parts joined by ``|``."""
    return F.sha1(F.concat_ws("|", *parts))


def owner_key(user: Column, anonymous: Column) -> Column:
    """Who owns a watch: a user, or an anonymous key of 8 to 128 characters; null if neither."""
    ok = F.length(anonymous).between(8, 128)
    return F.when(user.isNotNull(), F.concat(F.lit("user-"), user)).when(ok, F.concat(F.lit("anon-"), anonymous))


def _feedback_host(key: Column, name: str) -> Column:
    number = F.lpad(F.split(key, "/", 2)[0], 2, "0")
    return F.concat(F.lit(f"https://{name}"), number, F.lit(".wbbasket.ru/"), F.split(key, "/", 2)[1])


def feedback_photo(key: Column) -> Column:
    """struct(mini, full, jpg) of the links to a review's photo kept under ``shard/name``."""
    base = _feedback_host(key, "feedback-")
    return F.struct(*[F.concat(base, F.lit(f"/{file}")).alias(k) for k, file in (("mini", "ms.webp"), ("full", "fs.webp"), ("jpg", "fs.jpg"))])


def feedback_video(key: Column) -> Column:
    """struct(preview, hls) of the links to a review's video kept under ``shard/name``."""
    base = _feedback_host(key, "videofeedback")
    return F.struct(F.concat(base, F.lit("/preview.webp")).alias("preview"), F.concat(base, F.lit("/index.m3u8")).alias("hls"))


def allowed_host(host: Column, suffixes: tuple[str, ...] = V.IMAGE_HOSTS) -> Column:
    """Whether a host is one of those that pictures may come from, or below one."""
    return below(F.lower(host), suffixes)
