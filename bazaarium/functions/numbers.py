"""Numbers out of text: prices, ratings, counts, dates, and attributes mined from titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_number(text: Column) -> Column:
    """First number of a text, with a comma or a point; null without one."""
    return F.replace(F.regexp_extract(text, r"-?\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")


def digits_price(text: Column) -> Column:
    """All digits of a text as a price: ``38 112 ₽`` is 38112."""
    return F.regexp_replace(text, r"\D", "").try_cast("decimal(12,2)")


def decimal_price(text: Column) -> Column:
    """Price with a comma or a point and anything around the digits; null if none."""
    return F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[^\d.]", "").try_cast("decimal(12,2)")


def comma_number(text: Column, kind: str = "double") -> Column:
    """A number whose comma may stand for the point; null if it is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double").try_cast(kind)


def ruble_price(text: Column) -> Column:
    """Whole units of the first ruble price in a card's text."""
    found = F.regexp_extract(text, r"(?U)(\d{1,3}(?:[ \s]\d{3})*(?:,\d+)?)\s*₽", 1)
    return F.regexp_replace(F.split_part(found, F.lit(","), F.lit(1)), r"(?U)\s", "").try_cast("long")


def card_rating(text: Column) -> Column:
    """Rating before its bracketed count: ``4,7 (1,2 тыс)`` is 4.7."""
    return F.replace(F.regexp_extract(text, r"(\d[.,]\d)\s*\([^)]+\)", 1), F.lit(","), F.lit(".")).try_cast("double")


def card_reviews(text: Column) -> Column:
    """Count in brackets after the rating, thousands told by тыс, тысяч or k."""
    inside = F.regexp_extract(text, r"\d[.,]\d\s*\(([^)]+)\)", 1)
    n = F.replace(F.regexp_extract(inside, r"\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")
    return F.round(n * F.when(inside.rlike(r"\d\s*(тыс|тысяч|k|K)"), 1000).otherwise(1)).cast("long")


def discount_pct(price: Column, original: Column) -> Column:
    """Discount against the original price in whole percent."""
    return F.when(original > 0, F.round(F.lit(100.0) * (original - price) / original).cast("int"))


def review_time(raw: Column) -> Column:
    """Seconds since 1970 of a date that is seconds, milliseconds or an ISO text; null if it is none."""
    number = raw.try_cast("double")
    stamp = F.when(number > 1e9, F.when(number < 1e12, number).otherwise(number / 1000))
    return F.coalesce(stamp, F.try_to_timestamp(raw).cast("double"))


# Brands and beginnings of colours looked for in titles.
TITLE_BRANDS = (
    "Apple", "Samsung", "Xiaomi", "Huawei", "Sony", "JBL", "Marshall", "Bose", "LG", "Asus", "Lenovo", "HP", "Dell", "Acer", "MSI",
    "Logitech", "Razer", "Beats", "Sennheiser", "AKG", "Realme", "Honor", "Nothing", "OPPO", "Vivo", "TCL", "Philips", "Bosch",
    "Siemens", "Indesit", "Электролюкс", "Bork", "Tefal", "Polaris", "Redmond", "Kitfort", "Braun", "Moulinex", "Krups",
    r"De\s?Longhi", "Smeg", "Garmin", "Fitbit", "Anker", "Baseus", "Hoco", "Belkin", r"Western\s?Digital", "Seagate", "Kingston",
    "Sandisk", "ADATA", "Crucial", "Gigabyte", "ASRock", r"Cooler\s?Master", "NZXT", "Corsair", "Thermaltake", "Intel", "AMD",
    "NVIDIA", "Microsoft", "Google", "Pioneer", "Yamaha",
)
TITLE_COLOURS = (
    "чёрн", "черн", "бел", "сер", "серебр", "голуб", "син", "зелён", "зелен", "красн", "розов", "жёлт", "желт", "оранжев",
    "фиолетов", "пурпурн", "золот", "graphite", "titanium", "black", "white", "silver", "blue", "green", "red", "pink", "yellow",
    "orange", "purple", "gold", "natural", "midnight", "starlight",
)


def title_attributes(title: Column, text: Column) -> Column:
    """Map of what a card's title and text say: mark, condition, usual price, discount, delivery, stock, shops, brand,
    memory, RAM, diagonal, colour and SIM; keys without a find are left out."""
    def take(source: Column, pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(source, "(?iu)" + pattern, group)

    usual = F.regexp_replace(take(text, r"Обычно\s+(\d{1,3}(?:[ \s]\d{3})*)\s*₽"), r"(?U)\s", "").try_cast("long")
    cut = discount_pct(ruble_price(text), usual)
    terabytes, gigabytes = take(title, r"(\d(?:[.,]\d)?)\s*(?:ТБ|TB|T(?![\p{L}\d]))"), take(title, r"(\d{2,4})\s*(?:ГБ|GB|G(?![\p{L}\d]))")

    def unit(value: Column, name: str) -> Column:
        return F.when(value != "", F.concat(F.replace(value, F.lit(","), F.lit(".")), F.lit(name)))

    colour = F.concat_ws(" ", title, F.array_join(F.slice(F.split(text, "\n"), 1, 4), " "))
    found = {
        "Метка": F.when(text.rlike("(?iu)НИЗКАЯ ЦЕНА"), "Низкая цена"),
        "Состояние": F.when(F.concat_ws(" ", text, title).rlike("(?iu)Б/у|восстановленный|refurbished"), "Б/у").otherwise("Новый"),
        "Обычная цена": F.when(usual.isNotNull(), F.concat(F.replace(F.format_number(usual, 0), F.lit(","), F.lit("\u00a0")), F.lit(" ₽"))),
        "Скидка": F.when(cut > 0, F.concat(F.lit("-"), cut.cast("string"), F.lit("%"))),
        "Доставка": F.substring(take(text, r"(Возврат в течение[^\n]+)"), 1, 60),
        "Бесплатная доставка": F.when(text.rlike(r"(?iu)бесплатн[аы]?я\s+доставк"), "да"),
        "Наличие": take(text, r"(в\s+наличии|нет\s+в\s+наличии|под\s+заказ)"),
        "Магазинов": take(text, r"(\d+)\s+магазин"),
        "Бренд": take(title, rf"(?<![\p{{L}}\d])({'|'.join(TITLE_BRANDS)})(?![\p{{L}}\d])"),
        "Память": F.coalesce(unit(terabytes, " ТБ"), unit(gigabytes, " ГБ")),
        "ОЗУ": unit(take(title, r"(\d{1,2})\s*(?:ГБ|GB)\s*(?:ОЗУ|RAM|оперативн)"), " ГБ"),
        "Диагональ": unit(take(title, r"(\d{1,2}(?:[.,]\d)?)\s*(?:['\"″]|дюйм|inch)"), "''"),
        "Цвет": F.lower(take(colour, rf"(?<![\p{{L}}\d])((?:{'|'.join(TITLE_COLOURS)})[а-яёa-z]*)")),
        "SIM": take(title, r"(?<![\p{L}\d])(eSIM|nano[- ]?SIM|dual[- ]?SIM|SIM\+eSIM)(?![\p{L}\d])"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))
