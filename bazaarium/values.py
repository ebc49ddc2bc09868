"""Word lists, tables and thresholds that results depend on."""

from __future__ import annotations

# Sources in their usual order, and how a report names them.
SOURCES = ("wb", "ozon", "ya_market", "runet")
SOURCE_LABELS = {"wb": "Wildberries", "ozon": "Ozon", "ya_market": "Яндекс Маркет", "runet": "Рунет"}

# Cyrillic spellings of brands, token by token.
BRANDS = {
    "айфон": "iphone", "айфона": "iphone", "айфоны": "iphone", "айфоне": "iphone", "айфонов": "iphone",
    "айфончик": "iphone", "iphonе": "iphone", "айпад": "ipad", "айпэд": "ipad",
    "самсунг": "samsung", "самсунга": "samsung", "сяоми": "xiaomi", "ксяоми": "xiaomi", "ксиоми": "xiaomi",
    "шаоми": "xiaomi", "хуавей": "huawei", "хуавэй": "huawei", "хонор": "honor", "редми": "redmi", "оппо": "oppo",
    "макбук": "macbook", "макбука": "macbook", "асус": "asus", "леново": "lenovo", "хп": "hp", "делл": "dell",
    "сони": "sony", "бозе": "bose", "маршалл": "marshall", "марашалл": "marshall", "джбл": "jbl",
    "эйрподс": "airpods", "аирподс": "airpods", "аирпадс": "airpods",
    "найк": "nike", "адидас": "adidas", "пума": "puma", "рибок": "reebok", "нью бэлэнс": "new balance",
    "плейстейшн": "playstation", "плойка": "playstation", "пс5": "playstation 5", "ps5": "playstation 5",
    "пс4": "playstation 4", "ps4": "playstation 4", "иксбокс": "xbox", "хбокс": "xbox",
    "свитч": "nintendo switch", "нинтендо": "nintendo",
}

# Phrases replaced before single tokens.
PHRASES = {
    "айфон 15 про макс": "iphone 15 pro max", "айфон 16 про макс": "iphone 16 pro max",
    "айфон 15 про": "iphone 15 pro", "айфон 16 про": "iphone 16 pro",
    "айфон 15": "iphone 15", "айфон 16": "iphone 16",
    "макбук эйр": "macbook air", "макбук эир": "macbook air", "макбук про": "macbook pro",
    "эйрподс про": "airpods pro", "эйрподс макс": "airpods max", "иксбокс сериес": "xbox series",
}

# Terms a typo may be corrected to are all of the above.
TYPO_CUTOFF, TYPO_LEAST_CHARS = 80.0, 4

# Groups of words that stand for one another.
SYNONYMS = (
    ("наушники", "гарнитура"), ("телефон", "смартфон", "мобильник"), ("ноутбук", "лэптоп"), ("телевизор", "тв"),
    ("компьютер", "пк"), ("колонка", "акустика"), ("мышь", "мышка"), ("кроссовки", "кеды"),
    ("кофеварка", "кофемашина"), ("монитор", "дисплей"), ("рюкзак", "ранец"), ("микроволновка", "свч"),
    ("видеокарта", "видюха"), ("планшет", "таблет"), ("кофемолка", "кофеизмельчитель"),
)

# Words without weight in relevance, and the shape of a specification.
STOPWORDS = ("и", "или", "в", "на", "для", "от", "до", "с", "со", "по", "за", "the", "a", "an", "of", "for", "with", "and", "or")
SPEC_PATTERN = r"(?i)^(\d+(?:[.,]\d+)?(?:[a-zа-я%/-]*)?|[a-zа-я]\d+[a-zа-я0-9]*|pro|max|plus|mini|ultra|lite|super)$"
TELLING_KEYS = ("бренд", "марка", "модель", "серия", "линейка", "диагональ", "память", "озу", "ram", "процессор", "цвет", "материал", "вес", "размер", "тип", "категория", "состояние", "версия", "поколение")

# Clarification of queries that name two things.
CLARIFY_SPLIT = r"\s+(?:и|или|плюс|and|or|with)\s+|\s*[,+&;]\s*"
CLARIFY_SPEC = r"(?i)^(\d+(?:[.,]\d+)?(?:[a-zа-я%/-]*)?|[a-zа-я]\d+[a-zа-я0-9]*|\d+[a-zа-я]+|pro|max|plus|mini|ultra|lite|super|pcs|шт|kg|кг|г|ml|мл|см|мм|м)$"
CLARIFY_BRANDS = (
    "samsung", "lg", "sony", "xiaomi", "apple", "asus", "lenovo", "hp", "dell", "huawei", "honor", "philips", "bosch",
    "siemens", "delonghi", "тефаль", "redmond", "polaris", "panasonic", "canon", "michelin", "nokian", "yokohama",
    "bridgestone", "continental", "epson", "brother", "cisco",
)

# Price level of a region against the base region.
BASE_REGION, DEFAULT_LEVEL = 213, 0.97
REGION_LEVELS = {
    213: 1.00, 1: 1.00, 2: 0.98, 10174: 0.99, 54: 0.96, 65: 0.97, 35: 0.95, 43: 0.96, 47: 0.96, 39: 0.95, 51: 0.96,
    193: 0.94, 50: 0.97, 66: 0.96, 11111: 0.96, 63: 0.97, 64: 0.97, 75: 0.97, 56: 0.96, 55: 0.97, 11193: 1.03,
    11225: 1.08, 11409: 1.08, 76: 1.07, 74: 1.10, 78: 1.12, 79: 1.10, 80: 1.10, 58: 1.12, 22: 0.99, 977: 1.05, 959: 1.04,
}
REGION_CITIES = {
    2: "Санкт-Петербурге", 54: "Екатеринбурге", 65: "Новосибирске", 35: "Краснодаре", 43: "Казани", 47: "Нижнем Новгороде",
    39: "Ростове-на-Дону", 172: "Уфе", 51: "Самаре", 193: "Воронеже", 50: "Перми",
}

# Last volume of each storage shard, shard 1 first, and the step beyond the table.
SHARD_VOLUMES = (
    143, 287, 431, 719, 1007, 1061, 1115, 1169, 1313, 1601, 1655, 1919, 2045, 2189, 2405, 2621, 2837, 3053, 3269, 3485,
    3701, 3917, 4133, 4349, 4565, 4877, 5189, 5501, 5813, 6125, 6437, 6749, 7061, 7373, 7685,
)
SHARD_STEP = 312

# Hosts that other sources already cover.
EXCLUDED_HOSTS = (
    "wildberries.ru", "www.wildberries.ru", "ozon.ru", "www.ozon.ru", "market.yandex.ru", "ya.ru", "yandex.ru",
    "megamarket.ru", "sbermegamarket.ru", "aliexpress.ru", "aliexpress.com", "goods.ru", "lamoda.ru", "www.lamoda.ru",
)

# A shop's search page by a part of the seller's name, in order; a bare host has no search page.
SHOPS = (
    ("эльдорадо", "https://www.eldorado.ru/search/?q={q}"), ("м.видео", "https://www.mvideo.ru/product-list-page?q={q}"),
    ("мвидео", "https://www.mvideo.ru/product-list-page?q={q}"), ("ситилинк", "https://www.citilink.ru/search/?text={q}"),
    ("dns", "https://www.dns-shop.ru/search/?q={q}"), ("днс", "https://www.dns-shop.ru/search/?q={q}"),
    ("связной", "https://www.svyaznoy.ru/catalog?search_query={q}"), ("мтс", "https://shop.mts.ru/search/?q={q}"),
    ("билайн", "https://shop.beeline.ru/search?text={q}"), ("мегафон", "https://moscow.shop.megafon.ru/search/?q={q}"),
    ("ростелеком", "https://shop.rt.ru/search?q={q}"), ("озон", "https://www.ozon.ru/search/?text={q}"),
    ("ozon", "https://www.ozon.ru/search/?text={q}"), ("wildberries", "https://www.wildberries.ru/catalog/0/search.aspx?search={q}"),
    ("вайлдберриз", "https://www.wildberries.ru/catalog/0/search.aspx?search={q}"), ("яндекс маркет", "https://market.yandex.ru/search?text={q}"),
    ("yandex market", "https://market.yandex.ru/search?text={q}"), ("apple store", "https://re-store.ru/search/?q={q}"),
    ("apple-market", "https://apple-market.ru/search/?q={q}"), ("фонмарт", "https://fonmart.ru/search/?q={q}"),
    ("техносила", "https://www.technosila.ru/search?q={q}"), ("холодильник.ру", "https://www.holodilnik.ru/search/?q={q}"),
    ("holodilnik", "https://www.holodilnik.ru/search/?q={q}"), ("сбермегамаркет", "https://megamarket.ru/catalog/?q={q}"),
    ("мегамаркет", "https://megamarket.ru/catalog/?q={q}"), ("ашан", "https://www.auchan.ru/catalog/?text={q}"),
    ("перекресток", "https://www.perekrestok.ru/cat?search={q}"), ("пятёрочка", "https://5ka.ru/search/?q={q}"),
    ("юлмарт", "https://ulmart.ru"), ("ноу-хау", "https://nbcom.ru"), ("лента", "https://lenta.com"),
)
GENERIC_SEARCH = "/search/?q={q}"

# Characteristics that make no facet, by a part of the key, and labels of those that do.
FACET_BLACKLIST = (
    "комплект", "о магазине", "о продавце", "разрывн", "декоратив", "вес", "артикул", "штрих", "barcode", "гарант", "страна",
    "ширина", "высота", "длина", "глубина", "толщина", "год выпуска", "месяц",
)
FACET_LABELS = {"brand": "Бренд", "Brand": "Бренд", "Производитель": "Бренд"}
FACET_SKIPPED = ("rating", "feedbacks")
FACET_MOST, FACET_COVERAGE, FACET_NUMERIC = 8, 0.25, 0.70

# Contract price.  Variation in percent up to which prices are homogeneous.
NMCK_OFFERS, NMCK_LEAST, NMCK_VARIATION, NMCK_RATING = 5, 3, 33.0, 4.0
NMCK_BAND = (0.5, 2.0)

# Price drop in percent below the median that is flagged, in groups of this size or more.
DUMPING_LEAST, DUMPING_DROP, DUMPING_DROP_RUNET = 5, 30, 35

# Lead-ins of a picture's description, and marks around it.
IMAGE_LEADS = ("это ", "вижу ", "на фото ", "на изображении ", "Это ", "Вижу ", "На фото ", "На изображении ", "Запрос: ", "Поисковый запрос: ", "запрос: ")
IMAGE_MARKS = "\"'«»‹›„‟ .,!?:;—–"

# Names and values of page controls that are no characteristics, texts that are no reviews, and beginnings of
# the names of widgets that hold reviews.
CONTROL_NAMES = (
    "подробнее", "все характеристики", "в наличии", "о товаре", "в корзине", "ozon россия", "магазин теперь здесь",
    "перейти", "купить", "в корзину", "добавить",
)
CONTROL_VALUES = ("перейти", "купить", "подписаться", "в корзину", "смотреть")
CONTROL_TEXTS = (
    "перейти", "купить", "в корзину", "в корзине", "добавить", "оформить", "подписаться", "смотреть", "подробнее",
    "написать отзыв", "все отзывы", "оплатить", "выбрать", "сортировка", "фильтр",
)
REVIEW_WIDGETS = ("weblistreviews", "webreviewlist", "weblistreviewsv2", "reviewshelfpaginator", "weblistcomments")

# Hosts that pictures may come from, with all below them.
IMAGE_HOSTS = (
    "wbbasket.ru", "wb.ru", "wildberries.ru", "ozone.ru", "ozon.ru", "ozonusercontent.com", "ozcdn.com", "yandex.net", "yastatic.net", "yandex.ru", "gstatic.com", "googleusercontent.com",
    "re-store.ru", "biggeek.ru", "dns-shop.ru", "mvideo.ru", "citilink.ru", "cmstore.ru", "kingstore.link", "apple-market.ru", "stores-apple.com",
)
