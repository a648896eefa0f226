"""Patterns and word lists that decide results.

Java and Python disagree on ``\\s``: Python's knows Unicode, Java's does not unless told.  ``WS``
spells out what is meant, so that the patterns read the same in both.
"""

from __future__ import annotations

#: Unicode white space, as a character class without brackets.
WS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same characters one by one, for what takes no pattern: trimming ends at the first other character.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# --- Fixed values: these decide what is read from a page and must stay as they are. ---

SENTINEL = rf"(?iu)\A[{WS}]*(?:loading|please wait|n/?a|tbd|undefined|null|none|--+|—|\.{{2,}}|…| )*[{WS}]*\z"
TITLE_SUFFIX = rf"[{WS}]*[|–—·•][{WS}]*[^|–—·•]{{1,60}}\z"
PLACEHOLDER = rf"(?i)skeleton|shimmer|placeholder|is-?loading|loading-?state|aria-busy:[{WS}]*true|lqip|blurhash"

NAME_KEYS = ("name", "title", "productName", "product_name", "displayName")
DESCRIPTION_KEYS = ("description", "productDescription", "longDescription", "details", "detail")
BRAND_KEYS = ("brand", "manufacturer", "vendor", "brandName", "brand_name")
PRICE_KEYS = ("price", "lowPrice", "amount", "finalPrice", "salePrice", "currentPrice", "value", "priceAmount", "unitPrice")
RANGE_KEYS = ("lowprice", "highprice")
CURRENCY_KEYS = ("priceCurrency", "currency", "currencyCode", "priceCurrencyCode")
STOCK_STATE_KEYS = ("availability", "availabilityStatus", "inStock", "inventoryStatus", "stockStatus")
WAS_PRICE_KEY = r"(?i)(?:list|compare|compare_?at|regular|was|original|strike|strikethrough|full|retail|high)_?price|^msrp$|^price_?before"
CHARGE_TYPE = r"(?i)shipping|delivery|handling|tax|fee|installment|subscription|warranty|return"
CHARGE_PATH = r"(?i)shipping|delivery|handling|\btax\b|estimatedcost|chargespecification|returnpolicy|warranty|financ"
NOT_BUYABLE = r"(?i)out_?of_?stock|sold_?out|discontinued|back_?order"

SYMBOLS = {
    "$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₹": "INR", "₽": "RUB", "₺": "TRY", "₩": "KRW",
    "C$": "CAD", "A$": "AUD", "R$": "BRL", "NZ$": "NZD", "S$": "SGD", "HK$": "HKD", "US$": "USD",
    "SFR": "CHF", "ZŁ": "PLN", "￥": "JPY", "＄": "USD", "￡": "GBP", "￦": "KRW",
}
CODES = (
    "USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CHF", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "RON", "BRL", "MXN", "ARS", "CLP",
    "INR", "CNY", "KRW", "TRY", "ZAR", "NZD", "SGD", "HKD", "AED", "SAR", "ILS", "THB", "PHP", "IDR", "MYR", "VND", "RUB",
)
CURRENCY = r"(?:(?:C|A|R|US|NZ|S|HK)?[$]|[£€¥₹₽₺₩￥＄￡￦]|SFr\.?|zł|\b(?:" + "|".join(CODES) + r")\b)"
NUMBER = r"(?:[0-9][0-9.,\u00A0\u202F\u2009 ]{0,15}[0-9]|[0-9])"
GROUPING_SPACES = "\u00A0\u202F\u2009 "
MOST_AMOUNT = 10_000_000

HARD_CONTEXT = (
    r"(?i)cross[-_ ]?sell|up[-_ ]?sell|related|recommend|similar|also[-_ ]?(?:bought|viewed|like)|you[-_ ]?may|complete[-_ ]?the|"
    r"review|question|answer|footer|nav|menu|breadcrumb|gift[-_ ]?card|carousel"
)
SOFT_CONTEXT = r"(?i)shipping|delivery|reward|loyalty|bonus|coupon|promo|banner|financ|instal|afterpay|klarna|affirm|subscribe|save[-_ ]?up"
PRICE_CONTEXT = r"(?i)price|pricing|amount|cost|msrp|sale"

SIGNAL_KEYS = (
    "name", "title", "price", "offers", "sku", "brand", "image", "images", "description", "productid", "mpn", "gtin", "gtin13",
    "currency", "pricecurrency", "availability", "variants", "hasvariant", "skus", "media", "color", "colour", "size", "material",
)
PRODUCT_TYPES = ("product", "productgroup", "productmodel", "individualproduct")
ID_FIELDS = ("id", "@id", "__id", "key")
REFERENCE_KEY = r"(?:^|_)(?:ref|id|ids)$|Id$|Ids$|^(?:prices?|media|mediaIds|skus?|items?|variants?)$"
LEAST_SCORE = 4
MEMBER_PATH = r"(?i)hasVariant|itemListElement|isSimilarTo|isRelatedTo|isAccessoryOrSparePartFor|related|recommend|similar|crossSell|upSell"

IMAGE_EXTENSION = r"(?i)\.(?:jpe?g|png|webp|avif|gif|bmp|tiff?)(?:$|[?#])"
IMAGE_KEYS = (
    "url", "src", "srcset", "href", "image", "imageurl", "image_url", "img", "thumbnail", "thumb", "squarish", "portrait",
    "landscape", "hero", "picture", "photo", "source", "contenturl", "secure_url",
)
IMAGE_EXCLUDE = (
    r"(?i)related|recommend|similar|cross[-_]?sell|up[-_]?sell|also[-_]?(?:bought|viewed|like)|you[-_]?may|complete[-_]?the|carousel|banner|"
    r"promo|nav|menu|footer|header|breadcrumb|badge|icon|logo|payment|social|review|question|answer|swatch[-_]?nav|fitguide|sizechart|"
    r"size[-_]?guide|placeholder|sprite"
)
LADDER = (
    "micro", "mini", "xsmall", "tiny", "thumb", "thumbnail", "small", "preview", "medium", "standard", "default", "normal", "large", "xlarge",
    "xxlarge", "big", "full", "zoom", "max", "maximum", "original", "orig", "master", "raw", "hires", "hi_res", "highres",
)
CROPS = ("squarish", "square", "portrait", "landscape", "wide", "tall", "vertical", "horizontal", "cropped", "uncropped", "original_ratio")
CONTAINERS = (
    "sources", "source", "properties", "renditions", "sizes", "formats", "variants", "images", "urls", "url", "src", "srcset", "thumbnail",
    "crops", "versions", *CROPS,
)
RENDITION_SUFFIX = (
    r"(?i)[-_](?:thumb|thumbnail|mini|micro|small|medium|large|xlarge|full|max|square|standard|preview|zoom|orig|original|retina|"
    r"\d{2,4}x\d{1,4})(?=\.\w{2,5}$)"
)
RENDITION_WORD = r"(?:Small|Medium|Large|XLarge|XSmall)\d*(?:Retina)?(?=\.\w{2,5}$|$)"
ASSET_UUID = r"/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})/([^/]+)$"
IMAGE_ATTRIBUTES = ("srcset", "data-srcset", "src", "data-src", "data-original", "data-zoom-image")
IDENTITY_KEYS = ("sku", "mpn", "productID", "productGroupID", "itemId", "styleCode", "id")

VIDEO_EXTENSION = r"(?i)\.(?:mp4|m4v|webm|mov|ogv|m3u8|mpd)(?:$|[?#])"
VIDEO_KEYS = ("videourl", "video_url", "video", "contenturl", "content_url", "embedurl", "embed_url", "src", "url", "file", "source", "playbackurl", "hlsurl", "mp4")
VIDEO_TYPE_KEYS = ("mediatype", "type", "@type", "component", "cardtype", "kind", "format", "assettype")
VIDEO_ATTRIBUTES = ("src", "data-src", "data-video-src")

VARIANT_EXCLUDE = (
    r"(?i)related|recommend|similar|cross[-_]?sell|up[-_]?sell|also[-_]?(?:bought|viewed|like)|you[-_]?may|complete[-_]?the|carousel|nav|menu|"
    r"footer|header|breadcrumb|promo|banner|review|bundle|outfit|lookbook"
)
PRODUCT_ONLY_KEYS = ("price", "prices", "description", "url", "brand", "image", "images", "media", "currency", "slug", "canonicalurl", "categoryuri", "producturl", "offers")
AXES = {
    "color": "Color", "colour": "Color", "size": "Size", "fit": "Fit", "style": "Style", "material": "Material", "pattern": "Pattern",
    "width": "Width", "length": "Length", "flavor": "Flavor", "flavour": "Flavor", "scent": "Scent", "capacity": "Capacity",
    "volume": "Volume", "voltage": "Voltage", "wattage": "Wattage", "finish": "Finish", "gauge": "Gauge", "configuration": "Configuration",
    "inseam": "Inseam", "waist": "Waist", "cup": "Cup", "band": "Band", "shade": "Shade",
}
AXIS_ID_KEY = r"(?i)^([a-z]+?)(?:id|_id|code|key)$"
LABEL_KEYS = ("name", "label", "title", "value", "displayName", "display_name", "localizedLabel", "text", "optionValue")
ROW_ID_KEYS = ("sku", "skuId", "merchSkuId", "item", "itemId", "id", "code", "partNumber", "variantId", "productCode", "styleCode")
GTIN_KEYS = ("gtin", "gtin8", "gtin12", "gtin13", "gtin14", "ean", "upc", "isbn", "barcode")
MPN_KEYS = ("mpn", "manufacturerPartNumber")
ROW_STOCK_KEYS = ("availability", "inStock", "in_stock", "available", "stock", "status", "quantity", "inventoryQuantity", "stockLevel")
STOCK_PLACES = ("warehouses", "locations", "inventory", "stores")
PREORDER = r"(?i)pre.?order|pre.?sale"
OUT_OF_STOCK = r"(?i)out.?of.?stock|sold.?out|unavailable|discontinued|inactive|soldout"
IN_STOCK = r"(?i)in.?stock|instock|available|active|backorder"
PAIR_KEYS = ("selectedOptions", "options", "attributes", "variantValues", "specs", "properties")
CHOICE_KEYS = ("answers", "values", "choices", "options", "items", "variants", "swatches", "selections", "terms")
SKU_SET_KEYS = ("skus", "skuIds", "sku_ids", "variantIds", "productIds", "itemIds")
NULL_CHOICES = ("", "0", "-", "--", "n/a", "na", "none", "null", "false", "true")
ROW_IMAGE_KEYS = ("url", "src", "image", "imageurl", "thumbnail", "photo", "contenturl")

BREADCRUMB_TYPES = ("breadcrumblist", "breadcrumb")
CRUMB_NOISE = ("home", "homepage", "all", "shop", "back", "menu", "")
QUERY_NOISE = r"(?i)^(?:home|homepage|shop|all|back|index|browse|catalog|sale|new|item[\s ]*#|www\.|https?:)"

BUY_WORDS = r"(?i)add to (?:cart|bag|basket)|buy now|add to trolley|pre-?order|out of stock|sold out|in stock|checkout|InStock|OutOfStock"
LISTING_TYPE = r'(?i)"@type"\s*:\s*"(?:CollectionPage|SearchResultsPage)"'
PRODUCT_OG_TYPES = ("product", "product.item", "product.group", "og:product")
BAD_AXIS_NAME = r"(?iU)[/|,>]|\bvariant\b|\boption\b|\bitem\b|^\W*$"
NOISE_KEY = (
    r"(?i)^(?:__typename|_+id|tracking|analytics|gtm|ga|utm|telemetry|experiment|ab_?test|session|csrf|nonce|timestamp|created_?at|"
    r"updated_?at|locale|hreflang|breakpoints?|css|style|classname|dataLayer)"
)
META_SHOWN = r"(?i)og:|twitter:|description|keywords|price|product|category|brand"

TRANSIENT_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
TRANSIENT_NAMES = ("ratelimit", "timeout", "apiconnection", "internalserver", "serviceunavailable", "overloaded")
#: Dollars for a million tokens: in, out.
MODEL_PRICES = {
    "google/gemini-2.0-flash-lite-001": (0.075, 0.30),
    "google/gemini-2.5-flash-lite": (0.10, 0.40),
    "google/gemini-3-flash-preview": (0.50, 3.00),
    "google/gemini-3-pro-preview": (2.00, 12.00),
    "openai/gpt-5": (1.25, 10.00),
    "openai/gpt-5-mini": (0.25, 2.00),
    "openai/gpt-5-nano": (0.05, 0.40),
}
MODEL_CASCADE = ("openai/gpt-5-nano", "google/gemini-2.5-flash-lite", "openai/gpt-5-mini")
