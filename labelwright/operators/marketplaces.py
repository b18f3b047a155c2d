"""What to read from the pages of each marketplace.

A field is a list of sources tried in order.  Sources are plain tuples so that a
deployment can extend a marketplace without touching the extraction job:

``("rows", keys)``             first of these table keys
``("licence_rows", keys)``     first of these keys that holds a 14-digit licence number
``("number_rows", keys)``      first number in the first of these keys
``("text", pattern, flags)``   group 1 in the page corpus
``("plain", pattern, flags)``  same, commas removed
``("html", pattern, flags)``   group 1 in the raw HTML
``("whole", pattern, flags)``  whole match in the page corpus
``("column", name)``           a value prepared by the job
``("sane_price", pattern)``    group 1, kept between 1 and 100000
"""

from __future__ import annotations

# Fragments that mark a table key as relevant, per marketplace; keys that are skipped.
_COMMON_KEYS = ["manufactur", "packer", "importer", "country", "origin", "fssai", "net weight", "net quantity"]
COMPLIANCE_KEYS = {
    "amazon": _COMMON_KEYS + [
        "net content", "mrp", "maximum retail", "best before", "expiry", "shelf life",
        "consumer care", "contact information", "address", "legal", "item weight", "unit count",
        "number of items", "item form", "size", "tablets", "capsules", "ingredients",
        "allergen", "nutritional", "storage",
    ],
    "flipkart": _COMMON_KEYS + [
        "net content", "mrp", "maximum retail", "best before", "expiry", "shelf life",
        "consumer care", "contact", "address", "item weight", "ingredients", "allergen",
        "nutritional", "storage", "legal", "size", "unit count",
    ],
    "jiomart": _COMMON_KEYS + [
        "net content", "mrp", "maximum retail", "best before", "expiry", "shelf life",
        "consumer care", "contact", "address", "item weight", "ingredients", "allergen",
        "nutritional", "storage", "legal", "unit count", "batch",
    ],
    "generic": _COMMON_KEYS + [
        "mrp", "maximum retail", "best before", "expiry", "consumer care", "contact", "address",
        "item weight", "ingredients", "allergen", "nutritional", "storage", "legal", "declaration",
        "batch", "lot",
    ],
    "listing_text": _COMMON_KEYS + [
        "net content", "mrp", "maximum retail", "price", "best before", "expiry", "consumer care",
        "contact information", "address", "legal", "item weight", "item form", "package weight", "size",
        "number of items", "unit count", "tablets", "capsules",
    ],
}
SKIPPED_KEYS = {
    "amazon": [
        "asin", "best sellers rank", "customer reviews", "date first available", "feedback", "department",
        "colour", "color", "flavour", "flavor", "style", "pattern", "finish",
    ],
    "listing_text": [
        "asin", "best sellers rank", "customer reviews", "date first available", "feedback", "department",
        "colour", "color", "flavour", "flavor", "material", "style", "pattern", "finish", "brand",
    ],
}
NO_ROWS = ("meesho", "myntra")  # these read no table

# Opening tags, element names and ids that hold titles, details, bullets, description and price.
TITLE = {
    "amazon": [
        r"<(span)\b[^>]*\bid\s*=\s*[\"']productTitle[\"'][^>]*>",
        r"<(h1)\b[^>]*>",
        r"<(span)\b[^>]*\bclass\s*=\s*[\"'][^\"']*\ba-size-large\b[^\"']*[\"'][^>]*>",
    ],
    "flipkart": [
        r"<(span)\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?:B_NuCI|yhB1nd|VU-ZEz|x-product-title)[^\"']*[\"'][^>]*>",
        r"<(h1)\b[^>]*>",
    ],
    "jiomart": [
        r"<(h1)\b[^>]*>",
        r"<(span)\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?:product.title|product.name|pdp.title)[^\"']*[\"'][^>]*>",
    ],
    "generic": [r"<(h1)\b[^>]*>"],
}
DETAIL_IDS = [
    "detailBullets_feature_div", "productDetails_detailBullets_sections1",
    "productDetails_techSpec_section_1", "productDetails_feature_div", "productDetails_db_sections",
]
PRICE_IDS = ["corePriceDisplay_desktop_feature_div", "priceblock_ourprice", "priceblock_dealprice"]
LISTING_PRICE_IDS = [
    "corePriceDisplay_desktop_feature_div", "apex_desktop_newAccordionRow_priceBlock_id",
    "priceblock_ourprice", "priceblock_dealprice",
]
SPEC_CLASSES = (
    r"_2RngUh|_1s_Smc|_25bRXJ|_1UhVsV|_3Fm-hO|_1YokD2|_3-wDH0|X3BRps|_2o-xpa|_1mXcCf|rgWa7D|"
    r"pqs9Lf|Izz52n|col-9-12|_2b00jl|_1fgeW|_3l-3pn"
)
SECTION_WORDS = ["manufacturer", "fssai", "country of origin", "net quantity"]
STATE_PREFIXES = r"(?:window\.__PRELOADED_STATE__|window\.pageDataV4|window\._fn)\s*=\s*(\{.*\})"
CLEAN_TAGS = ["script", "style", "nav", "footer", "header", "aside", "noscript"]

# Text patterns shared by the marketplaces.  A value longer than usual goes on to the end
# of its line (a country, a seller) or sentence.
_COO_TAIL = r"Country\s*of\s*Origin\s*[:\-]?\s*([A-Za-z][A-Za-z\s]{2,}?)(?:\s{2,}|\||$|\n)"
_COO_LINE = r"Country\s*of\s*Origin\s*[:\-]?\s*([A-Za-z\s]{3,30}|[A-Za-z ]{31,})(?:\n|$|\|)"
_FSSAI_NEAR = r"(?:fssai|lic(?:ence|ense)?\s*no|lic\.\s*no)[^0-9]{0,30}([1-9]\d{13})"
_FSSAI_BARE = r"\b([1-9]\d{13})\b"
_SHELF = r"(?:shelf\s*life|best\s*before|expiry)[:\s]*([^\n|]{4,%d}[^\n|.;]*)"
_QTY = r"Net\s*(?:Quantity|Weight|Content|Vol(?:ume)?)\s*[:\-]?\s*([\d.,]+\s*(?:kg|g|ml|l(?:iter|itre)?|gm|gms)\b[^,\n]{0,30}[^,\n.;]*)"
_MFG = r"(?:Mfg\.?\s*Date?|Date\s*of\s*Manufacture?|Manufactured\s*On)\s*[:\-]?\s*([^\n|]{4,30}[^\n|.;]*)"
_PHONE = r"(1800[\s\-]?[\d\s\-]{7,12}|\+91[\s\-]?\d{10}|0\d{9,10})"
_EMAIL = r"[\w.+\-]+@[\w\-]+\.[\w.]+"
_MRP = r"M\.?R\.?P\.?\s*[:\s₹Rs.]*\s*([\d,]+\.?\d{0,2})"
_RUPEE = r"₹\s*([\d,]+\.?\d{0,2})"
AMAZON_PHONE = r"(1800[\s\-]?[\d\s\-]{7,12}|\+91[\s\-]?\d{10})"
_LICENCE_KEYS = ["FSSAI Lic. No", "FSSAI", "FSSAI Licence No", "FSSAI License No", "Fssai Lic No"]

# Sources of each field per marketplace.
FIELDS: dict[str, dict[str, list[tuple]]] = {
    "amazon": {
        "product_name": [("column", "title")],
        "brand": [("rows", ["Brand", "Item model number"])],
        "manufacturer_raw": [("rows", ["Manufacturer", "Manufacturer Contact Information", "Brand Contact"]),
                             ("column", "bullet_manufacturer")],
        "packer_raw": [("rows", ["Packer Contact Information", "Packer", "Packer Contact"]), ("column", "bullet_packer")],
        "importer_raw": [("rows", ["Importer", "Importer Contact Information"])],
        "country_of_origin": [
            ("rows", ["Country of Origin", "Country Of Origin", "Origin", "Made in"]),
            ("text", r"Country\s+of\s+Origin\s*[:\-]?\s*([A-Za-z][A-Za-z\s]{2,}?)(?:\s{2,}|\||$|\n)", "i"),
            ("column", "bullet_country"),
        ],
        "net_quantity": [("rows", ["Net Quantity", "Net Weight", "Net Content", "Item Weight", "Unit Count"])],
        "best_before": [("rows", ["Best Before", "Shelf Life", "Expiry"]), ("text", _SHELF % 60, "i")],
        "fssai": [("licence_rows", ["FSSAI Lic. No", "FSSAI", "FSSAI Licence No", "Fssai Lic No"]),
                  ("text", _FSSAI_NEAR, "i"), ("text", _FSSAI_BARE, "")],
        "mrp": [("plain", r"M\.?R\.?P\.?\s*[:\s₹Rs.]*\s*([\d,]+\.?\d{0,2})", "i")],
        "mfg_date": [("text", r"(?:Mfg\.?\s*Date|Date\s*of\s*Manufacture)[:\s]+([^\n|]{4,30}[^\n|.;]*)", "i")],
        "consumer_care_phone": [("column", "party_phone"), ("whole", AMAZON_PHONE, "")],
        "description": [("column", "description_block")],
        "price_block": [("column", "price_block_text")],
    },
    "flipkart": {
        "product_name": [("column", "title")],
        "manufacturer_raw": [
            ("rows", ["Manufacturer", "Marketed by", "Manufactured by", "Manufacturer Name", "Manufacturer Details",
                      "Packer", "Packed by", "Importer"]),
            ("text", r"(?:Manufactured|Marketed|Packed|Imported)\s*(?:and\s+\w+\s*)?[Bb]y\s*[:\-]?\s*([^\n]{5,})", ""),
        ],
        "packer_raw": [("rows", ["Packer", "Packed by", "Packer Contact Information"])],
        "importer_raw": [("rows", ["Importer", "Imported by", "Importer Details"])],
        "net_quantity": [
            ("rows", ["Net Quantity", "Net Weight", "Net Content", "Item Weight", "Unit Count", "Net Vol", "Net Volume"]),
            ("text", _QTY, "i"),
        ],
        "country_of_origin": [("rows", ["Country of Origin", "Country Of Origin", "Origin", "Made In"]), ("text", _COO_TAIL, "i")],
        "fssai": [("licence_rows", _LICENCE_KEYS), ("text", _FSSAI_NEAR, "i"), ("text", _FSSAI_BARE, "")],
        "best_before": [("rows", ["Best Before", "Shelf Life", "Expiry", "Best Before (From Mfg Date)"]), ("text", _SHELF % 80, "i")],
        "mrp": [("plain", r"M\.?R\.?P\.?\s*[:\s]*(?:Rs\.?|INR)?\s*([\d,]+\.?\d{0,2})", "i")],
        "mfg_date": [("text", _MFG, "i")],
        "consumer_care_phone": [("whole", _PHONE, "")],
        "consumer_care_email": [("whole", _EMAIL, "")],
    },
    "jiomart": {
        "product_name": [("column", "title"), ("column", "ld_name")],
        "brand": [("column", "ld_brand")],
        "description": [("column", "ld_description")],
        "manufacturer_raw": [
            ("column", "named_manufacturer"),
            ("text", r"(?:Manufacturer(?:\s+Name)?|Manufactured\s+by|Marketed\s+by|Packed\s+by)\s*[:\-]?\s*([^\n]{5,})", ""),
        ],
        "packer_raw": [("rows", ["Packer", "Packed by", "Packer Name"])],
        "importer_raw": [("rows", ["Importer", "Imported by", "Importer Name"])],
        "net_quantity": [
            ("rows", ["Net Quantity", "Net Weight", "Net Content", "Item Weight", "Unit Count", "Net Vol", "Net Volume", "Qty"]),
            ("text", _QTY, "i"),
        ],
        "country_of_origin": [("rows", ["Country of Origin", "Country Of Origin", "Origin", "Made In"]), ("text", _COO_TAIL, "i")],
        "fssai": [("licence_rows", _LICENCE_KEYS + ["FSSAI Lic No", "Licence No"]), ("text", _FSSAI_NEAR, "i"), ("text", _FSSAI_BARE, "")],
        "best_before": [("rows", ["Best Before", "Shelf Life", "Expiry", "Best Before (From Mfg Date)", "Best Before Date"]),
                        ("text", _SHELF % 80, "i")],
        "mrp": [
            ("number_rows", ["MRP", "Maximum Retail Price", "Price", "Selling Price"]),
            ("column", "ld_price"),
            ("plain", r"(?:M\.?R\.?P\.?|Price|only)\s*[:\s]*[₹Rs.]*\s*([\d,]+\.?\d{0,2})", "i"),
            ("sane_price", _RUPEE),
        ],
        "mfg_date": [("text", _MFG, "i")],
        "consumer_care_phone": [("whole", _PHONE, "")],
        "consumer_care_email": [("whole", _EMAIL, "")],
        "ingredients": [("text", r"(?:^|\n)\s*(?:Ingredients?|Composition)\s*[:\-]\s*(.{20,}?)(?:\n\n|\n[A-Z]|\z)", "is")],
    },
    "myntra": {
        "product_name": [("column", "titled_name"), ("column", "title")],
        "brand": [("html", r'"brandName"\s*:\s*"([^"]{2,})"', "")],
        "net_quantity": [("column", "size_quantity"), ("column", "detail_net_quantity")],
        "country_of_origin": [("column", "stated_country"), ("column", "detail_country_of_origin"), ("text", _COO_LINE, "i")],
        "manufacturer_raw": [("column", "detail_manufacturer_raw")],
        "packer_raw": [("column", "detail_packer_raw")],
        "importer_raw": [("column", "detail_importer_raw")],
        "ingredients": [("column", "detail_ingredients")],
        "allergen_info": [("column", "detail_allergen_info")],
        "storage_instructions": [("column", "detail_storage_instructions")],
        "fssai": [("column", "detail_fssai"), ("html", _FSSAI_BARE, "")],
        "seller": [("html", r'"seller"\s*:\s*"([^"]{3,})"', ""), ("html", r"Seller\s*:\s*([A-Z](?:[A-Za-z\s&]{2,60}|[A-Za-z &]{61,}))(?:$|\n|Add)", "")],
        "mrp": [("html", r'"mrp"\s*:\s*"?(\d+)"?', ""), ("plain", r"MRP\s*[₹Rs.]*\s*(\d[\d,]*\.?\d{0,2})", "i")],
    },
    "meesho": {
        "product_name": [("column", "next_name"), ("column", "title")],
        "brand": [("column", "next_brand")],
        "description": [("column", "next_description")],
        "mrp": [("plain", _MRP, "i"), ("column", "next_mrp")],
        "country_of_origin": [("text", _COO_LINE, "i")],
    },
    "generic": {
        "product_name": [("column", "title"), ("column", "next_name"), ("column", "ld_name")],
        "brand": [("column", "next_brand")],
        "manufacturer_raw": [
            ("rows", ["Manufacturer", "Marketed by", "Manufactured by", "Packer", "Manufacturer Name"]),
            ("text", r"(?:Manufactured|Marketed|Packed|Processed)\s*(?:and\s+\w+\s*)*[Bb]y\s*[:\-]?\s*([^\n\.]{5,})", ""),
        ],
        "net_quantity": [("rows", ["Net Quantity", "Net Weight", "Net Content", "Item Weight", "Unit Count"]), ("text", _QTY, "i")],
        "country_of_origin": [("rows", ["Country of Origin", "Country Of Origin", "Made In"]),
                              ("text", r"Country\s*of\s*Origin\s*[:\-]?\s*([A-Za-z\s]{3,30}|[A-Za-z ]{31,})(?:\n|$|\||,)", "i")],
        "mrp": [("plain", _MRP, "i"), ("column", "next_mrp"), ("column", "ld_price"), ("sane_price", _RUPEE)],
        "fssai": [("text", r"(?:fssai|lic(?:ence|ense)?\s*no)[^0-9]{0,30}([1-9]\d{13})", "i"), ("text", _FSSAI_BARE, "")],
        "best_before": [("text", _SHELF % 60, "i")],
        "consumer_care_phone": [("whole", _PHONE, "")],
        "consumer_care_email": [("whole", _EMAIL, "")],
    },
}
ADAPTERS = tuple(FIELDS)
RECORD_FIELDS = (
    "product_name", "brand", "manufacturer_raw", "packer_raw", "importer_raw", "country_of_origin",
    "net_quantity", "best_before", "fssai", "mrp", "mfg_date", "consumer_care_phone", "consumer_care_email",
    "seller", "description", "ingredients", "allergen_info", "storage_instructions", "price_block",
)

# Routing of titled product details, first hit wins: (field, words that must all appear).
DETAIL_ROUTES = [
    ("manufacturer_raw", "manufacturer"), ("packer_raw", "packer"), ("importer_raw", "importer"),
    ("country_of_origin", "country.*origin|origin.*country"), ("fssai", "fssai|lic"), ("ingredients", "ingredient"),
    ("allergen_info", "allergen"), ("storage_instructions", "storage"),
    ("net_quantity", "net.*(?:weight|qty|quantity)|(?:weight|qty|quantity).*net"),
]
PRODUCT_DETAILS = r'"productDetails"\s*:\s*(\[.*?\])\s*,\s*"(?:styleId|productId|brand|name)"'
SIZE_QUANTITY = r"^(\d+(?:\.\d+)?)\s*(g|gm|gram|kg|ml|l|litre|liter|count|pc|tab)"
BULLET_MANUFACTURER = ["mfg.", "manufactured by", "mkt. by", "marketed by"]
BULLET_COUNTRY = r"(?:made in|country of origin)[:\s]+([A-Za-z]{3,})"
LISTING_SOURCE = "Source: Amazon.in e-commerce listing (online marketplace)"
LISTING_NOTE = (
    "Note: Manufacturing date, expiry, and FSSAI number may only appear on physical packaging — "
    "verify with seller for full compliance."
)
LISTING_CLASSES = ["X3BRps", "_2o-xpa", "_1mXcCf", "rgWa7D", "dGKuTl", "_14cfVK"]
