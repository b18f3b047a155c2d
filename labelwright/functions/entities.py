"""Patterns and column builders for typed attributes in free label text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.literals import may_match
from .normalize import clean_entity_text, clean_licence
from .text import bind, first_match, matches, rx, strip

# Party headings with the roles each one announces, most specific first.  The block that
# follows runs to a blank line (or to the end of the line for the four line-anchored headings).
_BLOCK = r"\s*[:\-]?\s*(.+?)(?=\n\n|$)"
PARTY_PATTERNS = [
    (r"(?:Manufactured|Mfg\.?)\s*[,&]+\s*(?:Marketed|Market\.?)\s*[Bb]y" + _BLOCK, "is", ("manufacturer", "marketer")),
    (r"(?:Manufactured|Mfg\.?)\s*[,&]+\s*Packed\s*[Bb]y" + _BLOCK, "is", ("manufacturer", "packer")),
    (r"Processed[\s,]+[Pp]acked\s*(?:and\s+)?(?:[Mm]arketed\s*)?[Bb]y" + _BLOCK, "is", ("manufacturer", "packer", "marketer")),
    (r"Imported\s+in\s+India\s+[Bb]y\s*[:\-]?\s*(.+?)(?=\n\n|PACKED\s+BY|MFD\s+BY|MANUFACTURED|$)", "is", ("importer",)),
    (r"Imported\s+(?:and|&)\s+(?:Marketed|Distributed|Sold)\s+[Bb]y" + _BLOCK, "is", ("importer", "marketer")),
    (r"(?:Sole|Authoris[e]?d|Exclusive)\s+Importer" + _BLOCK, "is", ("importer",)),
    (r"^IMPORTER\s*[:\-]\s*(.+?)(?=$)", "ims", ("importer",)),
    (r"(?:Mkt\.?\s*[Bb]y|Marketed\s+[Bb]y|Marketed\s+(?:and|&)\s+Distributed\s+[Bb]y)" + _BLOCK, "is", ("marketer",)),
    (r"(?:For\s+Sale\s+in\s+India|India\s+Contact|India\s+Office)" + _BLOCK, "is", ("importer",)),
    (r"Manufactured\s+[Bb]y" + _BLOCK, "is", ("manufacturer",)),
    (r"(?:Mfd\.?|Mfg\.?)\s*[Bb]y" + _BLOCK, "is", ("manufacturer",)),
    (r"Mf[gd]\.?\s+in\s+[A-Za-z\s]+\s+[Bb]y" + _BLOCK, "is", ("manufacturer",)),
    (r"Marketed\s+[Bb]y" + _BLOCK, "is", ("marketer",)),
    (r"Packed\s+[Bb]y" + _BLOCK, "is", ("packer",)),
    (r"Imported\s+[Bb]y" + _BLOCK, "is", ("importer",)),
    (r"Distributed\s+[Bb]y" + _BLOCK, "is", ("distributor",)),
    (r"^MANUFACTURER\s*:\s*(.+?)(?=$)", "ims", ("manufacturer",)),
    (r"^PACKER\s*:\s*(.+?)(?=$)", "ims", ("packer",)),
    (r"^IMPORTER\s*:\s*(.+?)(?=$)", "ims", ("importer",)),
    (r"Manufacturer\s+Contact\s+Information\s*[:\-]?\s*(.+?)(?=\n\n|\n[A-Z][a-z]+\s+Contact|$)", "is", ("manufacturer",)),
    (r"Packer\s+Contact\s+Information\s*[:\-]?\s*(.+?)(?=\n\n|\n[A-Z][a-z]+\s+Contact|$)", "is", ("packer",)),
]
ROLES = ("manufacturer", "packer", "importer", "marketer")

# Words that make a line part of an address, and words that end a company name.
ADDRESS_WORDS = r"\b\d{6}\b|Survey|No\.|Plot|Street|Road|Lane|Phase|Sector|Village|Gram|Nagar|Industrial"
COMPANY_WORDS = r"Pvt\.?|Ltd\.?|Private|Limited|LLP|Industries|Enterprises|Solutions|Foods|Wellness|Pharma"

# Patterns per attribute, in order, with their flags.
_DATE = (
    r"(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}[-/\s]?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    r"[a-z]*[-/\s]?\d{2,4}|\d{4})"
)
_STOP = (
    r"(?=\n\n|\nALLERGEN|\nNUTRITION|\nSTORAGE|\nCALORIES?|\nENERGY\s*[:\-]?"
    r"|\nTOTAL\s+(?:FAT|CARB|PROTEIN)|\nAMOUNT\s+PER|$)"
)
_LIST = r"\s*[:\-.]?\s*(.{20,}?)" + _STOP
PATTERNS = {
    "net_quantity": [
        (r"NET\s*(?:WEIGHT|WT\.?|QUANTITY|QTY\.?|CONTENT|VOL(?:UME)?)\s*[:\-]?\s*([\d.,]+\s*(?:kg|g|gm|gms|L|litre|liter|ml|oz|lb))", "i"),
        (r"NET\s+WT\s*[:\-]?\s*([\d.,]+\s*(?:kg|g|gm|gms|L|ml|oz|lb))", "i"),
        (r"Nett?\s*(?:Weight|Wt\.?)\s*[:\-]?\s*([\d.,]+\s*(?:kg|g|gm|gms|L|ml))", "i"),
        (r"([\d.,]+\s*(?:kg|Kg|KG))\s*(?:\||$|\n)", "m"),
        (r"WEIGHT\s*[:\-]\s*([\d.,]+\s*(?:kg|g|gm|gms|L|ml))", "i"),
        (r"(?:Weight|Quantity)\s*[:\-]\s*([\d.,]+\s*(?:kg|g|gm|L|ml|pcs|units|tablets?|capsules?))", "i"),
    ],
    "mrp": [
        (r"M\.?R\.?P\.?\s*(?:Incl\.?\s*of\s*all\s*taxes?)?\s*[:\-₹Rs.]*\s*([\d,]+\.?\d{0,2})", "i"),
        (r"(?:MRP|M\.R\.P)\s*[:\-]?\s*(?:Rs\.?|₹|INR)?\s*([\d,]+\.?\d{0,2})", "i"),
        (r"(?:Rs\.?|₹)\s*([\d,]+\.?\d{0,2})\s*/?\s*-?\s*(?:MRP|M\.R\.P)", "i"),
        (r"(?:Retail\s*Price|Maximum\s*Retail\s*Price)\s*[:\-]?\s*(?:Rs\.?|₹)?\s*([\d,]+\.?\d{0,2})", "i"),
    ],
    "fssai": [
        (r"FSSAI\s*(?:Lic(?:ence|ense)?\.?\s*No\.?|License\s*No\.?|Lic\.?\s*No\.?|#|Reg\.?\s*No\.?|Licence\s*Number|License\s*Number)?\s*[:\-]?\s*([1-9][\d\s\-]{12,17}\d)", "i"),
        (r"Lic(?:ence|ense)?\.?\s*No\.?\s*[:\-]?\s*([1-9][\d\s\-]{12,17}\d)", "i"),
        (r"Licen[sc]e\s*(?:No\.?|Number)\s*[:\-]?\s*([1-9][\d\s\-]{12,17}\d)", "i"),
        (r"FSSAI[^\d]{0,60}([1-9][\d\s\-]{12,17}\d)", "is"),
        (r"(?:^|\n)\s*([1-9]\d{13})\s*(?:\n|$)", "m"),
        (r"(?:^|\n)\s*([1-9]\d{3}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{2})\s*(?:\n|$)", "m"),
        (r"\b([1-9][\d\s]{14,20}\d)\b", ""),
        (r"\b([1-9]\d{13})\b", ""),
    ],
    "mfg_date": [
        (r"(?:Mfg\.?\s*Date|MFG\.?\s*DATE|Date\s*of\s*Mfg\.?|Manufacturing\s*Date|Manufactured\s*On)\s*[:\-]?\s*(" + _DATE + ")", "i"),
        (r"Mfg\s*[:\-]\s*(" + _DATE + ")", "i"),
    ],
    "expiry_date": [
        (r"(?:Exp(?:iry)?\.?\s*Date|EXP\.?\s*DATE|Best\s*Before|BBE|Use\s*By|Expiry|Best\s*Before\s*(?:End)?|BB[D:]?)\s*[:\-]?\s*(" + _DATE + ")", "i"),
        (r"(?:Use\s*Before|Consume\s*Before)\s*[:\-]?\s*(" + _DATE + ")", "i"),
    ],
    "batch_no": [
        (r"(?:Batch\s*(?:No\.?|Code)?|Lot\s*(?:No\.?|#)?|Batch/Lot|B\.?\s*No\.?)\s*[:\-#]?\s*([A-Z0-9/\-]{3,})", "i"),
    ],
    "country_of_origin": [
        (r"Country\s*of\s*Origin\s*[:\-]?\s*([A-Za-z][A-Za-z\s]{2,}?)(?:\n|$|\||,|\s{2,})", "i"),
        (r"Country\s*of\s*Origin\s*[:\-]?\s*\n\s*([A-Za-z][A-Za-z\s]{2,}?)(?:\n|$|\||,)", "i"),
        (r"\bOrigin\s*[:\-]\s*([A-Za-z][A-Za-z\s]{2,}?)(?:\n|$|\||,|\s{2,})", "i"),
        (r"Made\s+in\s+([A-Za-z][A-Za-z\s]{2,}?)(?:\n|$|\||\.|\,|\s{2,})", "i"),
        (r"Product\s+of\s+([A-Za-z][A-Za-z\s]{2,}?)(?:\n|$|\||\.|\,)", "i"),
        (r"Produce\s+of\s+([A-Za-z][A-Za-z\s]{2,}?)(?:\n|$|\||\.|\,)", "i"),
    ],
    # The sixth pattern is a flat class: the nested repetition it stands for backtracks without bound.
    "ingredients": [
        (r"INGREDIENT[S]?" + _LIST, "is"),
        (r"INGRED(?:I[1lL]|IE|IA)ENTS?" + _LIST, "is"),
        (r"COMPOSITION" + _LIST, "is"),
        (r"MADE\s+(?:FROM|WITH)" + _LIST, "is"),
        (r"PREPARED\s+FROM" + _LIST, "is"),
        (r"CONTAINS\s*[:\-]\s*([A-Za-z][A-Za-z\s,()%\d.]{39,}?)" + _STOP, "is"),
    ],
    "allergen_info": [
        (r"ALLERGEN\s*(?:INFORMATION|INFO\.?)?\s*[:\-]?\s*(.{5,}?)(?=\n\n|\nSTORAGE|\nNUTRITION|$)", "is"),
        (r"(?:Contains|Allergy\s*Advice)\s*[:\-]\s*(.{5,}?)(?:\.|$|\n)", "i"),
        (r"(?:May\s+Contain|Contains\s+traces?\s+of)\s*[:\-]?\s*(.{5,}?)(?:\.|$|\n)", "i"),
    ],
    "storage_instructions": [
        (r"STORAGE\s*(?:INSTRUCTIONS?|CONDITIONS?|INFO\.?)?\s*[:\-]?\s*(.{5,}?)(?=\n\n|\nNUTRITION|\nALLERGEN|$)", "is"),
        (r"(?:Store|Keep)\s+(?:in|at|away)\s+(.{5,}?)(?:\.|$|\n)", "i"),
    ],
    "consumer_care_raw": [
        (r"(?:Consumer\s*Care|Customer\s*Care|Helpline|Care\s*Line|Toll[\s\-]*Free)\s*[:\-]?\s*(.{5,})", "is"),
    ],
}
PHONE = r"(?:1800[\s\-]?[\d\s\-]{6,12}|\+91[\s\-]?\d{10}|0\d{10})"
EMAIL = r"[\w.+\-]+@[\w\-]+\.[\w.]+"
BARCODE = r"\b(\d{8}|\d{12}|\d{13}|\d{14})\b"
BRAND = r"\bBrand\s*[:\-]\s*([A-Za-z][A-Za-z\s&]{2,}?)(?:\n|$|\|)"
NON_VEG = r"\bnon[\s\-]?vegetarian\b|\bnon[\s\-]?veg\b"
VEG = r"\bvegetarian\b|\bpure\s*veg\b|\bveg\b"
TRUNCATED = r"(?:,\s*$|\band\s*$|\(\s*$|\d+\.?\d*\s*%?\s*$|\d+\s*$)"

# Fall-back patterns over combined web or package text: (pattern, group, flags).
# A value longer than usual goes on to the end of its line (a country) or sentence.
FALLBACK_FIELDS = {
    "country_of_origin": (r"Country\s*of\s*Origin\s*[:\-]?\s*([A-Za-z\s]{3,30}|[A-Za-z ]{31,})(?:\n|$|\||\,)", 1, "i"),
    "fssai": (r"\b([1-9]\d{13})\b", 1, ""),
    "brand": (BRAND, 1, "i"),
    "consumer_care_phone": (r"(?:1800[\s\-]?[\d\s\-]{7,12}|\+91[\s\-]?\d{10})", 0, ""),
    "consumer_care_email": (EMAIL, 0, ""),
    "best_before": (r"(?:best\s*before|shelf\s*life|expiry)[:\s]*([^\n|]{4,60}[^\n|.;]*)", 1, "i"),
    "mfg_date": (r"(?:Mfg\.?\s*Date?|Date\s*of\s*Manufacture?|Manufactured\s*On)\s*[:\-]?\s*([^\n|]{4,30}[^\n|.;]*)", 1, "i"),
}
DECLARATIONS = [
    r"(?:Statutory\s+warning[^\n.]{5,})",
    r"(?:FSSAI[^\n.]{5,})",
    r"(?:Vegetarian|Non[\s\-]?Vegetarian)[^\n.]*",
    r"(?:Certified\s+Organic[^\n.]*)",
    r"(?:Lic\.?\s*No\.[^\n.]{5,})",
    r"(?:All\s+weights[^\n.]{5,})",
    r"(?:Weigh\s+before\s+buying[^\n.]*)",
]

# Presence patterns of the six critical fields, in report order.
CRITICAL_PATTERNS = {
    "manufacturer": r"manufactur|mfg\.?\s*by|packed\s*by|marketed\s*by|packer|importer",
    "net_qty": r"net\s*(?:weight|wt|quantity|qty|content|vol)|nett?\s*wt|\d+\s*(?:kg|g\b|ml|litre|liter)\b",
    "mrp": r"m\.?r\.?p\.?|maximum\s*retail\s*price|rs\.?\s*\d|₹\s*\d",
    "fssai": r"fssai|f\.?s\.?s\.?a\.?i|lic(?:ence|ense)?\s*no|[1-9]\d{13}",
    "country": r"country\s*of\s*origin|made\s*in\s*india|product\s*of|india|Made In",
    "ingredients": (
        r"INGREDI[EA]N[T]?S?\s*[:\-.]?|INGREDI[1l]ENTS\s*[:\-.]?|COMPOSITION\s*[:\-.]?"
        r"|MADE\s+(?:FROM|WITH)\s*[:\-.]?|PREPARED\s+FROM\s*[:\-.]?"
    ),
}


def _worth(low: Column | None, patterns: list[str]) -> list[Column | None]:
    return [None if low is None else may_match(low, p) for p in patterns]


def party_block(text: Column, i: int, low: Column | None = None) -> Column:
    """Cleaned block after the ``i``-th party heading; empty or NULL if the heading is absent.

    With ``low``, the folded text, a pattern here and below runs only if the text holds a literal that it needs.
    """
    pattern, flags, _ = PARTY_PATTERNS[i]
    block, (worth,) = clean_entity_text(F.regexp_extract(text, rx(pattern, flags), 1)), _worth(low, [pattern])
    return block if worth is None else F.when(worth, block)


def first_attribute(text: Column, name: str, low: Column | None = None) -> Column:
    """Cleaned value of the first matching pattern of an attribute; NULL or blank if none."""
    patterns = PATTERNS[name]
    return clean_entity_text(first_match(text, patterns, worth=_worth(low, [p for p, _ in patterns])))


def licence_number(text: Column, low: Column | None = None) -> Column:
    """First licence candidate that cleans to a valid number; invalid ones pass to the next pattern."""
    patterns = PATTERNS["fssai"]
    found = [bind(F.regexp_extract(text, rx(p, f), 1), lambda v: F.when(v != "", clean_licence(v))) for p, f in patterns]
    return F.coalesce(*[v if w is None else F.when(w, v) for v, w in zip(found, _worth(low, [p for p, _ in patterns]))])


def split_company(block: Column) -> Column:
    """Struct ``company, address`` of a party block.

    The company runs up to the first line that looks like an address, through
    the first line with a company word, or over two lines, whichever ends first.
    """

    def cut(lines: Column) -> Column:
        def ends(line: Column, i: Column) -> Column:
            return matches(line, ADDRESS_WORDS) | matches(line, COMPANY_WORDS) | (i >= 2)

        def divide(at: Column) -> Column:
            hit = F.get(lines, (at - 1).cast("int"))
            n = (
                F.when(at == 0, F.size(lines))
                .when(matches(hit, ADDRESS_WORDS), at - 1)
                .when(matches(hit, COMPANY_WORDS), at)
                .otherwise(at - 1)
            ).cast("int")
            n = F.greatest(n, F.lit(1))
            return F.struct(
                F.array_join(F.slice(lines, 1, n), " ").alias("company"),
                F.array_join(F.slice(lines, n + 1, F.size(lines) + 1), "\n").alias("address"),
            )

        return bind(F.array_position(F.transform(lines, ends), True), divide)

    lines = F.filter(F.transform(F.split(strip(block), "\n"), strip), lambda x: x != "")
    return bind(lines, cut)


def ingredients_complete(text: Column) -> Column:
    """False if the list ends in a comma, "and", an open bracket or a number."""
    return ~matches(F.right(strip(text), F.lit(80)), TRUNCATED)


def declarations(text: Column) -> Column:
    """Legal declarations found in the text, in pattern order."""
    hits = F.array(*[strip(F.regexp_extract(text, rx(p), 0)) for p in DECLARATIONS])
    return F.filter(hits, lambda h: h != "")


def fallback_field(text: Column, name: str) -> Column:
    pattern, group, flags = FALLBACK_FIELDS[name]
    return strip(F.regexp_extract(text, rx(pattern, flags), group))

