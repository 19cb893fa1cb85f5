"""Entities in text (X1 to X16, T1, T2), as column functions over regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.common import strip, when_first

# Patterns, suffixes, abbreviations and word lists.
BASIC_REFERENCES = (r"(?i)(?:ref|reference|licence|license)[\s:]+([A-Z0-9\-/]+)", r"(?i)([A-Z]{2,}\d{4,})", r"(?i)(\d{4,}/[A-Z0-9]+)")
BASIC_ADDRESS = r"(?i)(\d+\s+[A-Za-z\s]+(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Cl|Way|Place|Pl)[^,\n]*(?:,\s*[A-Za-z\s]+)*)"
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
BASIC_DATES = (r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", rf"(?i)(\d{{1,2}}\s+{MONTHS}\s+\d{{2,4}})", r"(\d{4}-\d{2}-\d{2})")
BASIC_NUMBERS = (r"(?i)(?:occupancy|capacity|persons?)[\s:]+(\d+)", r"(?i)(?:max|maximum)[\s:]+(\d+)", r"(?i)(\d+)\s+(?:persons?|people|occupants?)")
SUFFIXES = "street st road rd avenue ave lane ln drive dr close cl way place pl court ct crescent cres gardens gdns park square sq terrace ter grove mews hill view walk".split()
ABBREVIATIONS = {"St": "Street", "Rd": "Road", "Ave": "Avenue", "Dr": "Drive", "Cl": "Close", "Ln": "Lane", "Pl": "Place", "Ct": "Court", "Cres": "Crescent", "Gdns": "Gardens", "Sq": "Square", "Ter": "Terrace"}
STREET = rf"(?i)(\d+[A-Z]?\s+[A-Za-z\s]+(?:{'|'.join(SUFFIXES)}))\b"
POSTCODE_LINE = r"(?i)(\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b)"
DATES = (r"(\b\d{1,2}/\d{1,2}/\d{4}\b)", r"(\b\d{1,2}-\d{1,2}-\d{4}\b)", r"(\b\d{4}-\d{1,2}-\d{1,2}\b)", rf"(?i)(\b\d{{1,2}}\s+{MONTHS}\s+\d{{4}}\b)", rf"(?i)(\b{MONTHS}\s+\d{{1,2}},?\s+\d{{4}}\b)")
REFERENCES = (
    r"(?i)(\b[A-Z]{2,4}/\d{4,8}\b)", r"(?i)(\bHMO/\d{4,8}\b)", r"(?i)(\b[A-Z]{1,3}\d{4,8}\b)", r"(\b\d{6,8}\b)",
    r"(?i)(\bRef:\s*[A-Z0-9/\-]+\b)", r"(?i)(\bReference:\s*[A-Z0-9/\-]+\b)", r"(?i)(\bLicence\s+No[.:]\s*[A-Z0-9/\-]+\b)",
)
NAMES = (
    r"(?i)(?:manager|holder|owner|landlord|contact):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
    r"(?i)(?:name|person):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
    r"(?i)([A-Z][a-z]+\s+[A-Z][a-z]+)(?:\s+\((?:manager|holder|owner)\))?",
)
CAPITALIZED = r"(\b[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b)"
NO_NAMES = "street road avenue lane drive close way council borough district city town county house flat apartment building centre center office department service authority committee".split()
RULER = (
    ("LICENSE_REF", r"(?:^|\s)([A-Z]{2,4}/\d{4,6})(?=\s|$)"), ("LICENSE_REF", r"(?:^|\s)(\d{4,8})(?=\s|$)"),
    ("COUNCIL", r"(?i)(?:^|\s)(east lindsey district council|central bedfordshire council|dacorum borough council|fife council)(?=\s|$)"),
    ("HMO_TERM", r"(?i)(?:^|\s)(hmo manager|hmo|house in multiple occupation|licence holder|maximum occupancy|max occupancy)(?=\s|$)"),
    ("DATE_PATTERN", r"(?:^|\s)(\S*?(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{4}-\d{1,2}-\d{1,2})\S*)"),
    ("POSTCODE", r"(?:^|\s)([A-Z]{1,2}\d[A-Z\d]?\d[A-Z]{2})(?=\s|$)"),
)
_STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Cl|Way|Place|Pl"
ENTITY_PATTERNS = (
    ("ADDRESS", rf"(?i)(\d+\s+[A-Za-z\s]+(?:{_STREETS})\b)", 0.8), ("ADDRESS", rf"(?i)([A-Za-z\s]+(?:{_STREETS})\s*\d*)", 0.8),
    ("DATE", r"(\b\d{1,2}/\d{1,2}/\d{4}\b)", 0.85), ("DATE", r"(\b\d{1,2}-\d{1,2}-\d{4}\b)", 0.85), ("DATE", r"(\b\d{4}-\d{1,2}-\d{1,2}\b)", 0.85), ("DATE", rf"(?i)(\b\d{{1,2}}\s+{MONTHS}\s+\d{{4}}\b)", 0.85),
    ("LICENSE_REF", r"(\b[A-Z]{2,4}/\d{4,8}\b)", 0.9), ("LICENSE_REF", r"(\bHMO/\d{4,8}\b)", 0.9), ("LICENSE_REF", r"(\b\d{6,8}\b)", 0.9), ("LICENSE_REF", r"(\b[A-Z]{1,3}\d{4,8}\b)", 0.9),
)
FALLBACK = (("council", r"(?i)(\b\w+\s+(?:council|borough|authority)\b)", 0.6), ("reference", r"(\b[A-Z]{2,4}[/-]?\d{3,8}\b)", 0.7), ("date", r"(\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b)", 0.5))
HEADER_WORDS = ("name", "address", "date", "reference", "licence", "license")
KEYWORDS = ("licence", "license", "hmo", "occupancy", "manager", "holder")


def find_all(text: Column, *patterns: str) -> Column:
    """The first group of every match of each pattern in turn."""
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in patterns]
    return found[0] if len(found) == 1 else F.concat(*found)


def basic_data(text: Column) -> dict[str, Column]:
    """Candidate references and dates (distinct, sorted), the first ten addresses, and numbers with their repeats."""
    return {
        "potential_references": F.array_sort(F.array_distinct(find_all(text, *BASIC_REFERENCES))),
        "potential_addresses": F.slice(find_all(text, BASIC_ADDRESS), 1, 10),
        "potential_dates": F.array_sort(F.array_distinct(find_all(text, *BASIC_DATES))),
        "potential_numbers": F.transform(find_all(text, *BASIC_NUMBERS), lambda x: x.try_cast("int")),
    }


def capitalize_words(c: Column) -> Column:
    """Each word's first letter upper case, the rest lower, words by single spaces."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def normalize_address(c: Column) -> Column:
    out = F.regexp_replace(strip(c), r"\s+", " ")
    for short, long in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"(?i)\b{short}\b", long)
    return capitalize_words(out)


def address_candidates(line: Column) -> Column:
    """Addresses in a line, normalized, with confidences: street addresses, then up to 100 characters before each postcode and the postcode."""
    kind = "array<struct<text:string,confidence:double>>"
    street = F.transform(find_all(line, STREET), lambda t: F.struct(normalize_address(t).alias("text"), F.lit(0.8).alias("confidence")))
    codes = find_all(line, POSTCODE_LINE)
    ends = F.aggregate(
        codes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda s, code: F.struct(
            (_locate(line, code, s["at"]) + F.length(code) - 1).alias("at"),
            F.concat(s["spans"], F.array(F.struct(_locate(line, code, s["at"]).alias("start"), (_locate(line, code, s["at"]) + F.length(code) - 1).alias("stop")))).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    long = F.filter(ends, lambda x: F.length(strip(F.substring(line, F.lit(1), x["start"] - 1))) > 10)
    full = F.transform(long, lambda x: F.struct(normalize_address(F.substring(line, F.greatest(F.lit(1), x["start"] - 100), x["stop"] - F.greatest(F.lit(1), x["start"] - 100) + 1)).alias("text"), F.lit(0.9).alias("confidence")))
    return F.concat(street.cast(kind), full.cast(kind))


def _locate(text: Column, part: Column, after: Column) -> Column:
    """Place (from 1) of the first `part` in text after that many characters."""
    return F.call_function("locate", part, text, after + 1)


def normalize_date(c: Column, compat: bool = False) -> Column:
    """A date found in text as Y-m-d; null if it is none. Day before month unless that can't be. compat: so even after a leading year."""
    s = strip(c)

    def ymd(y: Column, a: Column, b: Column, day_first: bool) -> Column:
        first, other = ((a, b) if not day_first else (b, a)), ((b, a) if not day_first else (a, b))
        return F.coalesce(F.concat_ws("-", y, *first).try_cast("date"), F.concat_ws("-", y, *other).try_cast("date"))

    part = lambda p, i: F.regexp_extract(s, p, i)
    iso, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    dm, md = r"(?i)^(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})$", r"(?i)^([a-z]{3})[a-z]*\s+(\d{1,2}),?\s+(\d{4})$"
    month = lambda m: F.array_position(F.array(*[F.lit(x) for x in "jan feb mar apr may jun jul aug sep oct nov dec".split()]), F.lower(m)).cast("string")
    d = F.coalesce(
        F.when(s.rlike(iso), ymd(part(iso, 1), part(iso, 2), part(iso, 3), compat)),
        F.when(s.rlike(dmy), ymd(part(dmy, 3), part(dmy, 1), part(dmy, 2), True)),
        F.when(s.rlike(dm), F.concat_ws("-", part(dm, 3), month(part(dm, 2)), part(dm, 1)).try_cast("date")),
        F.when(s.rlike(md), F.concat_ws("-", part(md, 3), month(part(md, 1)), part(md, 2)).try_cast("date")),
    )
    return F.when(F.year(d).between(1900, 2100), d.cast("string"))


def dates(text: Column, compat: bool = False) -> Column:
    """Normalized dates in the order of the patterns, then of the text."""
    return F.filter(F.transform(find_all(text, *DATES), lambda d: normalize_date(d, compat)), lambda d: d.isNotNull())


def is_reference(c: Column) -> Column:
    """At least 4 characters, one of them a letter or digit, and at least 6 if all are letters or all digits."""
    return F.coalesce((F.length(c) >= 4) & c.rlike("[A-Za-z0-9]") & ~(c.rlike(r"^(\p{L}+|\d+)$") & (F.length(c) < 6)), F.lit(False))


def references(text: Column, distinct: bool = False) -> Column:
    """Upper-case references in the order of the patterns, with repeats unless distinct."""
    code = F.transform(find_all(text, *REFERENCES), lambda r: F.when(r.contains(":"), strip(F.regexp_replace(r, "^[^:]*:", ""))).otherwise(r))
    out = F.transform(F.filter(code, is_reference), F.upper)
    return F.array_distinct(out) if distinct else out


def is_name(c: Column) -> Column:
    """Two words or more, each with a capital first, no digits."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}")) & ~c.rlike(r"\d")


def is_likely_name(c: Column) -> Column:
    return ~F.lower(c).rlike("|".join(NO_NAMES)) & is_name(c)


def normalize_name(c: Column) -> Column:
    """Words capitalized, and so the parts around an apostrophe."""
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    words = F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, "'"), cap), "'")), " ")


def names(text: Column) -> Column:
    """Names by context (0.8), then capitalized words that aren't among them (0.6).

    Both finds are bound in a struct first: inside a lambda they would be searched for again for each element.
    """
    found = F.array(F.struct(F.filter(find_all(text, *NAMES), is_name).alias("known"), find_all(text, CAPITALIZED).alias("caps")))
    made = lambda a, c: F.transform(a, lambda n: F.struct(normalize_name(n).alias("text"), F.lit(c).alias("confidence")))
    both = F.transform(found, lambda s: F.concat(made(s["known"], 0.8), made(F.filter(s["caps"], lambda n: ~F.array_contains(s["known"], n) & is_likely_name(n)), 0.6)))
    return F.get(both, F.lit(0))


def _tagged(text: Column, pattern: str, **tags: Column) -> Column:
    return F.transform(find_all(text, pattern), lambda t: F.struct(*[c.alias(n) for n, c in tags.items()], t.alias("text")))


def ruler(text: Column) -> Column:
    """(label, text) of the rule set's entities."""
    return F.concat(*[_tagged(text, p, label=F.lit(label)) for label, p in RULER])


def entities(text: Column) -> Column:
    """(label, text, confidence) of addresses, dates and references: the rule set's and those of plain patterns, with repeats."""
    kinds = {"LICENSE_REF": "LICENSE_REF", "DATE_PATTERN": "DATE"}
    known = F.transform(F.filter(ruler(text), lambda e: e["label"].isin(*kinds)), lambda e: F.struct(F.when(e["label"] == "DATE_PATTERN", "DATE").otherwise(e["label"]).alias("label"), e["text"].alias("text"), F.lit(0.9).alias("confidence")))

    def made(label: str, pattern: str, score: float) -> Column:
        return F.transform(find_all(text, pattern), lambda t: F.struct(F.lit(label).alias("label"), strip(t).alias("text"), F.lit(score).alias("confidence")))

    return F.concat(known, *[made(*x) for x in ENTITY_PATTERNS])


def address_count(text: Column) -> Column:
    """How many of `entities` are addresses, in time linear in the text: its patterns take one of each run of letters and spaces with a street's word after its first character, and one of each run after a number where that word ends a word."""
    first = "".join(sorted({w[0] for w in _STREETS.split("|")}))
    street = rf"(?=[{first}])(?:{_STREETS})"
    return F.regexp_count(text, F.lit(rf"(?i)\d\s[A-Za-z\s]+?{street}\b")) + F.regexp_count(text, F.lit(rf"(?i)[A-Za-z\s]{street}[A-Za-z\s]*+"))


def person_names(found: Column) -> Column:
    """The texts of the persons among entities (label, text) of a model of names (X15), such as operators.entities."""
    return F.transform(F.filter(found, lambda e: e["label"] == "PERSON"), lambda e: e["text"])


def fallback(text: Column) -> Column:
    """(kind, confidence, text) of the plain patterns."""
    return F.concat(*[_tagged(text, p, kind=F.lit(kind), confidence=F.lit(score)) for kind, p, score in FALLBACK])


def looks_like_header(row: Column) -> Column:
    """Whether more than half of a row's cells look like headings."""
    cell = lambda x: (strip(x) != "") & (F.lower(x).rlike("|".join(HEADER_WORDS)) | ((F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 2)) | x.rlike("[:#]") | (x.rlike(r"^[\p{L} ]+$") & (F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) <= 3)))
    return (F.size(row) > 0) & (F.size(F.filter(row, cell)) * 2 > F.size(row))


def needs_ocr(text: Column) -> Column:
    """Less than 100 characters, or less than a tenth of them letters or digits."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.coalesce((F.length(strip(text)) < 100) | (F.try_divide(kept, F.length(text)) < 0.1), F.lit(True))


def estimated_records(text: Column) -> Column:
    """A fifth of the keyword hits, at least one."""
    hits = sum((F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(k)) for k in KEYWORDS), F.lit(0))
    return F.greatest(F.lit(1), F.floor(hits / 5).cast("int"))


def line_kind(line: Column) -> Column:
    """What a line of a document sets, by the first word group it has a part of (R2)."""
    low = F.lower(line)
    return when_first((low.rlike("council|authority|borough"), "council"), (low.rlike("hmo|reference|licence"), "reference"), (low.rlike("address|property"), "hmo_address"), (low.rlike("manager|holder"), "hmo_manager_name"), (low.rlike("occupancy|persons"), "max_occupancy"))
