"""Text and identity functions: entities, markup, section keys, references. All take and return columns; none is a UDF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space, beyond the regex engine's own ASCII set.
SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Named entities, in the order in which they are decoded.
NAMED_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&ndash;", "-"), ("&mdash;", "-"), ("&shy;", ""))
#: Word endings that a stem loses, in the order in which they are tried.
SUFFIXES = ("ies", "ing", "ers", "tion", "ment", "ness", "able", "ible", "ous", "ive", "ed", "es", "er", "ly", "s")
#: Tags that begin or end a line.
_BLOCK_TAGS = "p|div|li|ul|ol|tr|td|th|table|tbody|thead|tfoot|h[1-6]"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _accented() -> tuple[str, str]:
    """Latin letters that are an ASCII letter with a single mark, and those letters."""
    found = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]):
            found.append((chr(code), parts[0]))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


ACCENTED, PLAIN = _accented()


def spaced(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES + "+", " "))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _CAPITALS, _SMALL)


def like_ascii(c: Column, pattern: str) -> Column:
    """LIKE without case for ASCII letters; % and _ are wildcards and nothing escapes them.

    What stands between two % is found where it first comes after what is before it, and never sought again further on, so
    that a text is read once.
    """
    def said(part: str) -> str:
        return "".join("." if x == "_" else x if x.isascii() and x.isalnum() else f"\\x{{{ord(x):X}}}" for x in part)

    first, *rest = (said(p) for p in pattern.split("%"))
    between = "".join(f"(?>.*?{p})" for p in rest[:-1] if p)
    end = (f".*{rest[-1]}\\z" if rest[-1] else "") if rest else "\\z"
    return c.rlike(rf"(?is)\A{first}{between}{end}")


def named_entities(c: Column) -> Column:
    for entity, said in NAMED_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(said))
    return c


def _code_points(c: Column, pattern: str, base: int) -> Column:
    """Numeric references become characters, each distinct one in turn; out of range, they stay."""
    digits = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))
    whole = ("&#x", ";") if base == 16 else ("&#", ";")

    def put(text: Column, d: Column) -> Column:
        number = F.conv(F.ltrim(d, F.lit("0")), base, 16) if base == 16 else F.hex(F.try_to_number(F.lpad(d, 12, "0"), F.lit("999999999999")).cast("long"))
        wide = F.lpad(F.when(F.length(number) == 0, "0").otherwise(number), 8, "0")
        valid = (F.length(d) <= 7) & (wide <= "0010FFFF") & ~wide.between("0000D800", "0000DFFF")
        return F.when(valid, F.replace(text, F.concat(F.lit(whole[0]), d, F.lit(whole[1])), F.decode(F.unhex(wide), "UTF-32"))).otherwise(text)

    return F.when(F.contains(c, F.lit("&#")), F.aggregate(digits, c, put)).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Named entities in their order, then decimal, then hexadecimal references."""
    return _code_points(_code_points(named_entities(c), r"&#(\d+);", 10), r"&#x([0-9a-fA-F]+);", 16)


def normalize(c: Column) -> Column:
    """White space collapsed; none before punctuation or inside brackets."""
    c = F.regexp_replace(c, SPACES + "+", " ")
    c = F.regexp_replace(c, " +([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\( +", "("), r" +\)", ")"))


def strip_markup(c: Column) -> Column:
    """Footnotes go, breaks and blocks become line ends, other tags vanish."""
    c = F.regexp_replace(c, r'(?i)<sup[^>]*class="fnSup"[^>]*>[\s\S]*?</sup>', "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, rf"(?i)</?(?:{_BLOCK_TAGS})[^>]*>", "\n")
    return F.regexp_replace(c, r"<[^>]+>", "")


def html_to_text(c: Column) -> Column:
    return normalize(decode_entities(strip_markup(c)))


def html_to_text_spaced(c: Column) -> Column:
    """Any tag becomes a space; punctuation stays where it is."""
    return spaced(decode_entities(F.regexp_replace(c, r"<[^>]+>", " ")))


def section_from_marker(c: Column) -> Column:
    return F.regexp_replace(html_to_text(c), r"[§.\s]", "")


def section_from_key(c: Column) -> Column:
    split = F.when(c.rlike(r"^\d+[A-Z]+\z"), F.regexp_replace(c, r"^(\d+)([A-Z]+)\z", "$1/$2")).otherwise(c)
    return F.when(c.startswith("ART_"), F.substr(c, F.lit(5))).when(c.startswith("LEGACY_"), F.substr(c, F.lit(8))).otherwise(split)


def section_to_key(c: Column) -> Column:
    known = c.rlike(r"^\d+(/[A-Za-z]+)?\z")
    return F.when(known, F.upper(F.replace(c, F.lit("/"), F.lit("")))).otherwise(F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", "")))


def key_from_block_id(c: Column) -> Column:
    """Null where the id names no section."""
    return F.when(c.rlike(r"^SZ\d+[A-Z]*(@.*)?\z"), F.regexp_extract(c, r"^SZ(\d+[A-Z]*)", 1))


def section_from_text(c: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(c, r"^(\d+[A-Za-z]?(?:/[A-Za-z]+)?)\s*\.?\s*§", 1), F.lit("")))


def article_from_text(c: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(c, r"(?i)^([IVXLCDM]+|\d+)\s*\.\s*(?:Czikk|Cikk)\.?", 1), F.lit("")))


def article_key(c: Column) -> Column:
    return F.concat(F.lit("ART_"), F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", "")))


def title_from_key(key: Column, section: Column) -> Column:
    return F.when(key.startswith("ART_"), F.concat(section, F.lit(". Cikk"))).when(key.startswith("LEGACY_"), section).otherwise(F.concat(section, F.lit(". §")))


def provision_ref(section: Column) -> Column:
    return F.concat(F.lit("s"), F.lower(F.regexp_replace(section, "[^0-9A-Za-z]", "")))


def section_number(ref: Column) -> Column:
    return F.regexp_replace(ref, "^s", "")


def roman_to_arabic(c: Column) -> Column:
    """Subtractive numerals; any other character counts nothing."""
    values = F.create_map(*(F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair))
    each = F.transform(F.split(F.upper(c), ""), lambda x: F.coalesce(F.try_element_at(values, x), F.lit(0)))
    after = F.concat(F.slice(each, 2, F.greatest(F.size(each), F.lit(1))), F.array(F.lit(0)))
    signed = F.zip_with(each, after, lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.aggregate(signed, F.lit(0), lambda s, x: s + x)


#: How a statute is formally cited.
FORMAL = rf"(?iu)(\d{{4}})\.{SPACES}*évi{SPACES}+([IVXLCDM]+)\.{SPACES}*törvény"


def formal_ref_to_id(c: Column) -> Column:
    """`2012. évi C. törvény` anywhere in a text: hu-law-2012-100-00-00; null without it."""
    return F.when(c.rlike(FORMAL), F.concat(F.lit("hu-law-"), F.regexp_extract(c, FORMAL, 1), F.lit("-"), roman_to_arabic(F.regexp_extract(c, FORMAL, 2)).cast("string"), F.lit("-00-00")))


def id_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(hu-law-\d{4}-\d+-\d{2}-\d{2})", 1), F.lit(""))


def stem(c: Column) -> Column:
    """A word of five letters or more without the first ending that leaves three; null where none does."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for suffix in reversed(SUFFIXES):
        out = F.when(low.endswith(suffix) & (F.length(low) - len(suffix) >= 3), F.substring(low, F.lit(1), F.length(low) - len(suffix))).otherwise(out)
    return F.when(F.length(c) >= 5, out)


def sanitized(c: Column) -> Column:
    """Query text without what a query parser might trip over."""
    boolean = c.rlike(r"(?<![0-9A-Za-z_])(AND|OR|NOT)(?![0-9A-Za-z_])")
    loose = F.regexp_replace(c, r"[{}\[\]^~*:]", " ")
    plain = F.regexp_replace(F.regexp_replace(c, r"['\"(){}\[\]^~:]", " "), rf"\*(?!{SPACES}|\z)", " ")
    return spaced(F.when(boolean, loose).otherwise(plain))


def like_pattern(c: Column) -> Column:
    return F.when(spaced(c) == "", F.lit("%")).otherwise(F.concat(F.lit("%"), F.replace(spaced(c), F.lit(" "), F.lit("%")), F.lit("%")))


def url_segment(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"/jogszabaly/([^/?#]+)", 1), F.lit(""))


def iso_date(c: Column) -> Column:
    """`YYYY. MM. DD.` as YYYY-MM-DD; null in any other form."""
    p = r"^\s*(\d{4})\.\s*(\d{2})\.\s*(\d{2})\.?"
    return F.when(c.rlike(p), F.concat_ws("-", *(F.regexp_extract(c, p, i) for i in (1, 2, 3))))


def status_of_class(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("now")), "in_force").when(F.contains(low, F.lit("future")), "not_yet_in_force").when(F.contains(low, F.lit("past")), "repealed").otherwise("amended")


def positive_or(c: Column, default: int) -> Column:
    number = F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("long")
    return F.when(number > 0, number).otherwise(F.lit(default).cast("long"))


def is_uuid(c: Column) -> Column:
    return c.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z")


def age_days(iso: Column, now: Column) -> Column:
    """Whole days from an ISO time to another; null where it is no time."""
    return F.floor((F.unix_millis(now) - F.unix_millis(iso.try_cast("timestamp"))) / 86_400_000)


def two_digit_year(raw: Column) -> Column:
    """A year of two digits belongs to 1950 to 2049; any other is taken as it stands."""
    y = raw.try_cast("int")
    return F.when(F.length(raw) == 2, F.when(y >= 50, 1900 + y).otherwise(2000 + y)).otherwise(y)
