"""Names, markers and other short strings of documents, as column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.functions import numbers


def _chars():
    return (chr(n) for n in range(0x80, 0x1E944) if unicodedata.category(chr(n))[0] == "L")


@functools.cache
def _wide_uppers() -> str:
    """Characters whose upper-case form is several characters; as single ones they stay as they are."""
    return "".join(c for c in _chars() if len(c.upper()) > 1)


@functools.cache
def _least_of_orbits() -> tuple[str, str]:
    """Characters and the least character that case folding takes for the same, where it is another one."""
    least: dict[str, str] = {}
    for c in [*map(chr, range(0x80)), *_chars()]:
        key = c.lower() if len(c.lower()) == 1 else c
        key = key.upper().lower() if len(key.upper()) == 1 and len(key.upper().lower()) == 1 else key
        least[key] = min(least.get(key, c), c)
    pairs = []
    for c in [*map(chr, range(0x80)), *_chars()]:
        key = c.lower() if len(c.lower()) == 1 else c
        key = key.upper().lower() if len(key.upper()) == 1 and len(key.upper().lower()) == 1 else key
        if least[key] != c:
            pairs.append((c, least[key]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_key(s: Column) -> Column:
    """Each character as the least of those that differ from it in case only, so that names equal but for case have one key."""
    return F.translate(s, *_least_of_orbits())


def upper(s: Column) -> Column:
    """Upper case character by character: those without a single upper-case form stay."""
    wide = _wide_uppers()
    spare = "".join(map(chr, range(0xF0000, 0xF0000 + len(wide))))
    return F.translate(F.upper(F.translate(s, wide, spare)), spare, wide)


def capitalize(s: Column) -> Column:
    """The first character, and each after white space, in upper case; the rest as it is."""
    parts = F.split(s, r"(?<=\s)(?=\S)")
    return F.array_join(F.transform(parts, lambda w: F.concat(upper(F.substring(w, 1, 1)), F.substring(w, 2, sys.maxsize >> 32))), "")


#: Bullets of list styles. Fixed values.
BULLETS = {"none": "", "disc": "•", "circle": "◦", "square": "▪"}


def list_marker(style: Column, n: Column) -> Column:
    """The marker of a list's n-th item in a style; an unknown style has a bullet."""
    roman, alpha = numbers.roman(n), F.when(n < 1, n.cast("string")).otherwise(numbers.letters_bijective(n))
    counted = {"decimal": n.cast("string"), "lower-alpha": alpha, "upper-alpha": F.upper(alpha), "lower-roman": roman, "upper-roman": F.upper(roman)}
    out = F.lit("•")
    for k, v in {**{k: F.lit(v) for k, v in BULLETS.items()}, **{k: F.concat(v, F.lit(".")) for k, v in counted.items()}}.items():
        out = F.when(style == k, v).otherwise(out)
    return out


def css_class(style_id: Column) -> Column:
    return F.concat(F.lit("s-"), F.regexp_replace(style_id, "[^A-Za-z0-9_-]", "_"))


def symbol(code: Column) -> Column:
    """A character reference for a hexadecimal code, without the F0 of the private area; empty if there is none."""
    n = F.conv(F.regexp_replace(code, "^F0", ""), 16, 10).cast("bigint")
    return F.when(F.regexp_replace(code, "^F0", "").rlike("^[0-9A-Fa-f]{1,7}$") & (n > 0), F.concat(F.lit("&#"), n.cast("string"), F.lit(";"))).otherwise("")


#: Latin ligatures and what they stand for. Fixed values.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def split_ligatures(s: Column) -> Column:
    for c, parts in LIGATURES:
        s = F.replace(s, F.lit(c), F.lit(parts))
    return s


def untagged(font: Column) -> Column:
    """A font's name without the tag of a subset."""
    return F.when((F.length(font) > 7) & (F.substring(font, 7, 1) == "+"), F.substring(font, 8, 1 << 20)).otherwise(font)


def html_family(font: Column) -> Column:
    """The family that a font is asked for by in markup."""
    name = F.regexp_extract(untagged(font), r"(?s)^(.[^,+]*)?", 0)
    return F.when(F.coalesce(name, F.lit("")) == "", "serif").when(name.rlike("""[ ;:'"]"""), F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("")), F.lit("'"))).otherwise(name)


def fold_name(family: Column) -> Column:
    return F.regexp_replace(F.lower(family), "[^a-z0-9]", "")


#: Family words, and what they say. Fixed values.
_SAYS = {"bold": "bold|black|heavy", "italic": "italic|oblique", "fixed": "mono|courier", "serif": "times|serif|roman|georgia|book"}
#: The fourteen standard fonts by family, plain, bold, italic and both. Fixed values.
STANDARD = {
    "Courier": ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique"),
    "Helvetica": ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique"),
    "Times": ("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic"),
}
#: Families that stand for a standard one. Fixed values.
ALIASES = {"Arial": "Helvetica", "CourierNew": "Courier", "TimesNewRoman": "Times"}


def standard_font(font: Column, serif: Column, fixed: Column, symbolic: Column, bold: Column, italic: Column) -> Column:
    """The standard font that stands in for a font, by its name and the flags of its descriptor."""
    name = F.trim(untagged(font))
    low = F.lower(name)
    says = {k: low.rlike(v) for k, v in _SAYS.items()}

    def styled(family: str, b: Column, i: Column) -> Column:
        plain, fat, slanted, both = STANDARD[family]
        return F.when(b & i, both).when(b, fat).when(i, slanted).otherwise(plain)

    by_flags = lambda family: styled(family, bold | says["bold"], italic | says["italic"])
    out = F.when(symbolic & low.contains("dingbat"), "ZapfDingbats").when(symbolic & low.contains("symbol"), "Symbol")
    out = out.when(fixed | says["fixed"], by_flags("Courier")).when(serif | says["serif"], by_flags("Times")).otherwise(by_flags("Helvetica"))
    plain = F.regexp_replace(name, r"(PS)?(MT)?(?=[,-]|$)", "")
    family, style = F.substring_index(F.substring_index(plain, ",", 1), "-", 1), F.lower(F.regexp_extract(plain, "[,-](.*)$", 1))
    for alias, family_of in ALIASES.items():
        out = F.when((family == alias) & style.isin("", "bold", "italic", "bolditalic"), styled(family_of, style.startswith("bold"), style.endswith("italic"))).otherwise(out)
    return F.when(name.isin(*[x for v in STANDARD.values() for x in v], "Symbol", "ZapfDingbats"), name).otherwise(out)


#: Pairs that mirror each other in text from right to left. Fixed values, of the common ones.
MIRRORED = "()<>[]{}«»‹›⁅⁆⁽⁾₍₎≤≥〈〉《》「」『』【】"


def mirror(s: Column) -> Column:
    return F.translate(s, MIRRORED, "".join(b + a for a, b in zip(MIRRORED[::2], MIRRORED[1::2], strict=True)))


@functools.cache
def _not_left_to_right() -> str:
    """A class of the characters that make a text bidirectional, by their property."""
    kinds, found = {"R", "AL", "AN", "RLE", "RLO", "RLI", "LRE", "LRO", "LRI", "FSI", "PDF", "PDI"}, []
    for n in range(0x590, 0x1F000):
        if unicodedata.bidirectional(chr(n)) in kinds:
            if found and found[-1][1] == n - 1:
                found[-1][1] = n
            else:
                found.append([n, n])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in found) + "]"


def needs_bidi(s: Column) -> Column:
    """Whether a text has characters that do not run from left to right."""
    return s.rlike(_not_left_to_right())


#: Ranges of characters that a font has to lay out itself. Fixed values.
SHAPED = ((0x300, 0x36F), (0x590, 0x109F), (0x1700, 0x18AF), (0x1900, 0x1CFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xA800, 0xABFF), (0xFB1D, 0xFDFF), (0xFE00, 0xFE2F), (0xFE70, 0xFEFF), (0x10800, 0x10FFF), (0x11000, 0x11FFF), (0x1E800, 0x1EFFF))


def needs_shaping(s: Column) -> Column:
    return s.rlike("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SHAPED) + "]")


def base32(digits: Column) -> Column:
    """The number that digits 0 to V spell, up to 2^31; null for anything else."""
    n = F.conv(digits, 32, 10).cast("decimal(38,0)")
    return F.when(digits.rlike("^[0-9A-V]{1,16}$") & (n <= 1 << 31), n.cast("bigint"))


def office_color(s: Column) -> Column:
    """#rrggbb of six hexadecimal digits, with or without a mark before them; empty for anything else."""
    return F.coalesce(F.lower(F.concat(F.lit("#"), F.nullif(F.regexp_extract(F.trim(s), "^#?([0-9A-Fa-f]{6})$", 1), F.lit("")))), F.lit(""))


def image_type(content: Column) -> Column:
    """The media type of a picture by its first bytes; empty if it is none."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.when(head.startswith("FFD8"), "image/jpeg").when(head == "89504E470D0A1A0A", "image/png").when(head.rlike("^47494638(37|39)61"), "image/gif").when(head.startswith("424D"), "image/bmp")
    return F.when(F.octet_length(content) >= 9, F.coalesce(kind, F.lit(""))).otherwise("")


def has_word(words: Column, want: Column | str) -> Column:
    """Whether a list set apart by white space holds a word."""
    return F.array_contains(F.split(F.trim(F.regexp_replace(words, r"\s+", " ")), " "), want)


def html_document(title: Column, body: Column) -> Column:
    """A page of its own around the markup of its body."""
    from docframe.functions.text import html_escape

    return F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"/><title>'), html_escape(title), F.lit("</title></head><body>\n"), body, F.lit("</body></html>\n"))


def plain_markup(s: Column) -> Column:
    """Plain text as markup that keeps its white space."""
    from docframe.functions.text import html_escape

    return F.concat(F.lit("<pre>"), html_escape(s), F.lit("</pre>"))
