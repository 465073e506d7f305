"""Queries over the column functions: names, style values, colours, geometry, page boxes, dates, vector grammars."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import colour, cssvalues, dates, geometry, strings
from docframe.operators import tables
from docframe.plans import builders
from docframe.plans.formats import _LINES, made
from docframe.plans.registry import dealt, query, read
from docframe.sources import documents, vector

col = F.col
_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_IDS = ", ".join(_ID)


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


# -- strings ------------------------------------------------------------------------------------


@query("SELECT doc_id, replace(upper(replace(text, 'ß', chr(1))), chr(1), 'ß') AS key FROM documents")
def fold_keys(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", strings.fold_key(col("text")).alias("key"))


_WORDS = "regexp_extract_all(text, '[ \\t\\n]*[^ \\t\\n]+|[ \\t\\n]+')"
_AT = "length(regexp_extract(w, '^[ \\t\\n]*', 0))"


@query(
    f"""SELECT doc_id, replace(upper(replace(text, 'ß', chr(1))), chr(1), 'ß') AS upper, lower(text) AS lower,
               array_to_string(list_transform({_WORDS}, lambda w: w[:{_AT}] || replace(upper(replace(w[{_AT} + 1:{_AT} + 1], 'ß', chr(1))), chr(1), 'ß') || w[{_AT} + 2:]), '') AS capitalized FROM documents"""
)
def text_transforms(spark, sf_dir):
    t = col("text")
    return read(spark, sf_dir, "documents").select("doc_id", strings.upper(t).alias("upper"), F.lower(t).alias("lower"), strings.capitalize(t).alias("capitalized"))


_STYLES = "['none', 'disc', 'circle', 'square', 'decimal', 'lower-alpha', 'upper-alpha', 'lower-roman', 'upper-roman', 'other']"
_ALPHA = "(CASE WHEN n > 702 THEN chr((97 + ((n - 703) // 676) % 26)::INT) ELSE '' END) || (CASE WHEN n > 26 THEN chr((97 + ((n - 27) // 26) % 26)::INT) ELSE '' END) || chr((97 + (n - 1) % 26)::INT)"
_ROMAN = "array_to_string(['', 'm', 'mm', 'mmm'][n // 1000 + 1:n // 1000 + 1] || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1:n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1:n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1:n % 10 + 1], '')"


@query(
    f"""SELECT o_orderkey, style, n, CASE style WHEN 'none' THEN '' WHEN 'circle' THEN '◦' WHEN 'square' THEN '▪' WHEN 'decimal' THEN n || '.' WHEN 'lower-alpha' THEN {_ALPHA} || '.' WHEN 'upper-alpha' THEN upper({_ALPHA}) || '.'
               WHEN 'lower-roman' THEN {_ROMAN} || '.' WHEN 'upper-roman' THEN upper({_ROMAN}) || '.' ELSE '•' END AS marker
        FROM (SELECT o_orderkey, {_STYLES}[1 + o_custkey % 10] AS style, 1 + o_orderkey % 3999 AS n FROM orders)"""
)
def list_markers(spark, sf_dir):
    styles = F.array(*map(F.lit, ("none", "disc", "circle", "square", "decimal", "lower-alpha", "upper-alpha", "lower-roman", "upper-roman", "other")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.get(styles, (col("o_custkey") % 10).cast("int")).alias("style"), (1 + col("o_orderkey") % 3999).alias("n"))
    return rows.select("*", strings.list_marker(col("style"), col("n")).alias("marker"))


@query("SELECT p_partkey, 's-' || translate(p_brand || ' ' || p_type, '# ', '__') AS class, '&#' || (33 + p_partkey % 5000) || ';' AS symbol, '#' || lower(printf('%06X', p_partkey * 7919 % 16777216)) AS color FROM part")
def office_names(spark, sf_dir):
    """Class names of styles, characters of symbol fonts, colours."""
    code, rgb = F.hex(33 + col("p_partkey") % 5000), F.lpad(F.hex(col("p_partkey") * 7919 % 16777216), 6, "0")
    code = F.concat(F.lit("F0"), F.lpad(code, 4, "0"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", strings.css_class(F.concat_ws(" ", "p_brand", "p_type")).alias("class"), strings.symbol(code).alias("symbol"), strings.office_color(F.concat(F.lit(" "), rgb)).alias("color")
    )


@query("SELECT doc_id, text FROM documents")
def ligatures_split(spark, sf_dir):
    """Texts set with ligatures, and read as what these stand for."""
    t = col("text")
    for c, parts in sorted(strings.LIGATURES[:5], key=lambda p: -len(p[1])):
        t = F.replace(t, F.lit(parts), F.lit(c))
    return read(spark, sf_dir, "documents").select("doc_id", strings.split_ligatures(t).alias("text"))


_FACE = "['Arial', 'Times New Roman', 'CourierNew', 'Georgia', 'Book Antiqua', 'DejaVuSansMono', 'Verdana', 'Symbol', 'Helvetica', 'ArialMT'][1 + p_partkey % 10]"
_STYLE = "['', ',Bold', '-Italic', '-BoldItalic', '-Black'][1 + p_partkey // 10 % 5]"


@query(
    f"""SELECT p_partkey, CASE WHEN contains({_FACE}, ' ') THEN '''' || {_FACE} || CASE WHEN {_STYLE} = ',Bold' THEN '' ELSE {_STYLE} END || '''' WHEN {_STYLE} = ',Bold' THEN {_FACE} ELSE {_FACE} || {_STYLE} END AS family,
               lower(replace({_FACE}, ' ', '')) || replace(replace(lower({_STYLE}), ',', ''), '-', '') AS folded,
               CASE WHEN {_FACE} IN ('Symbol', 'Helvetica') AND {_STYLE} = '' THEN {_FACE}
                    WHEN {_FACE} IN ('CourierNew', 'DejaVuSansMono') THEN 'Courier' || CASE {_STYLE} WHEN '' THEN '' WHEN '-Italic' THEN '-Oblique' WHEN '-BoldItalic' THEN '-BoldOblique' ELSE '-Bold' END
                    WHEN {_FACE} IN ('Times New Roman', 'Georgia', 'Book Antiqua') THEN 'Times' || CASE {_STYLE} WHEN '' THEN '-Roman' WHEN '-Italic' THEN '-Italic' WHEN '-BoldItalic' THEN '-BoldItalic' ELSE '-Bold' END
                    ELSE 'Helvetica' || CASE {_STYLE} WHEN '' THEN '' WHEN '-Italic' THEN '-Oblique' WHEN '-BoldItalic' THEN '-BoldOblique' ELSE '-Bold' END END AS standard FROM part"""
)
def font_names(spark, sf_dir):
    faces = F.array(*map(F.lit, ("Arial", "Times New Roman", "CourierNew", "Georgia", "Book Antiqua", "DejaVuSansMono", "Verdana", "Symbol", "Helvetica", "ArialMT")))
    styles = F.array(*map(F.lit, ("", ",Bold", "-Italic", "-BoldItalic", "-Black")))
    plain = F.concat(F.get(faces, (col("p_partkey") % 10).cast("int")), F.get(styles, (F.floor(col("p_partkey") / 10) % 5).cast("int")))
    tagged = F.when(col("p_partkey") % 3 == 0, F.concat(F.lit("ABCDEF+"), plain)).otherwise(plain)
    no = F.lit(False)
    return read(spark, sf_dir, "part").select("p_partkey", strings.html_family(tagged).alias("family"), strings.fold_name(strings.untagged(tagged)).alias("folded"), strings.standard_font(tagged, no, no, no, no, no).alias("standard"))


@query(
    """SELECT doc_id, translate(text, '()[]<>{}', ')(][><}{') AS mirrored, doc_id % 4 = 1 AS bidi, doc_id % 4 IN (1, 2) AS shaping FROM documents"""
)
def direction_tests(spark, sf_dir):
    """Texts with a word of another script put in: which need bidirectional treatment, which a shaping font."""
    word = F.when(col("doc_id") % 4 == 1, " שלום ").when(col("doc_id") % 4 == 2, " नमस्ते ").when(col("doc_id") % 4 == 3, " привет ").otherwise("")
    t = F.concat("text", word)
    return read(spark, sf_dir, "documents").select("doc_id", strings.mirror(col("text")).alias("mirrored"), strings.needs_bidi(t).alias("bidi"), strings.needs_shaping(t).alias("shaping"))


@query("SELECT o_orderkey, (o_orderkey * 37 + 5)::BIGINT AS number FROM orders")
def base32_numbers(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", strings.base32(F.upper(F.conv(col("o_orderkey") * 37 + 5, 10, 32))).alias("number"))


@query("SELECT doc_id, ['image/jpeg', 'image/png', 'image/gif', 'image/bmp', ''][1 + doc_id % 5] AS type, contains(' ' || source || ' x ', ' src1 ') AS listed FROM documents")
def picture_types(spark, sf_dir):
    heads = F.array(*(F.unhex(F.lit(h)) for h in ("FFD8FFE000104A464946", "89504E470D0A1A0A0000", "47494638396101000100", "424D3600000000003600", "00010203040506070809")))
    return read(spark, sf_dir, "documents").select("doc_id", strings.image_type(F.get(heads, (col("doc_id") % 5).cast("int"))).alias("type"), strings.has_word(F.concat_ws("\t", "source", F.lit("x")), "src1").alias("listed"))


@query(
    """SELECT doc_id, '<pre>' || e || '</pre>' AS markup, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"/><title>Document ' || doc_id || '</title></head><body>' || chr(10) || '<pre>' || e || '</pre></body></html>' || chr(10) AS page
       FROM (SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS e FROM documents)"""
)
def text_as_markup(spark, sf_dir):
    markup = strings.plain_markup(col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", markup.alias("markup"), strings.html_document(F.concat(F.lit("Document "), col("doc_id").cast("string")), markup).alias("page"))


# -- style values -------------------------------------------------------------------------------

_UNITS = "['px', 'pt', 'pc', 'in', 'cm', 'mm', 'q', 'em', 'rem', 'ex', 'ch', '%', '', 'zz']"


@query(
    f"""SELECT {_IDS}, round(CASE u WHEN 'px' THEN q WHEN 'pt' THEN q * 4 / 3 WHEN 'pc' THEN q * 16 WHEN 'in' THEN q * 96 WHEN 'cm' THEN q * 96 / 2.54 WHEN 'mm' THEN q * 96 / 25.4 WHEN 'q' THEN q * 96 / 101.6 WHEN 'em' THEN q * 20
               WHEN 'rem' THEN q * 16 WHEN 'ex' THEN q * 10 WHEN 'ch' THEN q * 10 WHEN '%' THEN q * 4 END, 6) AS px,
               round(CASE u WHEN 'px' THEN q WHEN '' THEN q WHEN 'pt' THEN q * 4 / 3 WHEN 'pc' THEN q * 16 WHEN 'in' THEN q * 96 WHEN 'cm' THEN q * 96 / 2.54 WHEN 'mm' THEN q * 96 / 25.4 WHEN 'em' THEN q * 20 WHEN 'ex' THEN q * 10 WHEN '%' THEN q * 4 END, 6) AS units
        FROM (SELECT *, (l_quantity / 4)::DOUBLE AS q, {_UNITS}[1 + l_partkey % 14] AS u FROM lineitem)"""
)
def css_lengths(spark, sf_dir):
    units = F.array(*map(F.lit, ("px", "pt", "pc", "in", "cm", "mm", "q", "em", "rem", "ex", "ch", "%", "", "zz")))
    s = F.concat((col("l_quantity") / 4).cast("string"), F.get(units, (col("l_partkey") % 14).cast("int")))
    em, root, against = F.lit(20.0), F.lit(16.0), F.lit(400.0)
    return _lines(spark, sf_dir).select(*_ID, F.round(cssvalues.length(s, em, root, against), 6).alias("px"), F.round(cssvalues.drawing_length(F.upper(s), against, em), 6).alias("units"))


_FONT = "['medium', 'xx-small', 'x-large', 'smaller', 'larger', '150%', '2em', '12pt', 'bad', '-3px'][1 + l_partkey % 10]"
_WEIGHT = "['normal', 'bold', 'bolder', 'lighter', '350', '1200', 'thin'][1 + l_partkey % 7]"


@query(
    f"""SELECT {_IDS}, round(CASE {_FONT} WHEN 'medium' THEN 16 WHEN 'xx-small' THEN 9.6 WHEN 'x-large' THEN 24 WHEN 'smaller' THEN q / 1.2 WHEN 'larger' THEN q * 1.2 WHEN '150%' THEN q * 1.5 WHEN '2em' THEN q * 2 WHEN '12pt' THEN 16 WHEN '-3px' THEN 0 END, 6) AS size,
               CASE {_WEIGHT} WHEN 'normal' THEN 400 WHEN 'bold' THEN 700 WHEN 'bolder' THEN CASE WHEN w < 400 THEN 400 WHEN w < 600 THEN 700 ELSE 900 END WHEN 'lighter' THEN CASE WHEN w > 700 THEN 700 WHEN w > 500 THEN 400 ELSE 100 END WHEN '350' THEN 350 END AS weight
        FROM (SELECT *, l_quantity::DOUBLE AS q, (l_suppkey % 10) * 100 AS w FROM lineitem)"""
)
def font_values(spark, sf_dir):
    sizes = F.array(*map(F.lit, ("medium", "xx-small", "x-large", "smaller", "larger", "150%", "2em", "12pt", "bad", "-3px")))
    weights = F.array(*map(F.lit, ("normal", "bold", "bolder", "lighter", "350", "1200", "thin")))
    pick = lambda a, n: F.get(a, (col("l_partkey") % n).cast("int"))
    q, w = col("l_quantity").cast("double"), (col("l_suppkey") % 10) * 100
    return _lines(spark, sf_dir).select(*_ID, F.round(cssvalues.font_size(pick(sizes, 10), q, F.lit(16.0)), 6).alias("size"), cssvalues.font_weight(pick(weights, 7), w).alias("weight"))


@query("SELECT p_partkey, p_name || '|' || p_brand || ', Inc|' || p_type AS families FROM part")
def font_families(spark, sf_dir):
    s = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" , '"), col("p_brand"), F.lit(", Inc', "), col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(cssvalues.families(s), "|").alias("families"))


_NAMES = "['Red', 'lime', 'blue', 'orange', 'rebeccapurple', 'TAN', 'teal', 'nocolor', 'white', 'darkslategrey']"
_RGB = "[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 165, 0], [102, 51, 153], [210, 180, 140], [0, 128, 128], NULL, [255, 255, 255], [47, 79, 79]]"


@query(f"SELECT p_partkey, c[1] AS r, c[2] AS g, c[3] AS b FROM (SELECT p_partkey, {_RGB}[1 + p_partkey % 10] AS c FROM part)")
def named_colors(spark, sf_dir):
    names = F.array(*map(F.lit, ("Red", "lime", "blue", "orange", "rebeccapurple", "TAN", "teal", "nocolor", "white", "darkslategrey")))
    c = cssvalues.named_color(F.get(names, (col("p_partkey") % 10).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", *(c[k].alias(k) for k in "rgb"))


@query(
    """SELECT p_partkey, ('0x' || substr(h, 1, 2))::INT AS r, ('0x' || substr(h, 3, 2))::INT AS g, ('0x' || substr(h, 5, 2))::INT AS b, CASE WHEN p_partkey % 2 = 0 THEN 255 ELSE ('0x' || substr(h, 5, 2))::INT END AS a
       FROM (SELECT p_partkey, printf('%06x', p_partkey * 7919 % 16777216) AS h FROM part)"""
)
def hex_colors(spark, sf_dir):
    h = F.lower(F.lpad(F.hex(col("p_partkey") * 7919 % 16777216), 6, "0"))
    c = geometry.hex_color(F.when(col("p_partkey") % 2 == 0, F.concat(F.lit("#"), h)).otherwise(F.concat(F.lit("#"), h, F.substring(h, 5, 2))))
    return read(spark, sf_dir, "part").select("p_partkey", *(c[k].alias(k) for k in "rgba"))


_BORDER = "['none', 'dotted', 'dashed', 'solid', 'double', 'hidden']"
_RANK = "CASE {s} WHEN 'dotted' THEN 1 WHEN 'dashed' THEN 2 WHEN 'solid' THEN 3 WHEN 'double' THEN 4 ELSE 0 END"


@query(
    f"""SELECT {_IDS}, CASE WHEN hide THEN 'hidden' WHEN far THEN s2 ELSE s1 END AS style, CASE WHEN hide THEN 0 WHEN far THEN w2 ELSE w1 END::DOUBLE AS width FROM (
          SELECT *, s1 = 'hidden' OR s2 = 'hidden' AS hide, CASE WHEN {_RANK.format(s='s1')} = 0 THEN 0 ELSE w1 END AS t1, CASE WHEN {_RANK.format(s='s2')} = 0 THEN 0 ELSE w2 END AS t2, t2 > t1 OR (t1 = t2 AND {_RANK.format(s='s2')} > {_RANK.format(s='s1')}) AS far
          FROM (SELECT *, {_BORDER}[1 + l_partkey % 6] AS s1, {_BORDER}[1 + l_suppkey % 6] AS s2, (l_quantity % 3)::DOUBLE AS w1, (l_linenumber % 3)::DOUBLE AS w2 FROM lineitem))"""
)
def collapsed_borders(spark, sf_dir):
    styles = F.array(*map(F.lit, ("none", "dotted", "dashed", "solid", "double", "hidden")))
    border = lambda k, w: F.struct(F.get(styles, (col(k) % 6).cast("int")).alias("style"), (col(w) % 3).cast("double").alias("width"))
    b = cssvalues.stronger_border(border("l_partkey", "l_quantity"), border("l_suppkey", "l_linenumber"))
    return _lines(spark, sf_dir).select(*_ID, b["style"].alias("style"), b["width"].alias("width"))


# -- colours ------------------------------------------------------------------------------------

_M = "((({a}) * ({b}) + 127) // 255)"
_B, _S = "(l_partkey * 3 % 256)", "(l_suppkey * 7 % 256)"
_MODES = "['Multiply', 'Screen', 'Overlay', 'Darken', 'Lighten', 'ColorDodge', 'ColorBurn', 'HardLight', 'Difference', 'Exclusion', 'Normal']"
_HARD = f"CASE WHEN {{s}} <= 127 THEN {_M.format(a='{b}', b='2 * {s}')} ELSE {{b}} + (2 * {{s}} - 255) - {_M.format(a='{b}', b='2 * {s} - 255')} END"


@query(
    f"""SELECT {_IDS}, mode, (CASE mode WHEN 'Multiply' THEN {_M.format(a='b', b='s')} WHEN 'Screen' THEN b + s - {_M.format(a='b', b='s')} WHEN 'Overlay' THEN {_HARD.format(b='s', s='b')} WHEN 'Darken' THEN least(b, s) WHEN 'Lighten' THEN greatest(b, s)
          WHEN 'ColorDodge' THEN CASE WHEN b = 0 THEN 0 WHEN s = 255 THEN 255 ELSE least(255, b * 255 // (255 - s)) END WHEN 'ColorBurn' THEN CASE WHEN b = 255 THEN 255 WHEN s = 0 THEN 0 ELSE 255 - least(255, (255 - b) * 255 // s) END
          WHEN 'HardLight' THEN {_HARD.format(b='b', s='s')} WHEN 'Difference' THEN abs(b - s) WHEN 'Exclusion' THEN b + s - 2 * {_M.format(a='b', b='s')} ELSE s END)::INT AS sample
        FROM (SELECT {_IDS}, {_MODES}[1 + l_orderkey % 11] AS mode, {_B} AS b, {_S} AS s FROM lineitem)"""
)
def blend_modes(spark, sf_dir):
    modes = F.array(*map(F.lit, ("Multiply", "Screen", "Overlay", "Darken", "Lighten", "ColorDodge", "ColorBurn", "HardLight", "Difference", "Exclusion", "Normal")))
    mode = F.get(modes, (col("l_orderkey") % 11).cast("int"))
    b, s = (col("l_partkey") * 3 % 256).cast("int"), (col("l_suppkey") * 7 % 256).cast("int")
    return _lines(spark, sf_dir).select(*_ID, mode.alias("mode"), colour.blended(mode, b, s).alias("sample"))


@query(
    f"""SELECT {_IDS}, floor(least(greatest(CASE WHEN y <= 0.5 THEN x - (1 - 2 * y) * x * (1 - x) ELSE x + (2 * y - 1) * (CASE WHEN x <= 0.25 THEN ((16 * x - 12) * x + 4) * x ELSE sqrt(x) END - x) END * 255, 0), 255) + 0.5)::INT AS sample
        FROM (SELECT {_IDS}, {_B} / 255::DOUBLE AS x, {_S} / 255::DOUBLE AS y FROM lineitem)"""
)
def blend_soft_light(spark, sf_dir):
    b, s = (col("l_partkey") * 3 % 256).cast("int"), (col("l_suppkey") * 7 % 256).cast("int")
    return _lines(spark, sf_dir).select(*_ID, colour.blended(F.lit("SoftLight"), b, s).alias("sample"))


@query(
    f"""WITH c AS (SELECT {_IDS}, list_transform([l_partkey % 256, l_partkey * 3 % 256, l_partkey * 5 % 256], lambda x: x / 255::DOUBLE) AS b, list_transform([l_suppkey * 7 % 256, l_suppkey * 11 % 256, l_suppkey * 13 % 256], lambda x: x / 255::DOUBLE) AS s FROM lineitem),
        l AS (SELECT *, 0.3::DOUBLE * s[1] + 0.59::DOUBLE * s[2] + 0.11::DOUBLE * s[3] AS ls, 0.3::DOUBLE * b[1] + 0.59::DOUBLE * b[2] + 0.11::DOUBLE * b[3] AS lb FROM c),
        m AS (SELECT *, list_transform(b, lambda v: v + (ls - lb)) AS v FROM l),
        n AS (SELECT *, list_min(v) AS lo, list_max(v) AS hi, 0.3::DOUBLE * v[1] + 0.59::DOUBLE * v[2] + 0.11::DOUBLE * v[3] AS lv FROM m),
        d AS (SELECT *, CASE WHEN lo < 0 AND lv <> lo THEN list_transform(v, lambda x: lv + (x - lv) * lv / (lv - lo)) ELSE v END AS w FROM n),
        e AS (SELECT *, CASE WHEN hi > 1 AND hi <> lv THEN list_transform(w, lambda x: lv + (x - lv) * (1 - lv) / (hi - lv)) ELSE w END AS z FROM d)
        SELECT {_IDS}, floor(least(greatest(z[1] * 255, 0), 255) + 0.5)::INT AS r, floor(least(greatest(z[2] * 255, 0), 255) + 0.5)::INT AS g, floor(least(greatest(z[3] * 255, 0), 255) + 0.5)::INT AS b FROM e"""
)
def blend_luminosity(spark, sf_dir):
    rgb = lambda c, ks: F.struct(*((col(c) * k % 256).cast("int").alias(n) for n, k in zip("rgb", ks, strict=True)))
    out = colour.blended_whole(F.lit("Luminosity"), rgb("l_partkey", (1, 3, 5)), rgb("l_suppkey", (7, 11, 13)))
    return _lines(spark, sf_dir).select(*_ID, *(out[k].alias(k) for k in "rgb"))


_OPS = "['in', 'out', 'atop', 'xor', 'over']"


@query(
    f"""SELECT {_IDS}, op, ({_M.format(a='sa // 2', b="CASE WHEN op IN ('in', 'atop') THEN da WHEN op IN ('out', 'xor') THEN 255 - da ELSE 255 END")} + {_M.format(a='da // 3', b="CASE WHEN op IN ('in', 'out') THEN 0 ELSE 255 - sa END")})::INT AS r,
               ({_M.format(a='sa', b="CASE WHEN op IN ('in', 'atop') THEN da WHEN op IN ('out', 'xor') THEN 255 - da ELSE 255 END")} + {_M.format(a='da', b="CASE WHEN op IN ('in', 'out') THEN 0 ELSE 255 - sa END")})::INT AS a
        FROM (SELECT {_IDS}, {_OPS}[1 + l_orderkey % 5] AS op, {_S} AS sa, {_B} AS da FROM lineitem)"""
)
def porter_duff(spark, sf_dir):
    op = F.get(F.array(*map(F.lit, ("in", "out", "atop", "xor", "over"))), (col("l_orderkey") % 5).cast("int"))
    sample = lambda a, part: F.struct(*(F.floor(a / part).cast("int").alias(k) for k in "rgb"), a.cast("int").alias("a"))
    out = colour.composited(op, sample(col("l_suppkey") * 7 % 256, 2), sample(col("l_partkey") * 3 % 256, 3))
    return _lines(spark, sf_dir).select(*_ID, op.alias("op"), out["r"].alias("r"), out["a"].alias("a"))


_SRGB = "least(greatest(CASE WHEN {v} <= 0.0031308 THEN greatest({v}, 0) * 12.92 ELSE 1.055 * pow(least({v}, 1), 1 / 2.4::DOUBLE) - 0.055 END, 0), 1)"
_LABF = "(CASE WHEN {t} >= 6 / 29::DOUBLE THEN {t} * {t} * {t} ELSE ({t} - 4 / 29::DOUBLE) * (108 / 841::DOUBLE) END)"


def _to_rgb(x, y, z):
    rows = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
    return ", ".join(f"round({_SRGB.format(v=f'({p}::DOUBLE * {x} + {q}::DOUBLE * {y} + {r}::DOUBLE * {z})')}, 6) AS {n}" for n, (p, q, r) in zip("rgb", rows, strict=True))


@query(
    f"""SELECT {_IDS}, {_to_rgb('x', 'y', 'z')} FROM (SELECT {_IDS}, 0.9505::DOUBLE * {_LABF.format(t='(fy + a / 500)')} AS x, {_LABF.format(t='fy')} AS y, 1.089::DOUBLE * {_LABF.format(t='(fy - b / 200)')} AS z
        FROM (SELECT {_IDS}, (l_quantity * 2 + 16) / 116::DOUBLE AS fy, (l_partkey % 201 - 100)::DOUBLE AS a, (l_suppkey % 201 - 100)::DOUBLE AS b FROM lineitem))"""
)
def lab_colors(spark, sf_dir):
    c = colour.lab(col("l_quantity") * 2, (col("l_partkey") % 201 - 100).cast("double"), (col("l_suppkey") % 201 - 100).cast("double"), colour.D65)
    return _lines(spark, sf_dir).select(*_ID, *(F.round(c[k], 6).alias(k) for k in "rgb"))


@query(
    f"""SELECT {_IDS}, {_to_rgb('x', 'y', 'z')} FROM (SELECT {_IDS}, 0.4124::DOUBLE * p + 0.3576::DOUBLE * q + 0.1805::DOUBLE * r AS x, 0.2126::DOUBLE * p + 0.7152::DOUBLE * q + 0.0722::DOUBLE * r AS y, 0.0193::DOUBLE * p + 0.1192::DOUBLE * q + 0.9505::DOUBLE * r AS z
        FROM (SELECT {_IDS}, pow(l_quantity / 50, 2.2::DOUBLE) AS p, pow((l_partkey % 101) / 100::DOUBLE, 1.8::DOUBLE) AS q, (l_suppkey % 101) / 100::DOUBLE AS r FROM lineitem))"""
)
def calibrated_colors(spark, sf_dir):
    c = colour.calibrated(
        col("l_quantity") / 50, (col("l_partkey") % 101) / 100, (col("l_suppkey") % 101) / 100, (2.2, 1.8, 1.0), (0.4124, 0.2126, 0.0193, 0.3576, 0.7152, 0.1192, 0.1805, 0.0722, 0.9505)
    )
    return _lines(spark, sf_dir).select(*_ID, *(F.round(c[k], 6).alias(k) for k in "rgb"))


@query(
    f"""SELECT {_IDS}, floor((CASE WHEN h < 60 THEN c WHEN h < 120 THEN x WHEN h < 240 THEN 0 WHEN h < 300 THEN x ELSE c END + m) * 255 + 0.5)::INT AS r,
               floor((CASE WHEN h < 60 THEN x WHEN h < 180 THEN c WHEN h < 240 THEN x ELSE 0 END + m) * 255 + 0.5)::INT AS g, floor((CASE WHEN h < 120 THEN 0 WHEN h < 180 THEN x WHEN h < 300 THEN c ELSE x END + m) * 255 + 0.5)::INT AS b
        FROM (SELECT *, c * (1 - abs((h / 60) % 2 - 1)) AS x, l - c / 2 AS m FROM (SELECT *, (1 - abs(2 * l - 1)) * s AS c FROM (SELECT {_IDS}, (l_partkey % 360)::DOUBLE AS h, (l_suppkey % 101) / 100::DOUBLE AS s, l_quantity / 50 AS l FROM lineitem)))"""
)
def hsl_colors(spark, sf_dir):
    c = geometry.hsl_color((col("l_partkey") % 360).cast("double"), (col("l_suppkey") % 101) / 100, col("l_quantity") / 50)
    return _lines(spark, sf_dir).select(*_ID, *(c[k].alias(k) for k in "rgb"))


# -- geometry -----------------------------------------------------------------------------------


def _matrices():
    d = lambda c: col(c).cast("double")
    m = geometry.matrix(d("l_linenumber") + 1, d("l_quantity") / 8, d("l_linenumber") / -4, F.lit(2.0), d("l_partkey"), d("l_suppkey"))
    n = geometry.matrix(F.lit(0.5), F.lit(-1.0), d("l_quantity") / 2, F.lit(3.0), F.lit(-7.0), d("l_linenumber"))
    return m, n


_MN = f"(SELECT {_IDS}, l_linenumber + 1.0::DOUBLE AS a, l_quantity / 8 AS b, l_linenumber / -4.0::DOUBLE AS c, 2.0::DOUBLE AS d, l_partkey::DOUBLE AS e, l_suppkey::DOUBLE AS f, 0.5::DOUBLE AS p, -1.0::DOUBLE AS q, l_quantity / 2 AS r, 3.0::DOUBLE AS s, -7.0::DOUBLE AS t, l_linenumber::DOUBLE AS u FROM lineitem)"


@query(
    f"""SELECT {_IDS}, a * p + b * r AS a, a * q + b * s AS b, c * p + d * r AS c, c * q + d * s AS d, e * p + f * r + t AS e, e * q + f * s + u AS f, a * d - b * c AS det, round(sqrt(abs(a * d - b * c)), 9) AS expansion,
               round((c * f - d * e) / (a * d - b * c), 6) + 0.0 AS back_x, round((b * e - a * f) / (a * d - b * c), 6) + 0.0 AS back_y FROM {_MN}"""
)
def matrix_algebra(spark, sf_dir):
    """Products, determinants, and where the inverse takes the origin."""
    m, n = _matrices()
    both, back = geometry.concat(m, n), geometry.apply(geometry.invert(m), F.lit(0.0), F.lit(0.0))
    return _lines(spark, sf_dir).select(
        *_ID, *(both[k].alias(k) for k in geometry.FIELDS), geometry.determinant(m).alias("det"), F.round(geometry.expansion(m), 9).alias("expansion"), (F.round(back[0], 6) + 0.0).alias("back_x"), (F.round(back[1], 6) + 0.0).alias("back_y")
    )


_R = "l_partkey % 50 AS ax0, l_suppkey % 40 AS ay0, l_partkey % 50 + l_quantity AS ax1, l_suppkey % 40 + l_linenumber AS ay1, l_suppkey % 30 AS bx0, l_partkey % 20 AS by0, l_suppkey % 30 + l_quantity / 2 AS bx1, l_partkey % 20 + 9.5 AS by1"


@query(
    f"""SELECT {_IDS}, greatest(ax0, bx0)::DOUBLE AS ix0, least(ay1, by1)::DOUBLE AS iy1, greatest(ax0, bx0) >= least(ax1, bx1) OR greatest(ay0, by0) >= least(ay1, by1) AS apart, least(ax0, bx0)::DOUBLE AS ux0, greatest(ay1, by1)::DOUBLE AS uy1,
               ax0 <= bx0 AND ay0 <= by0 AND ax1 >= bx1 AND ay1 >= by1 AS holds, floor(bx0 * 1.5)::BIGINT AS px0, ceil(by1 * 1.5)::BIGINT AS py1 FROM (SELECT {_IDS}, {_R} FROM lineitem)"""
)
def box_algebra(spark, sf_dir):
    """Intersections, unions, containment, and the whole pixels that a scaled box covers."""
    p, s, q = col("l_partkey"), col("l_suppkey"), col("l_quantity")
    a, b = geometry.box(p % 50, s % 40, p % 50 + q, s % 40 + col("l_linenumber")), geometry.box(s % 30, p % 20, s % 30 + q / 2, p % 20 + 9.5)
    both, union, pixels = geometry.intersect(a, b), geometry.union(a, b), geometry.outer(geometry.apply_box(geometry.matrix(1.5, 0, 0, 1.5, 0, 0), b))
    return _lines(spark, sf_dir).select(
        *_ID, both["x0"].alias("ix0"), both["y1"].alias("iy1"), geometry.is_empty(both).alias("apart"), union["x0"].alias("ux0"), union["y1"].alias("uy1"), geometry.contains(a, b).alias("holds"), pixels["x0"].alias("px0"), pixels["y1"].alias("py1")
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount + pow(l_quantity / 50, 2) * (1 - l_discount), 9) AS tint FROM lineitem")
def exponential_tints(spark, sf_dir):
    t = geometry.exponential(col("l_quantity") / 50, [0.0], [1.0], 2.0)
    return _lines(spark, sf_dir).select(*_ID, F.round(col("l_discount") + t[0] * (1 - col("l_discount")), 9).alias("tint"))


# -- dates --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, date_trunc('second', o_orderdate) AS iso, date_trunc('second', o_orderdate) - to_minutes(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 150 ELSE -300 END) AS pdf, date_trunc('month', o_orderdate) AS month FROM orders")
def document_dates(spark, sf_dir):
    """Dates as documents write them, read back as UTC."""
    d, k = F.date_trunc("second", "o_orderdate"), col("o_orderkey") % 3
    zone = F.when(k == 0, "Z").when(k == 1, "+02'30'").otherwise("-05'00")
    iso = F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", dates.iso_date(iso).cast("timestamp_ntz").alias("iso"), dates.pdf_date(F.concat(F.lit("D:"), F.date_format(d, "yyyyMMddHHmmss"), zone)).cast("timestamp_ntz").alias("pdf"),
        dates.iso_date(F.date_format(d, "yyyy-MM")).cast("timestamp_ntz").alias("month"),
    )


# -- vector grammars ----------------------------------------------------------------------------


def _kernel(df, schema, rows_of):
    """rows_of(row as a dict) of each row, as rows of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [r for d in b.to_pylist() for r in rows_of(d)]
            cols = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


@query(
    """SELECT p_partkey, ord, op, x, y FROM (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 100)::DOUBLE AS k FROM part), LATERAL (
         SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS ord, unnest(['M', 'L', 'L', 'L', 'C', 'C', 'Z']) AS op, unnest([k, k + s, k + s, 5, 8, 14, NULL]) AS x, unnest([s, s, 2 * s, 2 * s, 2 * s + 3, 2 * s + 3, NULL]) AS y)"""
)
def svg_paths(spark, sf_dir):
    """Moves, lines, horizontal and vertical steps, cubics and quadratics, absolute and relative: where each ends."""
    d = F.concat(F.lit("M"), (col("p_partkey") % 100).cast("string"), F.lit(","), col("p_size").cast("string"), F.lit("h"), col("p_size").cast("string"), F.lit("v"), col("p_size").cast("string"), F.lit("H5 c1 1,2-.5 3,3q3 1 6 0z"))
    rows = read(spark, sf_dir, "part").select("p_partkey", d.alias("d"))
    return _kernel(rows, "p_partkey bigint, ord int, op string, x double, y double", lambda r: [(r["p_partkey"], k, op, *(a[-2:] if a else (None, None))) for k, (op, a) in enumerate(vector.path_segments(r["d"]))])


@query(
    """SELECT p_partkey, 2.0::DOUBLE * c + 0.0 AS a, 2.0::DOUBLE * s + 0.0 AS b, -3.0::DOUBLE * s + 0.0 AS c, 3.0::DOUBLE * c + 0.0 AS d, (10 + p_size)::DOUBLE AS e, (p_partkey % 50)::DOUBLE AS f FROM (
         SELECT p_partkey, p_size, [1, 0, -1, 0][1 + p_partkey % 4] AS c, [0, 1, 0, -1][1 + p_partkey % 4] AS s FROM part)"""
)
def svg_transforms(spark, sf_dir):
    s = F.concat(F.lit("translate(10 0) translate("), col("p_size").cast("string"), F.lit(","), (col("p_partkey") % 50).cast("string"), F.lit("),rotate("), (col("p_partkey") % 4 * 90).cast("string"), F.lit(") scale(2 3)"))
    rows = read(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    return _kernel(rows, "p_partkey bigint, a double, b double, c double, d double, e double, f double", lambda r: [(r["p_partkey"], *(round(v, 9) + 0.0 for v in vector.transform(r["s"])))])


@query(
    """SELECT p_partkey, round(least(400 / w, 300 / h), 9) AS scale, round((400 - w * least(400 / w, 300 / h)) / 2, 6) + 0.0 AS x, round((300 - h * least(400 / w, 300 / h)) / 2, 6) + 0.0 AS y, round(greatest(400 / w, 300 / h), 9) AS sliced
       FROM (SELECT p_partkey, (10 + p_size)::DOUBLE AS w, (5 + p_partkey % 60)::DOUBLE AS h FROM part)"""
)
def svg_viewports(spark, sf_dir):
    def rows(r):
        box = (0.0, 0.0, r["w"], r["h"])
        m, cut = vector.viewport(box, 400, 300), vector.viewport(box, 400, 300, "xMinYMin", True)
        return [(r["p_partkey"], m[0], m[4], m[5], cut[0])]

    found = read(spark, sf_dir, "part").select("p_partkey", (10 + col("p_size")).cast("double").alias("w"), (5 + col("p_partkey") % 60).cast("double").alias("h"))
    return _kernel(found, "p_partkey bigint, scale double, x double, y double, sliced double", rows).select("p_partkey", *(F.round(c, 9).alias(c) for c in ("scale", "sliced")), *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y")))


@query(
    """SELECT p_partkey, round(CASE WHEN x < 0.5 THEN 4 * x * x ELSE 1 - (2 * x - 1) * 0.5 END, 9) AS stitched, round(CASE WHEN x <= 0.5 THEN 2 * x ELSE 2 - 2 * x END, 9) AS sampled, round(x * x + 1, 9) AS calculated FROM (SELECT p_partkey, (p_partkey % 101) / 100::DOUBLE AS x FROM part)"""
)
def shading_functions(spark, sf_dir):
    """Stitched, sampled and calculated functions of one number."""
    first = {"FunctionType": 2, "Domain": [0, 1], "C0": [0], "C1": [1], "N": 2}
    second = {"FunctionType": 2, "Domain": [0, 1], "C0": [1], "C1": [0.5], "N": 1}
    stitched = {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.5], "Encode": [0, 1, 0, 1], "Functions": [first, second]}
    sampled = {"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [3], "BitsPerSample": 8}
    program = vector.program("{ dup mul 1 add }")

    def rows(r):
        x = r["x"]
        return [(r["p_partkey"], round(vector.evaluate(stitched, [x])[0], 9), round(vector.evaluate(sampled, [x], bytes([0, 255, 0]))[0], 9), round(vector.calculator(program, [x])[0], 9))]

    found = read(spark, sf_dir, "part").select("p_partkey", ((col("p_partkey") % 101) / 100).alias("x"))
    return _kernel(found, "p_partkey bigint, stitched double, sampled double, calculated double", rows)


# -- pages of PDF files -------------------------------------------------------------------------

_P = f"(SELECT doc_id, greatest(1, (len({_LINES}) + 39) // 40) AS pages FROM documents)"


@query(
    f"""SELECT doc_id, k::INT AS page, (500 + doc_id % 200)::DOUBLE AS media_width, (390 + doc_id % 50)::DOUBLE AS width, 760.0::DOUBLE AS height, t::INT AS rotate,
               (CASE t WHEN 0 THEN [2, 0, 0, -2, -20, 1560] WHEN 90 THEN [0, 2, 2, 0, -40, -20] WHEN 180 THEN [-2, 0, 0, 2, 2 * (400 + doc_id % 50), -40] ELSE [0, -2, -2, 0, 1560, 2 * (400 + doc_id % 50)] END)::DOUBLE[]::VARCHAR AS matrix
        FROM (SELECT *, 90 * ((doc_id + k) % 4) AS t FROM {_P}, unnest(generate_series(0, pages - 1)) AS t(k))"""
)
def pdf_pages(spark, sf_dir):
    """Boxes, rotation and the matrix to pixels at 144 dots an inch."""
    found = documents.pages(made(spark, sf_dir, builders.pdf), "doc_id", dpi=144)
    side = lambda c, a, b: F.get(c, F.lit(b)) - F.get(c, F.lit(a))
    text = F.concat(F.lit("["), F.array_join(F.transform("matrix", lambda v: F.format_string("%.1f", v + 0.0)), ", "), F.lit("]"))
    return found.select("doc_id", "page", side("media", 0, 2).alias("media_width"), side("bounds", 0, 2).alias("width"), side("bounds", 1, 3).alias("height"), "rotate", F.replace(text, F.lit("-0.0"), F.lit("0.0")).alias("matrix"))


@query("SELECT doc_id, unnest([0, 1]) AS ord, unnest(['Shown', 'Hidden']) AS name, unnest([true, false]) AS shown, unnest([false, false]) AS switched FROM documents")
def pdf_layers(spark, sf_dir):
    """Layers as the file has them, and after one is switched off."""
    return documents.layers(made(spark, sf_dir, builders.pdf), "doc_id", after={"switched": {"Shown": False}})


# -- tables -------------------------------------------------------------------------------------


@query(
    """SELECT order_key, row, col, rows, cols, text FROM (
         SELECT o AS order_key, r AS row, 0 AS col, n AS rows, 1 AS cols, 'order ' || o AS text FROM l WHERE r = 0
         UNION ALL SELECT o, r, 1, 1, 1 + l_linenumber % 3, l_returnflag FROM l
         UNION ALL SELECT o, r, 2 + l_linenumber % 3, 1, 1, l_linestatus FROM l)""".replace("SELECT order_key", "WITH l AS (SELECT l_orderkey AS o, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS r, count(*) OVER (PARTITION BY l_orderkey)::INT AS n, * FROM lineitem) SELECT order_key", 1)
)
def table_grid(spark, sf_dir):
    """A table an order, its first cell beside all rows: where the cells come to stand."""
    row = F.concat(F.lit('<td colspan="'), (1 + col("l_linenumber") % 3).cast("string"), F.lit('">'), col("l_returnflag"), F.lit("</td><td>"), col("l_linestatus"), F.lit("</td></tr>"))
    lines = dealt(_lines(spark, sf_dir), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row")))).alias("rows"))
    first = F.concat(F.lit('<td rowspan="'), F.size("rows").cast("string"), F.lit('">order '), col("l_orderkey").cast("string"), F.lit("</td>"))
    markup = F.concat(F.lit("<table><tr>"), first, F.array_join(F.transform("rows", lambda r: r["row"]), "<tr>"), F.lit("</table>"))
    found = tables.cells_of(lines.select("l_orderkey", markup.alias("html")), "l_orderkey")
    return found.select(col("l_orderkey").alias("order_key"), "row", "col", "rows", "cols", "text")
