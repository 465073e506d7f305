"""Values of style sheets and drawings: lengths, fonts, colours, borders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CSS pixels of a unit. Fixed values.
ABSOLUTE = {"px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6}
#: Font sizes by keyword, of the medium one. Fixed values.
SIZES = {"xx-small": 3 / 5, "x-small": 3 / 4, "small": 8 / 9, "medium": 1.0, "large": 6 / 5, "x-large": 3 / 2, "xx-large": 2.0, "xxx-large": 3.0}
#: Border styles from the weakest that is drawn. Fixed values.
BORDERS = ("dotted", "dashed", "solid", "double")
#: Colours of CSS by name. Fixed values.
COLORS = (
    "aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000 blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a "
    "burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b "
    "darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 "
    "darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff "
    "dimgray 696969 dimgrey 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520 "
    "gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 "
    "lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 "
    "lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 "
    "magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a "
    "mediumturquoise 48d1cc mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080 oldlace fdf5e6 olive 808000 "
    "olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f "
    "pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080 rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 "
    "seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 "
    "thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32"
)


def _number(s: Column) -> Column:
    return F.regexp_extract(s, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)


def _unit(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", "")))


def length(s: Column, em: Column, root: Column, against: Column) -> Column:
    """CSS pixels of a length as a style sheet writes it, a percentage against a size; a bare number only if it is zero."""
    n, unit = F.nullif(_number(s), F.lit("")).cast("double"), _unit(s)
    out = F.when((unit == "") & (n == 0), 0.0).when(unit == "%", n * against / 100).when(unit == "em", n * em).when(unit == "rem", n * root).when(unit.isin("ex", "ch"), n * em / 2)
    for name, px in ABSOLUTE.items():
        out = out.when(unit == name, n * px)
    return out


def drawing_length(s: Column, against: Column, em: Column) -> Column:
    """User units of a length as a drawing writes it; a bare number is one."""
    n, unit = F.nullif(_number(s), F.lit("")).cast("double"), _unit(s)
    out = F.when(unit == "", n).when(unit == "%", n * against / 100).when(unit == "em", n * em).when(unit == "ex", n * em / 2)
    for name, px in ABSOLUTE.items():
        if name != "q":
            out = out.when(unit == name, n * px)
    return out


def font_size(s: Column, parent: Column, root: Column, medium: float = 16.0) -> Column:
    """Pixels of a font size: a keyword, a step from the parent's, or a length whose em is the parent's; never below zero."""
    word = F.lower(F.trim(s))
    out = F.when(word == "smaller", parent / 1.2).when(word == "larger", parent * 1.2)
    for name, share in SIZES.items():
        out = out.when(word == name, F.lit(share * medium))
    return out.otherwise(F.greatest(length(word, parent, root, parent), F.lit(0.0)) * F.when(length(word, parent, root, parent).isNotNull(), 1))


def font_weight(s: Column, parent: Column) -> Column:
    """100 to 1000 of a weight; bolder and lighter go by the parent's."""
    word = F.lower(F.trim(s))
    n = F.when(word.rlike("^[+]?[0-9]{1,5}$"), word.cast("int"))
    bolder = F.when(parent < 400, 400).when(parent < 600, 700).otherwise(900)
    lighter = F.when(parent > 700, 700).when(parent > 500, 400).otherwise(100)
    return F.when(word == "normal", 400).when(word == "bold", 700).when(word == "bolder", bolder).when(word == "lighter", lighter).when(n.between(1, 1000), n)


def families(s: Column) -> Column:
    """The families of a list: quoted as they stand, others with single spaces; null if the list cannot be read."""
    parts = F.regexp_extract_all(s, F.lit(r"""("[^"]*"|'[^']*'|[^,"']+)"""), F.lit(1))
    quoted = lambda p: F.regexp_extract(p, r"""^\s*["'](.*)["']\s*$""", 1)
    names = F.filter(F.transform(parts, lambda p: F.when(p.rlike(r"""^\s*["']"""), quoted(p)).otherwise(F.trim(F.regexp_replace(p, r"\s+", " ")))), lambda n: n != "")
    bad = F.exists(names, lambda n: n.rlike(r"[;{}()]"))
    return F.when((F.size(names) > 0) & ~bad, names)


def named_color(name: Column) -> Column:
    """Red, green, blue of a colour's name in any case; null if it is none."""
    words = COLORS.split()
    packed = F.create_map(*(F.lit(x) for k, v in zip(words[::2], words[1::2], strict=True) for x in (k, int(v, 16))))
    n = F.try_element_at(packed, F.lower(F.trim(name)))
    return F.when(n.isNotNull(), F.struct(F.shiftright(n, 16).alias("r"), F.shiftright(n, 8).bitwiseAND(255).alias("g"), n.bitwiseAND(255).alias("b")))


def stronger_border(near: Column, far: Column) -> Column:
    """Of two borders (style, width) that share an edge the one that is drawn: hidden before all, then the wider, then the style, then the nearer."""
    shown = lambda b: F.when(b["style"].isin(*BORDERS), b["width"]).otherwise(0.0)
    rank = lambda b: F.coalesce(F.array_position(F.array(*map(F.lit, BORDERS)), b["style"]), F.lit(0))
    far_wins = (shown(far) > shown(near)) | ((shown(far) == shown(near)) & (rank(far) > rank(near)))
    picked = lambda k: F.when(far_wins, far[k]).otherwise(near[k])
    hidden = (near["style"] == "hidden") | (far["style"] == "hidden")
    return F.struct(F.when(hidden, "hidden").otherwise(picked("style")).alias("style"), F.when(hidden, 0.0).otherwise(picked("width")).alias("width"))
