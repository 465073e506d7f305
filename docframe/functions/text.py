"""Text functions on columns: plain text of HTML, escapes, scripts, white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that begin and end a line of text. Fixed values.
BLOCKS = (
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table td tfoot th thead tr ul"
).split()
#: Subtrees without text.
SILENT = ("head", "script", "style", "title", "rp")
#: Writing systems by code point. Fixed values; the first range that holds a character counts.
SCRIPTS = (
    ("latin", ((0x0, 0x36F),)),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("hangul", ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xAC00, 0xD7FF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x2E80, 0x2FDF), (0x3000, 0x303F), (0x3190, 0x319F), (0x3200, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x20000, 0x3FFFF))),
    ("emoji", ((0x1F000, 0x1FAFF), (0x2600, 0x27BF))),
)
#: Entities decoded by the native chain; the general kernel knows all.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'))


def node_text_steps() -> list[tuple[str, str]]:
    """(pattern, replacement) in order; the same in Java's and in RE2's syntax."""
    steps = [(r"(?s)<!--.*?-->", "")]
    steps += [(rf"(?is)<{t}\b.*?</{t}\s*>", "") for t in ("head", "script", "style", "title", "rp")]
    steps += [
        (r"(?is)</?(?:br|" + "|".join(BLOCKS) + r")\b[^>]*>", "\x01"),
        (r"(?s)<[a-zA-Z/!][^>]*>", ""),
        (r"[ \t\n\r\f\x0b]+", " "),
        (" *\x01[ \x01]*", "\n"),
        (r"^[\n ]+", ""),
        (r"[\n ]+$", ""),
    ]
    return steps + list(ENTITIES) + [("&amp;?", "&")]


def chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def node_text(html: Column) -> Column:
    """Block-aware plain text of markup without pre, CJK or rare entities: a native fast path for dom.node_text."""
    return chain(html, node_text_steps())


#: What the native chain does not read as the kernel does: kept white space, wide characters, entities beyond its own, ruby, unusual white space.
KERNEL_ONLY = r"(?i)<(?:pre|textarea|listing|xmp|plaintext|rp|rt|svg|math|template|noscript|iframe|!\[CDATA)\b|[\u2e80-\ud7ff\uf900-\ufaff\ufe30-\ufe4f\uff00-\uffef\x{20000}-\x{3ffff}\u0085\u00a0\u2028\u2029\x00-\x08]|&(?!(?:lt|gt|nbsp|copy|middot|quot|amp);|amp?\b|am\b|[^a-z#]|$)|&nbsp;"


def needs_kernel(html: Column) -> Column:
    """Whether markup holds what node_text would read in another way than dom.node_text."""
    return F.coalesce(html.rlike(KERNEL_ONLY), F.lit(False))


def chain_sql(expr: str, steps: list[tuple[str, str]]) -> str:
    q = lambda s: s.replace("'", "''")
    for pattern, to in steps:
        to = to.replace("\\", "\\\\") if not to.startswith("\\1") else to
        p = q(pattern).replace("\x01", "' || chr(1) || '")
        t = q(to).replace("\x01", "' || chr(1) || '")
        expr = f"regexp_replace({expr}, '{p}', '{t}', 'g')"
    return expr


def squash(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t\n\r\f\x0b]+", " "), "^ | $", "")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: An underscore between letters or digits is no emphasis, so its escape is taken back; twice, as neighbours overlap.
MD_ESCAPE = [(r"([\\`*\[\]<_])", r"\\$1"), *[(r"([0-9A-Za-z\x{80}-\x{10FFFF}])\\_([0-9A-Za-z\x{80}-\x{10FFFF}])", "$1_$2")] * 2]
MD_LEAD = [(r"^([#>\-+=|])", r"\\$1"), (r"^([0-9]+)([.)])", r"$1\\$2")]


def md_escape(c: Column) -> Column:
    return chain(c, MD_ESCAPE)


def md_lead(c: Column) -> Column:
    return chain(c, MD_LEAD)


def md_sql(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        to = to.replace("$1", "\\1").replace("$2", "\\2")
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return expr


def script_of(code_point: Column) -> Column:
    out = F.lit("other")
    for name, ranges in reversed(SCRIPTS):
        inside = F.lit(False)
        for a, b in ranges:
            inside = inside | code_point.between(a, b)
        out = F.when(inside, name).otherwise(out)
    return out


def script_sql(code: str) -> str:
    when = " ".join(f"WHEN {' OR '.join(f'{code} BETWEEN {a} AND {b}' for a, b in ranges)} THEN '{name}'" for name, ranges in SCRIPTS)
    return f"CASE {when} ELSE 'other' END"


def script_edges():
    """Sorted code points at which the writing system changes, and its name from there on."""
    edges = sorted({0, *(x for _, ranges in SCRIPTS for a, b in ranges for x in (a, b + 1))})
    name = lambda c: next((n for n, ranges in SCRIPTS if any(a <= c <= b for a, b in ranges)), "other")
    return edges, [name(c) for c in edges]


def script_counts(df, id_col: str, text_col: str):
    """(id, script, n): the characters of each writing system that a row has, counted in the row."""
    edges, names = script_edges()
    kinds = sorted(set(names))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        starts, kind = np.array(edges, np.uint32), np.array([kinds.index(n) for n in names])
        for b in batches:
            rows = []
            for k, t in enumerate(b.column(1).to_pylist()):
                n = np.bincount(kind[np.searchsorted(starts, np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32), side="right") - 1], minlength=len(kinds))
                rows += [(k, j, int(n[j])) for j in np.flatnonzero(n).tolist()]
            at, of, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([kinds[j] for j in of], pa.string()), pa.array(n, pa.int64())], names=[id_col, "script", "n"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, script string, n bigint")
