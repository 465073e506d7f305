"""References inside documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A scheme's `://` counts past the first character only.
EXTERNAL = r"^(?:mailto:|tel:|data:|.[^:]*(?::[^/][^:]*)*://)"


def is_external(href: Column) -> Column:
    return (F.locate("://", href) > 1) | href.startswith("mailto:") | href.startswith("tel:") | href.startswith("data:")


def fragment_of(href: Column) -> Column:
    return F.when(F.locate("#", href) > 0, F.regexp_extract(href, r"(?s)#(.*)$", 1)).otherwise(F.lit(""))


def clean_path(p: Column) -> Column:
    """`.` and `..` resolved as in a slash-separated path; `.` for nothing left. A leading slash stays."""
    rooted = p.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when(part.isin("", "."), acc)
            .when((part == "..") & F.when(F.size(acc) > 0, up).otherwise(F.lit(False)), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((part == "..") & rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    joined = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def resolve(base: Column, ref: Column) -> Column:
    """The path that a reference inside the part at base names, fragment and query cut."""
    cut = F.regexp_extract(ref, r"(?s)^([^#?]*)", 1)
    folder = F.when(F.locate("/", base) > 0, F.regexp_extract(base, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    return (
        F.when(cut == "", base)
        .when(cut.startswith("/"), clean_path(F.substring(cut, 2, 1 << 30)))
        .when(F.locate("://", cut) > 1, cut)
        .otherwise(clean_path(F.when(folder == "", cut).otherwise(F.concat_ws("/", folder, cut))))
    )
