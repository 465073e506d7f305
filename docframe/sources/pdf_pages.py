"""What a PDF says about its pages beside their text: boxes, rotation, layers, annotations."""

from __future__ import annotations

import math

from docframe.sources import pdf

#: Bits of an annotation's flags. Fixed values.
INVISIBLE, HIDDEN, PRINT, NO_VIEW = 1, 2, 4, 32
EVENTS = {"view": "View", "print": "Print", "export": "Export"}
PAGE = (0.0, 0.0, 612.0, 792.0)


def _rect(f: pdf.File, o) -> tuple[float, ...] | None:
    """A box with its corners in order; None if it has no area."""
    v = [f.get(x) for x in f.list(o)]
    if len(v) != 4 or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
        return None
    x0, x1 = sorted((float(v[0]), float(v[2])))
    y0, y1 = sorted((float(v[1]), float(v[3])))
    return (x0, y0, x1, y1) if x0 < x1 and y0 < y1 else None


def boxes(f: pdf.File, page: dict) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The media box, and what of it the crop box leaves to be seen."""
    media = _rect(f, page.get("MediaBox")) or PAGE
    crop = _rect(f, page.get("CropBox")) or media
    both = max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])
    return media, both if both[0] < both[2] and both[1] < both[3] else media


def rotation(f: pdf.File, page: dict) -> int:
    """Quarter turns, in degrees."""
    r = f.get(page.get("Rotate"))
    return int(r) % 360 // 90 * 90 if isinstance(r, (int, float)) else 0


def unit(f: pdf.File, page: dict) -> float:
    u = f.get(page.get("UserUnit"))
    return float(u) if isinstance(u, (int, float)) and 0 < u <= 1000 else 1.0


def device_matrix(visible, turned: int, scale: float) -> tuple[float, ...]:
    """From points of the page to pixels that begin at its upper left corner: turned clockwise, y down."""
    c, s = {0: (1, 0), 90: (0, 1), 180: (-1, 0), 270: (0, -1)}[turned]
    m = (c * scale, s * scale, s * scale, -c * scale)
    corners = [(m[0] * x + m[2] * y, m[1] * x + m[3] * y) for x in visible[::2] for y in visible[1::2]]
    return (*m, -min(x for x, _ in corners), -min(y for _, y in corners))


def pages(f: pdf.File, dpi: float = 72.0) -> list[tuple]:
    """(page, label, media box, visible box, rotation, unit, matrix) of every page."""
    found = f.pages()
    out = []
    for n, (p, label) in enumerate(zip(found, pdf.labels(f, len(found)), strict=True)):
        media, visible = boxes(f, p)
        turned, u = rotation(f, p), unit(f, p)
        out.append((n, label, list(media), list(visible), turned, u, list(device_matrix(visible, turned, dpi / 72 * u))))
    return out


class Layers:
    """Optional content: which groups are on for viewing, printing or exporting, and what a membership shows."""

    def __init__(self, f: pdf.File, event: str = "view"):
        self.f, props = f, f.dict(f.dict(f.trailer.get("Root")).get("OCProperties"))
        self.groups = [r for r in f.list(props.get("OCGs")) if isinstance(r, pdf.Ref)]
        config = f.dict(props.get("D"))
        refs = lambda k: {r.num for r in f.list(config.get(k)) if isinstance(r, pdf.Ref)}
        self.off = ({r.num for r in self.groups} - refs("ON") if config.get("BaseState") == "OFF" else set()) | refs("OFF")
        for use in map(f.dict, f.list(config.get("AS"))):
            if use.get("Event") != EVENTS[event]:
                continue
            for r in f.list(use.get("OCGs")):
                usage = f.dict(f.dict(r).get("Usage"))
                for c in f.list(use.get("Category")):
                    state = f.dict(usage.get(str(f.get(c)))).get(f"{f.get(c)}State")
                    if isinstance(r, pdf.Ref) and state in ("ON", "OFF"):
                        (self.off.add if state == "OFF" else self.off.discard)(r.num)

    def rows(self) -> list[tuple[int, str, bool]]:
        """(place, name, on) in the catalogue's order."""
        out = []
        for k, r in enumerate(self.groups):
            name = self.f.get(self.f.dict(r).get("Name"))
            out.append((k, pdf.text_string(name) if isinstance(name, bytes) else str(name or ""), r.num not in self.off))
        return out

    def switch(self, on: dict[str, bool]) -> Layers:
        """Turns groups on and off by name."""
        for (_, name, _), r in zip(self.rows(), self.groups, strict=True):
            if name in on:
                (self.off.discard if on[name] else self.off.add)(r.num)
        return self

    def shows(self, oc, depth: int = 0) -> bool:
        """Whether content under an /OC entry, a group or a membership, is seen."""
        d = self.f.dict(oc)
        if isinstance(oc, pdf.Ref) and oc.num in self.off:
            return False
        if d.get("Type") != "OCMD" or depth > 32:
            return True
        expression = self.f.list(d.get("VE"))
        if expression:
            return self._holds(expression, depth)
        of = self.f.get(d.get("OCGs"))
        groups = of if isinstance(of, list) else [d.get("OCGs")] if isinstance(of, dict) else []
        on = [g.num not in self.off for g in groups if isinstance(g, pdf.Ref)]
        if not on:
            return True
        return {"AllOn": all(on), "AnyOff": not all(on), "AllOff": not any(on)}.get(str(d.get("P") or "AnyOn"), any(on))

    def _holds(self, e, depth: int) -> bool:
        op, parts = self.f.get(e[0]), e[1:]
        values = []
        for p in parts:
            inner = self.f.get(p)
            values.append(self._holds(inner, depth + 1) if isinstance(inner, list) and inner and depth < 32 else not (isinstance(p, pdf.Ref) and p.num in self.off))
        return {"Not": not (values and values[0]), "And": all(values), "Or": any(values)}.get(str(op), True)


def annotations(f: pdf.File, page: dict, layers: Layers, event: str = "view") -> list[tuple]:
    """(place, subtype, rectangle, drawn) in drawing order: form fields last, links and pop-ups left out."""
    found = []
    for a in map(f.dict, f.list(page.get("Annots"))):
        kind = str(f.get(a.get("Subtype")) or "")
        if not a or kind in ("Popup", "Link"):
            continue
        flags = f.get(a.get("F"))
        flags = flags if isinstance(flags, int) else 0
        hidden = flags & (INVISIBLE | HIDDEN) or (not flags & PRINT if event == "print" else flags & NO_VIEW) or not layers.shows(a.get("OC"))
        look = f.get(f.dict(a.get("AP")).get("N"))
        if isinstance(look, dict):
            state = f.get(a.get("AS"))
            look = f.get(look.get(str(state))) if state else f.get(next(iter(look.values()))) if len(look) == 1 else None
        box = _rect(f, a.get("Rect"))
        found.append((kind == "Widget", kind, list(box) if box else None, bool(not hidden and isinstance(look, pdf.Stream) and box)))
    found.sort(key=lambda x: x[0])
    return [(k, *x[1:]) for k, x in enumerate(found)]


def fitted(box, matrix, rect) -> tuple[float, ...]:
    """The matrix that fits an appearance's box, under its own matrix, to the annotation's rectangle."""
    a, b, c, d, e, g = matrix
    at = [(a * x + c * y + e, b * x + d * y + g) for x in box[::2] for y in box[1::2]]
    x0, y0, x1, y1 = min(x for x, _ in at), min(y for _, y in at), max(x for x, _ in at), max(y for _, y in at)
    sx, sy = ((rect[2] - rect[0]) / (x1 - x0) if x1 > x0 else 1.0), ((rect[3] - rect[1]) / (y1 - y0) if y1 > y0 else 1.0)
    return (sx, 0.0, 0.0, sy, rect[0] - x0 * sx, rect[1] - y0 * sy) if all(map(math.isfinite, (sx, sy))) else (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
