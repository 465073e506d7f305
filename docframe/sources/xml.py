"""Small XML trees without namespaces, with limits."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.etree import ElementTree

MOST_NODES, DEEPEST = 1 << 21, 256


@dataclass
class X:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[X] = field(default_factory=list)

    def child(self, tag: str) -> X | None:
        return next((c for c in self.children if c.tag == tag), None)

    def find_all(self, tag: str):
        stack = [self]
        while stack:
            n = stack.pop()
            if n.tag == tag:
                yield n
            stack.extend(reversed(n.children))

    def find(self, tag: str) -> X | None:
        return next(self.find_all(tag), None)

    first = find

    def all_text(self) -> str:
        return self.text + "".join(c.all_text() + c.attrs.get("#tail", "") for c in self.children)


def local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def tree(b: bytes, mixed: bool = False) -> X:
    """mixed: text between children becomes #text nodes, in order."""
    if b"<!ENTITY" in b.replace(b"\0", b""):  # in any encoding, wherever it stands
        raise ElementTree.ParseError("entity declarations are not read")
    seen = 0

    def build(e, depth: int) -> X:
        nonlocal seen
        seen += 1
        if seen > MOST_NODES or depth > DEEPEST:
            raise ElementTree.ParseError("too many or too deep elements")
        x = X(local(e.tag), {local(k): v for k, v in e.attrib.items()}, "" if mixed else e.text or "")
        if mixed and e.text:
            x.children.append(X("#text", text=e.text))
        for c in e:
            if not isinstance(c.tag, str):
                continue
            sub = build(c, depth + 1)
            x.children.append(sub)
            if c.tail and mixed:
                x.children.append(X("#text", text=c.tail))
            elif c.tail and c.tail.strip():
                sub.attrs["#tail"] = c.tail
        return x

    return build(ElementTree.fromstring(b), 0)
