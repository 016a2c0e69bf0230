"""XML documents: records at a path, their normalised form, and changes that keep the document's order."""

from __future__ import annotations

import xml.sax
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr


@dataclass
class Element:
    name: str
    attributes: dict[str, str]
    line: int
    content: list = field(default_factory=list)  # texts and elements in document order

    @property
    def children(self) -> list[Element]:
        return [x for x in self.content if isinstance(x, Element)]

    @property
    def text(self) -> str:
        return "".join(x for x in self.content if isinstance(x, str)).strip()


class _Builder(xml.sax.ContentHandler):
    def __init__(self, parser) -> None:
        super().__init__()
        self.parser = parser
        self.stack: list[Element] = []
        self.root: Element | None = None

    def startElement(self, name, attrs) -> None:  # noqa: N802
        e = Element(name.rsplit(":", 1)[-1], {k.rsplit(":", 1)[-1]: v for k, v in attrs.items() if not k.startswith("xmlns")}, self.parser.getLineNumber())
        if self.stack:
            self.stack[-1].content.append(e)
        else:
            self.root = e
        self.stack.append(e)

    def endElement(self, name) -> None:  # noqa: N802
        self.stack.pop()

    def characters(self, text) -> None:
        if self.stack:
            c = self.stack[-1].content
            if c and isinstance(c[-1], str):
                c[-1] += text
            else:
                c.append(text)


def parse(text: str) -> Element:
    """The document's root; external entities are never fetched."""
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.setFeature(xml.sax.handler.feature_external_pes, False)
    b = _Builder(parser)
    parser.setContentHandler(b)
    parser.feed(text)
    parser.close()
    if b.root is None:
        raise ValueError("no root element")
    return b.root


def normalise(e: Element) -> object:
    """Text of a leaf; else attributes as @name, children by name (repeated ones as a list), text as #text.

    Text between children is kept as #content, the ordered list of texts and children.
    """
    if not e.attributes and not e.children:
        return e.text
    out: dict = {f"@{k}": v for k, v in e.attributes.items()}
    for c in e.children:
        v = normalise(c)
        if c.name in out:
            out[c.name] = [*out[c.name], v] if isinstance(out[c.name], list) else [out[c.name], v]
        else:
            out[c.name] = v
    if e.text:
        if e.children:
            out["#content"] = [x.strip() if isinstance(x, str) else {x.name: normalise(x)} for x in e.content if not isinstance(x, str) or x.strip()]
        else:
            out["#text"] = e.text
    return out


def records(root: Element, path: str = "") -> list[tuple[Element, Element | None]]:
    """(record, parent) at a dotted path that may begin with the root's name; without path the root itself."""
    if not path:
        return [(root, None)]
    steps = [s for s in path.strip(".").split(".") if s]
    if steps and steps[0] == root.name:
        steps = steps[1:]
    level: list[tuple[Element, Element | None]] = [(root, None)]
    for s in steps:
        level = [(c, e) for e, _ in level for c in e.children if c.name == s]
    if not level:
        raise ValueError(f"no element at {path!r}")
    return level


def record_value(e: Element, whole: bool) -> dict:
    v = normalise(e)
    return {e.name: v} if whole or not isinstance(v, dict) else v


def replace(e: Element, value: dict) -> None:
    """Give an element new contents; attributes, texts and children that stay keep their place, new ones follow sorted."""
    e.attributes = {k: _text(value[f"@{k}"]) for k in e.attributes if f"@{k}" in value} | {k[1:]: _text(value[k]) for k in sorted(value) if k.startswith("@") and k[1:] not in e.attributes}
    kept: list = []
    seen: dict[str, int] = {}
    for x in e.content:
        if isinstance(x, str):
            if x.strip() and "#text" not in value:
                kept.append(x)
            continue
        vs = _many(value.get(x.name)) if x.name in value else []
        i = seen.get(x.name, 0)
        seen[x.name] = i + 1
        if i < len(vs):
            _fill(x, vs[i])
            kept.append(x)
    for k in sorted(value):
        if k.startswith(("@", "#")):
            continue
        for v in _many(value[k])[seen.get(k, 0) :]:
            n = Element(k, {}, 0)
            _fill(n, v)
            kept.append(n)
    e.content = ([_text(value["#text"])] if "#text" in value else []) + kept


def _many(v: object) -> list:
    return v if isinstance(v, list) else [v]


def _text(v: object) -> str:
    return "" if v is None else "true" if v is True else "false" if v is False else str(v)


def _fill(e: Element, v: object) -> None:
    if isinstance(v, dict):
        replace(e, v)
    else:
        e.content = [_text(v)] if _text(v) else []


def remove(root: Element, e: Element, parent: Element | None) -> None:
    if parent is None or e is root:
        raise ValueError("the root element cannot be deleted")
    parent.content = [x for x in parent.content if x is not e]


def serialise(root: Element) -> str:
    """The document with two blanks of indent; elements with text stay on one line."""

    def write(e: Element, depth: int) -> str:
        pad = "  " * depth
        head = f"<{e.name}" + "".join(f" {k}={quoteattr(v)}" for k, v in e.attributes.items())
        if not e.children:
            return f"{pad}{head}>{escape(e.text)}</{e.name}>\n" if e.text else f"{pad}{head}/>\n"
        if e.text:
            inner = "".join(escape(x) if isinstance(x, str) else write(x, 0).rstrip("\n") for x in e.content)
            return f"{pad}{head}>{inner}</{e.name}>\n"
        return f"{pad}{head}>\n" + "".join(write(c, depth + 1) for c in e.children) + f"{pad}</{e.name}>\n"

    return '<?xml version="1.0" encoding="UTF-8"?>\n' + write(root, 0)
