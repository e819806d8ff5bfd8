"""Repair of single records whose markup is broken."""

from __future__ import annotations

import re

from rowtally.sources.xmlscan import TOKEN

_ATTRIBUTE = re.compile(r"""([^\s=<>/"'&]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>]+))""")
_BARE = re.compile(r"&(?!(?:#[0-9]+|#x[0-9a-fA-F]+|amp|lt|gt|quot|apos);)")


def _text(value: str) -> str:
    return _BARE.sub("&amp;", value).replace("<", "&lt;")


def _attributes(inside: str) -> str:
    """Each attribute once and quoted; what is none goes."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(inside):
        found.setdefault(name, _text(double or single or bare).replace('"', "&quot;"))
    return "".join(f' {n}="{v}"' for n, v in found.items())


def repaired(record: str) -> str:
    """The record with every element closed.

    An end tag closes all that is open inside its element. One of another name than any open closes the innermost element, but
    never the record itself, and what is open at the end is closed there. A ``<`` or ``&`` that starts no markup becomes text.
    Comments, instructions and declarations go.
    """
    out, stack, at = [], [], 0
    for m in TOKEN.finditer(record):
        if m["open"] and m["stray"] is not None:
            continue  # no tag: stays with the text around it
        out.append(_text(record[at:m.start()]))
        at = m.end()
        if m["close"]:
            if m["close"] in stack:
                while (name := stack.pop()) != m["close"]:
                    out.append(f"</{name}>")
                out.append(f"</{m['close']}>")
            elif len(stack) > 1:
                out.append(f"</{stack.pop()}>")
        elif m["open"]:
            inside = m["inside"]
            empty = inside.endswith("/")
            out.append(f"<{m['open']}{_attributes(inside.removesuffix('/'))}{'/' if empty else ''}>")
            if not empty:
                stack.append(m["open"])
        elif m[0].startswith("<![CDATA["):
            out.append(m[0] if m[0].endswith("]]>") else m[0] + "]]>")
    out.append(_text(record[at:]))
    return "".join(out) + "".join(f"</{n}>" for n in reversed(stack))
