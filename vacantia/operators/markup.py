"""Pages that the patterns of `html` would misread, written anew in a form that they read right.

A pattern finds a tag wherever '<' stands. It does not see that the '<' is part of an attribute value, or of an element whose
content is text (`textarea`, `title`, `iframe` ...), and it takes the first of repeated attributes. Such pages are few. A
test on the JVM tells them, and only those go through the tokenizer here: one pass over the page with the states data,
tag, attribute, raw text and text with references, each step ending behind where it began. It writes the same page
with the attributes that are read, each once, and without '<' that opens nothing.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The functions travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

READ_ATTRIBUTES = {"a": ("href", "title", "aria-label"), "script": ("id", "type")}
#: Elements whose content is text: with character references, or without.
REFERENCED, UNREFERENCED = ("textarea", "title"), ("xmp", "iframe", "noembed", "noframes")
HIDDEN = ("script", "style")

# --- the test, in Java's patterns -----------------------------------------------------------------
# A tag with '<' before its end, or a quote that does not end before one.
_OPEN_INSIDE = r"""[a-z](?:[^<>"'=]++|=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s<>"'][^\s<>]*+|(?=[<>]))|["'])*+(?:<|=\s*+["'])"""
# A text element with markup in it.
_TEXT_ELEMENT = rf"""({'|'.join([*REFERENCED, *UNREFERENCED])})(?=[\s/>])(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|["'])*+>[^<]*+<(?!/\1[\s/>])"""


def _repeated(tag: str) -> str:
    """A tag with one of its attributes twice."""
    found = []
    for name in READ_ATTRIBUTES[tag]:
        here = rf"""(?:[\s/]|(?<=["'])){name}(?=[\s/>=])"""
        others = rf"""(?:(?!{here})(?:[^\s/>="']++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>]))*+"""
        found.append(rf"{others}{here}{others}{here}")
    return rf"{tag}(?=[\s/>])(?:{'|'.join(found)})"


_DOUBTFUL = rf"(?i)<(?:{_OPEN_INSIDE}|{_TEXT_ELEMENT}|{_repeated('a')})"
_DOUBTFUL_SCRIPT = rf"(?i)<{_repeated('script')}"


def misread(html: Column, visible: Column) -> Column:
    """Whether the patterns may misread the page. `visible` is the page without what they take for scripts, styles and comments."""
    return visible.rlike(_DOUBTFUL) | html.rlike(_DOUBTFUL_SCRIPT)


# --- the tokenizer --------------------------------------------------------------------------------
_NEXT = re.compile(r"<(?:(?P<tag>/?[a-zA-Z][^\s/>]*+)|(?P<comment>!--)|[!?/])")
_ATTRIBUTE = re.compile(
    r"""[\s/]*+(?:(?P<name>[^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"(?P<double>[^"]*+)"|'(?P<single>[^']*+)'|(?P<bare>[^\s>]*+)))?+)?+"""
)
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in (*REFERENCED, *UNREFERENCED, *HIDDEN)}


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of the tag whose name ends at `at`, the last of each name, and where its '>' is; -1 if it has none."""
    found: dict[str, str] = {}
    while at < len(html) and html[at] != ">":
        m = _ATTRIBUTE.match(html, at)
        if m["name"] is not None:
            found[m["name"].lower()] = next((v for v in m.group("double", "single", "bare") if v is not None), "")
        at = m.end()
    return found, at if at < len(html) else -1


def _as_text(text: str) -> str:
    return text.replace("<", "&lt;")


def written_plainly(html: str) -> str:
    """The page as the patterns read it right. Time and memory are linear in its length.

    Comments and styles are left out. A tag, comment or text element that does not end takes the rest of the page.
    """
    out, at = [], 0
    while m := _NEXT.search(html, at):
        out.append(_as_text(html[at : m.start()]))
        if m["tag"] is None:
            end = html.find("-->" if m["comment"] else ">", m.end())
            at = len(html) if end < 0 else end + (3 if m["comment"] else 1)
            out.append("<!>")
            continue
        name = m["tag"].lower()
        attributes, end = _attributes(html, m.end())
        if end < 0:
            return "".join(out)
        at = end + 1
        read = [(n, attributes[n].replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")) for n in READ_ATTRIBUTES.get(name, ()) if n in attributes]
        tag = f"<{name}{''.join(f' {n}={chr(34)}{v}{chr(34)}' for n, v in read)}>" if name.isascii() else "<!>"
        if name not in _END:
            out.append(tag)
            continue
        close = _END[name].search(html, at)
        content, at = html[at : close.start() if close else len(html)], close.start() if close else len(html)
        if name == "script":
            out += [tag, content, "" if close else "</script>"]
        elif name == "style":
            out.append("<!>")
        else:
            out += [tag, _as_text(content if name in REFERENCED else content.replace("&", "&amp;"))]
    out.append(_as_text(html[at:]))
    return "".join(out)


def plain_form(html: Column) -> Column:
    """`written_plainly` of the pages that are not null."""

    @F.pandas_udf("string")
    def write(pages: pd.Series) -> pd.Series:
        return pages.map(written_plainly, na_action="ignore")

    return write(html)
