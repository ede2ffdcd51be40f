"""Walk of nested JSON: the one step no built-in expression can do.

VARIANT has no recursive function, orders object keys by name and rejects what the page's own order decides
(which of two equal postings comes first). So a small Arrow-batched function lists the objects of one script in visiting
order, cut down to the few fields the rules read. All rules on those fields are Spark expressions.

Two forms give the same list. Most scripts are read into a tree by the standard reader. A scanner does without the tree:
one pass over the text with the open lists and objects on a stack of its own, which keeps of each wanted field only where
it begins and ends. It takes scripts that are large or deep, as its memory follows their nesting and the objects
found, and those with long whole numbers, as it never converts one.
"""

from __future__ import annotations

import json
import re
import sys
from collections import deque
from collections.abc import Iterator
from itertools import compress

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import vocabulary as V

# The functions travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_HINTS = frozenset(V.JOB_HINT_KEYS)
_EMBEDDED_FIELDS = [*V.EMBEDDED_TITLE_KEYS, *V.EMBEDDED_URL_KEYS, "url", "location", "jobLocation"]
_LD_FIELDS = ["@type", "title", "url", "sameAs", "jobLocation"]
_SHOWN = ("title",)  # of linked data: shown as text whatever it is

LARGE = 4 << 20
#: Whole numbers of more digits are no VARIANT numbers.
DIGITS = 38
#: VARIANT takes a thousand levels. The rules look three levels into a field.
DEEPEST, LOOKED_AT = 500, 4


_NESTED = {dict, list}


def objects_everywhere(root: object) -> Iterator[dict]:
    """Objects with a job-hint key, parents first, in the order of the document."""
    todo = [root] if type(root) in _NESTED else []
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            if any(k.lower() in _HINTS for k in value):
                yield value
            value = value.values()
        # Plain values hold no objects; a list may have very many.
        todo.extend(reversed([*compress(value, map(_NESTED.__contains__, map(type, value)))]))


def linked_data_objects(root: object) -> Iterator[dict]:
    """Objects reachable through lists and '@graph' only, the graph's content before its owner."""
    todo = [(root, True)]
    while todo:
        value, fresh = todo.pop()
        if isinstance(value, list):
            todo.extend((v, True) for v in reversed(value))
        elif isinstance(value, dict) and fresh and "@graph" in value:
            todo += [(value, False), (value["@graph"], True)]
        elif isinstance(value, dict):
            yield value


def _finite(text: str) -> float | None:
    number = float(text)
    return number if number - number == 0 else None


_OPTIONS = {"parse_constant": lambda _: None, "parse_float": _finite}
_LONG = re.compile(rf"\d{{{DIGITS + 1}}}")


def _from_tree(root: object, linked: bool) -> list[str]:
    """The wanted fields of each visited object as JSON text. RecursionError when a field has too many levels to be written."""
    wanted = _LD_FIELDS if linked else _EMBEDDED_FIELDS
    out = []
    for found in linked_data_objects(root) if linked else objects_everywhere(root):
        # Escapes keep lone halves of surrogate pairs, which no encoding of text can hold.
        out.append(json.dumps({k: found[k] for k in wanted if k in found}))
        if out[-1].count("[") + out[-1].count("{") > DEEPEST:
            raise RecursionError
    return out


# --- the scanner --------------------------------------------------------------------------------

_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_NUMBER = r"-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?"
_TOKEN = re.compile(rf"[ \t\n\r]*+(?:(?P<mark>\[++|\]{{1,256}}+|[{{}},:])|(?P<string>{_STRING})|(?P<scalar>{_NUMBER}|true|false|null|NaN|-?Infinity))")
_PARTS = re.compile(rf"(?P<kept>{_STRING}|true|false|null|[,:])|(?P<opens>\[++|{{)|(?P<closes>\]++|}})|-?Infinity|NaN|(?P<number>{_NUMBER})")
_END = re.compile(r"[ \t\n\r]*+\Z")


class _Open:
    """A list or object whose end is not reached. Of an object: where its wanted fields lie, and what was found in each value.

    Lists that open one right in the other are one entry, `lists` of them open: all but the innermost hold nothing else so far.
    """

    __slots__ = ("is_object", "start", "lists", "deepest", "found", "key", "inside", "fields", "hinted")

    def __init__(self, is_object: bool, start: int, lists: int):
        self.is_object, self.start, self.lists, self.deepest, self.found = is_object, start, lists, 0, None
        self.key, self.inside, self.fields, self.hinted = None, {}, {}, False


def _joined(left: deque | None, right: deque | None) -> deque | None:
    """Both in order; the shorter is moved, so long lists are not copied again and again."""
    if not left or not right:
        return left or right
    if len(left) >= len(right):
        left.extend(right)
        return left
    right.extendleft(reversed(left))
    return right


def _closed(top: _Open, linked: bool) -> deque | None:
    """What an object holds in visiting order: itself before its values, or, as linked data, behind its graph."""
    if linked:
        return _joined(top.inside.get("@graph"), deque([top.fields]))
    found = deque([top.fields]) if top.hinted else None
    for inner in top.inside.values():
        found = _joined(found, inner)
    return found


def scanned(text: str, linked: bool) -> deque:
    """For each visited object the wanted fields it has, as (begin, end, levels) of the text. ValueError when malformed."""
    wanted = frozenset(_LD_FIELDS if linked else _EMBEDDED_FIELDS)
    stack: list[_Open] = []
    at, expects = 0, "value"
    while True:
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError(f"malformed at {at}")
        at, mark, string = token.end(), token["mark"], token["string"]
        kind = mark and mark[0]
        if kind in ("[", "{") and expects in ("value", "value or end"):
            stack.append(_Open(kind == "{", at - len(mark), len(mark)))
            expects = "key or end" if kind == "{" else "value or end"
            continue
        if string is not None and expects in ("key", "key or end"):
            top = stack[-1]
            top.key = json.loads(string) if "\\" in string else string[1:-1]
            expects = ":"
            continue
        if kind == ":" and expects == ":":
            expects = "value"
            continue
        if kind == "," and expects == ", or end":
            expects = "key" if stack[-1].is_object else "value"
            continue
        if kind in ("]", "}") and expects in (", or end", "key or end" if kind == "}" else "value or end") and stack[-1].is_object == (kind == "}"):
            top = stack[-1]
            closing = min(len(mark), top.lists)
            # What stands behind them in a run of ends is read again.
            at -= len(mark) - closing
            top.deepest += closing
            top.lists -= closing
            expects = ", or end"
            if top.lists:
                continue
            stack.pop()
            begin, levels = top.start, top.deepest
            found = _closed(top, linked) if top.is_object else top.found
        elif mark is None and expects in ("value", "value or end"):
            begin, levels, found = token.end() - len(string or token["scalar"]), 0, None
        else:
            raise ValueError(f"malformed at {at}")
        # A value is complete.
        if not stack:
            if not _END.match(text, at):
                raise ValueError(f"malformed at {at}")
            return found or deque()
        top = stack[-1]
        top.deepest = max(top.deepest, levels)
        if top.is_object:
            # Of equal keys the last value counts, at the place of the first.
            top.inside[top.key] = found
            top.hinted = top.hinted or top.key.lower() in _HINTS
            if top.key in wanted:
                top.fields[top.key] = (begin, at, levels)
        else:
            top.found = _joined(top.found, found)
        expects = ", or end"


def _number(token: str, instead: str | None = None) -> str:
    """A number as VARIANT can hold it. Long whole numbers are written as text, or as `instead` where only a text would count."""
    digits = token.lstrip("-")
    if digits.isdigit():
        return token if len(digits) <= DIGITS else instead or f'"{token}"'
    number = _finite(token)
    return "null" if number is None else repr(number)


def _written(text: str, begin: int, end: int, levels: int, shown: bool) -> str:
    """JSON text of a field: numbers as VARIANT can hold them, and of a value with too many levels those the rules look at."""
    if text[begin] == '"':
        return text[begin:end]
    keep = LOOKED_AT if levels > DEEPEST else levels
    out, level = [], 0
    for part in _PARTS.finditer(text, begin, end):
        if part["opens"]:
            out.append(part[0][: max(0, keep - level)])
            if level <= keep < level + len(part[0]):
                out.append("null")
            level += len(part[0])
        elif part["closes"]:
            kept, level = min(level, keep), level - len(part[0])
            out.append(part[0][: max(0, kept - level)])
        elif level <= keep:
            out.append(part["kept"] or (_number(part["number"], None if shown or level else "1") if part["number"] else "null"))
    return "".join(out)


def _from_spans(text: str, linked: bool) -> list[str]:
    """The same as `_from_tree`, from the text itself."""
    wanted = _LD_FIELDS if linked else _EMBEDDED_FIELDS
    shown = _SHOWN if linked else ()
    return [
        "{" + ", ".join(f'"{k}": {_written(text, *fields[k], k in shown)}' for k in wanted if k in fields) + "}" for fields in scanned(text, linked)
    ]


def _listing(text: str | None, linked: bool) -> list[str]:
    text = text or ""
    try:
        if len(text) <= LARGE and not _LONG.search(text):
            try:
                return _from_tree(json.loads(text, **_OPTIONS), linked)
            except RecursionError:
                pass
        return _from_spans(text, linked)
    except ValueError:
        return []


def json_objects(text: Column, linked: bool) -> Column:
    """ARRAY<STRING>: the visited objects of a JSON text; empty when it is malformed."""

    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _listing(t, linked))

    # A later filter must not take a copy of the walk with it: it would be done twice, the copy perhaps before a join.
    return walk.asNondeterministic()(text)
