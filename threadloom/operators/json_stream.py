"""Reading a JSON record as a stream: one element at a time, never the whole record.

`Reader.record` walks the text of a record from left to right. Of the envelope, the record's members, its collections and what they come
wrapped in it keeps no more than its place in the text; each element of a collection is read, turned into path-value-ordinal
triples, pivoted to rows and let go. What is held of a record are the rows asked for (`wanted`), as its text is only known to be valid
at its end. Containers nested too deep for the parser of the standard library are read by `deep`, which keeps its own stack.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from hashlib import blake2b

#: Keys under which services wrap the elements of a collection.
LISTS, NODE = ("nodes", "edges", "pages"), "node"
SPACE = re.compile(r"[ \t\n\r]*")
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
DIGITS = 4000
NO_FIELDS: dict = {}  # of all rows that keep none; never written to
WORDS = {"true": True, "false": False, "null": None}

Row = tuple[str, tuple[int, ...], dict | None, object]  # relation, ordinals, fields (None: a null element), identity


@dataclass(frozen=True)
class ShredSpec:
    """What to take from a record.

    roots: object paths behind which the record may stand. collections: fields that hold elements even when they come
    wrapped, encoded as text or alone. promoted: objects inside an element that become a relation of their own, at the
    element's ordinals. identity: per relation the relative paths that tell a first element from a repeated one; an
    empty tuple means all fields, a missing entry means that nothing repeats. A null identity never repeats.
    wanted: per relation the fields to give; None means all relations with all fields.
    """

    roots: tuple[tuple[str, ...], ...] = ()
    collections: frozenset[str] = frozenset()
    promoted: frozenset[str] = frozenset()
    identity: dict[str, tuple[str, ...]] = field(default_factory=dict)
    wanted: dict[str, frozenset[str]] | None = None


def _constant(token: str) -> None:
    raise ValueError(f"{token} is not JSON")


def _integer(digits: str) -> int | str:
    return int(digits) if len(digits) < DIGITS else digits  # longer ones stay text, as they are written


SCAN = json.JSONDecoder(parse_constant=_constant, parse_int=_integer).scan_once
STRING = json.decoder.scanstring


def text_of(value) -> str:
    """A scalar, or what is left of a container, as text."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def deep(text: str, at: int) -> tuple[object, int]:
    """The value at a place and its end, whatever its depth."""
    stack: list[list] = []  # [container, key]
    while True:
        at = SPACE.match(text, at).end()
        c = text[at : at + 1]
        if c and c in "[{":
            stack.append([[] if c == "[" else {}, None])
            at = SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                if c == "{":
                    at = _key(text, at, stack[-1])
                continue
            value, at = stack.pop()[0], at + 1
        elif c == '"':
            value, at = STRING(text, at + 1, True)
        elif m := NUMBER.match(text, at):
            value, at = (_integer(m[0]) if re.fullmatch(r"-?\d+", m[0]) else float(m[0])), m.end()
        else:
            word = next((w for w in WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError("no value")
            value, at = WORDS[word], at + len(word)
        while stack:
            container, key = stack[-1]
            if key is None:
                container.append(value)
            else:
                container[key] = value
            at = SPACE.match(text, at).end()
            c = text[at : at + 1]
            if c == ",":
                at = SPACE.match(text, at + 1).end()
                if key is not None:
                    at = _key(text, at, stack[-1])
                break
            if c != ("]" if key is None else "}"):
                raise ValueError("no end")
            value, at = container, at + 1
            stack.pop()
        else:
            return value, at


def _key(text: str, at: int, frame: list) -> int:
    if text[at : at + 1] != '"':
        raise ValueError("no key")
    frame[1], at = STRING(text, at + 1, True)
    at = SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("no colon")
    return at + 1


def elements(value, declared: bool, lists: tuple[str, ...] = LISTS) -> Iterator | None:
    """The elements that a value stands for, or None if it is no collection."""
    if isinstance(value, list):
        return iter(value)
    if isinstance(value, dict):
        for key in lists:
            inner = value.get(key)
            if isinstance(inner, list):
                return _unwrapped(key, inner)
        return iter((value,)) if declared else None
    if declared and isinstance(value, str):
        try:
            inner = Reader(value).whole()
        except ValueError:
            inner = None
        return elements(inner, True) if isinstance(inner, list | dict) else iter((value,))
    return None


def _unwrapped(key: str, inner: list) -> Iterator:
    if key == "nodes":
        return iter(inner)
    if key == "edges":
        return (e.get(NODE) if isinstance(e, dict) else e for e in inner)
    return (x for page in inner for x in (elements(page, False, LISTS[:2]) or ()))


def triples(node, spec: ShredSpec, path: str, ordinals: tuple[int, ...] = ()) -> Iterator[tuple[str, tuple[int, ...], object]]:
    """Path-ordinals-value triples of an element, in document order, whatever its depth.

    Objects give a triple of their own whose value is the empty dict, so that an empty object differs from null.
    """
    stack = [iter(((path, ordinals, node, False),))]
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            continue
        at, where, value, expand = step
        if not isinstance(value, dict | list):
            yield at, where, value
            continue
        inner = elements(value, False) if expand or isinstance(value, list) else None
        if inner is not None:
            stack.append(_numbered(inner, f"{at}[]", where))
            continue
        yield at, where, {}
        stack.append(_members(value, spec, at, where))


def _numbered(inner: Iterator, at: str, where: tuple[int, ...]) -> Iterator:
    return ((at, (*where, n), e, False) for n, e in enumerate(inner))


def _members(value: dict, spec: ShredSpec, at: str, where: tuple[int, ...]) -> Iterator:
    for key, inner in value.items():
        below = f"{at}.{key}" if at else key
        some = elements(inner, True) if inner is not None and below in spec.collections else None
        if some is None:
            yield below, where, inner, True
        else:
            for n, e in enumerate(some):
                yield f"{below}[]", (*where, n), e, False


class Pivot:
    """Groups an element's triples by their repeated ancestor into rows."""

    def __init__(self, spec: ShredSpec) -> None:
        self.spec, self.memo = spec, {}

    def ancestor(self, path: str) -> tuple[str, str]:
        """(relation, path inside it) of a triple's path."""
        if (known := self.memo.get(path)) is None:
            cut = path.rfind("[]") + 2 if "[]" in path else 0
            for p in self.spec.promoted:
                if (path == p or path.startswith(p + ".")) and len(p) > cut:
                    cut = len(p)
            known = self.memo[path] = (path[:cut], path[cut:].lstrip("."))
        return known

    def rows(self, node, path: str, ordinals: tuple[int, ...] = ()) -> list[Row]:
        """The rows of one element, or of a member that is no collection."""
        spec, found = self.spec, {}
        for at, where, value in triples(node, spec, path, ordinals):
            relation, inside = self.ancestor(at)
            if not relation:
                continue
            if value is None:
                if not inside and relation not in spec.promoted:
                    found.setdefault((relation, where), None)
                continue
            row = found.get((relation, where))
            if row is None:
                row = found[relation, where] = {}
            if isinstance(value, dict):
                if inside:
                    row[inside + "{}"] = ""
            else:
                row[inside] = text_of(value)
        out = []
        for (relation, where), row in found.items():
            identity = self.identity(relation, where, row, found)
            if spec.wanted is not None:
                if relation not in spec.wanted:
                    if relation in spec.identity:
                        out.append((relation, where, None if row is None else NO_FIELDS, identity))
                    continue
                row = row and ({k: v for k, v in row.items() if k in spec.wanted[relation]} or NO_FIELDS)
            elif row:
                row = {k: v for k, v in row.items() if k[-2:] != "{}"}
            out.append((relation, where, row, identity))
        return out

    def identity(self, relation: str, where: tuple[int, ...], row: dict | None, found: dict) -> object:
        keys = self.spec.identity.get(relation)
        if keys is None or row is None:
            return None
        if keys:
            return next((row[k] for k in keys if row.get(k) is not None), None)
        inner = [(p, sorted(found[p, where].items())) for p in self.spec.promoted if p.startswith(relation) and found.get((p, where)) is not None]
        return blake2b(repr((sorted(row.items()), inner)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Reader:
    """Walks one text."""

    def __init__(self, text: str, pivot: Pivot | None = None) -> None:
        self.text, self.pivot = text, pivot

    def space(self, at: int) -> int:
        return SPACE.match(self.text, at).end()

    def value(self, at: int) -> tuple[object, int]:
        try:
            return SCAN(self.text, at)
        except StopIteration:
            raise ValueError("no value") from None
        except RecursionError:
            return deep(self.text, at)

    def whole(self) -> object:
        value, at = self.value(self.space(0))
        if self.space(at) != len(self.text):
            raise ValueError("more than a value")
        return value

    def members(self, at: int, take: Callable[[str, int], int]) -> int:
        """Calls take(key, place of its value), which gives the value's end, for each member of the object that opens at a place."""
        text, at = self.text, self.space(at + 1)
        if text[at : at + 1] == "}":
            return at + 1
        frame = [None, None]
        while True:
            at = take_at = self.space(_key(text, at, frame))
            at = self.space(take(frame[1], take_at))
            if text[at : at + 1] == "}":
                return at + 1
            if text[at : at + 1] != ",":
                raise ValueError("no end of object")
            at = self.space(at + 1)

    def items(self, at: int, take: Callable[[int], int]) -> int:
        """The same for the elements of an array."""
        text, at = self.text, self.space(at + 1)
        if text[at : at + 1] == "]":
            return at + 1
        while True:
            at = self.space(take(at))
            if text[at : at + 1] == "]":
                return at + 1
            if text[at : at + 1] != ",":
                raise ValueError("no end of array")
            at = self.space(at + 1)

    def skip(self, at: int, levels: int = 3) -> int:
        """The end of a value that nobody wants; of large containers no more than a part is built."""
        c = self.text[at : at + 1]
        if levels and c == "{":
            return self.members(at, lambda _, j: self.skip(j, levels - 1))
        if levels and c == "[":
            return self.items(at, lambda j: self.skip(j, levels - 1))
        return self.value(at)[1]

    def collection(self, at: int, path: str, declared: bool) -> tuple[list[list[Row]] | None, int]:
        """Rows of each element of the collection at a place (None if it is none), and its end. Rows have their ordinals from the
        second on: the first is the element's place in the list."""
        c, rows = self.text[at : at + 1], self.pivot.rows
        if c == "[":
            out: list[list[Row]] = []

            def one(j: int) -> int:
                value, end = self.value(j)
                out.append(rows(value, path))
                return end

            return out, self.items(at, one)
        if c == "{" and declared:
            wrapped: dict[str, list[list[Row]]] = {}
            other: dict = {}

            def member(key: str, j: int) -> int:
                wrapped.pop(key, None)
                other.pop(key, None)
                if key not in LISTS or self.text[j : j + 1] != "[":
                    other[key], end = self.value(j)
                    return end
                some = wrapped[key] = []

                def each(k: int) -> int:
                    value, end = self.value(k)
                    some.extend(rows(e, path) for e in _unwrapped(key, [value]))
                    return end

                return self.items(j, each)

            end = self.members(at, member)
            best = next((wrapped[k] for k in LISTS if k in wrapped), None)
            return ([rows(other, path)] if best is None else best), end
        value, end = self.value(at)
        if value is None:
            return None, end
        if declared and isinstance(value, str):
            inner = Reader(value, self.pivot)
            try:
                start = inner.space(0)
                if value[start : start + 1] in ("[", "{"):
                    found, stop = inner.collection(start, path, True)
                    if inner.space(stop) == len(value):
                        return found, end
            except ValueError:
                pass
        if declared:
            return [rows(value, path)], end
        return None, end

    def record(self, at: int) -> tuple[dict | None, int]:
        """Member -> its rows, for the record at a place or behind its envelope there; and the end. None if there is no object."""
        spec, text = self.pivot.spec, self.text
        if text[at : at + 1] == "[":
            pages: list[dict] = []

            def page(j: int) -> int:
                found, end = self.record(j)
                if found is not None:
                    pages.append(found)
                return end

            end = self.items(at, page)
            return (self.together(pages) if pages else None), end
        if text[at : at + 1] != "{":
            return None, self.value(at)[1]
        own: dict[str, list] = {}
        roots: dict[tuple[str, ...], dict | None] = {}
        heads = {r[0] for r in spec.roots}

        def member(key: str, j: int) -> int:
            own.pop(key, None)
            if key in heads and text[j : j + 1] == "{":
                for root in spec.roots:
                    if root[0] == key:
                        roots[root] = None
                        end = self.root(root[1:], j, lambda found, root=root: roots.__setitem__(root, found))
                if not any(r[0] == key and roots.get(r) is not None for r in spec.roots) and spec.wanted is None:
                    own[key] = [False, self.pivot.rows(self.value(j)[0], key)]
                return end
            for root in list(roots):
                if root[0] == key:
                    del roots[root]
            declared = key in spec.collections
            if spec.wanted is not None and not declared:
                return self.skip(j)
            if declared or text[j : j + 1] == "[":
                found, end = self.collection(j, f"{key}[]", declared)
                if found is not None:
                    own[key] = [True, found]
                return end
            value, end = self.value(j)
            inner = elements(value, False) if isinstance(value, dict) else None
            own[key] = [True, [self.pivot.rows(e, f"{key}[]") for e in inner]] if inner is not None else [False, self.pivot.rows(value, key)]
            return end

        end = self.members(at, member)
        found = next((r for root in spec.roots if (r := roots.get(root)) is not None), None)
        return (own if found is None else found), end

    def root(self, rest: tuple[str, ...], at: int, take: Callable[[dict | None], None]) -> int:
        """Follows the path of an envelope; take gets the record behind it, the last one if a key repeats."""
        if not rest:
            found, end = Reader(self.text, Pivot(replace(self.pivot.spec, roots=()))).record(at)
            take(found)
            return end

        def member(key: str, j: int) -> int:
            if key != rest[0]:
                return self.skip(j)
            take(None)
            return self.root(rest[1:], j, take) if self.text[j : j + 1] == "{" else self.skip(j)

        return self.members(at, member)

    def together(self, pages: list[dict]) -> dict:
        """Several objects in one array are pages of one record: their collections run on, of other members the first counts."""
        out: dict[str, list] = {}
        for page in pages:
            for key, (many, rows) in page.items():
                if key in self.pivot.spec.collections and key in out:
                    out[key][1] = out[key][1] + rows
                elif key not in out:
                    out[key] = [many, list(rows)]
        return out

    def rows(self) -> Iterator[tuple[str, tuple[int, ...], bool, bool, dict]]:
        """(relation, ordinals, is_null, is_first, fields) of a whole text; nothing if there is no record; ValueError, at once, if it
        isn't JSON."""
        found, at = self.record(self.space(0))
        if self.space(at) != len(self.text):
            raise ValueError("more than a value")
        return self._marked(found or {})

    def _marked(self, found: dict) -> Iterator[tuple[str, tuple[int, ...], bool, bool, dict]]:
        spec, promoted = self.pivot.spec, {p: p[: p.rfind("[]") + 2] for p in self.pivot.spec.promoted}
        seen: dict[tuple, set] = {}
        while found:
            many, rows = found.pop(next(iter(found)))
            groups = rows if many else [rows]
            groups.reverse()  # elements are let go from the end
            for n in range(len(groups)):
                some, first = groups.pop(), {}
                for relation, where, fields, identity in some:
                    if fields is None or identity is None:
                        first[relation, where] = True
                        continue
                    known = seen.setdefault((relation, ((n, *where) if many else where)[:-1]), set())
                    first[relation, where] = identity not in known
                    known.add(identity)
                for relation, where, fields, _ in some:
                    if spec.wanted is None or relation in spec.wanted:
                        is_first = first.get((promoted[relation], where), True) if relation in promoted else first[relation, where]
                        yield relation, (n, *where) if many else where, fields is None, is_first, fields or NO_FIELDS
