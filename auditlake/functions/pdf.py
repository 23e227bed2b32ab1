"""The structure of a PDF: cross-reference tables and streams, objects, and the page tree.

Nothing is drawn.  The helpers work on one file's bytes inside a task.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

WHITE = rb"[\x00\t\n\x0c\r ]"
TOKEN = re.compile(rb"(?:%[^\r\n]*|" + WHITE + rb")*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)")
REFERENCE = re.compile(WHITE + rb"+(\d+)" + WHITE + rb"+R(?![A-Za-z])")
#: Objects that a page tree or a chain of tables may have before it counts as damaged.
MOST = 1_000_000


class Ref(NamedTuple):
    number: int


def value_at(data: bytes, at: int):
    """(value, end) of the object at a place: dictionaries, lists, references, names as bytes with their slash, numbers."""
    m = TOKEN.match(data, at)
    if m is None:
        raise ValueError("no object")
    token, at = m[1], m.end()
    if token == b"<<" or token == b"[":
        items, close = [], b">>" if token == b"<<" else b"]"
        while (m := TOKEN.match(data, at)) and m[1] != close:
            item, at = value_at(data, at)
            items.append(item)
        if m is None:
            raise ValueError("unclosed object")
        return (dict(zip(items[::2], items[1::2], strict=False)) if close == b">>" else items), m.end()
    if token == b"(":
        depth = 1
        while depth:
            m = re.compile(rb"\\.|[()]", re.DOTALL).search(data, at)
            if m is None:
                raise ValueError("unclosed text")
            depth, at = depth + (m[0] == b"(") - (m[0] == b")"), m.end()
        return b"", at
    if token.isdigit() and (m := REFERENCE.match(data, at)):
        return Ref(int(token)), m.end()
    return (float(token) if re.fullmatch(rb"[+-]?\d*\.?\d*", token) and token.strip(b"+-.") else token), at


class Pdf:
    """Objects of a file by number; the newest entry of the tables counts."""

    def __init__(self, data: bytes):
        self.data, self.places, self.trailer = data, {}, {}
        self.streams: dict[int, dict[int, object]] = {}
        at, seen = int(re.findall(rb"startxref\s+(\d+)", data)[-1]), set()
        waiting = [at]
        while waiting:
            at = waiting.pop(0)
            if at in seen or len(seen) > MOST:
                continue
            seen.add(at)
            head = self.table(at) if re.match(rb"\s*xref", data[at : at + 20]) else self.table_stream(at)
            self.trailer = head | self.trailer
            waiting += [int(head[k]) for k in (b"/XRefStm", b"/Prev") if k in head]

    def table(self, at: int) -> dict:
        m = re.compile(rb"\s*xref\s+").match(self.data, at)
        at = m.end()
        while m := re.compile(rb"(\d+)\s+(\d+)\s*[\r\n]+").match(self.data, at):
            first, at = int(m[1]), m.end()
            for k in range(int(m[2])):
                offset, kind = int(self.data[at : at + 10]), self.data[at + 17 : at + 18]
                if kind == b"n":
                    self.places.setdefault(first + k, (offset, None))
                at += 20
        return value_at(self.data, re.compile(rb"\s*trailer").match(self.data, at).end())[0]

    def table_stream(self, at: int) -> dict:
        head, rows = self.stream(at)
        widths = [int(w) for w in head[b"/W"]]
        index = head.get(b"/Index", [0, head[b"/Size"]])
        at = 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for k in range(int(n)):
                fields, x = [], at
                for w in widths:
                    fields.append(int.from_bytes(rows[x : x + w]) if w else None)
                    x += w
                at += sum(widths)
                kind = 1 if fields[0] is None else fields[0]
                if kind:
                    self.places.setdefault(int(first) + k, (fields[1], None) if kind == 1 else (fields[1], fields[2]))
        return head

    def object_at(self, at: int):
        m = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        return value_at(self.data, m.end())

    def stream(self, at: int) -> tuple[dict, bytes]:
        """Dictionary and content of a stream that is plain or deflated, with the predictors of PNG."""
        head, end = self.object_at(at)
        start = re.compile(rb"\s*stream\r?\n").match(self.data, end).end()
        raw = self.data[start : start + int(self.value(head[b"/Length"]))]
        kind = self.value(head.get(b"/Filter", []))
        if kind in (b"/FlateDecode", [b"/FlateDecode"]):
            raw = zlib.decompressobj().decompress(raw)
        elif kind:
            raise ValueError("unknown filter")
        how = self.value(head.get(b"/DecodeParms", {}))
        how = self.value(how[0]) if isinstance(how, list) else how
        if int(how.get(b"/Predictor", 1)) >= 10:
            width = int(how.get(b"/Columns", 1))
            rows, above = [], bytes(width)
            for k in range(0, len(raw) - width, width + 1):
                if raw[k] not in (0, 2):
                    raise ValueError("unknown predictor")
                row = raw[k + 1 : k + 1 + width]
                above = bytes((x + y) & 255 for x, y in zip(row, above, strict=True)) if raw[k] else row
                rows.append(above)
            raw = b"".join(rows)
        return head, raw

    def value(self, x):
        """The object that a reference names, or the value itself."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            place, inside = self.places[x.number]
            x = self.object_at(place)[0] if inside is None else self.within(place)[x.number]
        raise ValueError("endless reference")

    def within(self, number: int) -> dict[int, object]:
        """The objects of an object stream."""
        if number not in self.streams:
            head, raw = self.stream(self.places[number][0])
            n, first = int(head[b"/N"]), int(head[b"/First"])
            pairs = [int(x) for x in raw[:first].split()[: 2 * n]]
            self.streams[number] = {k: value_at(raw, first + at)[0] for k, at in zip(pairs[::2], pairs[1::2], strict=True)}
        return self.streams[number]

    def pages(self):
        """(width, height, rotation) of each page in order; what a page does not say, its ancestors do."""
        waiting, seen = [(self.value(self.trailer[b"/Root"])[b"/Pages"], {})], set()
        while waiting:
            ref, given = waiting.pop()
            if isinstance(ref, Ref):
                if ref in seen or len(seen) > MOST:
                    raise ValueError("a page is in the tree twice")
                seen.add(ref)
            node = self.value(ref)
            given = given | {k: node[k] for k in (b"/MediaBox", b"/Rotate") if k in node}
            if b"/Kids" in node:
                waiting += [(kid, given) for kid in reversed(self.value(node[b"/Kids"]))]
            else:
                box = [float(self.value(x)) for x in self.value(given.get(b"/MediaBox", [0, 0, 612, 792]))]
                yield abs(box[2] - box[0]), abs(box[3] - box[1]), int(self.value(given.get(b"/Rotate", 0))) % 360


def page_count(path: str, content: bytes | None) -> int:
    """Pages of a PDF; fails if it is damaged."""
    return sum(1 for _ in Pdf(content or b"").pages())
