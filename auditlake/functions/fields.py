"""Typed fields of business texts: addresses, amounts, dates, terms of payment, tax ids, signatures, item descriptions.

A text is a lattice: tokens lie between places, and a token may be several things at once (a
number, a year, a day).  Each production of the grammar is a sequence of kinds with a
weight; every stretch of tokens that it fits is an edge.  The fields are the edges of the
heaviest path through the lattice, so that of overlapping readings the more telling one
stays.  The helpers work on one text inside a task.

What starts at a token is found by one walk over the tokens' kinds for all productions
together: a step of the walk is a set of places in productions, and steps that were taken once are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import partial
from typing import NamedTuple

# fixed values: words that the grammar knows
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
STREETS = ("street", "road", "avenue", "lane", "square", "drive", "boulevard")
CURRENCY_SIGNS = "$€£¥₹"
CURRENCY_CODES = ("usd", "eur", "gbp", "jpy", "inr")
VAGUE = ("miscellaneous", "various", "sundries", "sundry", "misc", "etc")

TOKEN = re.compile(rf"\d{{4}}-\d\d-\d\d|\d+(?:[.,]\d+)*|[^\W\d_]+(?:[-'][^\W\d_]+)*|[{CURRENCY_SIGNS}%:;,./#-]")


class Field(NamedTuple):
    kind: str
    value: str
    start: int
    end: int
    weight: float


def kinds(token: str) -> set[str]:
    """Everything that a token can be."""
    low, out = token.lower(), {token.lower()}
    if re.fullmatch(r"\d{4}-\d\d-\d\d", token):
        out.add("ISO")
    elif token[0].isdigit():
        out.add("AMOUNT")
        # longer ones are neither a day nor a year, and int() refuses the longest
        if token.isdigit() and len(token) > 4000:
            out.add("NUMBER")
        elif token.isdigit():
            out |= {"NUMBER"} | ({"DAY"} if 1 <= int(token) <= 31 else set()) | ({"YEAR"} if 1900 <= int(token) <= 2100 else set())
    elif token[0] in CURRENCY_SIGNS:
        out.add("SIGN")
    elif token[0].isalpha():
        out.add("WORD")
        out |= ({"NAME"} if token[0].isupper() else set()) | ({"MONTH"} if low in MONTHS else set()) | ({"STREET"} if low in STREETS else set()) | ({"CODE"} if low in CURRENCY_CODES else set()) | ({"VAGUE"} if low in VAGUE else set())
    return out


#: (field, weight, sequence of kinds); a star takes up to three, a question mark one or none.
GRAMMAR = [
    ("address", 5, "NUMBER NAME* STREET"), ("address", 4, "NUMBER WORD* STREET"),
    ("amount", 3, "SIGN AMOUNT"), ("amount", 3, "AMOUNT CODE"), ("amount", 3, "CODE AMOUNT"), ("rate", 2, "AMOUNT %"),
    ("date", 3, "ISO"), ("date", 4, "DAY MONTH YEAR"), ("date", 4, "MONTH DAY ,? YEAR"),
    ("term", 4, "net NUMBER days?"), ("term", 5, "due on? ISO"), ("term", 5, "due by? ISO"), ("term", 4, "due by? DAY MONTH YEAR?"), ("term", 4, "due date :? ISO"), ("term", 4, "due date DAY MONTH YEAR?"), ("term", 4, "payable within NUMBER days"),
    ("tax_id", 4, "tax id :? NUMBER"), ("tax_id", 4, "vat id :? NUMBER"), ("tax_id", 4, "gst :? NUMBER"),
    ("signature", 4, "signed by NAME .? NAME?"), ("signature", 4, "signature : NAME .? NAME?"),
    ("term", 6, "NUMBER / NUMBER net NUMBER"), ("term", 4, "due on receipt"),
    *[("seller", 5, f"{x} : NAME*") for x in ("seller", "vendor", "supplier")], *[("buyer", 5, f"{x} : NAME*") for x in ("buyer", "customer", "receiver")],
    *[("total", 5, f"{x}total :? SIGN AMOUNT") for x in ("", "grand ")], ("subtotal", 5, "subtotal :? SIGN AMOUNT"), ("price", 5, "price :? SIGN AMOUNT"), ("quantity", 3, "quantity :? NUMBER"),
    *[("tax", 7, f"{x} AMOUNT % :? SIGN AMOUNT") for x in ("gst", "vat", "sales tax")], ("exemption", 5, "exempt under WORD* NUMBER?"), ("exemption", 5, "exemption certificate NUMBER?"),
    ("delivery", 5, "delivery date :? ISO"), ("effective", 5, "effective date :? ISO"), ("expiry", 5, "valid until ISO"),
    ("parties", 5, "parties : NAME and NAME"), ("scope", 4, "scope : NAME*"), ("duration", 4, "duration : NUMBER WORD"), ("issuer", 5, "issued by : NAME*"), ("holder", 5, "issued to : NAME*"),
    ("vague", 2, "VAGUE"), ("vague", 3, "services rendered"),
]


def ends(shape: list[str], tokens: list[set[str]], at: int) -> Iterator[int]:
    """Every place where a sequence of kinds that starts at a token can end."""
    if not shape:
        yield at
        return
    kind, rest = shape[0].rstrip("*?"), shape[1:]
    if shape[0].endswith("?"):
        yield from ends(rest, tokens, at)
    for n in range(1, 4 if shape[0].endswith("*") else 2):
        if at + n > len(tokens) or kind not in tokens[at + n - 1]:
            break
        yield from ends(rest, tokens, at + n)


def value_of(kind: str, text: str) -> str:
    """The plain form of a field: amounts as numbers, names without their label, dates and what is due on one as yyyy-MM-dd where they are whole."""
    if kind in ("seller", "buyer", "parties", "scope", "duration", "issuer", "holder"):
        return " ".join(text.partition(":")[2].split())
    if kind in ("amount", "rate", "tax_id", "total", "subtotal", "price", "quantity"):
        number = re.search(r"\d[\d.,]*", text)[0].rstrip(".,")
        whole, point, cents = number.rpartition("." if number.rfind(".") > number.rfind(",") else ",")
        return re.sub(r"[.,]", "", number) if not point or len(cents) == 3 else re.sub(r"[.,]", "", whole) + "." + cents
    if kind in ("date", "term", "delivery", "effective", "expiry"):
        if iso := re.search(r"\d{4}-\d\d-\d\d", text):
            return iso[0]
        month = next((k + 1 for k, m in enumerate(MONTHS) if m in text.lower().split()), 0)
        numbers = re.findall(r"\d+", text)
        if month and len(numbers) == 2:
            try:
                numbers = [int(x) for x in numbers]
                return date(max(numbers), month, min(numbers)).isoformat()
            except ValueError:
                return text
    return " ".join(text.split())


#: Entries of each table of what was seen; it starts anew when full.
SEEN = 50_000
#: Characters of the longest key that is kept.
LONG = 200

#: A production's place in the order of trial (by first kind, then as listed), its field, weight and sequence.
ORDERED = [(kind, float(weight), shape) for _, _, kind, weight, shape in sorted((s.split(" ")[0], k, kind, w, s.split(" ")) for k, (kind, w, s) in enumerate(GRAMMAR))]
NAMED = {x.rstrip("*?") for _, _, shape in ORDERED for x in shape}


class Seen(dict):
    """A table that makes what it lacks, keeps it unless its key is long, and starts anew when full."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        out = self.make(key)
        if len(key) <= LONG:
            if len(self) >= SEEN:
                self.clear()
            self[key] = out
        return out


class Step:
    """A set of places in productions: (production, which of its kinds is next, how many of a star were taken)."""

    __slots__ = ("after", "done", "places")
    known: dict[frozenset, Step] = {}

    def __init__(self, places: frozenset[tuple[int, int, int]]):
        self.places = places
        #: productions that may end here, in the order of trial
        self.done = [(p, *ORDERED[p][:2]) for p in sorted({p for p, at, _ in places if all(x.endswith("?") for x in ORDERED[p][2][at:])})]
        #: the step after a token by its kinds; None if no production goes on
        self.after = Seen(self.go)

    def go(self, sign: frozenset[str]) -> Step | None:
        to = set()
        for p, at, n in self.places:
            shape = ORDERED[p][2]
            for k in range(at, len(shape)):
                if shape[k].rstrip("*?") in sign:
                    to.add((p, k + 1, 0))
                    if shape[k].endswith("*") and (taken := n if k == at else 0) < 2:
                        to.add((p, k, taken + 1))
                if not shape[k].endswith("?"):
                    break
        places = frozenset(to)
        if not places:
            return None
        if places not in Step.known:
            Step.known[places] = Step(places)
        return Step.known[places]


START = Step(frozenset((p, 0, 0) for p in range(len(ORDERED))))
#: The kinds of a token that the grammar names, equal ones as one object.
SETS: dict[frozenset[str], frozenset[str]] = {}
SIGNS = Seen(lambda token: SETS.setdefault(x := frozenset(kinds(token) & NAMED), x))
VALUES = {kind: Seen(partial(value_of, kind)) for kind, _, _ in ORDERED}


def piece(text: str) -> tuple[list[frozenset[str]], list[int], list[int]]:
    """The signs of the tokens of a text, where they start and end."""
    found = list(TOKEN.finditer(text))
    return [SIGNS[m[0]] for m in found], [m.start() for m in found], [m.end() for m in found]


#: No token has a space, so what lies between spaces is taken apart by itself.
PIECES = Seen(piece)


def fields(text: str) -> list[Field]:
    """The fields on the heaviest path, in order; of equally heavy paths that with longer fields first."""
    signs, begins, closes, shift, after = [], [], [], [], 0
    for part in text.split(" "):
        s, a, b = PIECES[part]
        signs += s
        begins += a
        closes += b
        shift += [after] * len(s)
        after += len(part) + 1
    n = len(signs)
    starts = list(map(START.after.__getitem__, signs))
    weights, edges = [0.0] * (n + 1), [None] * n
    top = 0.0
    for at in range(n - 1, -1, -1):
        step = starts[at]
        if step is not None:
            end, edge, first = at, None, 0
            while step is not None:
                end += 1
                if step.done:
                    # a longer reading of the same kind says more
                    for p, kind, weight in step.done:
                        total = weights[end] + weight + 0.01 * (end - at)
                        if total > top or (total == top and edge and p < first):
                            top, edge, first = total, (kind, weight, end), p
                if end == n:
                    break
                step = step.after[signs[end]]
            edges[at] = edge
        weights[at] = top
    out, at = [], 0
    while at < n:
        if edge := edges[at]:
            kind, weight, end = edge
            a, b = begins[at] + shift[at], closes[end - 1] + shift[end - 1]
            out.append(Field(kind, VALUES[kind][text[a:b]], a, b, weight))
            at = end
        else:
            at += 1
    return out
