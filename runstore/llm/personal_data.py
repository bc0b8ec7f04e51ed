"""Personal data in whole texts: fixed patterns, and spans that a conditional random field adds."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .crf import Tagger
from .secrets import added, stutter, words

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CAUTION = 0.5
LONG_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+`` and DOMAIN: the local part is all that stands before an @."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of KINDS, then of start."""
    out = emails(text)
    for m in IP.finditer(text):
        # [0-9] is ASCII here; a part of more than three digits may still be small by leading zeros
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    if LONG_NUMBER.search(text):
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


MARKED = re.compile(r"@|[(\[]\x20*at\x20*[)\]]", re.IGNORECASE)


def sound(text: str) -> bool:
    """Whether what the model found may be personal data: an address has its sign, a number its digits,
    and what looks like a card or a machine's address its sum or bounds, which a tagger doesn't see."""
    if any(c.isalpha() for c in text):
        return MARKED.search(text) is not None
    groups = re.findall(r"[0-9]+", text)
    digits = "".join(groups)
    if "." in text and len(groups) == 4 and max(map(len, groups)) <= 3 and "+" not in text:
        return all(int(g) <= 255 for g in groups)
    return luhn(digits) if 13 <= len(digits) <= 19 and "+" not in text else 7 <= len(digits) <= 15


def labelled_table(rows: int = 900, seed: int = 13) -> list[tuple[str, list[tuple[int, int]]]]:
    """The training table: texts made from a few seeded forms, with the spans of personal data; half are without any."""
    r = random.Random(seed)
    run = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    num = lambda n: run("0123456789", n)
    low = "abcdefghijklmnopqrstuvwxyz"
    name = lambda: run(low, r.choice((2, 4, 6, 8))) + r.choice(("", "." + num(2), "." + run(low, 5), "_" + run(low, 3), num(2)))
    host = lambda: run(low, r.choice((4, 6, 9))) + r.choice(("", num(1), "." + run(low, 4)))
    tld = lambda: r.choice(("com", "org", "net", "de", "fr", "example.com", "example.org"))

    def card(parting: str) -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return parting.join(d[i : i + 4] for i in range(0, 16, 4))

    def datum() -> str:
        k = r.randrange(14)
        if k < 3:
            return f"{name()}@{host()}.{tld()}"
        if k == 3:
            at, dot = r.choice((("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."), ("[at]", ".")))
            return f"{name()} {at} {run(low, 6)} {dot} {r.choice(('com', 'org', 'net'))}" if dot != "." else f"{name()} {at} {run(low, 6)}.{tld()}"
        if k < 6:
            return ".".join(str(r.randrange(256)) for _ in range(4))
        if k == 6:
            return "[.]".join(str(r.randrange(256)) for _ in range(4))
        if k < 9:
            return card(r.choice(("", " ", "-", ".")))
        if k == 9:
            return f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"
        if k == 10:
            return r.choice((f"+{num(2)} {num(3)} {num(7)}", f"+{num(1)} {num(3)} {num(3)} {num(4)}", f"+{num(2)}-{num(2)}-{num(4)}-{num(4)}", f"00{num(2)} {num(3)} {num(6)}"))
        if k == 11:
            return r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(6)}"))
        return f"{num(3)}-{num(2)}-{num(4)}"

    def clean() -> str:
        return r.choice((
            words(r, 8), stutter(r), stutter(r), stutter(r), " ".join([r.choice(("at", "dot", "com", words(r, 1)))] * 8), num(r.choice((1, 2, 3, 4, 5, 6))), num(r.choice((7, 8, 12, 20))), f"{words(r, 1)} at {words(r, 2)}",
            f"{words(r, 2)} ({words(r, 1)}) [{words(r, 1)}]", f"{num(2)}.{num(2)}", f"{num(1)}.{num(1)}.", f"v{num(1)}.{num(1)}.{num(1)}", f"version {num(1)}.{num(2)}.{num(1)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(2)}:{num(2)}:{num(2)}",
            f"{num(3)},{num(3)}", f"{num(1)},{num(3)},{num(3)}.{num(2)}", run("0123456789abcdef", 40), "AKIA" + run("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), f'token = "{run("0123456789abcdef", 40)}"', f"the end at {run(low, 5)} dot", f"1. {words(r, 2)} 2. {words(r, 2)}",
            "| " + " | ".join(words(r, 1) for _ in range(5)), f"https://{host()}.{tld()}/{run(low, 6)}", f"www.{host()}.{tld()}", f"{num(2)}/{num(2)}", f"Copyright (c) 20{num(2)}", f"{r.choice((18, 19, 20))}{num(2)}-{r.choice((19, 20))}{num(2)}", f"20{num(2)}-{num(6)}", f"pages {num(3)}-{num(3)}", f"{num(2)}-{num(2)}", f"@{run(low, 7)} {words(r, 2)}", f"room {num(3)}, floor {num(1)}",
            "%%% " + words(r, 4) + " ***", f"ISBN {num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"order {num(3)}-{num(7)}", f"{num(1)}e-{num(2)}", f"{run(low, 4)}@{num(1)}.{num(1)}.{num(1)}",
        ))

    out = []
    for i in range(rows):
        a, b = words(r, r.randrange(0, 6)), words(r, r.randrange(0, 6))
        if i % 2:
            out.append((f"{a} {clean()} {b}", []))
        else:
            d, lead = datum(), r.choice(("", "", "", "call ", "mail: ", "contact ", "tel. ", "from ", "host ", "card "))
            tail = r.choice((" ", " ", ". ", ", ", "%%% ", "!! "))
            at = len(f"{a} {lead}")
            out.append((f"{a} {lead}{d}{tail}{b}", [(at, at + len(d))]))
    return out


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    return Tagger(joining="_", caution=CAUTION).fit(labelled_table())


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array of (kind, start, end) in code points, for each row of ``docs``.

    Kinds email, ip, card and phone are the base patterns, in this order and then by start; kind crf
    are spans that the model adds where no base span is, of the same kinds in other forms and of
    numbers that persons have; what looks like a card or an address must pass its sum or bounds.
    Null and empty texts have none, texts may be of any length; a row gives a row, repeated and null
    ids too; other columns are ignored. The model is fitted on the driver from ``labelled_table``.
    """
    ship(docs.sparkSession)
    model = tagger()

    def run(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            more, out = model.spans(batch.column(1)), []
            for k, text in enumerate(batch.column(1).to_pylist()):
                base = base_spans(text) if text else []
                fit = [(a, b) for a, b in more.get(k, ()) if sound(text[a:b])]
                out.append([{"kind": x, "start": a, "end": b} for x, a, b in base + added(base, fit)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kind))], ["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: int, end: int>>")
