"""Secrets in whole texts: fixed patterns, and spans that a conditional random field adds."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .crf import Tagger

KINDS = ("assign", "access", "hex")
# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA[A-Z0-9]+ of 20 characters or more: runs are maximal either way
HEX = re.compile(r"[0-9a-f]{24,}")
CAUTION = 0.5
KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of start, then of KINDS."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if KEYWORD.search(text) else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))



def added(base, spans, kind: str = "crf"):
    """The model's spans that touch no base span."""
    taken, at, out = sorted((a, b) for _, a, b in base), 0, []
    for a, b in spans:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not any(x < b and y > a for x, y in taken[at : at + 8]):
            out.append((kind, a, b))
    return out


def sound(text: str) -> bool:
    """Whether what the model found may be a secret: 8 ASCII characters or more, with digits, or long and of mixed case."""
    if len(text) < 8 or not text.isascii():
        return False
    return any(c.isdigit() for c in text) or len(text) >= 16 and text.lower() != text != text.upper()


PARTS = ("an", "er", "in", "th", "on", "re", "st", "la", "que", "ung", "der", "tion", "ment", "os", "el", "ich", "ou", "ble", "ja", "mi", "ción", "ñ", "é", "è", "ê", "ç", "ü", "ö", "ä", "ß", "í", "ó", "at", "of", "the", "es", "a", "is")


def words(r: random.Random, n: int) -> str:
    """Invented prose, as filler around what is labelled."""
    out = []
    for _ in range(n):
        w = "".join(r.choice(PARTS) for _ in range(r.choice((1, 1, 2, 2, 3, 4, 6, 8))))
        w = r.choice((w, w, w, w, w.capitalize(), w.upper())) + r.choice(("",) * 9 + (",", ".", ".", "!!", "%%%", "***", "###", "$$$", "&&&", " |", ":", "?"))
        out.append(w)
    return " ".join(out)


def stutter(r: random.Random) -> str:
    """Prose that repeats itself: a syllable within a word, a word, or a few words."""
    k = r.randrange(3)
    if k == 0:
        w = r.choice(PARTS) * r.choice((3, 4, 6, 9))
        return f"{words(r, 2)} {r.choice((w, w.capitalize(), w + r.choice(PARTS)))}{r.choice(('', '', '.', ','))} {words(r, 2)}"
    return " ".join([words(r, 1 if k == 1 else 2)] * r.choice((3, 5, 7)))


def labelled_table(rows: int = 750, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """The training table: texts made from a few seeded forms, with the secrets' spans; half are without any."""
    r = random.Random(seed)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = upper + lower + digit
    run = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    names = ("password", "passwd", "secret", "token", "api_key", "apikey", "pwd", "passphrase", "credential", "auth", "bearer", "Authorization", "client_secret", "access_key", "private_key", "key", "pass", "login", "signing_key", "DB_PASS", "SECRET_KEY", "pin")

    def secret() -> str:
        k = r.randrange(8)
        if k == 0:
            return run("0123456789abcdef", r.choice((24, 32, 40, 64)))
        if k == 1:
            return r.choice(("AKIA", "ASIA")) + run(upper + digit, 16)
        if k == 2:
            return r.choice(("ghp", "sk_live", "xoxb", "pat", "key", "npm", "glpat", "rk_test", "whsec")) + r.choice("_-") + run(alnum, r.choice((16, 24, 36)))
        if k == 3:
            return "eyJ" + run(alnum, 20) + "." + run(alnum, 30) + r.choice(("", "." + run(alnum + "_-", 40)))
        if k == 4:  # what a person makes up: a word with digits and signs in it
            w = run(lower, r.choice((4, 6, 8)))
            return "".join(c.upper() if r.random() < 0.3 else c for c in w) + run(digit, r.choice((2, 3, 4))) + run(alnum, r.choice((0, 3, 6)))
        return run(alnum if k < 7 else alnum + "+/", r.choice((12, 16, 20, 28, 40)))

    def clean() -> str:
        host = lambda: run(lower, r.choice((4, 7, 9)))
        return r.choice((
            words(r, 6), stutter(r), stutter(r), run(digit, r.choice((1, 2, 4, 8, 12, 16))), f"+1 ({run(digit, 3)}) 555-{run(digit, 4)}", run("abcdef0123456789", 7),
            f"the {r.choice(names)} is {words(r, 1)}", f"{r.choice(names)}: {words(r, 1)}", f"{r.choice(names)} {words(r, 3)}", f"{words(r, 1).lower()}@{host()}.example.com",
            ".".join(str(r.randrange(256)) for _ in range(4)), f"https://{host()}.example/{host()}/{run(digit, 5)}", f"www.{host()}.org/{host()}.html?id={run(digit, 4)}",
            " ".join(run(digit, 4) for _ in range(4)), f"src/{run(lower + '_', 12)}.py", f"{run(upper, r.choice((8, 14, 22, 30)))}!!", run(lower, r.choice((12, 16, 24, 36))),
            f"def {host()}_{host()}(self, {host()}):", f"import {host()}.{host()} as {host()[:3]}", f"{host().capitalize()}{host().capitalize()}{host().capitalize()}()", f"{run(upper, 5)}_{run(upper, 7)}_{run(upper, 4)} = {run(digit, 3)}",
            f"20{run(digit, 2)}-{run(digit, 2)}-{run(digit, 2)}T{run(digit, 2)}:{run(digit, 2)}:{run(digit, 2)}Z", f"v{run(digit, 1)}.{run(digit, 2)}.{run(digit, 1)}-rc{run(digit, 1)}", f"#{run('0123456789ABCDEF', 6)}", f"GET /{host()}/{run(digit, 6)} HTTP/1.1 {run(digit, 3)}",
        ))

    out = []
    for i in range(rows):
        a, b = words(r, r.randrange(0, 5)), words(r, r.randrange(0, 5))
        if i % 2:
            out.append((f"{a} {clean()} {b}", []))
            continue
        s, q, name = secret(), r.choice(('"', "'", "", "")), r.choice(names)
        name = r.choice((name, name, name.upper(), f"{run(upper, 4)}_{name.upper()}", f"--{name}", f"{words(r, 1)} {name}"))
        lead = r.choice((f"{name} = {q}", f"{name}={q}", f"{name}: {q}", f"{name} is {q}", f"{name} {q}", f"{words(r, 1)} ", f"{words(r, 1)} '", "", "", ""))
        tail = lead[-1] if lead[-1:] in ("'", '"') else ""
        at = len(f"{a} {lead}")
        out.append((f"{a} {lead}{s}{tail}{r.choice(('', '', '.', ',', ';'))} {b}", [(at, at + len(s))]))
    return out


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    return Tagger(joining="+/_-", file_features=True, caution=CAUTION).fit(labelled_table())


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, secrets: array of (kind, start, end) in code points, for each row of ``docs``.

    Kinds assign, access and hex are the base patterns; kind crf are sound spans that the model adds
    where no base span is. Null and empty texts have none, texts may be of any length; a row gives a row, repeated and null ids too;
    other columns are ignored. The model is fitted on the driver from ``labelled_table``.
    """
    ship(docs.sparkSession)
    model = tagger()

    def run(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            more, out = model.spans(batch.column(1)), []
            for k, text in enumerate(batch.column(1).to_pylist()):
                base = base_spans(text) if text else []
                out.append([{"kind": x, "start": a, "end": b} for x, a, b in sorted(base + added(base, [(a, b) for a, b in more.get(k, ()) if sound(text[a:b])]), key=lambda x: (x[1], x[0] == "crf" and 9 or KINDS.index(x[0])))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kind))], ["doc_id", "secrets"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, secrets array<struct<kind: string, start: int, end: int>>")


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by ``mark``; overlapping spans are one.

    All other columns and the number of rows stay; a null text stays null, and texts may be of any length.
    """
    ship(docs.sparkSession)
    model, schema, at = tagger(), docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            more, out = model.spans(batch.column(at)), []
            for k, text in enumerate(batch.column(at).to_pylist()):
                base = base_spans(text) if text else []
                spans = sorted([(a, b) for _, a, b in base] + [(a, b) for a, b in more.get(k, ()) if sound(text[a:b])])
                if spans:
                    parts, end = [], 0
                    for a, b in spans:
                        if a >= end:
                            parts += [text[end:a], mark]
                        end = max(end, b)
                    text = "".join(parts) + text[end:]
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, schema)


def span_digests(found: DataFrame, column: str, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of each base kind, the digest of the base spans and all spans, from ``find_*`` results."""
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter(column, lambda x: x["kind"] != "crf")
    of = lambda k: F.size(F.filter(column, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col(column)).alias("spans"))
