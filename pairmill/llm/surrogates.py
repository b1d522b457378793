"""PII: surrogate generation.

Detected entities are replaced by made-up ones of the same type, drawn with a
key: the same entity gets the same surrogate everywhere, in the writing of the
mention (separators, upper case, script), and names keep their gender.  A
surrogate depends on the key, the type, the entity and a try number, so a task
can make it without looking anything up.  Tries are counted up in a distributed
check until no two entities share a surrogate and none is an entity that
occurs; the entities with a later try than the first are handed to the tasks in
blocks of a fixed size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, map_arrow, staged

#: Entities with a later try that are handed to the tasks at a time.
BLOCK = 200_000

# Titles by the gender they tell (m, f, or x for neither).
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "herrn": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m", "господин": "m", "г-н": "m", "κύριος": "m",
    "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "madame": "f", "mme": "f", "mlle": "f", "señora": "f", "señorita": "f", "sra": "f", "srta": "f", "doña": "f",
    "госпожа": "f", "г-жа": "f", "κυρία": "f", "dr": "x", "prof": "x", "professor": "x",
}
# Syllables of made-up names by script: starts, middles, ends of given names by gender, ends of surnames.
SYLLABLES = {
    "latin": ("al ber ca do el fre ga han il jo ka lu ma no or pa ri sa ti va".split(), "ba de li mo na ra ri so ta vi".split(),
              {"m": "an bert don ko mir nus on ric tor vin".split(), "f": "a ana elle ia ina issa ora ra ta ya".split(), "x": "el en is o ur y".split()},
              "berg by feld hart ler man mont ner ova ski son stone vale wick".split()),
    "cyrillic": ("ал бо ва га да ел за иг ка ла ма ни ол па ро са та фе".split(), "бе ви ди ли ме на ра си та".split(),
                 {"m": "ан ей ил ис кар ом слав тор".split(), "f": "а ана ена ия ина лия ора".split(), "x": "а я ь".split()}, "ев ин ко ов ский цев чук".split()),
    "greek": ("αλ βα γε δη ελ θε κα λε μα νι πα ρο στ φι".split(), "γα δο λι μη νι ρα στα".split(),
              {"m": "ας ης ος ων".split(), "f": "α η ω ία".split(), "x": "ι ις".split()}, "άκης ίδης όπουλος έας άτος".split()),
}

EMAIL = re.compile(r"(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
NUMBER = re.compile(r"(?<![\w.+-])(?:\+|\()?\d(?:[ .()\-]{0,2}\d){6,18}(?![\w-])(?!\.\d)")
IP = re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\w])(?!\.\d)")
KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|sk-)[A-Za-z0-9]{20,}")
SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\w*\s*[=:]\s*[\"']?([^\s\"',;]{4,})")
HEX = re.compile(r"(?<=[\"'])[0-9a-fA-F]{32,}(?=[\"'])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# A search is fast if a pattern begins with a few letters, so what must not stand before a title is looked at afterwards.
NAME = re.compile("(" + "|".join(sorted({re.escape(x) for t in TITLES for x in (t if not t.isascii() else t.title(), t.title(), t.upper())}, key=len, reverse=True))
                  + r")\.?[ \t]+([^\W\d_a-z][^\W\d_]+(?:[ \t]+[^\W\d_][^\W\d_]+){0,2})")
SECRET_NAMES = ("passw", "pwd", "secret", "token", "api")
DIGITS = re.compile(r"[0-9]+")
#: Characters around digits in which numbers of any kind are looked for; longer than any of them.
AROUND = 100

Mention = tuple[int, int, str, str]  # start, end, type, entity


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def number_kind(text: str) -> tuple[str, str] | None:
    """Type and entity of a run of digits with separators."""
    digits = re.sub(r"\D", "", text)
    plain = text.lstrip("+(")
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", text):
        return "ssn", digits
    if len(digits) in range(13, 20) and digits[0] in "3456" and re.fullmatch(r"\d+|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}", text):
        return "card", digits
    marked = text[0] in "+(" or re.fullmatch(r"(?:1[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", text)
    if marked and 7 <= len(digits) <= 15 and text.count("(") == text.count(")") and not re.search(r"\d{13}", plain):
        return "phone", digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    return None


def mentions(text: str) -> list[Mention]:
    """Entities of a text, in order and apart; where two overlap, the kind looked for first counts."""
    found: list[Mention] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if any(x in text for x in ("AKIA", "ASIA", "ghp_", "sk-")):
        found += [(m.start(), m.end(), "key", m[0]) for m in KEY.finditer(text)]
    low = text.lower()
    if any(x in low for x in SECRET_NAMES):
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in SECRET.finditer(text)]
    windows: list[list[int]] = []
    for m in DIGITS.finditer(text):
        if windows and m.start() - AROUND <= windows[-1][1]:
            windows[-1][1] = m.end() + AROUND
        else:
            windows.append([max(0, m.start() - AROUND), m.end() + AROUND])
    for a, b in windows:
        found += [(m.start(), m.end(), "secret", m[0]) for m in HEX.finditer(text, a, b)]
        for m in IBAN.finditer(text, a, b):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                found.append((m.start(), m.end(), "iban", plain))
        found += [(m.start(), m.end(), "ip", m[0]) for m in IP.finditer(text, a, b)]
        for m in NUMBER.finditer(text, a, b):
            if kind := number_kind(m[0]):
                found.append((m.start(), m.end(), *kind))
    for m in NAME.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        names = []
        for w in re.finditer(r"[^\W\d_]+", m[2]):
            if not w[0][0].isupper():
                break
            names.append(w)
        gender = TITLES[m[1].lower()]
        for k, w in enumerate(names):
            kind = "surname" if k == len(names) - 1 else f"given-{gender}"
            found.append((m.start(2) + w.start(), m.start(2) + w.end(), f"{kind}-{script_of(w[0])}", w[0].lower()))
    # in order of their starts, of overlapping ones the first found; their number is small against the text's length
    rank = sorted(range(len(found)), key=lambda i: (found[i][0], i))
    out: list[tuple[int, Mention]] = []
    for i in rank:
        while out and found[i][0] < out[-1][1][1] and i < out[-1][0]:
            out.pop()
        if not out or found[i][0] >= out[-1][1][1]:
            out.append((i, found[i]))
    return [m for _, m in out]


class Draw:
    """A keyed stream of numbers for one entity and try."""

    def __init__(self, key: bytes, kind: str, entity: str, turn: int):
        self.seed = hashlib.blake2b(f"{kind}\0{turn}\0{entity}".encode(), key=key, digest_size=32).digest()
        self.more, self.left = 0, b""

    def below(self, n: int) -> int:
        while True:
            if len(self.left) < 4:
                self.left += hashlib.blake2b(self.seed + self.more.to_bytes(4, "big")).digest()
                self.more += 1
            x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
            if x < 2**32 // n * n:
                return x % n

    def of(self, choices):
        return choices[self.below(len(choices))]

    def like(self, text: str) -> str:
        """Letters and digits for letters and digits; anything else stays, but a text of nothing else becomes letters."""
        if not any(c.isalpha() or c.isdecimal() and c.isascii() for c in text):
            return self.letters(len(text))
        out = []
        for c in text:
            if c.isdecimal() and c.isascii():
                out.append(self.of("0123456789"))
            elif c.isalpha():
                letters = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}.get(script_of(c), "abcdefghijklmnopqrstuvwxyz")
                x = self.of(letters)
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)

    def letters(self, n: int) -> str:
        return "".join(self.of("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def surrogate(key: bytes, kind: str, entity: str, turn: int) -> str:
    """The surrogate entity, in the same normal form as the entity; never the entity itself."""
    while True:
        s = _made(Draw(key, kind, entity, turn), kind, entity, (turn & 0xFFFF) + (turn >> 16))
        if s != entity:
            return s
        turn += 1 << 16  # tries of the check stay below


def _made(d: Draw, kind: str, entity: str, tries: int) -> str:
    """Names, e-mails and secrets get longer with the tries, so that there are always enough of them."""
    more = tries // 4
    if kind == "email":
        name, _, domain = entity.rpartition("@")
        labels = domain.split(".")
        return f"{d.like(name)}{d.letters(more)}@{'.'.join([d.like(x) for x in labels[:-1]] + labels[-1:])}"
    if kind == "ip":
        def octet(x: str) -> str:
            low, high = (0, 255) if more else {1: (0, 9), 2: (10, 99), 3: (100, 255)}[len(x)]
            return str(low + d.below(high - low + 1))
        return ".".join(octet(x) for x in entity.split("."))
    if kind == "card":
        body = entity[0] + d.like(entity[1:-1])
        good = next(c for c in "0123456789" if luhn(body + c))
        return body + (good if luhn(entity) else d.of([c for c in "0123456789" if c != good]))
    if kind == "phone":
        keep = max(0, len(entity) - 10)  # a country code, where there is one
        return entity[:keep] + str(1 + d.below(9)) + d.like(entity[keep + 1:])
    if kind == "iban":
        body = d.like(entity[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
        return f"{entity[:2]}{check:02d}{body}"
    if kind == "key":
        head = re.match(r"AKIA|ASIA|ghp_|sk-", entity)[0]
        return head + d.like(entity[len(head):])
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity):
        return "".join(d.of("0123456789abcdef" if entity.lower() == entity else "0123456789ABCDEF") for _ in range(len(entity) + more))
    if kind.startswith(("given-", "surname-")):
        starts, middles, ends, last = SYLLABLES[kind.rpartition("-")[2]]
        name = d.of(starts) + "".join(d.of(middles) for _ in range(d.below(3 + tries)))
        return name + d.of(last if kind.startswith("surname") else ends[kind.split("-")[1]])
    return d.like(entity) + (d.letters(more) if kind == "secret" else "")


def written(kind: str, new: str, mention: str) -> str:
    """The surrogate in the mention's writing."""
    if kind in ("phone", "card", "ssn"):
        room = sum(c.isdecimal() for c in mention) - len(new)
        digits = iter(re.sub(r"\D", "", mention)[:room] + new if room > 0 else new)
        return "".join(next(digits) if c.isdecimal() else c for c in mention)
    if kind == "iban":
        chars = iter(new)
        return "".join(next(chars) if c != " " else c for c in mention)
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind.startswith(("given-", "surname-")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]
    return new


def replace(text: str, key: bytes, turns: dict[tuple[str, str], int], make=surrogate) -> tuple[str, list[dict]]:
    """The text with surrogates, and the spans (in the new text) with their types."""
    out, spans, last, size = [], [], 0, 0
    for a, b, kind, entity in mentions(text):
        new = written(kind, make(key, kind, entity, turns.get((kind, entity), 0)), text[a:b])
        out += [text[last:a], new]
        size += a - last
        spans.append({"start": size, "end": size + len(new), "kind": kind})
        size += len(new)
        last = b
    out.append(text[last:])
    return "".join(out), spans


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct ``kind`` and ``entity`` of all texts; equal ones are first merged in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {(kind, e) for t in b.column(0).to_pylist() if t for _, _, kind, e in mentions(t)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([e for _, e in seen], pa.string())], ["kind", "entity"])
    return map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "kind string, entity string").distinct()


def assign(known: DataFrame, key: bytes, make=surrogate) -> DataFrame:
    """``kind``, ``entity``, ``turn``, ``surrogate`` for distinct entities: surrogates all differ, and none is an entity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(key, *x) for x in zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "turn")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "entity", "turn", "surrogate"])
    schema = "kind string, entity string, turn int, surrogate string"
    known = staged(known, "pii-entities")
    now = staged(known.withColumn("turn", F.lit(0)).mapInArrow(run, schema), "pii-turns")
    # names of one script are told apart whatever their kind; other kinds have forms of their own
    space = lambda c: F.regexp_replace(c, "^(?:given-.|surname)", "name")
    real = known.select(space(F.col("kind")).alias("space"), F.col("entity").alias("surrogate")).distinct()
    while True:
        by = now.withColumn("space", space(F.col("kind")))
        # the entity that was first to take a surrogate keeps it: the lowest turn, then the lowest entity
        owner = by.groupBy("space", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("turn", "kind", "entity")).alias("own"))
        # checked against real entities as well
        taken = owner.join(real.withColumn("real", F.lit(True)), ["space", "surrogate"], "left")
        bad = staged(taken.where("n > 1 or real").select("space", "surrogate", "own", F.coalesce("real", F.lit(False)).alias("real")), "pii-taken")
        if bad.isEmpty():
            return now
        me = F.struct("turn", "kind", "entity")
        hit = by.join(bad, ["space", "surrogate"], "left")
        moves = F.col("real").isNotNull() & (F.col("real") | (me != F.col("own")))
        hit = staged(hit.select("kind", "entity", "surrogate", F.when(moves, F.col("turn") + 1).otherwise(F.col("turn")).alias("turn"), moves.alias("moves")), "pii-moves")
        again = hit.where("moves").select("kind", "entity", F.col("turn").cast("int")).mapInArrow(run, schema)
        now = staged(hit.where("not moves").select("kind", "entity", F.col("turn").cast("int"), "surrogate").unionAll(again), "pii-turns")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", block: int = BLOCK, make=surrogate) -> DataFrame:
    """``docs`` with surrogates in the text, plus ``spans`` (array of start, end, kind, in the new text).

    ``make`` makes a surrogate from key, kind, entity and try.  Texts without
    entities are unchanged; null stays null with no spans.  A
    column called spans is replaced.  Repeated rows get the same text; an empty
    table gives no rows.
    """
    secret = hashlib.blake2b(key.encode()).digest()
    out = docs.drop("spans")
    assigned = assign(entities(out, text_col), secret, make)
    late = assigned.where("turn > 0").select("kind", "entity", "turn").orderBy("kind", "entity")
    (col,) = free_names([*out.columns, "spans"], "turns")
    turns = "array<struct<kind:string,entity:string,turn:int>>"
    names = [*out.columns, col]
    text_at = names.index(text_col)
    held = out.select("*", F.array().cast(turns).alias(col))
    schema = held.schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("turn", pa.int32())]))

    def known(part: dict):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = []
                for t, before in zip(b.column(text_at).to_pylist(), b.column(len(names) - 1).to_pylist()):
                    mine = {(k, e) for _, _, k, e in mentions(t)} if t else set()
                    got.append(before + [{"kind": k, "entity": e, "turn": shared.value[k, e]} for k, e in sorted(mine) if (k, e) in shared.value])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, kind)], names)
        return run

    part: dict[tuple[str, str], int] = {}
    for r in late.toLocalIterator():
        part[r["kind"], r["entity"]] = r["turn"]
        if len(part) >= block:
            held, part = map_arrow(held, known(part), schema), {}
    # the last block is looked up while replacing
    rest = docs.sparkSession.sparkContext.broadcast(part)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    done = out.select("*", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>").alias("spans")).schema
    done_names = [*out.columns, "spans"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = [], []
            for t, before in zip(b.column(text_at).to_pylist(), b.column(len(names) - 1).to_pylist()):
                turns_of = rest.value if not before else rest.value | {(x["kind"], x["entity"]): x["turn"] for x in before}
                new, s = replace(t, secret, turns_of, make) if t else (t, [])
                texts.append(new)
                found.append(s)
            cols = list(b.columns[:-1])
            cols[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, spans)], done_names)
    return map_arrow(held, finish, done)
