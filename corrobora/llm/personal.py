"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Patterns only look where a text has what they begin with or hang on (a digit, a plus sign, an at sign), so most texts are
passed by. Every span has a score: the kind's own, more for a passed checksum, more or less for words within ``NEAR``
characters before and after it. Spans of the four base kinds always stay, with their score; spans of the added kinds
(iban, ssn) stay if their checks and a score of ``LEAST`` allow it.

Defined cases: null and empty texts have no spans; a null id is kept; every row of docs has one row; a pattern's match
that fails its check is dropped and the search goes on behind it.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corrobora.llm.common import slices, texts_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4                # so many of the kinds are the base
NEAR = 40
LEAST = 0.5

#: The patterns of the contract, in forms that stay linear on long runs: a number that fails from its first digit fails
#: from any, so a match starts there and no digit is given back; an e-mail address is found from its at sign.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: added kinds
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: fixed values: lengths of account numbers by country
_IBAN_SIZE = dict(zip(
    ("AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ "
     "LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK").split(),
    (24, 23, 28, 20, 28, 20, 16, 22, 22, 29, 28, 21, 22, 28, 24, 22, 18, 28, 20, 29, 24, 18, 18, 27, 22, 22, 23, 18, 27, 28, 21, 28, 22, 23, 23, 26, 27, 30, 30, 20,
     28, 32, 21, 20, 20, 21, 25, 27, 24, 22, 19, 27, 31, 30, 18, 15, 24, 28, 29, 25, 29, 24, 22, 24, 31, 24, 19, 24, 27, 25, 28, 23, 24, 26, 29, 22, 24, 20)))
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")

#: words that speak for a kind, and words that speak against personal data (four languages)
_FOR = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login", "adresse", "direccion"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "telefon", "telefono", "appelez"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
_AGAINST = ("example", "version", "sample", "test", "order", "item", "isbn", "doi", "build", "release")
_START = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.3}
_CHECKED = {"card": 0.3, "iban": 0.4, "ip": 0.1}


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if at % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", m.end() if m else at + 1)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers as long as their country's; of other countries whatever ends at a word's end and passes, the longest first."""
    at = 0
    while m := _IBAN.search(text, at):
        signs = [i for i in range(m.start(), m.end()) if text[i] != " "]
        size = _IBAN_SIZE.get(m[0][:2])
        ends = [signs[n - 1] + 1 for n in ((size,) if size else range(len(signs), 14, -1)) if n <= len(signs)]
        end = next((e for e in ends if not (e < len(text) and text[e].isascii() and text[e].isalnum()) and mod97(text[m.start():e])), None)
        if end:
            yield m.start(), end
        at = end or m.start() + 4


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


_FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def score(kind: str, text: str, start: int, end: int) -> float:
    """How surely a checked span is personal, 0 to 1."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR):start] + " " + text[end:end + NEAR])}
    out = _START[kind] + _CHECKED.get(kind, 0.0)
    out += 0.2 * any(w in near for w in _FOR[kind]) - 0.3 * any(w in near for w in _AGAINST)
    return round(min(1.0, max(0.0, out)), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; code points, end exclusive."""
    wanted = []
    if "@" in text:
        wanted.append("email")
    if _DIGIT.search(text):
        wanted += ["ip", "card", *(["phone"] if "+" in text else []), "iban", *(["ssn"] if "-" in text else [])]
    out, taken = [], []
    for kind in wanted:
        for start, end in _FINDERS[kind](text):
            s = score(kind, text, start, end)
            if KINDS.index(kind) < BASE:
                taken.append((start, end))
            elif s < LEAST or any(a < end and start < b for a, b in taken):
                continue
            out.append((kind, start, end, s))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array of (kind, start, end, score), one row for every row of docs."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "score"), x)) for x in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(kind))], names=["doc_id", "found"])
    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:int,end:int,score:double>>")


def joined(found: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in found)


def personal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (as spans)."""
    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")

    def run(batches):
        for b in slices(batches):
            rows = []
            for doc_id, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = [(f["kind"], f["start"], f["end"]) for f in found]
                base = [s for s in spans if s[0] in KINDS[:BASE]]
                rows.append((doc_id, *(sum(s[0] == k for s in base) for k in KINDS[:BASE]),
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), ",".join(str(f["score"]) for f in found)))
            cols = zip(*rows) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in schema.split(", ")])
    return scan(docs).mapInArrow(run, schema)
