"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors: at-signs, plus-signs, digits, schemes
(``://``) and identifier cues (``iban``, ``account`` ...).  A deterministic local
parser expands each anchor to both sides, validates it and gives a span:

* ``email`` around an at-sign, ``ip`` / ``card`` from a digit, ``phone`` from a plus-sign
  (the base kinds; per kind leftmost and non-overlapping, a match that fails its check is
  dropped and its characters are not tried again);
* ``account``: an account number with valid ISO 7064 check digits (mod 97) after a cue;
* ``login``: a web address that carries ``user:password@`` after its scheme.

Every anchor of a base kind is part of every match of that kind, so the expansion finds
exactly the base matches.  Offsets are code points, end exclusive.

Defined cases: a null text is empty; texts of any length are read whole; repeated rows
are answered each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respan.llm.util import batched, bound_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("account", "login")
#: Cues that announce an account number (lower case; matched without regard to case).
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
#: Characters that may stand between a cue and its number.
CUE_GAP = 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"[^A-Za-z0-9]*?(?:(?:number|no|nr|num|is)\b[^A-Za-z0-9]*)?"
                      r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_USERINFO = re.compile(r"[^\s/@:]+:[^\s/@]+@[^\s/]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 check of an account number (first four characters moved to the end)."""
    text = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in text)) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", "@")
    a.add_word("+", "+")
    a.add_word("://", "s")
    for d in "0123456789":
        a.add_word(d, "d")
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, "c")
    a.make_automaton()
    return a


def spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data of a text, by kind and start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = chain_end = run_end = phone_end = account_end = 0
    for at, what in anchors.iter(text):
        if what == "d":
            if at >= chain_end:
                m = _CHAIN.match(text, at)
                chain_end = m.end() if m else at + 1
                if m and m.end() - at >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, m.end()))
            if at >= run_end:
                run_end = _DIGITS.match(text, at).end()
                if at >= ip_end and text[run_end:run_end + 1] == "." and (m := _IP.match(text, at)):
                    ip_end = m.end()
                    if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
                        found["ip"].append((at, ip_end))
        elif what == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found["email"].append((start, email_end))
        elif what == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    found["phone"].append((at, phone_end))
        elif what == "c":
            if at >= account_end and (m := _ACCOUNT.match(text, at + 1)) and m.start(1) - at <= CUE_GAP:
                for end in _ends(text, *m.span(1)):
                    if mod97(text[m.start(1):end].replace(" ", "")):
                        account_end = end
                        found["account"].append((m.start(1), end))
                        break
        else:  # "://" ends at ``at``
            start = at - 2
            while start > 0 and text[start - 1] in _SCHEME:
                start -= 1
            if start < at - 2 and (m := _USERINFO.match(text, at + 1)):
                found["login"].append((start, m.end()))
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def _ends(text: str, start: int, end: int) -> Iterator[int]:
    """Possible ends of an account number: the longest first, then before each space."""
    yield end
    while (end := text.rfind(" ", start, end)) > 0:
        if len(text[start:end].replace(" ", "")) < 15:
            return
        yield end


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _map(docs: DataFrame, doc_id: str, text: str, columns: list[tuple[str, pa.DataType, str]], row) -> DataFrame:
    bound_batches(docs.sparkSession)
    schema = pa.schema([(n, t) for n, t, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for cols in batched(batches):
            out = [row(d, t or "", spans(t or "", anchors)) for d, t in zip(cols["d"], cols["t"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema,
                                                                                 strict=True)], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    return rows.mapInArrow(run, ", ".join(f"{n} {ddl}" for n, _, ddl in columns))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    def row(d, t, found):
        base = [s for s in found if s[0] in BASE_KINDS]
        return (d, *(sum(s[0] == k for s in base) for k in BASE_KINDS),
                hashlib.sha256(joined(base).encode()).hexdigest(), joined(found))

    columns = [("doc_id", pa.int64(), "long"), *((f"n_{k}", pa.int64(), "long") for k in BASE_KINDS),
               ("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string")]
    return _map(docs, doc_id, text, columns, row)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by ``[KIND]``; overlapping spans become one,
    named after the one that starts first (ties: the longer)."""
    out, last = [], 0
    todo = sorted(found, key=lambda s: (s[1], -s[2]))
    i = 0
    while i < len(todo):
        kind, a, b = todo[i]
        i += 1
        while i < len(todo) and todo[i][1] < b:
            b = max(b, todo[i][2])
            i += 1
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; nulls stay null, other columns
    are untouched."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        anchors = automaton()
        return texts.map(lambda t: redacted(t, found) if t and (found := spans(t, anchors)) else t)

    return docs.withColumn(text, clean(F.col(text)))
