"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, schemes, plus
signs, digits and identifier cues ("password", "iban", "account", ...).  At each
anchor small deterministic parsers expand to the left and right, fix the boundary
and validate (domain labels, octet ranges, Luhn, mod 97, area numbers).  Nothing
else of the text is looked at, and no run of characters is parsed twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import map_batches, quoted
from millrace.plans.shipping import worker_cache

SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key", "private_key", "passwort", "contraseña")
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "routing")
KEY_CUES = ("akia", "asia", "ghp_", "sk-", "xox")
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://")

_LOCAL = re.compile(r"[\w.%+'\-]", re.UNICODE)
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w\-]{0,61}[^\W_])?\.)+([^\W\d_]{2,24})(?![\w\-])")
_URL = re.compile(r"[a-z]+://[^\s<>\"'`{}|\\^]+", re.IGNORECASE)
_HOST = re.compile(r"[a-z]+://(?:[^\s/@]*@)?(\[[0-9a-f:]+\]|[\w\-.]+)(?::\d+)?", re.IGNORECASE)
_IPV4 = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\d|\.\d)")
_CARD = re.compile(r"\d(?:[ \-]?\d){12,18}(?!\d|[\-]\d)")
_PHONE = re.compile(r"\+\d{1,3}(?:[ .\-]?(?:\(\d{1,4}\)|\d{1,4}))(?:[ .\-]?\d{2,4}){1,4}(?!\d)")
_PHONE_US = re.compile(r"\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d|[.\-]\d)")
_SSN = re.compile(r"(\d{3})-(\d{2})-(\d{4})(?!\d|-\d)")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(r"[\w\-]*+")
_ASSIGNED = re.compile(r"[\"']?\s{0,3}(?::=|=>|[=:])\s{0,3}(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"',;]{6,}))")
_ACCOUNT = re.compile(r"[a-z]*\.?\s{0,3}(?:number|num|no|nr|id|#|n°)?\.?\s{0,3}[:=#]?\s{0,3}(\d(?:[ \-]?\d){5,16})(?!\d)", re.IGNORECASE)
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])|sk-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}")

Found = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _email(text: str, at: int) -> Found | None:
    start = at
    while start > 0 and at - start <= 64 and _LOCAL.match(text[start - 1]):
        start -= 1
    while start < at and text[start] in ".-'%+":
        start += 1
    local = text[start:at]
    domain = _DOMAIN.match(text, at + 1)
    if not domain or not 1 <= len(local) <= 64 or local[-1] == "." or ".." in local or domain.end() - at > 254:
        return None
    return "email", start, domain.end()


def _url(text: str, at: int) -> Found | None:
    if at and text[at - 1].isalnum():
        return None
    host = _HOST.match(text, at)  # reads to the next slash at most; the rest only follows a sound host
    if not host or "." not in host[1] and ":" not in host[1] and host[1] != "localhost":
        return None
    found = _URL.match(text, at)
    if not found:
        return None
    end = found.end()
    while text[end - 1] in ".,;:!?)]" and end > host.end():
        end -= 1
    return "url", at, end


def _phone(text: str, at: int) -> Found | None:
    m = _PHONE.match(text, at)
    if m and 8 <= sum(c.isdigit() for c in m[0]) <= 15 and not (at and text[at - 1].isalnum()):
        return "phone", at, m.end()
    return None


def _digits(text: str, at: int) -> Found | None:
    before = text[at - 1] if at else " "
    if before.isdigit():
        return None  # not the start of its run, which has been parsed
    if at >= 2 and text[at - 2 : at].isascii() and text[at - 2 : at].isupper() and not (at > 2 and text[at - 3].isalnum()):
        m = _IBAN.match(text, at - 2)
        if m and 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0].replace(" ", "")):
            return "iban", at - 2, m.end()
    if before == "(":
        m = _PHONE_US.match(text, at - 1)
        if m:
            return "phone", at - 1, m.end()
    if before.isalnum() or before == "_":
        return None
    m = _IPV4.match(text, at)
    if m and before != "." and all(int(o) < 256 and (o == "0" or o[0] != "0") for o in m.groups()):
        return "ip", at, m.end()
    m = _SSN.match(text, at)
    if m and before != "-" and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
        return "ssn", at, m.end()
    m = _PHONE_US.match(text, at)
    if m and before not in "-.":
        return "phone", at, m.end()
    m = _CARD.match(text, at)
    if m and before != "-":
        plain = m[0].replace(" ", "").replace("-", "")
        if plain[0] in "23456" and len(set(plain)) > 1 and luhn(plain) and not (m.end() < len(text) and text[m.end()].isalnum()):
            return "card", at, m.end()
    return None


def _secret(text: str, at: int) -> Found | int | None:
    """A secret, or the place before which no other cue can lead to one."""
    if at and text[at - 1].isalpha():
        return None
    name = _NAME.match(text, at)
    m = _ASSIGNED.match(text, name.end())
    if not m:
        return name.end()  # every cue in this run of letters has the same end
    k = 1 if m[1] else 2 if m[2] else 3
    value, end = m[k], m.end(k)
    if not any(c.isdigit() for c in value):
        return end if k == 3 else name.end()
    if k == 3:
        stripped = value.rstrip(".)]}%#$&*!")
        value, end = stripped, end - (len(value) - len(stripped))
    if len(value) < 6:
        return name.end()
    return "secret", m.start(k), end


def _account(text: str, at: int) -> Found | None:
    if at and text[at - 1].isalpha():
        return None
    m = _ACCOUNT.match(text, at)
    if not m:
        return None
    plain = m[1].replace(" ", "").replace("-", "")
    return ("card" if 13 <= len(plain) <= 19 and luhn(plain) else "account"), m.start(1), m.end(1)


def _key(text: str, at: int) -> Found | None:
    if at and text[at - 1].isalnum():
        return None
    m = _KEY.match(text, at)
    return ("secret", at, m.end()) if m else None


def _automaton():
    cache = worker_cache()
    if "pii_automaton" not in cache:
        import ahocorasick

        parsers: list[tuple[tuple[str, ...], Callable]] = [(("@",), _email), (SCHEMES, _url), (("+",), _phone), (tuple("0123456789"), _digits), (SECRET_CUES, _secret), (ACCOUNT_CUES, _account), (KEY_CUES, _key)]
        automaton = ahocorasick.Automaton()
        for cues, parse in parsers:
            for cue in cues:
                automaton.add_word(cue, (len(cue), parse))
        automaton.make_automaton()
        cache["pii_automaton"] = automaton
    return cache["pii_automaton"]


def folded(text: str) -> str:
    """Lower case, character for character, so that offsets stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def find(text: str) -> list[Found]:
    """(kind, start, end) of each finding, in order and without overlaps."""
    out: list[Found] = []
    done = barren = 0
    for last, (size, parse) in _automaton().iter(folded(text)):
        at = last - size + 1
        if at < done or (parse is _secret and at < barren):
            continue
        got = parse(text, at)
        if isinstance(got, int):
            barren = got
        elif got and got[1] >= done:
            out.append(got)
            done = got[2]
    return out


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each finding: (doc_id, kind, start_pos, end_pos, value).

    Positions count characters from 0.  Defined results: a null or empty text has
    no row; a null doc_id is carried as null; repeated rows repeat their findings;
    where findings overlap, the one whose anchor comes first stays; an empty table
    gives no rows; other columns are ignored.  Texts are read whole.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"doc_id": [], "kind": [], "start_pos": [], "end_pos": [], "value": []}
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for kind, a, z in find(t) if t else ():
                for name, value in zip(out, (d, kind, a, z, t[a:z])):
                    out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", batch.schema.field(0).type), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("value", pa.string())]))

    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, kind string, start_pos int, end_pos int, value string")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every finding replaced by its kind, as ``[EMAIL]``.

    Defined results: null and empty texts stay as they are; other columns aren't read,
    so nulls in them, ties and repeated rows change nothing; an empty table gives an
    empty one; clashing names are harmless.  Texts are read whole.
    """
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def cleaned(texts):
        def one(t):
            if t is None:
                return None
            parts, at = [], 0
            for kind, a, z in find(t):
                parts += [t[at:a], f"[{kind.upper()}]"]
                at = z
            return "".join([*parts, t[at:]])

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text, cleaned(quoted(text)))
