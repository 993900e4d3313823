"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, URL schemes, ``www.``, a plus before a
digit, issuer-like digits, and cues of identifiers and secrets. From each anchor a deterministic parser
expands left and right to the boundaries of the candidate and validates it:

* ``email``: local part and dotted domain by character class, length and label rules;
* ``url``: scheme, host with a dot or a user part, up to a delimiter, without trailing punctuation;
* ``ip``: four octets of 0 to 255 without leading zeros;
* ``phone``: an international number of 8 to 15 digits with single separators and balanced brackets;
* ``card``: 13 to 19 digits, in plain or separated groups, that pass the Luhn sum and have an issuer's start and length;
* ``iban``: country, check digits and length, with the mod-97 sum;
* ``ssn``: nine digits as 3-2-4 with valid groups, after a cue;
* ``account``: 6 to 17 digits after an account cue;
* ``secret``: the value assigned to a password-like name, or a token with a known prefix; of any length.

Overlapping findings are resolved by the earlier start, then the longer, then the kind's name.

Defined cases: null and empty texts have no findings; offsets count characters from 0; rows that repeat are
searched each; the longest texts are searched whole; input columns besides id and text are not read by ``find``, and
``redact`` replaces an input column named ``n_private``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from windrose.llm._common import col, mapped, others, whole_ids

Finding = tuple[int, int, str]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+/=?^_`{|}~-")
_DIGITS = frozenset("0123456789")
_HOST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
_LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\Z")
_OPENING = "'/=?{|`"
_IBAN_LENGTH = dict(
    AD=24, AE=23, AT=20, BE=16, BG=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24, FI=18, FR=27, GB=22, GR=27, HR=21, HU=28,
    IE=22, IL=23, IS=26, IT=27, LI=21, LT=20, LU=20, LV=21, MC=27, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, SA=24, SE=24, SI=19, SK=24, SM=27, TR=26,
)


_runs: dict[re.Pattern, tuple[str, int, int]] = {}


def _run_end(kind: re.Pattern, text: str, at: int) -> int:
    """The end of the run of one class of characters; the last run is kept, so that many cues inside it take linear time."""
    last = _runs.get(kind)
    if last is None or last[0] is not text or not last[1] <= at < last[2]:
        last = _runs[kind] = text, at, kind.match(text, at).end()
    return last[2]


def _host_end(text: str, at: int) -> int:
    end, n = at, len(text)
    while end < n and text[end] in _HOST:
        end += 1
    while end > at and text[end - 1] in ".-":
        end -= 1
    return end


def email(text: str, at: int) -> Finding | None:
    """``at``: the at-sign."""
    start = at
    while start and text[start - 1] in _LOCAL and at - start < 65:
        start -= 1
    while start < at and (text[start] in _OPENING or text[start] == "."):
        start += 1
    end = _host_end(text, at + 1)
    local, labels = text[start:at], text[at + 1 : end].split(".")
    if not local or len(local) > 64 or end - at > 254 or local[-1] == "." or ".." in local:
        return None
    if len(labels) < 2 or not all(map(_LABEL.match, labels)) or len(labels[-1]) < 2 or not labels[-1].isalpha():
        return None
    return start, end, "email"


_URL_RUN = re.compile(r"[^ \t\r\n\"<>|\\^`{}]*")
_AUTHORITY = re.compile(r"[^/?#]*")
_MARKS = ".,;:!?'*"
_trimmed: list = [None, 0, 0]  # the last text, the end of a run in it, and that end without trailing marks


def _link(text: str, start: int, host: int) -> Finding | None:
    """The anchors inside one run of URL characters share its end, so that many of them take linear time."""
    end = _run_end(_URL_RUN, text, host)
    if _trimmed[0] is not text or _trimmed[1] != end:
        last = end
        while last and text[last - 1] in _MARKS:
            last -= 1
        _trimmed[:] = text, end, last
    end = max(host, _trimmed[2])
    if end > host and text[end - 1] == ")":
        surplus = text.count(")", host, end) - text.count("(", host, end)
        while end > host and (text[end - 1] in _MARKS or text[end - 1] == ")" and surplus > 0):
            surplus -= text[end - 1] == ")"
            end -= 1
    authority = text[host : min(end, _AUTHORITY.match(text, host).end())].rpartition("@")[2].partition(":")[0]
    labels = authority.split(".")
    if len(labels) < 2 or not all(map(_LABEL.match, labels)):
        return None
    return start, end, "url"


def scheme(text: str, at: int) -> Finding | None:
    """``at``: the colon of ``://``."""
    start = at
    while start and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    return _link(text, start, at + 3) if start < at else None


def www(text: str, at: int) -> Finding | None:
    if at and (text[at - 1].isalnum() or text[at - 1] in "/.@-"):
        return None
    return _link(text, at, at)


_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![\d])(?!\.\d)")


def ip(text: str, at: int) -> Finding | None:
    """``at``: the first digit of a run."""
    if at and (text[at - 1] in ".-_" or text[at - 1].isalnum()):
        return None
    found = _IP.match(text, at)
    if not found or any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in found.groups()):
        return None
    if found.end() < len(text) and (text[found.end()].isalpha() or text[found.end()] == "_"):
        return None
    return at, found.end(), "ip"


_PHONE = re.compile(r"\+\d{1,3}(?:[ .\-/]?(?:\(\d{1,5}\)|\d+))*")


def phone(text: str, at: int) -> Finding | None:
    """``at``: a plus sign."""
    if at and (text[at - 1].isalnum() or text[at - 1] in "+=/"):
        return None
    found = _PHONE.match(text, at)
    if not found:
        return None
    end, digits = found.end(), sum(c in _DIGITS for c in found.group())
    if not 8 <= digits <= 15 or end < len(text) and (text[end].isalpha() or text[end] == "_"):
        return None
    return at, end, "phone"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


_CARD = re.compile(r"\d(?:[ -]?\d){12,18}(?![\d])")
_ISSUER = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3[068]\d{12}(?:\d\d)?|35\d{14}|6\d{15,18}")


def card(text: str, at: int) -> Finding | None:
    """``at``: the first digit of a run."""
    if at and (text[at - 1].isalnum() or text[at - 1] in "._#"):
        return None
    found = _CARD.match(text, at)
    if not found:
        return None
    end, raw = found.end(), re.sub("[ -]", "", found.group())
    if end < len(text) and (text[end].isalpha() or text[end] == "_") or not _ISSUER.fullmatch(raw) or len(set(raw)) == 1 or not luhn(raw):
        return None
    return at, end, "card"


_IBAN = re.compile(r"([A-Z]{2})\d{2}(?: ?[A-Z0-9]){11,30}")


def iban(text: str, at: int) -> Finding | None:
    """``at``: the country code's first letter."""
    if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None
    found = _IBAN.match(text, at)
    if not found:
        return None
    length, end, raw = _IBAN_LENGTH[found.group(1)], at, ""
    while end < found.end() and len(raw) < length:
        if text[end] != " ":
            raw += text[end]
        end += 1
    if len(raw) != length or end < len(text) and text[end].isalnum():
        return None
    if int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 != 1:
        return None
    return at, end, "iban"


_SSN = re.compile(r"[\s:#=a-zA-Z.]{0,12}?(\d{3})-(\d{2})-(\d{4})(?![\d-])")
_NUMBER = re.compile(r"(?:\s*(?:no|nr|num|number|id))?\.?\s*[:#=]?\s*((?:\d[ -]?){5,16}\d)(?![\dA-Za-z])", re.I)
_NAME = re.compile(r"[\w-]*")
_ASSIGNS = re.compile(r"[\"']?\s*+[=:]\s*+")
_QUOTED = re.compile(r"\"([^\"\n]{4,})\"|'([^'\n]{4,})'")
_BARE = re.compile(r"[^\s\"',;|<>]*")
def _cue_starts(text: str, at: int) -> bool:
    return not (at and (text[at - 1].isalnum()))


def ssn(text: str, at: int, end: int) -> Finding | None:
    found = _SSN.match(text, end) if _cue_starts(text, at) else None
    if not found or found[1] in ("000", "666") or found[1][0] == "9" or found[2] == "00" or found[3] == "0000":
        return None
    return found.start(1), found.end(), "ssn"


def account(text: str, at: int, end: int) -> Finding | None:
    found = _NUMBER.match(text, end) if _cue_starts(text, at) else None
    return (found.start(1), found.end(1), "account") if found else None


def assigned(text: str, at: int, end: int) -> Finding | None:
    found = _ASSIGNS.match(text, _run_end(_NAME, text, end))
    if not found or at and text[at - 1].isalpha():
        return None
    start = found.end()
    if quoted := _QUOTED.match(text, start):
        start, stop = quoted.span(quoted.lastindex)
    else:
        stop = _run_end(_BARE, text, start)
        if stop - start < 4:
            return None
        while stop > start and text[stop - 1] in ".!?)":
            stop -= 1
    if stop - start < 6 or not any(text[i].isdigit() or not text[i].isalnum() for i in range(start, stop)):
        return None
    return start, stop, "secret"


_PREFIXED = {
    "AKIA": re.compile(r"AKIA[A-Z0-9]{12,}+(?![A-Za-z0-9])"), "ASIA": re.compile(r"ASIA[A-Z0-9]{16,}+(?![A-Za-z0-9])"),
    "ghp_": re.compile(r"ghp_[A-Za-z0-9]{20,}"),
    "-----BEGIN": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)?"),
}


_LONG = {
    "sk-": (re.compile("sk-"), re.compile("[A-Za-z0-9_-]*"), 20), "xox": (re.compile("xox[abprs]-"), re.compile("[A-Za-z0-9-]*"), 10),
    "AIza": (re.compile("AIza"), re.compile("[A-Za-z0-9_-]*"), 30),
}


_JWT = [re.compile(x) for x in ("[A-Za-z0-9_-]*", "[A-Za-z0-9_-]*(?:)", "(?:)[A-Za-z0-9_-]*")]  # three patterns, so that each keeps its last run


def _web_token(text: str, at: int) -> Finding | None:
    end = at - 1
    for part in _JWT:
        start, end = end + 1, _run_end(part, text, end + 1)
        if end - start < 8 or part is not _JWT[-1] and text[end : end + 1] != ".":
            return None
    return at, end, "secret"


def prefixed(text: str, at: int, cue: str) -> Finding | None:
    if at and text[at - 1].isalnum():
        return None
    if cue in _LONG:
        head, run, least = _LONG[cue]
        found = head.match(text, at)
        end = _run_end(run, text, found.end()) if found else 0
        return (at, end, "secret") if found and end - found.end() >= least else None
    if cue == "eyJ":
        return _web_token(text, at)
    found = _PREFIXED[cue].match(text, at)
    return (at, found.end(), "secret") if found else None


def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    machine.add_word("@", (1, email))
    machine.add_word("://", (3, scheme))
    for w in ("www.", "WWW."):
        machine.add_word(w, (4, www))
    for d in "0123456789":
        machine.add_word("+" + d, (2, phone))
        machine.add_word(d, (1, _digit_run))
    for country in _IBAN_LENGTH:
        for d in "0123456789":
            machine.add_word(country + d, (3, iban))
    for cue, parser in [(c, ssn) for c in ("ssn", "social security")] + [(c, account) for c in ("account", "acct", "konto", "cuenta", "compte", "customer id", "passport")]:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            machine.add_word(form, (len(form), _cue(parser, len(form))))
    for cue in ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key"):
        for form in {cue, cue.upper(), cue.capitalize()}:
            machine.add_word(form, (len(form), _cue(assigned, len(form))))
    for cue in (*_PREFIXED, *_LONG, "eyJ"):
        machine.add_word(cue, (len(cue), _prefix(cue)))
    machine.make_automaton()
    return machine


def _cue(parser: Callable, size: int) -> Callable[[str, int], Finding | None]:
    return lambda text, at: parser(text, at, at + size)


def _prefix(cue: str) -> Callable[[str, int], Finding | None]:
    return lambda text, at: prefixed(text, at, cue)


def _digit_run(text: str, at: int) -> Finding | None:
    if at and text[at - 1] in _DIGITS:
        return None
    return ip(text, at) or card(text, at)


_MACHINE: list = []


def scan(text: str) -> list[Finding]:
    """(start, end, kind) of all findings, in order and without overlaps."""
    if not _MACHINE:
        _MACHINE.append(_automaton())
    found = []
    for last, (size, parser) in _MACHINE[0].iter(text):
        hit = parser(text, last + 1 - size)
        if hit:
            found.append(hit)
    found.sort(key=lambda f: (f[0], -f[1], f[2]))
    out, upto = [], 0
    for f in found:
        if f[0] >= upto:
            out.append(f)
            upto = f[1]
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[int] = []
        found: list[Finding] = []
        values: list[str] = []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for hit in scan(text) if text else ():
                rows.append(i)
                found.append(hit)
                values.append(text[hit[0] : hit[1]])
        starts, ends, kinds = (pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string())))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), kinds, starts, ends, pa.array(values, pa.string())], ["doc_id", "kind", "start", "end", "value"])


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value): a row per finding."""
    whole_ids(docs, doc_id)
    source = docs.where(col(text).isNotNull()).select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"))
    return source.mapInArrow(_find, "doc_id bigint, kind string, start int, end int, value string")


def masked(text: str, found: list[Finding]) -> str:
    out, upto = [], 0
    for start, end, kind in found:
        out += [text[upto:start], f"<{kind}>"]
        upto = end
    return "".join([*out, text[upto:]])


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs``, all its columns, with every finding in ``text`` replaced by its kind in angle brackets, and ``n_private``."""
    names = others(docs, "n_private")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(at).to_pylist():
                found = scan(t) if t else []
                texts.append(masked(t, found) if found else t)
                counts.append(len(found))
            columns = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*batch.schema.names, "made_n_private"])

    return mapped(docs.select(*map(col, names)), run, [("n_private", "integer")])
