"""Personal data: format-preserving pseudonyms from a keyed Feistel permutation.

Found values are validated (Luhn and length for cards, mod 97 for IBANs, area rules for social security numbers, octets for
addresses, at most 64 characters before the @ of emails, the calendar for dates) and then replaced by the image under a keyed permutation of their own format: digits stay digits,
letters stay letters of their case, separators stay, check digits are valid again, dates stay dates. As the permutation
depends on the key and the kind alone, equal values become equal pseudonyms in all documents, and different ones different ones.

A value is a number below the size of its format; a balanced Feistel network of 8 rounds permutes the next larger power of
four, and values that land outside are permuted again (cycle walking). One value in as many as the format has is its own image.

Cards, IBANs and phones may run on into what follows: at each place the longest end at a group border that is valid counts. A phone doesn't
reach into a valid number of another kind if it can end before it, and part of a card gives way to a longer valid card that starts within.

Defined results: null texts stay null; texts without findings are unchanged; values that fail validation stay; where findings
overlap, the first kind in KINDS that matches at the leftmost place wins; texts of any length are searched whole; rows keep their multiplicity; columns other
than doc_id and text are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DAY_ZERO, DAY_END = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Kind -> pattern, in order of precedence. Numbers end at digit borders, and begin at one, so that a run is entered once. An email is found from its @ on.
KINDS = {
    "email": r"@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|[0-9a-f]{40}|(?:ghp|gho|ghs)_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])|(?:(?<=password=)|(?<=passwd=)|(?<=api_key=)|(?<=secret=)|(?<=token=))[A-Za-z0-9]{8,}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![A-Za-z0-9])[a-z]{2}\d{2}[a-z0-9]{11,30}(?![A-Za-z0-9])",
    "address": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)|(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{6,39}(?![\w:])",
    "date": r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])|(?<![\d\-.,])(?<!\d )\d{3} \d{2} \d{4}(?![\d\-]| \d|[.,]\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(0\) ?)?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ \-]\d{4}(?!\d)|(?<![\d.\-])(?<!\d )0[1-9](?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})(?!\d|[ .\-]\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])",
    "card": r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d]|[.\-]\d)",
}
_EACH = {kind: re.compile(pattern, re.A) for kind, pattern in KINDS.items()}
_NUMBERS = [k for k in KINDS if k != "email"]
_ANY = re.compile("|".join(f"(?P<{kind}>{KINDS[kind]})" for kind in _NUMBERS), re.A)
#: Characters before an @, and how many there may be.
_LOCAL, _LONGEST = re.compile(r"[A-Za-z0-9._%+\-]"), 64
_RUN = re.compile(r"\w+|\W", re.A)
#: What every match holds one of: a text without any needs no search.
_HINT = re.compile(r"\d[ \-]?\d[ \-]?\d|\+\d|[A-Za-z]{2}\d\d|\d[./\-]\d|@|:[0-9A-Fa-f]{0,4}:|[0-9a-f]{40}|AKIA|gh[pos]_|sk-|(?:password|passwd|api_key|secret|token)=")


@lru_cache(maxsize=100_000)
def permuted(key: bytes, tweak: str, value: int, size: int) -> int:
    """The image of value among the numbers below size."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def once(x: int) -> int:
        left, right = x >> half, x & mask
        for k in range(ROUNDS):
            seed = hashlib.blake2b(b"%d|%d|%d|" % (k, size, half) + tweak.encode() + b"|" + right.to_bytes(width, "big"), key=key, digest_size=min(64, width + 8)).digest()
            left, right = right, left ^ (int.from_bytes(seed, "big") & mask)
        return left << half | right

    x = once(value)
    while x >= size:
        x = once(x)
    return x


def _characters(key: bytes, tweak: str, text: str) -> str:
    """Digits for digits, lower-case for lower-case and upper-case for upper-case letters; all else stays. Long texts go piece by piece."""
    if len(text) > 100:
        return "".join(_characters(key, f"{tweak}|{len(text)}|{k}", text[k : k + 100]) for k in range(0, len(text), 100))
    value, size = 0, 1
    kinds = [("0", 10) if c.isdigit() else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else None for c in text]
    for c, kind in zip(text, kinds, strict=True):
        if kind:
            value, size = value * kind[1] + ord(c) - ord(kind[0]), size * kind[1]
    value = permuted(key, tweak, value, size)
    out = list(text)
    for k in range(len(text) - 1, -1, -1):
        if kinds[k]:
            value, digit = divmod(value, kinds[k][1])
            out[k] = chr(ord(kinds[k][0]) + digit)
    return "".join(out)


def _refill(shape: str, symbols: str) -> str:
    """shape with its letters and digits replaced by symbols in turn."""
    left = iter(symbols)
    return "".join(next(left) if c.isalnum() else c for c in shape)


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(key: bytes, text: str) -> str | None:
    digits = re.sub("[^0-9]", "", text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    size = 10 ** (len(digits) - 1)
    payload = f"{permuted(key, 'card', int(digits[:-1]), size):0{len(digits) - 1}d}"
    return _refill(text, payload + luhn_digit(payload))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(key: bytes, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1 or (plain.islower() and sum(map(str.isdigit, plain)) < 10):
        return None
    body = _characters(key, "iban", plain[4:])
    return _refill(text, f"{plain[:2]}{98 - _mod97(plain[:2] + '00' + body):02d}{body}")  # letters keep their case


def _ssn(key: bytes, text: str) -> str | None:
    def valid(n: int) -> bool:
        area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    value = int(re.sub("[ -]", "", text))
    if not valid(value):
        return None
    image = permuted(key, "ssn", value, 10**9)
    while not valid(image):
        image = permuted(key, "ssn", image, 10**9)
    return _refill(text, f"{image:09d}")


def _address(key: bytes, text: str) -> str | None:
    if ":" in text:
        try:
            value = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        digits = text.replace(":", "")
        if sum(map(bool, text.split(":"))) < 3 or not any(c.isdigit() for c in digits) or not value.is_global and not value.is_private:
            return None
        image = f"{permuted(key, f'address|{text.count(":")}', int(digits, 16), 16 ** len(digits)):0{len(digits)}x}"
        return _refill(text, image.upper() if digits.isupper() else image)
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    image = permuted(key, "address", int.from_bytes(bytes(octets), "big"), 2**32)
    return ".".join(map(str, image.to_bytes(4, "big")))


def _date(key: bytes, text: str) -> str | None:
    """Days are permuted again until the image is written with as many digits and read in the same order: 25/12/1999, which is no date by month first, is one by day first."""
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    orders = ("ymd",) if mark == "-" else ("mdy", "dmy") if mark == "/" else ("dmy",)
    order, ordinal = next(((o, n) for o in orders if (n := _ordinal(dict(zip(o, parts, strict=True)))) is not None), (None, None))
    if order is None:
        return None
    short = any(len(p) == 1 for p in parts)

    def written(ordinal: int) -> list[str]:
        day = datetime.date.fromordinal(ordinal)
        of = {"y": f"{day.year:04d}", "m": str(day.month), "d": str(day.day)}
        return [of[o] if o == "y" or short else of[o].zfill(2) for o in order]

    if written(ordinal) != parts:  # zeros before some parts and not before others
        return None
    while True:
        ordinal = DAY_ZERO + permuted(key, "date", ordinal - DAY_ZERO, DAY_END - DAY_ZERO + 1)
        new = written(ordinal)
        if [len(x) for x in new] == [len(x) for x in parts] and (order == orders[0] or int(new[0]) > 12):
            return mark.join(new)


def _ordinal(parts: dict[str, str]) -> int | None:
    try:
        ordinal = datetime.date(int(parts["y"]), int(parts["m"]), int(parts["d"])).toordinal()
    except ValueError:
        return None
    return ordinal if DAY_ZERO <= ordinal <= DAY_END else None


def _phone(key: bytes, text: str) -> str | None:
    digits = re.sub("[^0-9]", "", text)
    if not 7 <= len(digits) <= 15:
        return None
    return _characters(key, "phone", text)


def _email(key: bytes, text: str) -> str | None:
    return _characters(key, "email", text[: text.rindex(".")]) + text[text.rindex(".") :]


def _secret(key: bytes, text: str) -> str | None:
    if re.fullmatch("[0-9a-f]+", text) and len(text) <= 100:
        return f"{permuted(key, 'hex', int(text, 16), 16 ** len(text)):0{len(text)}x}"
    head = next((len(p) for p in ("AKIA", "ghp_", "gho_", "ghs_", "sk-") if text.startswith(p)), 0)
    return text[:head] + _characters(key, "secret", text[head:])


PSEUDONYM: dict[str, Callable[[bytes, str], str | None]] = {
    "email": _email, "secret": _secret, "iban": _iban, "address": _address, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card,
}


#: Kinds whose matches may run on into what follows, and values that a phone leaves alone (of cards, those in their usual groups).
_OPEN = ("iban", "phone", "card")
_APART = {k: _EACH[k] for k in ("address", "date", "ssn")} | {"card": re.compile(r"\d{4}(?:([ \-])\d{4}(?:\1\d{4}){2}|([ \-])\d{6}\2\d{5})(?!\d|[ \-]\d{4}(?!\d))", re.A)}


def _ends(kind: str, text: str, start: int) -> list[int]:
    """The ends of the kind at this place, longest first: the match's own and, for open kinds, the group borders within it."""
    found = _EACH[kind].match(text, start)
    if found is None:
        return []
    if kind not in _OPEN:
        return [found.end()]
    borders = (e for e in range(found.end() - 1, start, -1) if text[e] in " .-" and text[e - 1] not in " .-")
    return [found.end(), *(e for e in borders if _EACH[kind].fullmatch(text, start, e))]


def _valid(kind: str, key: bytes, text: str, start: int) -> tuple[int, str] | None:
    """End and pseudonym of the longest valid value of the kind at this place."""
    ends = _ends(kind, text, start)
    valid = [(e, new) for e in ends if (new := PSEUDONYM[kind](key, text[start:e])) is not None]
    if not valid:
        return None
    end, new = valid[0]
    later = [b for b in range(start + 1, ends[0]) if text[b - 1] in " -" and text[b].isalnum()] if kind in _OPEN else []
    if kind == "phone":
        spans = [(b, w.end()) for b in later if text[b - 1] == " " for k, p in _APART.items() if (w := p.match(text, b)) and PSEUDONYM[k](key, w.group()) is not None]
        clear = [(e, n) for e, n in valid if all(e <= first for first, _ in spans)]
        uncut = [(e, n) for e, n in valid if all(e <= first or e >= last for first, last in spans)]
        return (clear or uncut or valid)[0]
    if kind == "card" and end < ends[0]:
        digits = lambda a, b: sum(c.isdigit() for c in text[a:b])
        for b in later:
            if b < end and (w := next((e for e in _ends(kind, text, b) if _card(key, text[b:e]) is not None), None)) is not None and digits(b, w) > digits(start, end):
                return None
    return end, new


def _local(text: str, mark: int, floor: int) -> int | None:
    """Where the email with its @ at ``mark`` begins: a letter or digit, not before ``floor``; None if there is none, or more than 64 characters before the @."""
    start, first = mark, None
    while start > floor and mark - start <= _LONGEST and _LOCAL.match(text, start - 1):
        start -= 1
        if text[start].isalnum():
            first = start
    return first if mark - start <= _LONGEST else None


def pseudonymised(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The new text and what was replaced: kind, start, end in the new text, and the pseudonym."""
    if not _HINT.search(text):
        return text, []
    out, found, at, length = [], [], 0, 0
    place = 0
    mail, other = _EACH["email"].search(text), _ANY.search(text)
    while mail or other:
        # an email goes back from its @ as far as its characters and the last finding allow
        start = _local(text, mail.start(), at) if mail else None
        if mail and start is None:
            mail = _EACH["email"].search(text, mail.end())
            continue
        if mail and (other is None or start <= other.start()):
            kind, best = "email", (mail.end(), _email(key, text[start : mail.end()]))
        else:
            start = other.start()
            # what fails as one kind may hold another; else look again one run of digits or letters later
            kinds = (other.lastgroup, *(k for k in _NUMBERS if k != other.lastgroup))
            kind, best = next(((k, w) for k in kinds if (w := _valid(k, key, text, start)) is not None), (None, None))
        if best is None:
            place = _RUN.match(text, start).end()
            other = _ANY.search(text, place)
            continue
        end, new = best
        out += [text[at:start], new]
        length += start - at
        found.append((kind, length, length + len(new), new))
        length += len(new)
        at = place = end
        if mail and mail.start() < at:
            mail = _EACH["email"].search(text, at)
        if other and other.start() < at:
            other = _ANY.search(text, at)
    return "".join([*out, text[at:]]), found


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_found, one count per kind, and findings (kind, start, end, pseudonym); a row per row of docs."""
    counts = ", ".join(f"n_{k} int" for k in KINDS)
    fields = f"doc_id long, text string, n_found int, {counts}, findings array<struct<kind: string, start: int, end: int, pseudonym: string>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(None, []) if t is None else pseudonymised(t, secret) for t in batch.column(1).to_pylist()]
            per_kind = [pa.array([sum(f[0] == k for f in found) for _, found in both], pa.int32()) for k in KINDS]
            findings = pa.array([[dict(zip(("kind", "start", "end", "pseudonym"), f, strict=True)) for f in found] for _, found in both], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in both], pa.string()), pa.array([len(f) for _, f in both], pa.int32()), *per_kind, findings],
                names=["doc_id", "text", "n_found", *(f"n_{k}" for k in KINDS), "findings"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)
