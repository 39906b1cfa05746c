"""Format-preserving pseudonyms for personal data.

Validated values (card numbers, IBANs, social security and phone numbers, IP addresses, dates, mail addresses, secret
tokens) are found in whole texts and replaced by a keyed permutation within their own format: check digits stay right,
separators stay in place, and equal values get equal pseudonyms in every document, however they are written: what is
permuted is the value itself (a mail address without its letters' case, a phone number with its calling code, the 128
bits of an IPv6 address, the day of a date). No value is its own pseudonym.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .quality_rules import pieces

ROUNDS = 8


class Feistel:
    """Keyed permutations of 0..n-1 without fixed points, for any n over 1."""

    def __init__(self, key: bytes):
        self.key = key

    def _dice(self, tweak: bytes, r: int, x: int) -> int:
        h = blake2b(tweak + bytes([r]) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), key=self.key, digest_size=64)
        return int.from_bytes(h.digest(), "big")

    def _once(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * self._dice(tweak, r, left)) % b
            else:
                left = (left + sign * self._dice(tweak, r, right)) % a
        return left * b + right

    def _walk(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        x = self._once(x, n, tweak, back)
        while x >= n:
            x = self._once(x, n, tweak, back)
        return x

    def permute(self, x: int, n: int, tweak: str) -> int:
        """x's place in one cycle over all of 0..n-1, so never x itself."""
        t = f"{tweak}/{n}".encode()
        return self._walk((self._walk(x, n, t) + 1) % n, n, t, back=True)


#: Alphabets whose letters are permuted among themselves; any other character stays.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
HEX = ["0123456789abcdef", "0123456789ABCDEF"]


#: Longer values are permuted in blocks of half of it and more: numbers stay within the dice's bits, and time in proportion to the length.
BLOCK = 64


def permuted_text(value: str, alphabets: list[str], fp: Feistel, tweak: str) -> str:
    """Each character stays in its alphabet; the string of all of them is permuted as one number, a long one block by block,
    each after the pseudonyms of those before it."""
    if len(value) > 2 * BLOCK:
        n, out = len(value) // BLOCK, ""
        for k in range(n):
            part = value[k * len(value) // n:(k + 1) * len(value) // n]
            before = blake2b(out[-2 * BLOCK:].encode(), digest_size=8).hexdigest() if k else ""
            out += permuted_text(part, alphabets, fp, f"{tweak}/{k}/{before}/")
        return out
    where = [next((a for a in alphabets if c in a), None) for c in value]
    x, n = 0, 1
    for c, a in zip(value, where):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    if n < 2:
        return value
    x = fp.permute(x, n, tweak + "".join("-" if a is None else str(alphabets.index(a)) for a in where))
    out = []
    for c, a in zip(reversed(value), reversed(where)):
        if a:
            x, k = divmod(x, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def relaid(original: str, new: str) -> str:
    """The characters of new in the places of original's letters and digits."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in original)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def card(value: str, fp: Feistel) -> str | None:
    digits = re.sub(r"\D", "", value)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = permuted_text(digits[:-1], ALPHABETS, fp, "card")
    return relaid(value, body + luhn_digit(body))


def iban_check(country: str, bban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"


def iban(value: str, fp: Feistel) -> str | None:
    plain = value.replace(" ", "")
    country, check, bban = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(bban) <= 30 or iban_check(country, bban) != check:
        return None
    new = permuted_text(bban, ALPHABETS, fp, "iban" + country)
    return relaid(value, country + iban_check(country, new) + new)


#: Length of the whole IBAN by country.
IBAN_LENGTHS = {
    c: n for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items() for c in cs.split()
}


def shorter(kind: str, value: str) -> Iterator[str]:
    """Candidates of a match of the pattern, best first: itself, then its beginnings that end at a group or word boundary.

    An IBAN has its country's length, if that is known: it goes before, and instead of any other beginning.
    """
    if kind not in ("card", "iban"):
        yield value
        return
    ends = [m.start() for m in re.finditer(r"[ \-]", value)]
    if kind == "card":
        yield value
        for end in reversed(ends):
            if sum(c.isdigit() for c in value[:end]) >= 13:
                yield value[:end]
        return
    length = lambda end: end - value.count(" ", 0, end)
    fixed = IBAN_LENGTHS.get(value[:2])
    yield from (value[:end] for end in ends if length(end) == fixed)
    yield value
    if not fixed:
        yield from (value[:end] for end in reversed(ends) if length(end) >= 15)


def ssn(value: str, fp: Feistel) -> str | None:
    area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(fp.permute(x, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


#: Calling codes of one and two digits; all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def phone(value: str, fp: Feistel) -> str | None:
    """The calling code stays. Ten digits without one are of code 1, so that they are linked with the same number after +1."""
    digits = re.sub(r"\D", "", value)
    if not 10 <= len(digits) <= 15:
        return None
    code = ""
    if value.startswith("+"):
        code = next((c for c in SHORT_CODES if digits.startswith(c)), digits[:3])
    return relaid(value, code + permuted_text(digits[len(code):], ALPHABETS, fp, "phone" + (code or "1")))


def ip(value: str, fp: Feistel) -> str | None:
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255:
        return None
    x = fp.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def ip6(value: str, fp: Feistel) -> str | None:
    """The address's 128 bits are permuted; written in full, with or without leading zeros, or shortened, as the original is."""
    if not any(c.isdigit() for c in value):
        return None
    try:
        x = int(ipaddress.IPv6Address(value))
    except ValueError:
        return None
    new = ipaddress.IPv6Address(fp.permute(x, 1 << 128, "ip6"))
    if "::" in value:
        out = str(new)
    elif len(value) == 39:
        out = new.exploded
    else:
        out = ":".join(f"{int(g, 16):x}" for g in new.exploded.split(":"))
    return out.upper() if re.search("[A-F]", value) else out


#: First and last year of each range within which dates are permuted.
YEARS = [(1, 999), (1000, 1899), (1900, 2099), (2100, 9999)]
DAYS = [(dt.date(a, 1, 1).toordinal(), dt.date(b, 12, 31).toordinal()) for a, b in YEARS]


def _shifted(year: int, month: int, day: int, fp: Feistel) -> dt.date | None:
    try:
        x = dt.date(year, month, day).toordinal()
    except ValueError:
        return None
    first, last = next(r for r in DAYS if r[0] <= x <= r[1])
    return dt.date.fromordinal(first + fp.permute(x - first, last - first + 1, "date"))


def iso_date(value: str, fp: Feistel) -> str | None:
    sep = value[4]
    new = _shifted(int(value[:4]), int(value[5:7]), int(value[8:]), fp)
    return new and f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"


def day_date(value: str, fp: Feistel) -> str | None:
    """Day first, or month first where only that gives a date."""
    sep = re.search(r"\D", value)[0]
    a, b, year = value.split(sep)
    pad = len(a) == 2 and len(b) == 2
    new, swap = _shifted(int(year), int(b), int(a), fp), False
    if new is None:
        new, swap = _shifted(int(year), int(a), int(b), fp), True
    if new is None:
        return None
    first, second = (new.month, new.day) if swap else (new.day, new.month)
    return f"{first:02d}{sep}{second:02d}{sep}{new.year:04d}" if pad else f"{first}{sep}{second}{sep}{new.year:04d}"


#: Months by name.
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "en short": "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
MONTH = "(?i:" + "|".join(sorted({m for ms in MONTHS.values() for m in ms}, key=lambda m: (-len(m), m))) + ")"
ORDINAL = {1: "st", 2: "nd", 3: "rd", 21: "st", 22: "nd", 23: "rd", 31: "st"}


def named_date(value: str, fp: Feistel) -> str | None:
    """A day, a month's name and a year, in either order; the name stays in its language and case, an English ordinal follows the day."""
    m = re.search(r"(?<!\d)\d{1,2}(?!\d)", value)
    name = re.search(MONTH, value)[0]
    language = next(k for k, ms in MONTHS.items() if name.lower() in ms)
    new = _shifted(int(value[-4:]), MONTHS[language].index(name.lower()) + 1, int(m[0]), fp)
    if new is None:
        return None
    month = MONTHS[language][new.month - 1]
    month = month.upper() if name.isupper() else month.capitalize() if name[0].isupper() else month
    day = f"{new.day:02d}" if m[0][0] == "0" else str(new.day)
    parts = re.split(f"({re.escape(name)}|{m[0]}(?:st|nd|rd|th)?)", value[:-4], maxsplit=2)
    for i in (1, 3):
        parts[i] = month if parts[i] == name else day + (ORDINAL.get(new.day, "th") if parts[i] != m[0] else "")
    return "".join(parts) + f"{new.year:04d}"


def recased(original: str, new: str) -> str:
    """new with capitals where original has them."""
    return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new))


def mail(value: str, fp: Feistel) -> str | None:
    """The local part is permuted, its letters' case apart; one without letters or digits has no pseudonym, so its domain's first label is
    permuted instead."""
    local, domain = value.rsplit("@", 1)
    new = recased(local, permuted_text(local.lower(), ALPHABETS, fp, "mail")) if len(local.lower()) == len(local) else local
    if new == local:
        label, dot, rest = domain.partition(".")
        return f"{local}@{recased(label, permuted_text(label.lower(), ALPHABETS, fp, 'host'))}{dot}{rest}"
    return f"{new}@{domain}"


def secret(value: str, fp: Feistel) -> str | None:
    if len(set(value)) < 6:
        return None
    for h in HEX:
        if all(c in h for c in value):
            return permuted_text(value, [h], fp, "secret")
    return permuted_text(value, ALPHABETS, fp, "secret") if re.search(r"\d", value) else None


#: Beginnings by which issued keys are known, and what follows them.
KEY_FORMS = {
    "AKIA": "[0-9A-Z]{16}", "ASIA": "[0-9A-Z]{16}", "AIza": r"[0-9A-Za-z_\-]{35}", "ghp_": "[0-9A-Za-z]{36,}", "gho_": "[0-9A-Za-z]{36,}", "ghu_": "[0-9A-Za-z]{36,}",
    "ghs_": "[0-9A-Za-z]{36,}", "glpat-": r"[0-9A-Za-z_\-]{20,}", "sk_live_": "[0-9A-Za-z]{16,}", "xoxb-": r"[0-9A-Za-z\-]{20,}", "xoxp-": r"[0-9A-Za-z\-]{20,}",
}


def issued_key(value: str, fp: Feistel) -> str | None:
    head = next(h for h in KEY_FORMS if value.startswith(h))
    return head + permuted_text(value[len(head):], ALPHABETS, fp, "secret")


#: Kind, pattern (its group "v" is the value, if it has one) and pseudonym; earlier kinds win.
KINDS: list[tuple[str, str, Callable[[str, Feistel], str | None]]] = [
    ("mail", r"(?<![\w.%+\-])[\w.%+\-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", mail),
    ("secret", r"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|key)[\"']?[ \t]*[:=][ \t]*[\"']?(?P<v>[A-Za-z0-9_\-]{16,})", secret),
    ("issued_key", r"(?<![A-Za-z0-9])(?:" + "|".join(h + rest for h, rest in KEY_FORMS.items()) + r")(?![A-Za-z0-9])", issued_key),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", iban),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", ip),
    ("ip6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)(?![\w:])", ip6),
    ("iso_date", r"(?<![\w\-/.])\d{4}([\-/.])(?:0[1-9]|1[0-2])\1\d{2}(?![\w\-/]|\.\d)", iso_date),
    ("day_date", r"(?<![\w\-/.])\d{1,2}([\-/.])\d{1,2}\1\d{4}(?![\w\-/]|\.\d)", day_date),
    ("named_date", rf"(?<![\w\-/.])(?:\d{{1,2}}(?:st|nd|rd|th|\.)?[ ](?:de[ ])?{MONTH}(?![^\W\d_])\.?,?[ ](?:de[ ])?\d{{4}}|{MONTH}(?![^\W\d_])\.?[ ]\d{{1,2}}(?:st|nd|rd|th)?,?[ ]\d{{4}})(?!\w)", named_date),
    ("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])", ssn),
    ("card", r"(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w])(?!-\d)", card),
    ("phone", r"(?<!\w)(?:\+\d{1,3}(?:[ .\-]?\(\d{1,4}\)|(?=[ .\-]))(?:[ .\-]?\d{2,4}){2,4}|\+\d{10,15}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}([.\-])\d{3}\N\d{4})(?!\w)", phone),
]


def _pattern() -> re.Pattern:
    """One pattern of all kinds; numbered groups inside kinds are told apart by name."""
    parts = []
    for name, pattern, _ in KINDS:
        pattern = pattern.replace("(?P<v>", f"(?P<v_{name}>")
        if r"([\-/.])" in pattern:
            pattern = pattern.replace(r"([\-/.])", rf"(?P<s_{name}>[\-/.])").replace(r"\1", rf"(?P=s_{name})")
        if r"([.\-])" in pattern:
            pattern = pattern.replace(r"([.\-])", rf"(?P<s_{name}>[.\-])").replace(r"\N", rf"(?P=s_{name})")
        parts.append(f"(?P<{name}>{pattern})")
    return re.compile("|".join(parts))


PATTERN = _pattern()
#: Every value holds one of these, and none a newline: other lines need no closer look.
HOT = re.compile(r"[0-9@:=]")
INSIDE = re.compile(r"[^\w+(]")
MAKE = {name: f for name, _, f in KINDS}
#: What stands before four numbers that are a version.
VERSION = re.compile(r"(?i)\b(?:v|ver\.?|versions?|release|rev\.?|build)[ \t:=]*$")
#: By kind, the later ones and their own patterns. Mail and secrets begin unlike any later kind that could be meant.
AFTER = {name: [(k, re.compile(p.replace(r"\N", r"\1"))) for k, p, _ in KINDS[i + 1:] if name not in ("mail", "secret") and k != "secret"] for i, (name, _, _) in enumerate(KINDS)}


class Pseudonymiser:
    def __init__(self, key: bytes):
        fp = Feistel(key)
        self.of = lru_cache(1 << 16)(lambda kind, value: MAKE[kind](value, fp))

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds found in order. Candidates that don't validate stay."""
        if not HOT.search(text):
            return text, []
        lines, kinds = text.split("\n"), []
        for i, line in enumerate(lines):
            if HOT.search(line):
                lines[i] = self._line(line, kinds)
        return "\n".join(lines), kinds

    def _value(self, kind: str, m: re.Match, group: str | int) -> tuple[str, int, int, str] | None:
        """Kind, start, end and pseudonym of the first candidate in the match that validates."""
        if kind == "ip" and VERSION.search(m.string, max(0, m.start() - 16), m.start()):
            return None
        for value in shorter(kind, m[group]):
            new = self.of(kind, value)
            if new is not None and new != value:
                return kind, m.start(group), m.start(group) + len(value), new
        return None

    def _line(self, text: str, kinds: list[str]) -> str:
        out, at, pos = [], 0, 0
        while m := PATTERN.search(text, pos):
            kind = m.lastgroup if m.lastgroup in MAKE else next(k for k in MAKE if m.group(k) is not None)
            found = self._value(kind, m, "v_secret" if kind == "secret" else kind)
            if not found:  # a later kind may begin at the same place
                rest = ((k, p.match(text, m.start())) for k, p in AFTER[kind])
                found = next((f for k, other in rest if other and (f := self._value(k, other, 0))), None)
            if not found:
                # another candidate may still begin inside
                nxt = INSIDE.search(text, m.start() + 1)
                pos = max(m.start() + 1, min(m.end(), nxt.start() if nxt else m.end()))
                continue
            kind, start, end, new = found
            kinds.append(kind)
            out += [text[at:start], new]
            at = pos = end
        return "".join(out) + text[at:]


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in the text, ``n_values`` and ``kinds`` (distinct, sorted, joined by commas).

    Null texts stay null with no values; empty texts stay empty. Whole texts are searched, however long, in time that grows with
    their length: a run of word characters is tried as a mail address once, from its beginning. Rows are
    independent: ties and repeated rows give equal results, an empty table an empty one. Added columns replace columns
    of the same names. Domains of mail addresses, calling codes, countries of IBANs and beginnings of issued keys are kept.
    Secrets have any length; dates lie in any year from 1 to 9999 and stay in their range of YEARS.
    """
    docs = docs.drop("n_values", "kinds")
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymiser(key)
        for whole in batches:
            for b in pieces(whole, text_col):
                texts, n, kinds = [], [], []
                for t in b[text_col].to_pylist():
                    new, found = p.replace(t) if t else (t, [])
                    texts.append(new)
                    n.append(len(found))
                    kinds.append(",".join(sorted(set(found))))
                arrays = [pa.array(texts, pa.string()) if c == text_col else b[c] for c in cols]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(kinds, pa.string())], names=[*cols, "n_values", "kinds"])

    schema = docs.select(*cols, F.lit(0).cast("long").alias("n_values"), F.lit("").alias("kinds")).schema
    return docs.mapInArrow(run, schema)


#: For tests and the query; a deployment passes its own secret.
EXAMPLE_KEY = b"caselattice example key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), EXAMPLE_KEY)


QUERIES = {"op1_pii": op1_pii}
ORACLE: dict[str, str] = {}
