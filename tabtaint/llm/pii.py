"""PII (operator 10): format-preserving Feistel pseudonyms.

Validated numbers (payment cards, phone numbers, IBANs, social security numbers, IPv4 addresses,
hexadecimal tokens), dates and mail addresses are replaced by values of the same format.  A keyed
Feistel network permutes the numbers below N (walking the cycle until the value is below N); with
it, x becomes P'(P(x) + 1 mod N), P' being the inverse of P: a permutation without fixed points that the
key reverses.  Equal values get equal pseudonyms in every document, whatever their separators.

Numbers in digit groups may stand beside other groups.  When the check of a run fails, its shorter
runs of whole groups are tried, then those that begin at a later group; of overlapping card numbers
one with an issuer's first digits is preferred.  Undoing a text is ambiguous where a card's neighbours
and part of its pseudonym happen to pass these tests as well; a value alone is always restored.

Defined cases: a null text stays null, an empty one empty; texts without such values come back
unchanged; numbers that fail their check (Luhn, mod 97, calendar, octets) are left alone; repeated
rows get equal results; other columns pass through untouched.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.llm.common import ready

DEFAULT_KEY = "change this key"
ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "secret", "email")

# ---- keyed permutation --------------------------------------------------------------------


class Permutation:
    """Keyed permutation of ``range(n)`` without fixed points (``n`` > 1)."""

    def __init__(self, key: str, tweak: str, n: int):
        self.n = n
        self.a = 1 << ((n - 1).bit_length() + 1) // 2
        self.b = -(-n // self.a)
        self.key = hashlib.blake2b(f"{tweak}|{n}".encode(), key=hashlib.blake2b(key.encode()).digest()).digest()

    def _f(self, i: int, x: int, m: int) -> int:
        h = hashlib.blake2b(b"%d|%d" % (i, x), key=self.key, digest_size=32).digest()
        return int.from_bytes(h, "big") % m

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + self._f(i, left, self.b)) % self.b
            else:
                left = (left + self._f(i, right, self.a)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - self._f(i, left, self.b)) % self.b
            else:
                left = (left - self._f(i, right, self.a)) % self.a
        return left * self.b + right

    def _walk(self, step, x: int) -> int:
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x

    def _shifted(self, x: int, by: int) -> int:
        return self._walk(self._back, (self._walk(self._once, x) + by) % self.n)

    def apply(self, x: int) -> int:
        return self._shifted(x, 1)

    def undo(self, x: int) -> int:
        return self._shifted(x, -1)


# ---- formats ------------------------------------------------------------------------------

def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def refill(model: str, characters: str) -> str:
    """``model`` with its letters and digits replaced, in order, by ``characters``."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in model)


#: Date formats that are recognised; of two that fit, the first counts.
DATES = {"%Y-%m-%d": r"\d{4}-\d{2}-\d{2}", "%d/%m/%Y": r"\d{2}/\d{2}/\d{4}", "%d.%m.%Y": r"\d{2}\.\d{2}\.\d{4}",
         "%m/%d/%Y": r"\d{2}/\d{2}/\d{4}", "%m.%d.%Y": r"\d{2}\.\d{2}\.\d{4}"}
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900 to 2099
#: Days that can't be taken for a month, and the others: each are permuted among themselves, so a
#: date stays in the format it was recognised by.
LATE, EARLY = ([d for d in range(FIRST_DAY, FIRST_DAY + DAYS) if (datetime.date.fromordinal(d).day > 12) == late]
               for late in (True, False))
#: The ITU's country calling codes of one and two digits; all others have three.
CALLING = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
DIGITS_IN = re.compile(r"[0-9]")
GROUP = re.compile(r"[A-Z0-9]+")
FIRST_GROUP = re.compile(r"\W*\w+")
#: A run of one digit group, or of several that are no list of short numbers.
CARD_RUN = re.compile(r"\d{13,19}|\d{3,}(?:[ -]\d{3,})*[ -]\d+")
#: The lengths of the IBAN registry.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 "
    "FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
    "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
    "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
FOUR_FOURS = re.compile(r"\d{4}(?:[ -]\d{4}){3}")
#: First digits of payment card numbers.
ISSUED = re.compile(r"4|5[1-5]|2[2-7]|3[04-9]|6")
CARD = r"\d(?:[ -]?\d){12,18}(?!\w)"
CARDS = re.compile(CARD)
NUMBERS = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<date>(?:" + "|".join(dict.fromkeys(DATES.values())) + r")(?:(?![\w/-])|(?=[Tt]\d\d)|(?=[Zz]\b)))"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<card>" + CARD + r")"
    r"|(?P<secret>(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,64}(?!\w))"
    r")")
EMAIL = re.compile(r"(?<![\w.%+-])(\w(?:[\w.%+-]{0,62}\w)?)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24})(?![\w])")


def runs(kind: str, s: str, later: bool) -> Iterator[str]:
    """The runs of whole groups at the beginning of ``s`` that may be a number: the one of the country's
    length or of four groups of four digits, the whole (unless the search had begun at an earlier
    group), then, of cards, the longest first."""
    ends = [m.end() for m in GROUP.finditer(s)]
    if kind == "iban":
        yield from (s[:e] for e in ends if sum(map(str.isalnum, s[:e])) == IBAN_LENGTHS.get(s[:2]))
        if not later:
            yield s
        return
    four = FOUR_FOURS.match(s)
    if four and four.end() in ends:
        yield four.group(0)
    if not later:
        yield s
    for e in reversed(ends):
        if 13 <= sum(c.isdigit() for c in s[:e]) and CARD_RUN.fullmatch(s[:e]):
            yield s[:e]


@cache
def alphabet(c: str) -> tuple[str, str]:
    """The characters that may stand for ``c``, and their name: digits, letters of its case, and beyond
    ASCII those of its kind among the 256 code points around it."""
    if c.isascii():
        return next((x, n) for x, n in (("0123456789", "1"), ("abcdefghijklmnopqrstuvwxyz", "2"),
                                        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0")) if c in x)
    page, kind = ord(c) >> 8, unicodedata.category(c)
    some = (chr(k) for k in range(max(page << 8, 128), (page + 1) << 8))
    return "".join(x for x in some if x.isalnum() and unicodedata.category(x) == kind), f"[{page}{kind}]"


class Pseudonyms:
    """The replacements under one key; ``undo=True`` restores the values."""

    def __init__(self, key: str = DEFAULT_KEY, undo: bool = False):
        self.key, self.undo, self.made = key, undo, {}

    def number(self, kind: str, x: int, n: int) -> int:
        p = self.made.get((kind, n))
        if p is None:
            p = self.made[(kind, n)] = Permutation(self.key, kind, n)
        return p.undo(x) if self.undo else p.apply(x)

    def digits(self, kind: str, s: str, base: int = 10) -> str:
        x = self.number(kind, int(s, base), base ** len(s))
        return f"{x:0{len(s)}d}" if base == 10 else f"{x:0{len(s)}x}"

    def card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        new = self.digits("card", d[:-1])
        return refill(s, new + luhn_digit(new))

    def iban(self, s: str) -> str | None:
        d = re.sub(r"\W", "", s)
        if not 15 <= len(d) <= 34 or iban_digits(d[:2], d[4:]) != d[2:4]:
            return None
        shape, digits = d[4:], re.sub(r"\D", "", d[4:])
        it = iter(self.digits("iban", digits) if digits else "")
        account = "".join(next(it) if c.isdigit() else c for c in shape)
        return refill(s, d[:2] + iban_digits(d[:2], account) + account)

    def ssn(self, s: str) -> str | None:
        if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000":
            return None
        a, b, c = int(s[:3]), int(s[4:6]), int(s[7:])
        x = self.number("ssn", ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999)
        x, c = divmod(x, 9999)
        a, b = divmod(x, 99)
        a = a + 1 + (a + 1 >= 666)
        return f"{a:03d}-{b + 1:02d}-{c + 1:04d}"

    def phone(self, s: str) -> str | None:
        """The country code stays, however it is set off; the national number is permuted."""
        d = re.sub(r"\D", "", s)
        code = CALLING.match(d).group(0) if s[0] == "+" else ""
        if not 7 <= len(d) <= 15 or len(d) - len(code) < 4:
            return None
        return refill(s, code + self.digits("phone", d[len(code):]))

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.number("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, s: str) -> str | None:
        for form in DATES:
            try:
                day = datetime.datetime.strptime(s, form).date()
            except ValueError:
                continue
            if 0 <= day.toordinal() - FIRST_DAY < DAYS:
                days = LATE if day.day > 12 else EARLY
                new = days[self.number("date", bisect_left(days, day.toordinal()), len(days))]
                return datetime.date.fromordinal(new).strftime(form)
        return None

    def secret(self, s: str) -> str:
        return self.digits("secret", s, 16)

    def email(self, local: str) -> str | None:
        """Letters become letters of the same case and script, digits digits; other characters stay."""
        x, n = 0, 1
        marks = [(c, *alphabet(c)) for c in local if c.isalnum()]
        for c, some, _ in marks:
            x, n = x * len(some) + some.index(c), n * len(some)
        if n == 1:
            return None
        x, new = self.number(f"email{''.join(name for *_, name in marks)}", x, n), []
        for _, some, _ in reversed(marks):
            x, r = divmod(x, len(some))
            new.append(some[r])
        return refill(local, "".join(reversed(new)))

    def first(self, kind: str, s: str, later: bool) -> tuple[str, str] | None:
        """The first run at the beginning of ``s`` that passes its check, and its replacement."""
        found = ((run, getattr(self, kind)(run)) for run in (runs(kind, s, later) if kind in ("card", "iban") else (s,)))
        return next(((run, new) for run, new in found if new is not None), None)

    def issued(self, hit: tuple[str, str]) -> bool:
        return bool(ISSUED.match(hit[self.undo]))

    def numbers(self, text: str, found: Counter) -> str:
        out, done, at, later = [], 0, 0, -1
        while m := NUMBERS.search(text, at):
            kind, start = m.lastgroup, m.start()
            hit = self.first(kind, m.group(0), start <= later)
            if hit is None:
                at, later = start + FIRST_GROUP.match(m.group(0)).end(), max(later, m.end())
                continue
            if kind == "card" and not self.issued(hit):
                for g in [g.start() for g in GROUP.finditer(hit[0])][1:]:
                    other = CARDS.match(text, start + g)
                    other = other and self.first(kind, other.group(0), True)
                    if other and self.issued(other):
                        start, hit = start + g, other
                        break
            found[kind] += 1
            out += [text[done:start], hit[1]]
            done = at = start + len(hit[0])
        return "".join(out) + text[done:]

    def text(self, text: str | None) -> tuple[str | None, Counter]:
        """The text with pseudonyms, and how many of each kind."""
        found: Counter = Counter()
        if not text:
            return text, found

        def mail(m: re.Match) -> str:
            new = self.email(m.group(1))
            found["email"] += new is not None
            return m.group(0) if new is None else f"{new}@{m.group(2)}"

        if DIGITS_IN.search(text):
            text = self.numbers(text, found)
        if "@" in text:
            text = EMAIL.sub(mail, text)
        return text, found


# ---- Spark --------------------------------------------------------------------------------

COUNTS = ", ".join(f"n_{k} bigint" for k in KINDS)


def _replacer(key: str, undo: bool):
    """Column function: a text to a struct of its kinds' counts and the new text."""
    @F.pandas_udf(f"{COUNTS}, n_replaced bigint, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Pseudonyms(key, undo)
        for batch in batches:
            done = [p.text(t) for t in batch]
            out = {f"n_{k}": [f[k] for _, f in done] for k in KINDS}
            out |= {"n_replaced": [sum(f.values()) for _, f in done], "text": [t for t, _ in done]}
            yield pd.DataFrame(out)

    return run


def pseudonymise(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY, undo: bool = False) -> DataFrame:
    """``docs`` with its text column's personal values replaced; all other columns untouched."""
    ready(docs)
    return docs.withColumn(text, _replacer(key, undo)(F.col(f"`{text}`").cast("string"))["text"])


def report(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY) -> DataFrame:
    """Per document: ``doc_id``, the count of each kind, ``n_replaced``, the new ``text`` and its sha256."""
    ready(docs)
    done = docs.select("doc_id", _replacer(key, False)(F.col(f"`{text}`").cast("string")).alias("r"))
    return done.select("doc_id", "r.*").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
