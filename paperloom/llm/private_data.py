"""Personal data and secrets replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, phone numbers, payment-card and other long numbers, IPv4 and IPv6
addresses, social-security numbers, IBANs, access keys, quoted tokens, passwords, and names after a
title, after "name:", "name is" or a label of a person ("Contact:", "Patient:"), or with a known given name (in lower
case only before a known surname that is no other word); dates of birth and passport numbers after their labels, and
street addresses. Hangul has no case: there a name is a
given name with a surname before it (with or without a space, particles may follow) or after it. A surrogate keeps what makes the mention what it is: separators, case,
country code, issuer digit and check digit of a card, private or public range of an address, top
domain, a name's gender and script, the ten years or so of a birth date, and a street's kind.

Surrogates come from a keyed permutation of all values of a form: F(x) = P'(P(x) + 1), where P is
a Feistel network over mixed radices (HMAC-SHA256 as its round function) and P' its inverse; of values that have one
digit only, all are put in one keyed order, and the next one is taken. So
one value always gets one surrogate, in all texts and whatever its case or spacing (coreference),
two values of a form never share one, and no value is its own. Values that a form excludes are
passed over by applying F again, which keeps it a permutation. Names go a word at a time, whatever
its role: known given names within those of their gender and script, known surnames within their list (Slavic
ones keep the ending that tells the gender), any other word to words that are in no list, with vowels for vowels and
usual pairs of consonants for such pairs; a last a, which tells a woman's name in many languages, stays and never appears.
So "John Thomas" and "Mr Thomas" agree, and so do "Петров" and "Петрова". A title stays in the text. Since one word always
has one surrogate, a title that contradicts the list changes nothing.
No table of entities is needed, nothing is shuffled, and adding rows changes no earlier result. Each
text is checked nevertheless: a value whose surrogate another value of the text has takes the next
free one, and ``n_collisions`` counts such values (none are known).

Defined cases: a null text stays null and has no entities; an overlap belongs to the mention that
starts first, then to the longer one; repeated rows get equal results; columns of the new names
are replaced; an empty table gives an empty one. A very long text is held whole, as a part of its own.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import hmac
import ipaddress
import itertools
import re
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.common import slices

#: Given names by script and gender. Surrogates for them come from the same list.
GIVEN = {
    ("latin", "f"): "Mary Anna Emma Julia Laura Sophie Claire Alice Helen Ingrid Monika Sabine Petra Carmen Lucia Isabel Elena Teresa Camille Juliette Amelie Charlotte Emily Grace Olivia Nora Ruth Susan Karen Linda Priya Anjali Fatima Aisha Yuki Sakura Mei Leila Zahra Chiara Giulia Agnieszka Katarzyna Deborah Barbara Patricia Jennifer Elizabeth Margaret Sarah Jessica Nancy Sandra Kimberly Rachel Hannah Olga Natalia Svetlana Irina Tatiana Deepa Kavita".split(),
    ("latin", "m"): "James John Peter Paul Thomas Michael David Daniel Martin Stefan Jürgen Klaus Wolfgang Hans Pierre Jacques Louis Antoine Carlos Miguel Javier Pablo Diego Andrew George Henry William Robert Oliver Simon Raj Arjun Wei Hiroshi Kenji Mohammed Ahmed Omar Ali Giovanni Luca Piotr Łukasz Tomasz Ivan Sergei Dmitri Boris Igor Vladimir Sanjay Vikram Richard Charles Christopher Matthew Anthony Donald Steven Kevin Brian Edward Joseph".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Михаил Андрей Николай Павел Виктор Олег".split(),
    ("hangul", "f"): "지영 수진 미경 은주 혜진 유진 민지 서연".split(),
    ("hangul", "m"): "민수 준호 성민 영수 지훈 동현 상우 재현".split(),
}
#: Titles, with the gender that they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Dr": "", "Prof": "",
}
#: Surnames. Those of the last two lists have a second form with an a at their end, for women.
FAMILY = {
    "latin": "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson White Harris Clark Clarke Lewis Robinson Walker Young Hall Wright Green Baker Adams Nelson Hill Campbell Mitchell Roberts Carter Phillips Evans Turner Parker Collins Edwards Stewart Morris Murphy Cook Rogers Morgan Cooper Peterson Bailey Kelly Howard Ward Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Garcia Martinez Lopez Gonzalez Perez Sanchez Dubois Durand Moreau Laurent Rossi Russo Ferrari Bianchi Kowalski Nowak Hansen Larsen Sharma Gupta Patel Singh Khan Tanaka Suzuki Wang Zhang".split(),
    "slavic": "Ivanov Petrov Sidorov Volkov Popov Sokolov Kozlov Novikov Morozov Orlov".split(),
    "cyrillic": "Иванов Петров Сидоров Волков Попов Соколов Козлов Новиков Морозов Орлов Смирнов Кузнецов Фёдоров Никитин Захаров Зайцев Павлов Семёнов Голубев Виноградов".split(),
}
#: Surnames that are other words as well, so in lower case they mark no name.
WORDS = "brown white young hall wright green baker hill turner parker cook cooper ward walker miller taylor carter fischer weber wagner becker koch".split()
#: Labels of a person, and words of what stands there if it is none.
LABELS = "Contact: Patient: Employee: Applicant: Attn: Signed:".split()
OFFICES = set("us support team office department sales service services customer center centre desk help press media information inquiries relations management technical".split())
STREETS = "Street St Road Rd Avenue Ave Lane Drive Boulevard".split()
MONTHS = "January February March April May June July August September October November December".split()
#: Pairs of consonants that stay pairs: at the start of a word or after another consonant, and after a vowel.
ONSETS = "br cr dr fr gr pr tr bl cl fl gl pl sl sk sm sn sp st sw sh ch th".split()
CODAS = "nd nt ns ng nk rd rk rn rs rt rm ld lt lk ls lm ll nn ss tt rr mm st ck".split()
#: Letter classes within which the letters of a word change places; other letters do so within their block of 128.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåéèêëíìîïóòôöõúùûü", "çñ", "ßðþ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "0123456789", "".join(map(chr, range(0xAC00, 0xD7A4)))]
_CLASS_OF = {c: (x, k) for x in CLASSES for k, c in enumerate(x)}


def low(text: str) -> str:
    """In lower case, a character for each; a final sigma is one as any other."""
    return "".join(c.lower()[0] for c in text).replace("ς", "σ")


def up(text: str) -> str:
    """In upper case where that is one character for each."""
    return "".join(c.upper() if len(c.upper()) == 1 else c for c in text)


@functools.cache
def _spot(c: str) -> tuple[str, int] | None:
    """The class of a letter (lower case or without case) or digit, and its place there."""
    if c in _CLASS_OF or not c.isalpha():
        return _CLASS_OF.get(c)
    kind, start = unicodedata.category(c), ord(c) & ~127
    same = [x for x in map(chr, range(start, start + 128)) if x not in _CLASS_OF and unicodedata.category(x) == kind and low(x) == x and low(up(x)) == x]
    return ("".join(same), same.index(c)) if c in same and len(same) > 1 else None


def _units(word: str) -> list[tuple]:
    """The pairs and letters of a word, each with its class and place there; what has none stands alone."""
    out, at, after_vowel = [], 0, False
    while at < len(word):
        pairs, pair = (CODAS, word[at : at + 2]) if after_vowel else (ONSETS, word[at : at + 2])
        if pair in pairs:
            out.append((pairs, pairs.index(pair)))
            at, after_vowel = at + 2, False
        else:
            out.append(_spot(word[at]) or (word[at], 0))
            after_vowel = word[at] in CLASSES[0] or word[at] in CLASSES[2]
            at += 1
    return out


def _ending(word: str) -> str:
    return word[-1] if len(word) > 2 and word[-1] in "aая" else ""


_GENDER = {name: kind for kind, names in GIVEN.items() for name in names}
_GIVEN = {low(name): (kind, k) for kind, names in GIVEN.items() for k, name in enumerate(names)}
_FAMILY = {low(name): (kind, k) for kind, names in FAMILY.items() for k, name in enumerate(names)}
#: Hangul surnames; these alone mark a name next to a given name.
SURNAMES = [*"김이박최정강조윤장임한오서신권황안송류유전홍고문양손배백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용", "남궁", "황보", "제갈", "사공", "선우", "서문", "독고"]
_SURNAME = {x: ([y for y in SURNAMES if len(y) == len(x)], [y for y in SURNAMES if len(y) == len(x)].index(x)) for x in SURNAMES}
_SURNAME_BEFORE = re.compile(rf"(?<!\w)(?:{'|'.join(SURNAMES)}) *$")
_SURNAME_AFTER = re.compile(rf" +(?:{'|'.join(SURNAMES)})(?!\w)")
_PARTICLE = re.compile(r"(?:은|는|이|가|을|를|의|와|과|도|만|에게|한테|께서|께|에게서|이다|입니다|씨|님|씨가|씨는|씨의|씨를|님이|님은|님의|님을)?(?!\w)")
_HANGUL = re.compile("[가-힣]")
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_NUMBERS = re.compile(
    r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d.-])(?<!\d )\d{3} \d{2} \d{4}(?![\d-])(?! \d))"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d))"
    r"|(?P<phone>(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])"
    r"|(?<![\d.-])(?<!\d )(?:\d{3} \d{3} \d{4}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4})(?![\d-])(?! \d))"
    r"|(?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]))"
    r"|(?P<card>(?<![\d.])\d(?:[ -]?\d){11,18}(?!\d))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
)
_BORN = re.compile(
    rf"(?:\b(?:born|birth|DOB)\b)(?: on| date)?\s{{0,3}}:?\s{{0,3}}(?P<value>\d{{4}}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{{4}}|\d\d? (?:{'|'.join(MONTHS)}) \d{{4}}|(?:{'|'.join(MONTHS)}) \d\d?, \d{{4}})(?!\d)", re.I
)
_PASSPORT = re.compile(r"\bpassport(?: (?:number|no\.?))?(?: is)?\s{0,3}[:#]?\s{0,3}(?P<value>[A-Z]{0,2}\d{6,9})(?![A-Za-z0-9])", re.I)
_STREET = re.compile(rf"(?<![\w.,-])[1-9]\d{{0,4}} (?:[^\W\d_a-z][^\W\d_]+ ){{1,3}}(?:{'|'.join(STREETS)})\b")
_EMAIL = re.compile(r"[^\W_](?:[\w.+%-]*[\w+%-])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}", re.ASCII)
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z2-7]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")
_KEY_ANY_CASE = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", re.I)
_SECRET = re.compile(r"""(?:token|secret|api[_-]?key|passw(?:or)?d|pwd)["']?\s{0,3}[:=]\s{0,3}["']?(?P<value>[A-Za-z0-9+/_.~-]{6,}[A-Za-z0-9])""", re.I)
_TITLED = re.compile(rf"\b(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.? +(?P<name>{_WORD}(?: +{_WORD})?)")
_LABELLED = re.compile(rf" *(?P<name>{_WORD}(?: +{_WORD}){{1,2}})")
_NAMED = re.compile(rf"(?P<name>{_WORD}(?: +{_WORD})?)")


class Keyed:
    """Keyed permutations without fixed points over tuples of digits in mixed radices."""

    ROUNDS = 8

    def __init__(self, key: bytes):
        self.key, self.orders = key, {}

    def _next(self, form: str, x: int, count: int) -> int:
        """What follows ``x`` in a keyed order of ``count`` numbers, a few thousand at most."""
        if form not in self.orders:
            if len(self.orders) >= 1000:
                self.orders.clear()
            order = sorted(range(count), key=lambda n: hmac.digest(self.key, f"{form}|{n}".encode(), "sha256"))
            self.orders[form] = dict(zip(order, order[1:] + order[:1]))
        return self.orders[form][x]

    def _round(self, form: str, number: int, x: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        seed = hmac.digest(self.key, f"{form}|{number}|{x}".encode(), "sha256")
        return int.from_bytes(hashlib.shake_256(seed).digest(size), "big") % modulus

    def permuted(self, form: str, values: list[int], radices: list[int]) -> list[int]:
        """F of the header. ``form`` names the permutation; radices of one are left alone."""
        half = len(radices) // 2
        parts = [radices[:half], radices[half:]]
        mods, nums, at = [], [], 0
        for part in parts:
            m = n = 0
            m = 1
            for r in part:
                n = n * r + values[at]
                m *= r
                at += 1
            mods.append(m)
            nums.append(n)
        total = mods[0] * mods[1]
        if total < 2:
            return list(values)
        name = f"{form}|{radices}"
        a, b = nums
        if 1 in mods:  # rounds over one digit would only add a constant, and F one
            n = self._next(name, a + b, total)
            a, b = (n, 0) if mods[1] == 1 else (0, n)
        for i in range(self.ROUNDS if 1 not in mods else 0):
            a = (a + self._round(name, 2 * i, b, mods[0])) % mods[0]
            b = (b + self._round(name, 2 * i + 1, a, mods[1])) % mods[1]
        if 1 not in mods:
            a, b = divmod((a * mods[1] + b + 1) % total, mods[1])
        for i in reversed(range(self.ROUNDS if 1 not in mods else 0)):
            b = (b - self._round(name, 2 * i + 1, a, mods[1])) % mods[1]
            a = (a - self._round(name, 2 * i, b, mods[0])) % mods[0]
        out = []
        for n, part in ((b, parts[1]), (a, parts[0])):
            for r in reversed(part):
                n, d = divmod(n, r)
                out.append(d)
        return out[::-1]

    def digits(self, form: str, text: str, radices: list[int] | None = None, low: list[int] | None = None) -> str:
        radices, low = radices or [10] * len(text), low or [0] * len(text)
        new = self.permuted(form, [int(c) - k for c, k in zip(text, low)], radices)
        return "".join(str(d + k) for d, k in zip(new, low))

    def letters(self, form: str, text: str) -> str:
        """Letters and digits of ``text`` (lower case) within their classes; others stay."""
        spots = [_spot(c) for c in text]
        values, radices = [s[1] for s in spots if s], [len(s[0]) for s in spots if s]
        new = iter(self.permuted(form + "|" + "".join(s[0][0] if s else c for s, c in zip(spots, text)), values, radices))
        return "".join(s[0][next(new)] if s else c for s, c in zip(spots, text))

    def syllables(self, form: str, text: str) -> str:
        """A word (lower case) with the same kinds of pairs and letters."""
        units = _units(text)
        kinds, got = [u[0] for u in units], [u[1] for u in units]
        while True:  # pass over words that read as other pairs
            got = self.permuted(form + "|" + "".join(k[0] for k in kinds), got, [len(k) for k in kinds])
            new = "".join(k[n] for k, n in zip(kinds, got))
            if new == text or [u[0] for u in _units(new)] == kinds:
                return new

    def alphabet(self, form: str, text: str, symbols: str) -> str:
        return "".join(symbols[i] for i in self.permuted(form, [symbols.index(c) for c in text], [len(symbols)] * len(text)))


def luhn(digits: str) -> str:
    """The check digit that makes ``digits`` and it a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def cased(like: str, text: str) -> str:
    """``text`` in the case of ``like``."""
    if like.isupper() and len(like) > 1:
        return up(text)
    if like.islower():
        return low(text)
    return "".join(up(t) if i < len(like) and like[i].isupper() else t for i, t in enumerate(text))


def filled(like: str, symbols: str) -> str:
    """The letters and digits of ``like`` replaced in order by ``symbols``."""
    new = iter(symbols)
    return "".join(next(new) if c.isalnum() else c for c in like)


def _special(ip: list[int]) -> int:
    """Which kind of range an address is in; surrogates stay in it."""
    a, b = ip[0], ip[1]
    if a == 10:
        return 1
    if (a, b) == (192, 168):
        return 2
    if a == 172 and 16 <= b < 32:
        return 3
    return 4 if a == 127 else 5 if a in (0, 255) or a >= 224 else 0


class Surrogates:
    """Surrogates of mentions: ``of(kind, mention)`` gives the value's canonical form and its text."""

    def __init__(self, key: bytes, kept: int = 100_000):
        self.keyed, self.kept, self.known = Keyed(key), kept, {}

    def of(self, kind: str, mention: str, gender: str = "") -> tuple[str, str]:
        at = (kind, mention, gender)
        if at not in self.known:
            if len(self.known) >= self.kept:
                self.known.clear()
            self.known[at] = getattr(self, "_" + kind)(mention)
        return self.known[at]

    def _email(self, x: str):
        value = x.lower()
        user, _, domain = value.partition("@")
        labels = domain.split(".")
        new = self.keyed.letters("user|" + domain, user) + "@" + ".".join([self.keyed.letters("domain", ".".join(labels[:-1])), labels[-1]])
        return value, cased(x, new)

    def _phone(self, x: str):
        digits = "".join(c for c in x if c.isdigit())
        code = len(re.match(r"\+?(\d*)", x)[1]) if x[0] == "+" else 0
        code = code if code <= 3 else 1
        trunk = x[0] != "+" and digits[0] == "0"  # that zero stays
        code = 1 if trunk else code
        rest = digits[code:]
        national = len(rest) == 10 and code <= 1 and not trunk  # area and exchange don't start with 0 or 1
        low = [2 if national and i in (0, 3) and rest[i] >= "2" else 0 for i in range(len(rest))]
        radices = [10 - k for k in low]
        form = f"phone|{digits[:code] or '1' if national else digits[:code]}|{low}"
        return digits if code else "1" + digits if national else digits, filled(x, digits[:code] + self.keyed.digits(form, rest, radices, low))

    def _card(self, x: str):
        digits = "".join(c for c in x if c.isdigit())
        body, valid = digits[1:-1], luhn(digits[:-1]) == digits[-1]
        if valid:
            new = digits[0] + self.keyed.digits(f"card|{digits[0]}", body)
            new += luhn(new)
        else:
            new = digits
            while True:  # pass over numbers that are valid
                new = digits[0] + self.keyed.digits(f"number|{digits[0]}", new[1:])
                if luhn(new[:-1]) != new[-1]:
                    break
        return digits, filled(x, new)

    def _ssn(self, x: str):
        digits = "".join(c for c in x if c.isdigit())
        return digits, filled(x, self.keyed.digits("ssn", digits))

    def _ip(self, x: str):
        ip = [int(p) for p in x.split(".")]
        new = ip
        while True:
            new = self.keyed.permuted("ip", new, [256] * 4)
            if _special(new) == _special(ip):
                break
        return ".".join(map(str, ip)), ".".join(map(str, new))

    def _ip6(self, x: str):
        """The first group, which tells the kind of network, stays."""
        value = ipaddress.IPv6Address(x)
        groups = value.exploded.split(":")
        new = self.keyed.permuted(f"ip6|{groups[0]}", [int(g, 16) for g in groups[1:]], [1 << 16] * 7)
        new = ipaddress.IPv6Address(":".join([groups[0], *(f"{g:x}" for g in new)]))
        return value.exploded, cased(x, new.exploded if len(x) == 39 else new.compressed)

    def _iban(self, x: str):
        value = x.replace(" ", "")
        country, body = value[:2], value[4:]
        numbers = lambda s: int("".join(str(int(c, 36)) for c in s))
        valid = numbers(body + country + value[2:4]) % 97 == 1
        shape = "".join("9" if c.isdigit() else "A" for c in body)
        new = self.keyed.permuted(f"iban|{country}|{shape}|{valid}", [int(c) if c.isdigit() else ord(c) - 65 for c in body], [10 if c.isdigit() else 26 for c in body])
        body = "".join(str(n) if s == "9" else chr(65 + n) for n, s in zip(new, shape))
        check = f"{98 - numbers(body + country + '00') % 97:02d}" if valid else value[2:4]
        return value, filled(x, country + check + body)

    def _key(self, x: str):
        upper = x.upper()
        if upper[:4] in ("AKIA", "ASIA"):
            symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" if not set(upper[4:]) & set("0189") else "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
            return upper, cased(x, upper[:4] + self.keyed.alphabet(f"key|{upper[:4]}", upper[4:], symbols))
        head = re.match(r"gh[pousr]_|sk-", x)[0]
        return x, head + self._mixed("key|" + head, x[len(head) :])

    def _mixed(self, form: str, x: str) -> str:
        """Each letter and digit of a secret within its kind."""
        kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
        spots = [next(((k, k.index(c)) for k in kinds if c in k), None) for c in x]
        shape = "".join(s[0][0] if s else c for s, c in zip(spots, x))
        new = iter(self.keyed.permuted(form + "|" + shape, [s[1] for s in spots if s], [len(s[0]) for s in spots if s]))
        return "".join(s[0][next(new)] if s else c for s, c in zip(spots, x))

    def _secret(self, x: str):
        for symbols in ("0123456789abcdef", "0123456789ABCDEF"):
            if len(x) >= 8 and set(x) <= set(symbols) and set(x) & set("0123456789"):
                value = x.lower()
                return value, cased(x, self.keyed.alphabet("hex", value, "0123456789abcdef"))
        return x, self._mixed("secret", x)

    def _birth(self, x: str):
        """Another day of the same 3,600."""
        numbers = [int(n) for n in re.findall(r"\d+", x)]
        month = re.search("[^\\W\\d_]+", x)
        if month:
            d, m, y = numbers[0], [n.lower() for n in MONTHS].index(month[0].lower()) + 1, numbers[1]
        else:
            y, m, d = numbers if x[:4].isdigit() else reversed(numbers)
        swapped = not month and not x[:4].isdigit() and m > 12  # month before day
        m, d = (d, m) if swapped else (m, d)
        at, new = datetime.date(y, m, d).toordinal(), None
        while new is None or (new.day > 12) != (d > 12):  # so that a date in figures reads in the same order
            block, day = divmod(at, 3600)
            high, rest = self.keyed.permuted(f"birth|{block}", list(divmod(day, 60)), [60, 60])
            at = block * 3600 + high * 60 + rest
            new = datetime.date.fromordinal(at) if 1 <= at <= datetime.date.max.toordinal() else None
        if month:
            parts = iter([str(new.day), f"{new.year:04d}"])
            text = re.sub(r"\d+|[^\W\d_]+", lambda w: next(parts) if w[0].isdigit() else cased(w[0], MONTHS[new.month - 1]), x)
        else:
            order = (new.year, new.month, new.day) if x[:4].isdigit() else (new.month, new.day, new.year) if swapped else (new.day, new.month, new.year)
            parts = iter(order)
            text = re.sub(r"\d+", lambda w: f"{next(parts):0{len(w[0])}d}", x)
        return f"{y:04d}-{m:02d}-{d:02d}", text

    def _passport(self, x: str):
        value = x.upper()
        return value, cased(x, self._mixed("passport", value))

    def _street(self, x: str):
        number, *words = x.split(" ")
        new = self.keyed.digits("street", number, [9] + [10] * (len(number) - 1), [1] + [0] * (len(number) - 1))
        return low(x), " ".join([new, *(cased(w, self._word(low(w))) for w in words[:-1]), words[-1]])

    def _word(self, word: str) -> str:
        """The surrogate of a word of a name, in lower case."""
        if re.search("['’-]", word):
            return "".join(w if w in "'’-" else self._word(w) for w in re.split("(['’-])", word) if w)
        if word in _GIVEN:
            kind, at = _GIVEN[word]
            names = GIVEN[kind]
            return low(names[self.keyed.permuted(f"given|{kind}", [at], [len(names)])[0]])
        if word in _SURNAME:
            same, at = _SURNAME[word]
            return same[self.keyed.permuted(f"hangul|{len(word)}", [at], [len(same)])[0]]
        both = _joined(word)
        if both:
            return self._word(both[0]) + self._word(both[1])
        ending = _ending(word)
        stem = word[: len(word) - len(ending)]
        if _family(word):
            kind, at = _FAMILY.get(word) or _FAMILY[stem]
            return low(FAMILY[kind][self.keyed.permuted(f"family|{kind}", [at], [len(FAMILY[kind])])[0]]) + ("" if word in _FAMILY else ending)
        new = stem
        while True:  # within the words that are none of these
            new = self.keyed.syllables("surname", new)
            whole = new + ending
            if new == stem or not (whole in _GIVEN or whole in _SURNAME or _joined(whole) or _family(whole)) and _ending(whole) == ending:
                return whole

    def _name(self, x: str):
        parts, gaps = re.findall(_WORD, x), re.split(_WORD, x)
        out = [cased(p, self._word(low(p))) for p in parts]
        if any(_joined(p) for p in parts) or len(parts) == 2 and _HANGUL.match(x) and parts[1] in _GENDER and parts[0] not in _GENDER:
            value = " ".join([y for p in reversed(parts) for y in reversed(_joined(p) or (p,))])  # given name first
        else:
            value = " ".join(low(p) for p in parts)
        return value, "".join(g + o for g, o in zip(gaps, [*out, ""]))


def _family(word: str) -> bool:
    """Whether a word (lower case) is a known surname, in either form."""
    return word in _FAMILY or word[-1:] in "aа" and _FAMILY.get(word[:-1], ("latin",))[0] == {"a": "slavic", "а": "cyrillic"}.get(word[-1:])


def _joined(word: str) -> tuple[str, str] | None:
    """Surname and given name of a Hangul word that is both."""
    if _HANGUL.match(word) and word[-2:] in _GENDER and word[:-2] in SURNAMES:
        return word[:-2], word[-2:]
    return None


def _triggers():
    """An automaton for what starts the rarer kinds."""
    found = ahocorasick.Automaton()
    for word, kind in [("@", "email"), *((w, "secret") for w in ("token", "secret", "api", "passw", "pwd", "Token", "Secret", "Api", "API", "Passw", "PASSW", "TOKEN", "SECRET", "PWD")), *((w, "key") for w in ("AKIA", "ASIA", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")), ("name is", "labelled"), ("ame:", "labelled"), *((x, "person") for x in LABELS), *((x, "birth") for x in ("born", "birth", "DOB", "Born", "Birth", "BORN", "BIRTH", "dob")), *((x, "passport") for x in ("passport", "Passport", "PASSPORT")), *((" " + x, "street") for x in STREETS), *((t, "titled") for t in TITLES), *((x, "named") for n in _GENDER for x in {n, up(n), low(n)})]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _is_address(x: str) -> bool:
    """Whether ``x`` is an IPv6 address that stands for some host, and not two names with colons between them."""
    try:
        return len(x) > 5 and any(c.isdigit() for c in x) and int(ipaddress.IPv6Address(x)) > 1
    except ValueError:
        return False


def _is_date(x: str) -> bool:
    """Whether a matched date exists, in the order of its parts or, written with separators, with month before day."""
    numbers = [int(n) for n in re.findall(r"\d+", x)]
    if len(numbers) == 2:  # the month is a word
        day, year = numbers
        month = [n.lower() for n in MONTHS].index(re.search(r"[^\W\d_]+", x)[0].lower()) + 1
    else:
        year, month, day = numbers if x[:4].isdigit() else reversed(numbers)
        if month > 12 and not x[:4].isdigit():
            month, day = day, month
    try:
        return bool(datetime.date(year, month, day))
    except ValueError:
        return False


_HAS_DIGIT = re.compile("[0-9]")
_automaton = None


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the mentions, without overlaps, in order."""
    global _automaton
    if _automaton is None:
        _automaton = _triggers()
    out = []
    kinds: dict[str, list[tuple[int, int]]] = {}
    for end, (kind, size) in _automaton.iter(text):
        kinds.setdefault(kind, []).append((end + 1 - size, end + 1))
    if "email" in kinds:
        out += [(*m.span(), "email", "") for m in _EMAIL.finditer(text)]
    if "secret" in kinds and _HAS_DIGIT.search(text):
        out += [(*m.span("value"), "secret", "") for m in _SECRET.finditer(text) if _HAS_DIGIT.search(m["value"])]
    if "key" in kinds:
        out += [(*m.span(), "key", "") for p in (_KEY, _KEY_ANY_CASE) for m in p.finditer(text)]
    if _HAS_DIGIT.search(text):
        out += [(*m.span(), m.lastgroup, "") for m in _NUMBERS.finditer(text) if m.lastgroup != "ip6" or _is_address(m[0])]
    for kind, pattern in (("birth", _BORN), ("passport", _PASSPORT)):
        if kind in kinds:
            out += [(*m.span("value"), kind, "") for m in pattern.finditer(text) if kind != "birth" or _is_date(m["value"])]
    if "street" in kinds:
        out += [(*m.span(), "street", "") for m in _STREET.finditer(text)]
    persons = {end for _, end in kinds.get("person", ())}
    for end in sorted(persons.union(end for _, end in kinds.get("labelled", ()))):
        m = _LABELLED.match(text, end)
        if m and not (end in persons and OFFICES & set(low(m["name"]).split())):
            capital = list(itertools.takewhile(lambda w: w[0][:1].isupper(), re.finditer(_WORD, m["name"])))
            if len(capital) > 1:
                out.append((m.start("name"), m.start("name") + capital[-1].end(), "name", ""))
    for start, _ in kinds.get("titled", ()):
        m = _TITLED.match(text, start)
        if m and (not start or not text[start - 1].isalnum()):
            words = [w for w in re.finditer(_WORD, m["name"]) if w[0][:1].isupper()]
            if _HANGUL.match(m["name"]):
                first, second = (re.findall(_WORD, m["name"]) + [""])[:2]
                end = m.end("name") if first in SURNAMES and second in _GENDER or first in _GENDER and second in SURNAMES else m.start("name") + len(first)
                out.append((m.start("name"), end, "name", TITLES[m["title"]]))
            elif m["name"][:1].isupper():
                end = m.start("name") + (words[1].end() if len(words) > 1 else words[0].end())
                out.append((m.start("name"), end, "name", TITLES[m["title"]]))
    for start, end in kinds.get("named", ()):
        if _HANGUL.match(text, start):
            before, after = _SURNAME_BEFORE.search(text[max(0, start - 8) : start]), _SURNAME_AFTER.match(text, end)
            if before and _PARTICLE.match(text, end):
                out.append((start - len(before[0]), end, "name", _GENDER[text[start:end]][1]))
                continue
            if after and not (start and text[start - 1].isalnum()):
                out.append((start, after.end(), "name", _GENDER[text[start:end]][1]))
                continue
        if (start and (text[start - 1].isalnum() or text[start - 1] in "'’-")) or (end < len(text) and text[end].isalnum()):
            continue
        m = _NAMED.match(text, start)
        words = m["name"].split()
        known = len(words) > 1 and words[1] not in WORDS and _family(words[1])
        if len(words) > 1 and (words[1][:1].isupper() and text[start].isupper() or text[start].islower() and known):  # a given name alone isn't taken for a person
            out.append((start, m.end("name"), "name", _GIVEN[low(text[start:end])][0][1]))
    out.sort(key=lambda s: (s[0], -s[1]))
    kept, last = [], 0
    for s in out:
        if s[0] >= last:
            kept.append(s)
            last = s[1]
    return kept


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[int, int, str, str]], int]:
    """The new text, (start, end, kind, surrogate) of each mention in the old one, and collisions."""
    found, parts, last, taken, same = find(text), [], 0, {}, 0
    spans = []
    for start, end, kind, gender in found:
        value, new = surrogates.of(kind, text[start:end], gender)
        canonical, met = surrogates.of(kind, new, gender)[0], False
        while taken.setdefault((kind, canonical), value) != value:
            new, met = surrogates.of(kind, new, gender)[1], True
            canonical = surrogates.of(kind, new, gender)[0]
        same += met
        parts += [text[last:start], new]
        last = end
        spans.append((start, end, kind, new))
    return ("".join([*parts, text[last:]]) if found else text), spans, same


def surrogate_text(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced, ``entities`` (places in the old text, kind, surrogate) and ``n_collisions``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop("entities", "n_collisions")
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string("entities array<struct<start:int,end:int,kind:string,surrogate:string>>, n_collisions int").fields)
    arrow = to_arrow_schema(schema)
    at = docs.columns.index(text)

    def run(batches):
        surrogates = Surrogates(key)
        for batch in batches:
            for part in slices(batch):
                done = [(None, [], 0) if t is None else replace(t, surrogates) for t in part.column(text).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([d[0] for d in done], pa.string())
                entities = pa.array([[dict(zip(("start", "end", "kind", "surrogate"), s)) for s in d[1]] for d in done], arrow.field("entities").type)
                yield pa.RecordBatch.from_arrays([*columns, entities, pa.array([d[2] for d in done], pa.int32())], names=arrow.names)

    return docs.mapInArrow(run, schema)
