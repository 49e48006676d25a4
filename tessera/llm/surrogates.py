"""Personal data and secrets replaced by keyed surrogates of the same type and format.

Detected entities: e-mail addresses, phone numbers, IP addresses, payment card
numbers (issuer prefix and check digit right), social security numbers, IBANs,
secrets, and names: after a title, after words that introduce a name, before an
address in angle brackets, and then every further mention of such a name's words in
the document.

A surrogate comes from a keyed permutation of all strings of the entity's format: a
Feistel network p, walked until it is inside the format's domain, used as
p^-1(p(x) + 1), which is one cycle through the whole domain, so that nothing is
its own surrogate. Equal entities therefore get equal surrogates in the whole corpus
(coreference), and different entities of one type different ones (distinctness),
with nothing to look up or to shuffle. Cards keep issuer and check digit, IBANs
country and checksum, addresses octets in range; letters stay in their script. A
word of a name is numbered among all words of its script, the number permuted and
spelt in syllables, as many as that domain needs, with an ending for the gender that
the mention's title shows, or for a bare mention the last title before it, else the
first behind; so a name has one stem everywhere, whatever its title, and two words never
share one, at any number of names.

Collision check: surrogates that equal another entity of the document, which is then
replaced itself, are counted in n_clashes; they are left as they are, since moving
one of them would break coreference with other documents.

Edge cases: null text stays null with no entities; empty text stays empty;
overlapping finds: the earlier, then the longer wins; repeated rows are treated
each, alike; a very long text is handled whole, in memory of a few times its size;
an empty table gives no rows; further columns are ignored by ``redact`` and kept by
``with_surrogates``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import small_batches
from .textkit import lean

#: In production the key comes from a secret store; it is a parameter everywhere.
DEFAULT_KEY = b"tessera-surrogates"
ROUNDS = 8

EMAIL = re.compile(r"[\w.%+'-]*[\w%+]@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NUMBER = re.compile(
    rf"(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?(?!\d{1,3}\.\d)\d{2,4}){2,3}?(?!\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]))",
    re.ASCII,
)
#: IPv6 addresses of eight groups, or shortened ones that begin with a group of three digits or more, one of them decimal.
IPV6 = re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f]*\d)[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])", re.ASCII)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII)
SECRET = re.compile(
    r"(?i:\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9_/+=.-]{8,})"
    r"|(?P<bare>\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9_-]{20,}|\b(?=[0-9a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,64}\b)",
    re.ASCII,
)
#: Titles and the gender that a surrogate name takes ("" where the title shows none).
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Sr": "m", "Sra": "f", "Srta": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Don": "m", "Doña": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: Words that introduce a name.
INTRODUCTIONS = (
    "my name is", "mein Name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут", "με λένε",
    "name:", "full name:", "contact:", "author:", "signed:", "nom:", "auteur:", "nombre:", "autor:", "kontakt:", "имя:", "автор:", "όνομα:",
)
_WORD_OF_NAME = r"(?:[A-Z]['’])?[^\W\d_a-zа-яα-ω][^\W\d_]{1,20}"
_NAME = rf"(?P<name>{_WORD_OF_NAME}(?:[ -]{_WORD_OF_NAME}){{0,2}})"
PERSON = re.compile(r"\b(?P<title>" + "|".join(sorted(TITLES, key=len, reverse=True)) + rf")\.? {_NAME}")
INTRODUCED = re.compile(r"(?<!\w)(?i:" + "|".join(map(re.escape, sorted(INTRODUCTIONS, key=len, reverse=True))) + rf") {_NAME}")
ADDRESSED = re.compile(rf"(?<!\w){_NAME} <(?=[^<>\s@]+@[^<>\s@]+>)")
_TITLE_HINT = re.compile("|".join(sorted(TITLES, key=len, reverse=True)))
_INTRODUCTION_HINTS = sorted({x.lower() for x in INTRODUCTIONS if not any(y != x and y in x for y in INTRODUCTIONS)})
_DIGITS = re.compile(r"\d", re.ASCII)
#: Prefixes of card issuers, kept in a surrogate.
ISSUER = re.compile(r"4|5[0-8]|3[4-689]|30[0-5]|6011|64[4-9]|65|62|6[0-9]|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)")

#: Alphabets by script: a character is replaced inside its own.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщыьэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àáâäçèéêëìíîïñòóôöùúûü", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ",
)
_ALPHABET_OF = {c: a for a in ALPHABETS for c in a}
_HEX = "0123456789abcdef"
_lower = lambda first, last: "".join(c for c in map(chr, range(first, last)) if c.islower())
#: Letters of names; consonants, vowels, vowels of the first syllable, and what follows the
#: syllables (masculine, feminine, neither). A name belongs to the first that has all its letters.
SPELLINGS = {
    "ascii": (_lower(0x61, 0x7B), "bcdfghjklmnprstvwz", "aeiou", "aeiou", {"m": "no", "f": "na", "": "ne"}),
    "latin": (_lower(0x61, 0x7B) + _lower(0xDF, 0x180), "bcdfghjklmnprstvwz", "aeiou", "áéíóú", {"m": "no", "f": "na", "": "ne"}),
    "cyrillic": (_lower(0x430, 0x460), "бвгдзклмнпрстфхц", "аеиоу", "аеиоу", {"m": "нов", "f": "нова", "": "нко"}),
    "greek": (_lower(0x390, 0x3CF), "βγδζθκλμνπρστφχ", "αειου", "αειου", {"m": "νος", "f": "να", "": "νι"}),
}


@lru_cache(maxsize=10_000)
def alphabet_of(c: str) -> str:
    """The characters that may stand for ``c``: those of its alphabet, or, outside the listed ones,
    of its kind in its part of Unicode, so that no letter or digit of any script stays as it is."""
    if c in _ALPHABET_OF or not c.isalnum():
        return _ALPHABET_OF.get(c, c)
    for width in (0x100, 0x1000, 0x20000):
        first = ord(c) // width * width
        kind = unicodedata.category(c)
        near = "".join(x for x in map(chr, range(first, first + width)) if unicodedata.category(x) == kind and x not in _ALPHABET_OF)
        if len(near) > 9:
            return near
    return near


@lru_cache(maxsize=1000)
def _syllables(letters: int, units: int, length: int) -> tuple[int, int]:
    """(syllables, first number) of the words of ``length``: each length has room of its own among the
    numbers that so many syllables can spell."""
    count, used = 1, 0
    for n in range(1, length + 1):
        while used + letters**n > units**count:
            count, used = count + 1, 0
        used += letters**n
    return count, used - letters**length


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    compact = text.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


class Permutation:
    """A keyed bijection of range(size) for every tweak that leaves no value where it is (if there are two)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, width: int) -> int:
        size = (width + 7) // 8
        data = half.to_bytes(size, "big")
        digest = b"".join(hashlib.blake2b(tweak + bytes([0, i]) + block.to_bytes(4, "big") + data, key=self.key, digest_size=64).digest() for block in range((size + 63) // 64))
        return int.from_bytes(digest, "big") & ((1 << width) - 1)

    def _network(self, value: int, size: int, tweak: bytes, forward: bool) -> int:
        width = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << width) - 1
        while True:
            left, right = value >> width, value & mask
            if forward:
                for i in range(ROUNDS):
                    left, right = right, left ^ self._round(tweak, i, right, width)
            else:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(tweak, i, left, width), left
            value = left << width | right
            if value < size:
                return value

    def __call__(self, value: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return value
        return self._network((self._network(value, size, tweak, True) + 1) % size, size, tweak, False)

    def text(self, text: str, tweak: bytes, alphabets: list[str] | None = None) -> str:
        """Permute ``text`` among all strings of its format: each character stays in its alphabet."""
        alphabets = alphabets or [alphabet_of(c) for c in text]
        value, size = 0, 1
        for c, a in zip(text, alphabets, strict=True):
            value, size = value * len(a) + a.index(c), size * len(a)
        shape = "".join(a[0] if len(a) > 1 else c for c, a in zip(text, alphabets, strict=True)).encode()
        value = self(value, size, tweak + b"|" + shape)
        out = []
        for a in reversed(alphabets):
            value, d = divmod(value, len(a))
            out.append(a[d])
        return "".join(reversed(out))


class Surrogates:
    def __init__(self, key: bytes = DEFAULT_KEY):
        self.permute = Permutation(key)
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _of(self, kind: str, entity: str) -> str:
        return getattr(self, f"_{kind}")(entity, kind.encode())

    def _email(self, entity: str, tweak: bytes) -> str:
        """The whole address is permuted; the reserved domain keeps it from being anyone's."""
        return self.permute.text(entity, tweak) + ".example"

    def _ip(self, entity: str, tweak: bytes) -> str:
        value = int.from_bytes(bytes(map(int, entity.split("."))), "big")
        return ".".join(map(str, self.permute(value, 1 << 32, tweak).to_bytes(4, "big")))

    def _ipv6(self, entity: str, tweak: bytes) -> str:
        low = entity.lower()
        return self.permute.text(low, tweak, [c if c == ":" else _HEX for c in low])

    def _phone(self, entity: str, tweak: bytes) -> str:
        m = re.match(r"\+\d{1,3}(?=\D)", entity)
        head = m[0] if m else ""
        return head + self.permute.text(entity[len(head) :], tweak + head.encode())

    def _ssn(self, entity: str, tweak: bytes) -> str:
        return self.permute.text(entity, tweak)

    def _card(self, entity: str, tweak: bytes) -> str:
        digits = re.sub(r"\D", "", entity)
        head = ISSUER.match(digits)[0]
        n = len(digits) - 1 - len(head)
        body = head + str(self.permute(int(digits[len(head) : -1]), 10**n, tweak + b"|%s%d" % (head.encode(), n))).zfill(n)
        it = iter(next(body + c for c in "0123456789" if luhn(body + c)))
        return "".join(next(it) if c.isdigit() else c for c in entity)

    def _iban(self, entity: str, tweak: bytes) -> str:
        compact = entity.replace(" ", "")
        account = self.permute.text(compact[4:], tweak + compact[:2].encode())
        check = 98 - int("".join(str(int(c, 36)) for c in account + compact[:2] + "00")) % 97
        it = iter(f"{compact[:2]}{check:02d}{account}")
        return "".join(c if c == " " else next(it) for c in entity)

    def _secret(self, entity: str, tweak: bytes) -> str:
        if re.fullmatch(r"[0-9a-f]+", entity):
            return self.permute.text(entity, tweak + b"|hex", [_HEX] * len(entity))
        return self.permute.text(entity, tweak)

    def _name(self, word: str, tweak: bytes, gender: str = "") -> str:
        low = word.lower()
        for script, (letters, consonants, vowels, first, endings) in SPELLINGS.items():
            if all(c in letters for c in low):
                break
        else:  # a script without syllables here
            return self.permute.text(word, tweak)
        value = 0
        for c in low:
            value = value * len(letters) + letters.index(c)
        units = len(consonants) * len(vowels)
        count, offset = _syllables(len(letters), units, len(low))
        value = self.permute(offset + value, units**count, tweak + f"|{script}|{count}".encode())
        out = []
        for i in range(count):
            value, c = divmod(value, len(consonants))
            value, v = divmod(value, len(vowels))
            out.append(consonants[c] + (vowels if i else first)[v])
        name = "".join(out) + endings[gender]
        return name.upper() if word.isupper() else name.capitalize() if word[0].isupper() else name

    _name_m = lambda self, word, tweak: self._name(word, b"name", "m")
    _name_f = lambda self, word, tweak: self._name(word, b"name", "f")

    def person(self, name: str, gender: str) -> str:
        """A surrogate of each word, in the form of the gender."""
        kind = f"name_{gender}" if gender else "name"
        return "".join(w if w in " -" else self.of(kind, w) for w in re.split(r"([ -])", name))


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of ``text``, in order, none overlapping."""
    spans = []
    if "@" in text:
        spans += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if _DIGITS.search(text):
        for m in NUMBER.finditer(text):
            kind = m.lastgroup
            if kind == "card":
                digits = re.sub(r"\D", "", m[0])
                if not luhn(digits) or not ISSUER.match(digits):
                    continue
            spans.append((m.start(), m.end(), kind))
        spans += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text) if _iban_ok(m[0])]
        if text.count(":") > 1:
            spans += [(m.start(), m.end(), "ipv6") for m in IPV6.finditer(text)]
        for m in SECRET.finditer(text):
            group = m.lastgroup
            spans.append((m.start(group), m.end(group), "secret"))
    elif "=" in text or ":" in text:
        spans += [(m.start("value"), m.end("value"), "secret") for m in SECRET.finditer(text) if m["value"]]
    people = []
    if _TITLE_HINT.search(text):
        people += [(m.start("name"), m.end("name"), f"person_{TITLES[m['title']]}") for m in PERSON.finditer(text)]
    low = text.lower()
    if any(x in low for x in _INTRODUCTION_HINTS):
        people += [(m.start("name"), m.end("name"), "person_") for m in INTRODUCED.finditer(text)]
    if "@" in text and "<" in text:
        people += [(m.start("name"), m.end("name"), "person_") for m in ADDRESSED.finditer(text)]
    if people:
        words = {x for a, b, _ in people for w in re.split("[ -]", text[a:b]) for x in (w, w.upper(), w.capitalize())}
        again = re.compile(r"(?<![\w@])(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")(?![\w@])")
        spans += people + [(m.start(), m.end(), "person_") for m in again.finditer(text)]
    spans.sort(key=lambda s: (s[0], -s[1]))
    out, reach = [], 0
    for span in spans:
        if span[0] >= reach:
            out.append(span)
            reach = span[1]
    return out


def replace(text: str, surrogates: Surrogates) -> tuple[str, Counter, int, int]:
    """(text with surrogates, entities by type, distinct entities, surrogates that equal another entity)."""
    spans = find(text)
    if not spans:
        return text, Counter(), 0, 0
    genders: dict[str, str] = {}  # of a word, as the last title before shows it, or the first behind
    titled = [(text[a:b].lower(), kind.partition("_")[2]) for a, b, kind in spans if kind.startswith("person_") and kind != "person_"]
    for name, gender in titled:
        for w in re.split("[ -]", name):
            genders.setdefault(w, gender)
    given: dict[tuple[str, str, str], str] = {}
    parts, at, counts = [], 0, Counter()
    for a, b, kind in spans:
        (kind, _, gender), entity = kind.partition("_"), text[a:b]
        if kind == "person":
            words = re.split("[ -]", entity.lower())
            genders |= dict.fromkeys(words, gender) if gender else {}
            gender = next((genders[w] for w in words if w in genders), "")
        if (kind, entity, gender) not in given:
            given[kind, entity, gender] = surrogates.person(entity, gender) if kind == "person" else surrogates.of(kind, entity)
        counts[kind] += 1
        parts += [text[at:a], given[kind, entity, gender]]
        at = b
    entities = {e for _, e, _ in given}
    return "".join([*parts, text[at:]]), counts, len({key[:2] for key in given}), sum(new in entities for new in given.values())


def _each(batches: Iterator[pa.RecordBatch], at: int, key: bytes, build) -> Iterator[pa.RecordBatch]:
    surrogates = Surrogates(key)
    for batch in batches:
        yield build(batch, [None if t is None else replace(t, surrogates) for t in batch.column(at).to_pylist()])


def redact(documents: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities, n_distinct, entity_types and n_clashes of every row."""
    schema = documents.select("doc_id").schema.add("text", "string").add("n_entities", "long").add("n_distinct", "long").add("entity_types", "string").add("n_clashes", "long")

    def build(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        none = (None, Counter(), 0, 0)
        found = [x or none for x in found]
        columns = [
            pa.array([x[0] for x in found], pa.string()), pa.array([sum(x[1].values()) for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()),
            pa.array([",".join(f"{k}:{n}" for k, n in sorted(x[1].items())) for x in found], pa.string()), pa.array([x[3] for x in found], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    small_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(lean(lambda b: _each(b, 1, key, build)), schema)


def with_surrogates(documents: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """``documents`` with entities replaced in text; n_chars follows where it is a column."""
    names = documents.columns
    at = names.index("text")

    def build(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        columns = list(batch.columns)
        columns[at] = pa.array([None if x is None else x[0] for x in found], columns[at].type)
        if "n_chars" in names:
            i = names.index("n_chars")
            columns[i] = pa.array([n if x is None else len(x[0]) for x, n in zip(found, columns[i].to_pylist(), strict=True)], columns[i].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(documents.sparkSession)
    return documents.mapInArrow(lean(lambda b: _each(b, at, key, build)), T.StructType(documents.schema.fields))
