"""PII: surrogates that keep type, format, script and gender.

Entities: e-mail addresses, phone, card, IBAN and social-security numbers, IPv4 addresses,
secrets (assigned tokens, keys and passwords, long hexadecimal strings, well-known key
formats) and names after a form of address or with a listed given name. Each is replaced by a keyed permutation of the
strings of its format: digits become digits, vowels vowels, consonants consonants, letters
stay in their script and case, separators stay. Card numbers keep whether their check digit
is right, addresses whether they are private. A given name of the lists becomes one of the
other list of its gender; another name keeps its last letter, which carries gender in many
languages.

A permutation maps different originals of one format to different surrogates, in all
documents alike, without any exchange between tasks: the same entity always receives the
same surrogate (coreference), and two entities never share one. Names and addresses agree in any
case, numbers whatever separates their digits. Permutations are single
cycles, so that no string of two or more of a format is its own surrogate, and there is no
second try that would depend on the text. A surrogate may spell like another original of the
text (which is replaced as well); such cases are counted.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_KEY = "change-me"

# fixed values: forms of address by gender
MALE = "Mr Mister Sir Herr Monsieur Señor Sr Don Господин".split()
FEMALE = "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Señorita Doña Госпожа".split()
OTHER = "Dr Prof Professor".split()
# fixed values: given names by gender
GIVEN = {
    "m": "Adam Alexander Andreas Antonio Carlos Charles Daniel David Diego Eric Felix Francisco George Hans Henri Hugo Jack James Jean John Jorge José Juan Julien Karl Lars Louis Luis Manuel Mark Martin Michael Miguel Nicolas Oliver Paul Pedro Peter Philippe Pierre Rafael Richard Robert Samuel Stefan Thomas Walter William".split(),
    "f": "Alice Amelia Ana Anna Barbara Beatriz Camille Carmen Caroline Chloe Clara Claire Elena Elisabeth Ella Emily Emma Eva Grace Hannah Helga Ingrid Isabel Jane Julia Karen Katharina Laura Léa Lena Linda Lucia Lucy Manon Margaret Maria Marie Marta Mary Monika Olivia Patricia Petra Rosa Sarah Sofia Sophie Susan Ursula".split(),
}

# fixed values: seldom given names; a name of GIVEN becomes one of these, and the reverse
SPARE = {
    "m": "Absalom Adelmar Alaric Ambrose Anselm Archibald Balduin Barnaby Bertrand Caspian Clodoaldo Cuthbert Cyprian Dagobert Demetrio Eberhard Eleazar Emeric Eustace Evaristo Fulgencio Gaspard Gerwin Godfrey Gottlieb Hadrian Hartmut Hildebert Horatio Ignatius Isidor Jasper Joachim Leander Leocadio Lothar Ludovic Marcellin Melchior Meinrad Mortimer Octavian Osbert Osvaldo Percival Quentin Raimund Rodolfo".split(),
    "f": "Adelheid Agatha Albertina Althea Anastasia Apollonia Araminta Aurelia Balbina Bernadette Brunhilde Calliope Cassandra Celestina Clementine Clotilde Cordelia Cressida Delphine Demetria Dorothea Edeltraud Eleonora Ernestine Esmeralda Euphemia Eustacia Felicitas Fiorella Florentine Gertrude Gisela Griselda Guadalupe Gwendolen Hermione Hildegard Hortense Imogen Jacinta Josephine Leocadia Leopoldine Ludmilla Magdalena Mathilda Melisande Millicent Octavia".split(),
}
LISTS = {g: (names, SPARE[g]) for g, names in GIVEN.items()}
GIVEN = {g: [*a, *b] for g, (a, b) in LISTS.items()}
_GENDER = {name: g for g, names in GIVEN.items() for name in names}

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
_SETS = [
    "0123456789", _VOWELS, _CONSONANTS, _VOWELS.upper(), _CONSONANTS.upper(),
    "áàâãäåæéèêëíìîïóòôõöøúùûü", "ÁÀÂÃÄÅÆÉÈÊËÍÌÎÏÓÒÔÕÖØÚÙÛÜ", "çñýß", "ÇÑÝ",
    "".join(map(chr, range(0x3B1, 0x3CA))), "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))),
    "".join(map(chr, range(0x5D0, 0x5EB))), "".join(map(chr, range(0x627, 0x64B))),
]
_PLACE = {c: (s, i) for s in _SETS for i, c in enumerate(s)}
_HEX = {c: ("0123456789abcdef", i) for i, c in enumerate("0123456789abcdef")}
_ALNUM = {c: (s, i) for s in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for i, c in enumerate(s)}
_CJK = (0x4E00, 0x9FA6)

_ADDRESS = "|".join(sorted(MALE + FEMALE + OTHER, key=len, reverse=True))
_NAME_WORD = r"[^\W\d_a-zß-öø-ÿ][\w'’\-]*"
_NAME = re.compile(rf"\b({_ADDRESS})(\.?[  ])({_NAME_WORD}(?:[  ]{_NAME_WORD}){{0,2}})")
_ADDRESSES = MALE + FEMALE + OTHER
_CAPITAL = re.compile(r"[A-Z]\w+")
_NO_BLANK = re.compile(r"[^ \xa0]+")
_ANY_GIVEN = "|".join(sorted(_GENDER, key=len, reverse=True))
_FULL_NAME = re.compile(rf"\b((?:{_ANY_GIVEN})(?:[ \xa0](?:{_ANY_GIVEN}))*)[ \xa0]({_NAME_WORD})")
_EMAIL = re.compile(r"[\w.%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_SECRET = re.compile(
    r"""(?P<assigned>(?i:token|passwd|password|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)["']?\s*[:=]\s*["']?)(?P<value>[A-Za-z0-9_\-/+=.]{8,})"""
    r"|(?P<known>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9\-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[\w\-]+\.[\w\-]+\.[\w\-]+)\b)"
    r"|(?P<hex>\b[0-9a-f]{32,128}\b)"
)
_SECRET_HINTS = ("token", "passw", "pwd", "secret", "key", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "eyj")
_LONG_HEX = re.compile("[0-9a-f]{32}")
#: A cheap search for runs that may hold a number; only in them the formats are told apart.
_RUN = re.compile(r"\d[\d .()\-]{5,}")
_NUMBER = re.compile(
    r"(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<card>(?<![\d.])\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}(?!\d|\.\d))"
    r"|(?P<phone>(?:(?:\+|\b00)\d{1,3}[ .\-]?)?(?:\(\d{1,5}\)[ .\-]?)\d{2,5}(?:[ .\-]?\d{2,5}){0,4}(?!\d|\.\d)"
    r"|(?:\+|\b00)\d{1,3}[ .\-]?\d{1,5}(?:[ .\-]?\d{2,5}){1,5}(?!\d|\.\d)|(?<![\d.\-/])\d{3}[ .\-]\d{3,4}[ .\-]\d{4}(?![\d\-]))"
)
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_DIGITS = re.compile(r"\d")
# fixed values: international dialling codes of one and of two digits; all others have three
_ONE = {"1", "7"}
_TWO = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _dialling(digits: str) -> int:
    """Digits of the dialling code at the head of an international number."""
    return 1 if digits[:1] in _ONE else 2 if digits[:2] in _TWO else 3


def _like(text: str, model: str) -> str:
    """``text`` (in lower case) in the case of ``model``: letter by letter if both are as long."""
    if len(text) == len(model):
        return "".join(c.upper() if m.isupper() and len(c.upper()) == 1 else c for c, m in zip(text, model, strict=True))
    return text.upper() if model.isupper() and len(model) > 1 else text if model.islower() else text[:1].upper() + text[1:]


class Permuter:
    """Keyed permutations of the strings of a format (a Feistel network with cycle walking)."""

    def __init__(self, key: str):
        self.key = key.encode()
        self.word = lru_cache(100_000)(self._word)

    def _round(self, n: int, size: int, tag: bytes) -> int:
        need, out, i = (size + 7) // 8, b"", 0
        while len(out) < need:
            out += hmac.new(self.key, tag + b"|%d|%d" % (i, n), hashlib.sha256).digest()
            i += 1
        return int.from_bytes(out[:need], "big") & ((1 << size) - 1)

    def number(self, x: int, n: int, tag: str) -> int:
        """The image of x under a permutation of 0..n-1 that is a single cycle: x itself only if n is 1."""
        if n < 2:
            return x
        y = (self._walk(x, n, tag) + 1) % n
        return self._walk(y, n, tag, back=True)

    def _walk(self, x: int, n: int, tag: str, back: bool = False) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for r in reversed(range(8)) if back else range(8):
                f = self._round(left if back else right, half, f"{tag}|{n}|{r}".encode())
                left, right = (right ^ f, left) if back else (right, left ^ f)
            x = left << half | right
            if x < n:
                return x

    def _word(self, text: str, tag: str, sets: str = "letters") -> str:
        """The image of a string; characters outside the sets, and their places, stay."""
        places = {"hex": _HEX, "alnum": _ALNUM, "letters": _PLACE}[sets]
        found, x, n = [], 0, 1
        for c in text:
            p = places.get(c)
            if p is None and sets == "letters" and _CJK[0] <= ord(c) < _CJK[1]:
                p = (range(*_CJK), ord(c) - _CJK[0])
            found.append(p)
            if p:
                x, n = x * len(p[0]) + p[1], n * len(p[0])
        form = hashlib.sha256("".join("." if p is None else str(len(p[0])) for p in found).encode()).hexdigest()
        x = self.number(x, n, f"{tag}|{form}")
        out = []
        for c, p in zip(reversed(text), reversed(found), strict=True):
            if p is None:
                out.append(c)
            else:
                x, i = divmod(x, len(p[0]))
                out.append(chr(p[0][i]) if isinstance(p[0], range) else p[0][i])
        return "".join(reversed(out))

    def digits(self, text: str, tag: str, keep: int, valid) -> str:
        """Digits of ``text`` after the first ``keep``, permuted until ``valid(digits)``; the rest stays."""
        own = [i for i, c in enumerate(text) if c.isdigit() and c.isascii()]
        number = "".join(text[i] for i in own)
        head, tail = number[:keep], number[keep:]
        while True:
            tail = self._word(tail, f"{tag}|{head}")
            if valid(head + tail):
                break
        out = list(text)
        for i, c in zip(own, head + tail, strict=True):
            out[i] = c
        return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _private(octets: list[int]) -> bool:
    return octets[0] in (10, 127) or octets[:2] == [192, 168] or (octets[0] == 172 and 16 <= octets[1] < 32)


class Surrogates:
    """Replaces the entities of one text at a time."""

    def __init__(self, key: str = DEFAULT_KEY):
        self.permuter = Permuter(key)

    def _of(self, kind: str, text: str) -> str:
        own = self._image(kind, text)
        if own != text:
            return own
        # a format of one string, such as letters of no set: a name made from the keyed digest
        digest = hmac.new(self.permuter.key, f"{kind.split('_')[0]}|{text}".encode(), hashlib.sha256).hexdigest()[:16]
        return "X" + digest.translate(str.maketrans("0123456789", "ghijklmnop"))

    def _image(self, kind: str, text: str) -> str:
        p = self.permuter
        if kind == "email":
            low = text.lower() if len(text.lower()) == len(text) else text
            local, _, domain = low.rpartition("@")
            name, _, top = domain.rpartition(".")
            return _like(p.word(local + "@" + name, "email", "letters") + "." + top, text)
        if kind == "ip":
            octets = [int(x) for x in text.split(".")]
            x = int.from_bytes(bytes(octets), "big")
            while True:
                x = p.number(x, 1 << 32, "ip")
                if _private(list(x.to_bytes(4, "big"))) == _private(octets) and bool(x >> 24) == bool(octets[0]):
                    break
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "card":
            good = luhn("".join(c for c in text if c.isdigit()))
            return p.digits(text, "card", 1, lambda d: luhn(d) == good)
        if kind == "ssn":
            plain = not re.match("000|666|9", text)
            return p.digits(text, "ssn", 0, lambda d: bool(re.match("000|666|9", d)) != plain)
        if kind == "phone":
            if text.startswith("00"):
                return "00" + self._image(kind, "+" + text[2:])[1:]
            digits = "".join(c for c in text if c.isdigit())
            country = _dialling(digits) if text.startswith("+") else 0
            zero = digits[country : country + 1] == "0"
            return p.digits(text, "phone", country, lambda d: (d[country : country + 1] == "0") == zero)
        if kind == "iban":
            return text[:2] + p.word(text[2:], "iban", "alnum")
        if kind == "secret":
            return p.word(text, "secret", "hex" if re.fullmatch("[0-9a-f]+", text) else "alnum")
        # names agree in any case
        title = text[:1].upper() + text[1:].lower()
        if title in _GENDER:
            g = _GENDER[title]
            for names, others in (LISTS[g], LISTS[g][::-1]):
                if title in names:
                    return _like(others[p.number(names.index(title), len(names), f"given|{g}|{names[0]}")].lower(), text)
        word = text.lower() if len(text.lower()) == len(text) else text
        while True:  # past the given names, which are images of each other
            word = p.word(word, "name", "letters") if len(word) < 4 else p.word(word[:-1], f"name|{word[-1]}", "letters") + word[-1]
            if word[:1].upper() + word[1:] not in _GENDER:
                return _like(word, text)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the entities, in order, without overlaps."""
        spans: list[tuple[int, int, str]] = []
        if "@" in text:
            spans += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
        digits = _DIGITS.search(text) is not None
        low = text.lower()
        if any(h in low for h in _SECRET_HINTS) or (digits and _LONG_HEX.search(text)):
            for m in _SECRET.finditer(text):
                spans.append((*(m.span("value") if m["value"] else m.span()), "secret"))
        if digits:
            done = 0
            for run in _RUN.finditer(text):
                for m in _NUMBER.finditer(text, max(done, run.start() - 2), run.end()):
                    kind = m.lastgroup
                    done = m.end()
                    if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                        continue
                    if kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                        continue
                    spans.append((*m.span(), kind))
            spans += [(*m.span(), "iban") for m in _IBAN.finditer(text) if not text[: m.start()][-1:].isalnum()]
        if any(a in text for a in _ADDRESSES):
            for m in _NAME.finditer(text):
                g = "m" if m[1] in MALE else "f" if m[1] in FEMALE else "o"
                at = m.start(3)
                words = re.split(r"[  ]", m[3])
                spans += [(at + (o := sum(len(w) + 1 for w in words[:i])), at + o + len(w), f"name_{g}") for i, w in enumerate(words)]
        if not _GENDER.keys().isdisjoint(_CAPITAL.findall(text)):
            for m in _FULL_NAME.finditer(text):
                g = _GENDER[re.split(r"[ \xa0]", m[1])[0]]
                spans += [(w.start(), w.end(), f"name_{g}") for w in _NO_BLANK.finditer(text, m.start(), m.end())]
        spans.sort(key=lambda s: (s[0], -s[1]))
        out: list[tuple[int, int, str]] = []
        for s in spans:
            if not out or s[0] >= out[-1][1]:
                out.append(s)
        names = {text[a:b]: k for a, b, k in out if k.startswith("name")}
        if names:  # the same name without a form of address
            taken = iter([*out, (len(text) + 1, len(text) + 1, "")])
            now = next(taken)
            more = []
            for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b", text):
                while now[1] <= m.start():
                    now = next(taken)
                if m.end() <= now[0]:
                    more.append((*m.span(), names[m[0]]))
            out = sorted(out + more)
        return out

    def replace(self, text: str) -> tuple[str, dict[str, int], int]:
        """The text with surrogates, entities by type, and surrogates that spell like an original of the text."""
        spans = self.find(text)
        if not spans:
            return text, {}, 0
        given: dict[str, str] = {}
        counts: dict[str, int] = {}
        pieces, last = [], 0
        for a, b, kind in spans:
            own = text[a:b]
            if own not in given:
                given[own] = self._of(kind, own)
            counts[kind.split("_")[0]] = counts.get(kind.split("_")[0], 0) + 1
            pieces += [text[last:a], given[own]]
            last = b
        pieces.append(text[last:])
        return "".join(pieces), counts, sum(s in given for s in given.values())


TYPES = ["email", "phone", "ip", "card", "ssn", "iban", "secret", "name"]
_OUT = "doc_id long, text string, n_entities long, " + ", ".join(f"n_{t} long" for t in TYPES) + ", n_collisions long"


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text with surrogates, and counts of entities by type.

    A null text stays null with counts 0. Repeated rows and null ids are handled row by
    row. Other columns are not read. There is no shuffle; the whole text is searched, however
    long it is. An empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            texts, rows = [], []
            for t in batch.column(1).to_pylist():
                text, counts, collisions = (t, {}, 0) if t is None else surrogates.replace(t)
                texts.append(text)
                rows.append([sum(counts.values()), *(counts.get(k, 0) for k in TYPES), collisions])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(TYPES) + 2)
            names = ["n_entities", *(f"n_{k}" for k in TYPES), "n_collisions"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "text", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, _OUT)


def replace_in(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with surrogates in ``text_col``; ``size_col``, if there is one, is counted anew."""
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            texts = [t if t is None else surrogates.replace(t)[0] for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(work, docs.schema)
    if size_col and size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return out
