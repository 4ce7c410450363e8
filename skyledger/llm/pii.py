"""Personal data replaced by surrogates that look like it.

E-mail addresses, telephone numbers, card numbers, account numbers, network
addresses, secrets and names after a title or with a listed given name are found in the whole text. Each is
read as a number in the mixed radix its own shape spans (digit by digit, vowel
by vowel, consonant by consonant, hex by hex) and moved to its successor on a
keyed cycle of that space: a Feistel permutation, one step, and back. So

* the replacement has the same length, case, script, separators and checksum
  state, and a given name of a listed gender becomes another of that gender;
* the same entity becomes the same surrogate everywhere under one key
  (coreference), without a table that grows with the corpus, and however it is
  written: what moves is the address in lower case, the digits of a number
  without its separators, each word of a name by itself; the mention's own
  spacing and case are laid over the result. A person named once is also found
  without title later in the text;
* two entities never share a surrogate and none keeps its value, because a
  cycle is a bijection without fixed points. ``collisions`` checks that over a
  whole corpus, and each task checks what it has replaced;
* nobody without the key can go back. It comes from the session's setting
  ``KEY_SETTING``; where that is unset, the session draws one at random.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.common import aside, process_cache, table

#: setting that holds the secret key; without it a session draws one of its own
KEY_SETTING = "spark.skyledger.surrogateKey"
ROUNDS = 8

#: given names that mark a gender
WOMEN = "Anna Maria Sofia Laura Julia Emma Clara Elena Lucia Marta Sarah Linda Susan Karen Nancy Helen Claire Camille Juliette Ingrid".split()
MEN = "John James Robert Michael David Thomas Peter Paul Martin Daniel Carlos Miguel Pedro Pierre Antoine Hans Klaus Stefan Jorge Louis".split()
TITLES = "Mr Mrs Ms Miss Mister Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Don Doña".split()

#: letters told apart so that a surrogate stays pronounceable; ``wide_classes`` has all others
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
SCRIPTS = (
    "áéíóúàèìòùâêîôûäëïöü",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
)

FOLDED = frozenset(VOWELS + CONSONANTS + SCRIPTS[0] + SCRIPTS[2])

EMAIL = re.compile(r"(?<![\w.+-])[^\W_][\w.+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
SECRET = re.compile(r"(?i)\b(?:api[_-]?key|secret(?:[_-]?key)?|token|password|passwd|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{8,}={0,2})")
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-")
ACCESS_KEY = re.compile(r"\b(?:AKIA|ASIA|AIza|ghp_|gho_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,}")
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADDRESS = re.compile(rf"(?<![\d.])(?:{_BYTE}\.){{3}}{_BYTE}(?!\d|\.\d)")
_PADDED = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
PADDED = re.compile(rf"(?<![\d.])(?:{_PADDED}\.){{3}}{_PADDED}(?!\d|\.\d)")
ACCOUNT = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
CARD = re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])")
SOCIAL = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w])|(?<![\w.])\+\d{7,15}(?!\w)")
#: + or trunk 0 and groups of any size, counted by ``is_dialled``; then national numbers without either
DIALLED = re.compile(r"(?<![\w.+/,:=-])(?:\+ ?|(?=\(?00?[1-9]))\(?\d+\)?(?:(?: [/-] |[ ./-])?\(\d+\)\d*|(?: [/-] |[ ./-])\d+)*(?!\w|[.,:/-]\d)")
NATIONAL = re.compile(r"(?<![\w.+/,:=-])(?:[6-9]\d\d(?:[ .-]\d\d){3}|[89]\d[ .-]\d{3}(?:[ .-]\d\d){2}|[2-9]\d{9}|[67]\d{8})(?!\w|[.,:/-]\d)")
DATE = re.compile(r"\d\d?([./ -])\d\d?\1\d{4}")
NAME = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.? ([^\W\d_][^\W\d_'-]+(?: [^\W\d_a-zß-ÿ][^\W\d_'-]+)?)")
#: a given name without a title; ``entities`` looks for the capital
GIVEN = re.compile(r"\b((?:" + "|".join(WOMEN + MEN) + r") [^\W\d_]+(?:['’-][^\W\d_]+)*)")
#: in this order an entity keeps the places it has taken
PATTERNS = (("email", EMAIL), ("secret", SECRET), ("access", ACCESS_KEY), ("ip", ADDRESS), ("padded", PADDED), ("account", ACCOUNT), ("card", CARD), ("social", SOCIAL), ("phone", PHONE), ("phone", DIALLED), ("phone", NATIONAL), ("name", NAME), ("name", GIVEN))


def _classes() -> dict[str, tuple[str, int]]:
    out = {}
    for chars in ("0123456789", VOWELS, CONSONANTS, VOWELS.upper(), CONSONANTS.upper(), *SCRIPTS, *(s.upper() for s in SCRIPTS)):
        for k, c in enumerate(chars):
            out[c] = (chars, k)
    return out


CLASSES = _classes()


def wide_classes() -> dict[str, tuple[str, int]]:
    """Classes of all other letters and digits by script, category and neighbourhood, built once in each process that needs them."""
    known = process_cache()
    if "wide_classes" not in known:
        groups: dict[tuple, list[str]] = {}
        for code in range(128, 0x110000):
            c = chr(code)
            if c.isalnum() and c not in CLASSES:
                script, category = unicodedata.name(c, "OTHER").split()[0], unicodedata.category(c)
                near = unicodedata.name(c).rpartition(" ")[0] if category == "Nd" else code >> (7 if script in ("LATIN", "GREEK", "CYRILLIC") else 12)
                groups.setdefault((script, category, near), []).append(c)
        lone = [c for chars in groups.values() if len(chars) < 2 for c in chars]
        whole = ["".join(chars) for chars in (*groups.values(), lone) if len(chars) > 1]
        known["wide_classes"] = {c: (chars, k) for chars in whole for k, c in enumerate(chars)}
    return known["wide_classes"]


HEX = {c: ("0123456789abcdef", k) for k, c in enumerate("0123456789abcdef")}


def hexadecimal(value: str) -> str:
    """lower (or digits only), upper, or nothing."""
    if len(value) < 16 or not all(c in HEX for c in value.lower()):
        return ""
    return "lower" if value == value.lower() else "upper" if value == value.upper() else ""


def secret_key(spark: SparkSession) -> str:
    """The key of the session: from its setting, or drawn at random once and kept there, so that a session's results agree."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def laid(chars: str, value: str) -> str:
    """``chars`` in the places of the letters and digits of ``value``; the rest of ``value`` stays."""
    rest, out = iter(chars), []
    for c in value:
        out.append(next(rest) if c.isalnum() else c)
    return "".join(out)


def folded(value: str) -> str:
    """Lower case in Latin and Cyrillic script, where every letter of a class has one capital; other scripts keep their case apart."""
    return "".join(low if (low := c.lower()) in FOLDED else c for c in value)


class Surrogates:
    """Surrogates under one key; what it has made is kept while a task runs."""

    def __init__(self, key: str, most: int = 100_000):
        self.key, self.most = key.encode(), most
        self.made: dict[tuple[str, str], str] = {}
        self.back: dict[tuple[str, str], str] = {}

    def _digest(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")

    def _feistel(self, x: int, n: int, tweak: str, forward: bool) -> int:
        """Keyed permutation of 0..n-1: a Feistel network over the next square, walked until it is inside."""
        side = 1
        while side * side < n:
            side *= 2
        while True:
            a, b = divmod(x, side)
            for r in range(ROUNDS) if forward else reversed(range(ROUNDS)):
                if forward:
                    a, b = b, (a + self._digest(tweak, n, r, b)) % side
                else:
                    a, b = (b - self._digest(tweak, n, r, a)) % side, a
            x = a * side + b
            if x < n:
                return x

    def step(self, x: int, n: int, tweak: str) -> int:
        """The next of x on a keyed cycle through all of 0..n-1: never x itself."""
        if n < 2:
            raise ValueError("a space of one member has no surrogate")
        return self._feistel((self._feistel(x, n, tweak, True) + 1) % n, n, tweak, False)

    def shaped(self, value: str, tweak: str, classes: dict[str, tuple[str, int]] = CLASSES, fixed: frozenset[int] = frozenset()) -> str:
        """Every character that has a class moves inside it; the rest is the shape."""
        if any(c not in classes and c.isalnum() for c in value):
            classes = classes | {c: wide_classes()[c] for c in value if c not in classes and c.isalnum()}
        at = [k for k, c in enumerate(value) if c in classes and k not in fixed]
        number, size = 0, 1
        for k in at:
            chars, place = classes[value[k]]
            number = number * len(chars) + place
            size *= len(chars)
        shape = "".join(classes[c][0][0] if c in classes and k not in fixed else c for k, c in enumerate(value))
        number = self.step(number, size, f"{tweak}:{shape}")
        out = list(value)
        for k in reversed(at):
            chars = classes[value[k]][0]
            number, place = divmod(number, len(chars))
            out[k] = chars[place]
        return "".join(out)

    def of(self, kind: str, value: str) -> str:
        """The surrogate of an entity; raises if two entities of a kind ever met in one."""
        got = self.made.get((kind, value))
        if got is None:
            got = getattr(self, f"_{kind}")(value)
            if self.back.setdefault((kind, got), value) != value:
                raise ValueError(f"two entities of kind {kind} share a surrogate")
            if len(self.made) >= self.most:
                self.made.clear(), self.back.clear()
            self.made[kind, value] = got
            self.back[kind, got] = value
        return got

    def _email(self, value: str) -> str:
        """User and domain move, the last label (the kind of domain) stays; one address in any case has one surrogate, in that case."""
        low = folded(value)
        out = self.shaped(low, "email", fixed=frozenset(range(low.rindex("."), len(low))))
        return "".join(n.upper() if c.isupper() and folded(n.upper()) == n else n for c, n in zip(value, out))

    def _secret(self, value: str) -> str:
        """Hexadecimal stays so, in its case; nothing else becomes hexadecimal, so the spaces stay apart."""
        kind = hexadecimal(value)
        if kind == "upper":
            out = self.shaped(value.lower(), "secret-upper", HEX)
            while out.isdigit():
                out = self.shaped(out, "secret-upper", HEX)
            return out.upper()
        if kind == "lower":
            return self.shaped(value, "secret-lower", HEX)
        out = self.shaped(value, "secret")
        while hexadecimal(out):
            out = self.shaped(out, "secret")
        return out

    def _access(self, value: str) -> str:
        """The prefix names the service and stays."""
        return self.shaped(value, "access", fixed=frozenset(range(4 if value[2] != "-" else 3)))

    def _ip(self, value: str) -> str:
        """The four numbers as one of 32 bits."""
        number = 0
        for part in value.split("."):
            number = number * 256 + int(part)
        number = self.step(number, 1 << 32, "ip")
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))

    def _padded(self, value: str) -> str:
        """Addresses with leading zeros keep the width of their numbers."""
        return self.shaped(value, "padded")

    def _account(self, value: str) -> str:
        """However it is spaced; the country stays."""
        return laid(self.shaped(value.replace(" ", ""), "account", fixed=frozenset((0, 1))), value)

    def _card(self, value: str) -> str:
        """However it is spaced: all digits but the last move, and the last keeps its distance from the checksum."""
        digits = "".join(c for c in value if c.isdigit())
        body, end = digits[:-1], digits[-1]
        out = self.shaped(body, "card")
        shift = int(end) - check_digit(body)
        # in the digits of its own script
        return laid(out + chr(ord(end) - int(end) + (check_digit(out) + shift) % 10), value)

    def _social(self, value: str) -> str:
        return self.shaped(value, "social")

    def _phone(self, value: str) -> str:
        """The country code and trunk zeros stay; the national number moves alike however it is written.

        National numbers of one length and no leading zero are one space.
        """
        code = re.match(r"\+ ?\d{1,3}(?=[ .(/-])", value)
        at = [k for k, c in enumerate(value) if c.isdigit() and k >= (code.end() if code else 0)]
        while len(at) > 1 and int(value[at[0]]) == 0:
            at = at[1:]
        least = 10 ** (len(at) - 1) if int(value[at[0]]) else 0
        number = int("".join(str(int(value[k])) for k in at)) - least
        moved = str(self.step(number, 10 ** len(at) - least, f"phone:{len(at)}:{least}") + least).zfill(len(at))
        out = list(value)
        for k, d in zip(at, moved):
            out[k] = chr(ord(value[k]) - int(value[k]) + int(d))
        return "".join(out)

    def _name(self, value: str) -> str:
        """Word by word, so that a family name alone is the one it was beside a given name; listed given names keep their gender."""
        given, gap, family = value.partition(" ")
        for names in (WOMEN, MEN):
            if given in names:
                given = names[self.step(names.index(given), len(names), f"given:{len(names)}:{names[0]}")]
                break
        else:
            given = self._letters(given)
        return given + gap + " ".join(self._letters(w) if any(map(str.isalnum, w)) else w for w in family.split(" "))

    def _letters(self, value: str) -> str:
        low = folded(value)
        out = self.shaped(low, "name")
        # a listed name must not arise from letters: walk on along the cycle
        while out.capitalize() in WOMEN + MEN:
            out = self.shaped(out, "name")
        return "".join(n.upper() if c.isupper() and folded(n.upper()) == n else n for c, n in zip(value, out))


def check_digit(digits: str) -> int:
    """Luhn's check digit of what stands before it; other characters do not count."""
    total = 0
    for k, c in enumerate(reversed([c for c in digits if c.isdigit()])):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def is_dialled(value: str) -> bool:
    """7 to 15 digits that are neither a date nor a signed decimal."""
    return 7 <= sum(c.isdigit() for c in value) <= 15 and not DATE.fullmatch(value) and not re.fullmatch(r"\+ ?\d+\.\d+", value)


_DIGIT = re.compile(r"\d")


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of what is found in the whole text, in order, without overlaps."""
    if not text:
        return []
    has_digit, found = _DIGIT.search(text) is not None, []
    # what a kind cannot do without is looked for first
    absent = set() if has_digit else {"ip", "padded", "account", "card", "social", "phone"}
    if "@" not in text:
        absent.add("email")
    if "=" not in text and ":" not in text:
        absent.add("secret")
    if not any(p in text for p in PREFIXES):
        absent.add("access")
    unnamed = {NAME} if not any(t in text for t in TITLES) else set()
    if not any(t in text for t in WOMEN + MEN):
        unnamed.add(GIVEN)
    for kind, pattern in PATTERNS:
        if kind in absent or pattern in unnamed:
            continue
        group = pattern.groups
        for m in pattern.finditer(text):
            a, b = m.span(group)
            # rows of dashes hold nothing to replace
            if not any(map(str.isalnum, text[a + (0 if kind != "access" else 3 if text[a + 2] == "-" else 4) : b])):
                continue
            if kind == "card" and not 13 <= sum(c.isdigit() for c in m.group()) <= 19:
                continue
            if pattern is DIALLED and not is_dialled(m.group()) or pattern is GIVEN and not m.group(1).partition(" ")[2][0].isupper():
                continue
            if all(b <= x or a >= y for x, y, _, _ in found):
                found.append((a, b, kind, text[a:b]))
    # a person who was named once is met again without title, by the whole name or a part of it
    known = {w for _, _, kind, value in found if kind == "name" for w in value.split(" ") if len(w) > 2 and w[0].isupper()}
    if known:
        words = "|".join(map(re.escape, sorted(known, key=lambda w: (-len(w), w))))
        for m in re.finditer(rf"(?<!\w)(?:{words})(?: (?:{words}))*(?!\w)", text):
            if all(m.end() <= x or m.start() >= y for x, y, _, _ in found):
                found.append((m.start(), m.end(), "name", m.group()))
    return sorted(found)


def replace(text: str | None, made: Surrogates) -> tuple[str | None, int]:
    """The text with surrogates, and how many entities it had."""
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, value in found:
        out += [text[at:a], made.of(kind, value)]
        at = b
    return "".join([*out, text[at:]]), len(found)


def surrogate(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text`` and their number in ``n_entities``; no shuffle.

    Null and empty texts stay as they are with 0 entities. Repeated rows change
    alike; an empty table gives no rows; a column of that name is replaced.
    """
    key, kept = key or secret_key(docs.sparkSession), [c for c in docs.columns if c != "n_entities"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "n_entities int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for batch in batches:
            got = [replace(t.as_py(), made) for t in batch.column(batch.schema.get_field_index(text))]
            cols = [pa.array([g[0] for g in got], pa.string()) if c == text else batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[1] for g in got], pa.int32())], [*kept, "n_entities"])

    return docs.select(kept).mapInArrow(run, schema)


def entity_table(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Distinct (kind, value, surrogate) of a corpus."""
    key = key or secret_key(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for batch in batches:
            rows = {(kind, value) for t in batch.column(0) for _, _, kind, value in entities(t.as_py())}
            rows = sorted((kind, value, made.of(kind, value)) for kind, value in rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["kind", "value", "surrogate"])

    return docs.select(text).mapInArrow(run, "kind string, value string, surrogate string").distinct()


def collisions(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Surrogates of a corpus that stand for more than one entity, or for themselves: none."""
    own = entity_table(docs, text, key)
    return own.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.max((F.col("value") == F.col("surrogate")).cast("int")).alias("same")).where("n > 1 or same > 0")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return surrogate(table(spark, folder, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: every document, with surrogates in its text and its characters counted anew."""
    inner, back = aside(docs, {"n_entities"})
    done = surrogate(inner)
    return back(done.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))
