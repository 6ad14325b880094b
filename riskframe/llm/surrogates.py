"""Surrogates for personal data, by DataFrame functions alone.

One pattern finds the entities of a text in order; the text is cut at them and joined again with a
surrogate in the place of each.  A surrogate keeps its entity's kind and format: letters stay letters
of their script and case (in names vowels stay vowels, and the title and the last letter, which mark
gender, stay), digits stay digits, separators stay; numbers that pass their check digits (cards, IBANs)
still do; addresses stay valid, and private, loopback and public ones stay what they are.

Spellings of one entity share a surrogate: the digits of a phone, card or account number are permuted
without their separators, an e-mail address in lower case, and the spelling is put on again.  A person
is found behind a title; every later or earlier mention of one of the person's names in the same text,
with or without the title, becomes the same surrogate name.

What varies is permuted by a keyed Feistel network: in each of ``ROUNDS`` rounds one half of the
string is shifted, character by character inside its own alphabet, by a SHA-256 of the key and the
other half.  A permutation never maps two entities to one, and maps an entity to the same surrogate in
every document, so distinctness and coreference need no table of entities, no join and no shuffle.
``checked`` verifies both over all entities found, and that no surrogate is its entity.

Defined results: a null text stays null and has no entities; a text without entities stays as it is;
repeated rows and equal entities get equal surrogates; empty tables give no rows; other columns stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import materialised

ROUNDS = 4

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = (
    r"(?:Mrs|Mr|Ms|Miss|Mister|Doctor|Dr|Professor|Prof|Sir|Dame|Herr|Herrn|Frau|Monsieur|Madame|Mme|Mlle|Señora|Señorita|Señor|Sra|Sr"
    r"|господин|госпожа|г-н|г-жа|κύριος|κυρία)"
)
_NAME = r"\p{Lu}[\p{L}\p{M}'’-]{1,40}"
_LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"

#: Kind and pattern, in order of precedence.  Repetitions are bounded or of a single class, so that
#: very long words cost no more than their length; secrets have no longest length.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("secret", rf"(?<![A-Za-z0-9]){_LABEL}[^\s\"',;]{{4,}}+"),
    ("key", r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9_])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"),
    ("phone", r"(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"),
    ("phone", r"(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.-])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d-])"),
    ("person", rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.? {_NAME}(?: {_NAME}){{0,2}}"),
)
ANY = "|".join(p for _, p in PATTERNS)
#: Around a name that was found before.
_ALONE = (r"(?<![\p{L}\p{M}\p{N}])(?:", r")(?![\p{L}\p{M}\p{N}])")

#: Alphabets that characters are shifted inside of.  In names, vowels and consonants are apart.
_DIGITS = ("0123456789",)
#: Latin, Greek and Cyrillic letters beyond the plain ones.
_FURTHER = (
    [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)],
    [*range(0x386, 0x391), *range(0x3AA, 0x3B1), *range(0x3CA, 0x3CF)],
    [*range(0x400, 0x410), *range(0x450, 0x460), *range(0x490, 0x4C0)],
)
_LETTERS = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    *("".join(map(chr, r)) for r in (range(0x3B1, 0x3CA), range(0x391, 0x3A2), range(0x430, 0x450), range(0x410, 0x430))),
    *("".join(c for c in map(chr, r) if test(c)) for r in _FURTHER for test in (str.islower, str.isupper)),
)
_VOWELS = "aeiouαεηιουωаеиоуыэюя"


def _name_alphabets() -> tuple[str, ...]:
    """Vowels and consonants of every alphabet, a letter with marks going with the letter below them."""
    out = []
    for letters in _LETTERS:
        vowel = [unicodedata.normalize("NFD", c)[0].lower() in _VOWELS for c in letters]
        out += ["".join(c for c, v in zip(letters, vowel) if v == want) for want in (True, False)]
    return tuple(a for a in out if len(a) > 1)


_NAMES = _name_alphabets()
_HEX = ("0123456789", "abcdef")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def _shifted(part: Column, other: Column, turn: Column, key: str, alphabets: Sequence[str]) -> Column:
    def moved(c: Column, by: Column) -> Column:
        out = c
        for alphabet in alphabets:
            at = F.instr(F.lit(alphabet), c)
            place = F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1
            out = F.when(at > 0, F.substring(F.lit(alphabet), place.cast("int"), F.lit(1))).otherwise(out)
        return out

    def body(stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            pair = F.substring(stream, (i % 32) * 2 + 1, F.lit(2))
            return moved(c, _number(pair))

        return F.array_join(F.transform(F.split(part, ""), one), "")

    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), turn.cast("string"), other).cast("binary"), 256)
    return F.when(F.length(part) == 0, part).otherwise(_let(seed, body))


def permuted(text: Column, key: str, alphabets: Sequence[str]) -> Column:
    """A keyed permutation of the strings that have their characters of each alphabet in the same places."""

    def network(whole: Column) -> Column:
        half = F.floor(F.length(whole) / 2).cast("int")
        first = F.struct(
            F.substring(whole, F.lit(1), half).alias("l"),
            F.substring(whole, half + 1, F.length(whole)).alias("r"),
        )

        def turn(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            left = F.when(even, _shifted(s["l"], s["r"], i, key, alphabets)).otherwise(s["l"])
            right = F.when(even, s["r"]).otherwise(_shifted(s["r"], s["l"], i, key, alphabets))
            return F.struct(left.alias("l"), right.alias("r"))

        turns = F.array(*[F.lit(i) for i in range(ROUNDS)])
        turned = F.aggregate(turns, first, turn, lambda s: F.concat(s["l"], s["r"]))
        return F.when(F.length(whole) == 1, _other(whole, key, alphabets)).otherwise(turned)

    return _let(text, network)


def _other(c: Column, key: str, alphabets: Sequence[str]) -> Column:
    """Another character of the alphabet: one that varies alone is never shifted by nothing."""
    by = _number(F.substring(F.sha2(F.lit(key).cast("binary"), 256), 1, 4))
    out = c
    for alphabet in alphabets:
        at = F.instr(F.lit(alphabet), c)
        step = 1 + F.pmod(by, F.lit(len(alphabet) - 1))
        place = F.pmod(at - 1 + step, F.lit(len(alphabet))) + 1
        out = F.when(at > 0, F.substring(F.lit(alphabet), place.cast("int"), F.lit(1))).otherwise(out)
    return out


def _respelt(e: Column, new: Column, part: str) -> Column:
    """The characters of ``new`` in the places of those of ``e`` that match ``part``; the others stay."""

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(e, F.lit(1), i), f"[^{part}]", ""))
        return F.when(c.rlike(f"[{part}]"), F.substring(new, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(e, ""), one), "")


def _recased(e: Column, new: Column) -> Column:
    """``new`` with capitals where ``e`` has them."""

    def one(c: Column, i: Column) -> Column:
        own = F.substring(e, i + 1, F.lit(1))
        return F.when(own.rlike("[A-Z]"), F.upper(c)).otherwise(c)

    return F.array_join(F.transform(F.split(new, ""), one), "")


def _behind(e: Column, keep: str, key: str, alphabets: Sequence[str]) -> Column:
    """What pattern ``keep`` matches at the start stays; the rest is permuted."""
    start = F.regexp_extract(e, f"^(?:{keep})", 0)
    return F.concat(start, permuted(F.substring(e, F.length(start) + 1, F.length(e)), key, alphabets))


def _email(e: Column, key: str) -> Column:
    domain = F.substring_index(e, "@", -1)
    fixed = F.regexp_extract(domain, r"(?i)(?:example\.(?:com|net|org)|[^.]*)$", 0)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(fixed))
    alphabets = (*_DIGITS, *_LETTERS[:1])

    def part(own: Column, name: str) -> Column:
        return _recased(own, permuted(F.lower(own), f"{key}/{name}", alphabets))

    return F.concat(part(F.substring_index(e, "@", 1), "local"), F.lit("@"), part(host, "host"), fixed)


def _phone(e: Column, key: str) -> Column:
    """The first digits, two behind a plus sign, stay; how the digits are grouped does not matter."""
    kept = F.when(e.startswith("+"), 2).otherwise(1)

    def of_digits(digits: Column) -> Column:
        rest = F.substring(digits, kept + 1, F.length(digits))
        return _respelt(e, F.concat(F.substring(digits, F.lit(1), kept), permuted(rest, key, _DIGITS)), r"\d")

    return _let(F.regexp_replace(e, r"\D", ""), of_digits)


#: Networks that addresses stay inside of: first number, how many follow, and the size of each half of a host's number.
_NETWORKS = ((10 << 24, 24), (127 << 24, 24), ((172 << 24) + (16 << 16), 20), ((192 << 24) + (168 << 16), 16))
#: How often a public address is permuted on while it lands in one of them; one step does for 99 % of all.
_WALK = 8


def _ip(e: Column, key: str) -> Column:
    octets = F.split(e, r"\.")
    number = octets[0].cast("long") * (1 << 24) + octets[1].cast("long") * (1 << 16)
    number = number + octets[2].cast("long") * 256 + octets[3].cast("long")

    def turned(value: Column, bits: int) -> Column:
        half = 1 << (bits // 2)

        def turn(s: Column, i: Column) -> Column:
            def by(other: Column) -> Column:
                seed = F.concat_ws("\x1f", F.lit(f"{key}/{bits}"), i.cast("string"), other.cast("string"))
                return _number(F.substring(F.sha2(seed.cast("binary"), 256), 1, 8))

            even = i % 2 == 0
            left = F.when(even, F.pmod(s["l"] + by(s["r"]), F.lit(half))).otherwise(s["l"])
            right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + by(s["l"]), F.lit(half)))
            return F.struct(left.alias("l"), right.alias("r"))

        first = F.struct(F.floor(value / half).alias("l"), F.pmod(value, F.lit(half)).alias("r"))
        turns = F.array(*[F.lit(i) for i in range(ROUNDS)])
        return F.aggregate(turns, first, turn, lambda s: s["l"] * half + s["r"])

    def inside(value: Column, network: tuple[int, int]) -> Column:
        return value.between(network[0], network[0] + (1 << network[1]) - 1)

    def public(value: Column) -> Column:
        return ~(inside(value, _NETWORKS[0]) | inside(value, _NETWORKS[1]) | inside(value, _NETWORKS[2]) | inside(value, _NETWORKS[3]))

    def placed(value: Column) -> Column:
        steps = F.array(*[F.lit(i) for i in range(_WALK)])
        walked = F.aggregate(
            steps, turned(value, 32), lambda at, _: F.when(public(at), at).otherwise(turned(at, 32))
        )
        out = walked
        for network in _NETWORKS:
            own = F.lit(network[0]) + turned(value - network[0], network[1])
            out = F.when(inside(value, network), own).otherwise(out)
        return out

    def dotted(value: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.floor(value / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])

    return _let(_let(number, placed), dotted)


def _iban_check(country: Column, account: Column) -> Column:
    """The number of the two digits that make an IBAN of these parts valid."""

    def value(rest: Column, c: Column) -> Column:
        at = F.instr(F.lit(_LETTERS[1]), c)
        return F.when(at > 0, (rest * 100 + at + 9) % 97).otherwise((rest * 10 + c.cast("int")) % 97)

    return 98 - F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), value)


def _iban(e: Column, key: str) -> Column:
    """The country stays; the account is permuted, and the check digits stay as far from valid as they are."""

    def of_plain(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

        def finish(new: Column) -> Column:
            off = F.substring(plain, 3, 2).cast("int") - _iban_check(country, account)
            check = F.pmod(_iban_check(country, new) + off - 2, F.lit(97)) + 2
            return _respelt(e, F.concat(country, F.lpad(check.cast("string"), 2, "0"), new), "A-Z0-9")

        return _let(permuted(account, key, (*_DIGITS, _LETTERS[1])), finish)

    return _let(F.regexp_replace(e, " ", ""), of_plain)


def _check_digit(body: Column) -> Column:
    """The digit that makes ``body`` and itself a valid card number."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(
        F.transform(F.split(F.reverse(body), ""), weight), F.lit(0), lambda a, b: a + b
    )
    return F.pmod(-total, F.lit(10))


def _card(e: Column, key: str) -> Column:
    def of_digits(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)

        def finish(new: Column) -> Column:
            # How far the last digit is from the valid one stays, so valid numbers stay valid.
            off = F.substring(digits, -1, 1).cast("int") - _check_digit(body)
            return F.concat(new, F.pmod(_check_digit(new) + off, F.lit(10)).cast("string"))

        return _let(_behind(body, r"\d", key, _DIGITS), finish)

    return _respelt(e, _let(F.regexp_replace(e, r"\D", ""), of_digits), r"\d")


def _secret(e: Column, key: str) -> Column:
    label = F.regexp_extract(e, f"^{_LABEL}", 0)

    def body(value: Column) -> Column:
        anything = permuted(value, key, (*_DIGITS, *_LETTERS[:2]))
        return F.when(value.rlike("^[0-9a-f]+$"), permuted(value, f"{key}/hex", _HEX)).otherwise(anything)

    return F.concat(label, _let(F.substring(e, F.length(label) + 1, F.length(e)), body))


def _named(names: Column, key: str) -> Column:
    def word(w: Column) -> Column:
        stem = F.substring(w, F.lit(1), F.length(w) - 1)
        return F.concat(permuted(stem, key, _NAMES), F.substring(w, -1, 1))

    return F.array_join(F.transform(F.split(names, " "), word), " ")


def _person(e: Column, key: str) -> Column:
    title = F.regexp_extract(e, rf"^{_TITLE}\.? ", 0)
    return F.concat(title, _named(F.substring(e, F.length(title) + 1, F.length(e)), key))


def kind_of(e: Column) -> Column:
    """The kind of an entity; what matches no pattern is the name of a person found elsewhere in the text."""
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(e.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def surrogate(e: Column, key: str) -> Column:
    """The surrogate of one entity as ``ANY`` finds it."""
    letters = (*_DIGITS, *_LETTERS[:2])
    makers = {
        "email": _email(e, f"{key}/email"),
        "secret": _secret(e, f"{key}/secret"),
        "key": _behind(e, r"AKIA|ASIA|gh[a-z]_|sk-", f"{key}/key", letters),
        "iban": _iban(e, f"{key}/iban"),
        "ip": _ip(e, f"{key}/ip"),
        "phone": _phone(e, f"{key}/phone"),
        "ssn": _behind(e, r"\d", f"{key}/ssn", _DIGITS),
        "card": _card(e, f"{key}/card"),
        "person": _person(e, f"{key}/person"),
        "name": _named(e, f"{key}/person"),
    }

    def by_kind(kind: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, made in makers.items():
            out = F.when(kind == name, made).otherwise(out)
        return out

    return F.coalesce(_let(kind_of(e), by_kind), e)


def _names(entities: Column) -> Column:
    """The names of the persons among ``entities``, longest first, so that none hides behind its beginning."""
    behind = F.filter(entities, lambda e: e.rlike(f"^(?:{PATTERNS[-1][1]})$"))
    plain = F.transform(behind, lambda e: F.regexp_replace(e, rf"^{_TITLE}\.? ", ""))
    words = F.array_distinct(F.flatten(F.transform(plain, lambda n: F.split(n, " "))))
    sized = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("size"), w.alias("w"))))
    return F.transform(sized, lambda x: x["w"])


def _with_entities(docs: DataFrame, text: str, pattern: str, found: str) -> DataFrame:
    """Add each text's pattern and what it finds: for most the general one, and with persons their names too."""
    first = docs.withColumn(found, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    named = first.withColumn(pattern, F.when(F.size(found) > 0, _names(F.col(found))))
    alone = F.concat(F.lit(f"{ANY}|{_ALONE[0]}"), F.array_join(pattern, "|"), F.lit(_ALONE[1]))
    named = named.withColumn(pattern, F.when(F.size(pattern) > 0, alone))
    again = F.regexp_extract_all(F.col(text), F.col(pattern), F.lit(0))
    return named.withColumn(found, F.when(F.col(pattern).isNull(), F.col(found)).otherwise(again))


def _between(text: str, pattern: str) -> Column:
    return F.when(F.col(pattern).isNull(), F.split(F.col(text), ANY, -1)).otherwise(
        F.split(F.col(text), F.col(pattern), -1)
    )


def _free(df: DataFrame, name: str) -> str:
    """``name``, longer if the table has such a column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def replaced(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text; columns and rows stay."""
    pattern, found = _free(docs, "__pattern"), _free(docs, "__found")
    held = _with_entities(docs, text_col, pattern, found)
    new = F.transform(found, lambda e: surrogate(e, key))
    pieces = F.zip_with(_between(text_col, pattern), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(F.col(text_col))
    return held.withColumn(text_col, text).select(*docs.columns)


def entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per entity: ``(<id_col>, ordinal, kind, start, entity, surrogate)``; ``start`` counts characters."""
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("text"))
    hit = _with_entities(rows, "text", "pattern", "e").filter(F.size("e") > 0)
    between = _between("text", "pattern")
    sizes = F.zip_with(between, "e", lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        sizes,
        first,
        lambda s, g: F.struct(
            (s["at"] + g["gap"] + F.coalesce(g["size"], F.lit(0))).alias("at"),
            F.concat(s["starts"], F.array(s["at"] + g["gap"])).alias("starts"),
        ),
        lambda s: s["starts"],
    )
    rows = hit.select("__id", F.posexplode(F.arrays_zip("e", starts.alias("start"))).alias("ordinal", "x"))
    rows = rows.filter(F.col("x.e").isNotNull())
    return rows.select(
        F.col("__id").alias(id_col),
        "ordinal",
        kind_of(F.col("x.e")).alias("kind"),
        F.col("x.start").alias("start"),
        F.col("x.e").alias("entity"),
        surrogate(F.col("x.e"), key).alias("surrogate"),
    )


def checked(found: DataFrame) -> DataFrame:
    """``found`` entities with ``collides``: another entity of the kind has the same surrogate, or it is its own.

    ``found`` is stored first, since it is read twice.  Equal entities are merged before the shuffle,
    so a frequent one costs a row per task.
    """
    found = materialised(found)
    spread = found.groupBy("kind", "surrogate").agg(F.min("entity").alias("a"), F.max("entity").alias("b"))
    clashes = spread.filter(F.col("a") != F.col("b")).select(
        F.col("kind").alias("__kind"), F.col("surrogate").alias("__surrogate")
    )
    same = (F.col("kind") == F.col("__kind")) & (F.col("surrogate") == F.col("__surrogate"))
    collides = F.col("__kind").isNotNull() | (F.col("surrogate") == F.col("entity"))
    return found.join(clashes, same, "left").select(*found.columns, collides.alias("collides"))
