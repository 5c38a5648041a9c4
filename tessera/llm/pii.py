"""Surrogates for personal data, with DataFrame and SQL functions only.

One pattern finds the entities: e-mail addresses, telephone numbers, payment cards and bank account numbers (with valid
check digits), IPv4 addresses, social security numbers, access keys, and secrets after a label. Names are found after a
title, or as a common given name with another word; then every mention in that document of one of their words counts,
with or without title, alone or with the other, as a given or a family name.

An entity's surrogate comes from a keyed digest of its type and canonical form (letters in lower case and digits,
without separators), so every mention of an entity gets the same surrogate whatever its spelling, and nobody without
the key can tell which. Given and family names are entities of their own, so a full name, its parts and the same family
elsewhere keep together. A surrogate looks alike: letters of the same script and case, digits for digits, separators
where they were, telephone numbers that could be dialled, cards and accounts with valid check digits, given names of
the gender that the title or the given name tells, Slavic family names with the ending of theirs.

Collision check. All distinct entities are gathered as a table; where two of them got one surrogate, or a surrogate is
itself an entity of the corpus, all but the first draw again with the next attempt, until none is left. Later attempts
have more to draw from (names get more syllables, addresses more letters), so the draws come to an end. The entities
that had to draw again are joined back to the rows that mention them.

Lengths are bounded as their standards have it: of an address, 64 characters before the sign, 63 in a label and 127
labels; what goes on beyond stays. Names without a title whose given name isn't in the list are not found. The key is the argument, or the setting ``KEY``
of the session; where neither is set, the session draws a key at random, and another session gives other surrogates.

Defined results: null and empty texts, and texts without entities, stay as they are. Repeated rows get equal texts.
Very long texts are read whole; no pattern backtracks into a repeated group. Empty tables give no rows. Other columns
are kept, whatever their names.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: The session's setting with the key. Its name makes Spark hide the value where it shows settings; plans hold a reference
#: to a table of one row with the key, never the key (``_shown_to``).
KEY = "spark.tessera.pii.secret"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles by gender, and common given names that are no other words.
_TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña", "госпожа"],
    "n": ["Dr", "Doctor", "Prof", "Professor"],
}
_KNOWN = {
    "m": ["James", "John", "Robert", "Michael", "David", "Thomas", "Daniel", "Peter", "Paul", "Martin", "Hans", "Klaus", "Stefan", "Jürgen", "Wolfgang", "Pierre", "Jean", "Jacques", "Michel", "Antoine", "Luis", "Carlos", "José", "Juan", "Miguel", "Pedro", "Javier", "Иван", "Пётр", "Алексей", "Сергей"],
    "f": ["Mary", "Anna", "Maria", "Elizabeth", "Sarah", "Emma", "Laura", "Julia", "Susan", "Linda", "Sabine", "Ursula", "Monika", "Marie", "Sophie", "Claire", "Camille", "Carmen", "Isabel", "Lucía", "Ana", "Elena", "Ольга", "Анна", "Мария", "Елена", "Наталья"],
}


#: Characters of a secret up to which it is replaced one by one; a longer one is hexadecimal digits as many.
LONG = 512


def _one_of(*lists: list[str]) -> str:
    return "(?:" + "|".join(sorted({x for words in lists for x in words}, key=lambda x: (-len(x), x))) + ")"


_TITLE, _FIRST = _one_of(*_TITLES.values()), _one_of(*_KNOWN.values())
_WORD = rf"(?!{_TITLE}(?!\p{{L}}))\p{{Lu}}\p{{Ll}}{{1,40}}+(?:[-'’]\p{{Lu}}\p{{Ll}}{{1,40}}+){{0,3}}+"
NAME = rf"(?=[\p{{Lu}}г])(?<!\p{{L}})(?:{_TITLE}\.? {_WORD}(?: {_WORD})?|{_FIRST} {_WORD})(?!\p{{L}})"
#: What may follow a telephone number after a space and is no block of it: entities of four blocks, which a number would
#: always cut in two, and of three blocks, which it would cut from its second block on.
_LONG = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)|\d{{4}}(?:[ -]\d{{4}}){{3}}(?![\p{{L}}\d])"
_SHORT = r"\d{3}-\d{2}-\d{4}(?![\d-])|\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)"
#: In the order in which they are tried; Java patterns without groups that capture.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,126}+",
    "secret": r"(?<!\p{L})(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_+/-]{8,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)|\d{2,4})" + rf"(?: (?!{_LONG})|[.-]?)\d{{2,4}}(?:(?: (?!{_LONG}|{_SHORT})|[.-]?)\d{{2,4}}){{1,2}}" + r"(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\p{L}\p{N}.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\p{L}\d])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What an entity has somewhere; texts without it needn't be searched.
HINT = r"[@\d]|(?i:password|passwd|pwd|secret|token|key)"

_GIVEN = {
    ("m", "latin"): ["Adrian", "Bruno", "Casper", "Dario", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Jonas", "Konrad", "Leon", "Marco", "Nils", "Oscar", "Pablo"],
    ("f", "latin"): ["Alma", "Bianca", "Carla", "Diana", "Elsa", "Flora", "Greta", "Helena", "Irene", "Judith", "Klara", "Lucia", "Marta", "Nora", "Olivia", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл"],
    ("f", "cyrillic"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Ксения", "Лидия"],
}
_BEGIN = {"latin": ["Al", "Ber", "Cor", "Dal", "Fen", "Gar", "Hol", "Kel", "Lan", "Mar", "Nor", "Ost", "Per", "Ros", "Sal", "Ter"], "cyrillic": ["Бел", "Вор", "Гор", "Дол", "Зим", "Кол", "Лес", "Мор"]}
_MIDDLE = {"latin": ["a", "be", "da", "e", "ge", "i", "la", "me", "na", "o", "ra", "se", "ti", "u", "va", "we"], "cyrillic": ["а", "е", "и", "о", "ри", "ла", "не", "ми"]}
_END = {("m", "latin"): ["berg", "ford", "lin", "mann", "ner", "rio", "son", "ton"], ("m", "cyrillic"): ["нов", "ков", "лёв", "тин"], ("f", "cyrillic"): ["нова", "кова", "лёва", "тина"]}
_END["f", "latin"] = _END["m", "latin"]
#: Endings of given names that are made of syllables, once the lists are used up.
_LAST = {("m", "latin"): ["n", "r", "s", "t"], ("f", "latin"): ["la", "na", "ra", "ssa"], ("m", "cyrillic"): ["л", "м", "н", "р"], ("f", "cyrillic"): ["ла", "на", "ра", "са"]}
_WOMAN_ENDING = "(?<=ов|ев|ёв|ин|ын)а$"


def kind_of(match: Column) -> Column:
    """The type of an entity that ``ANY`` found."""
    out = F
    for name, pattern in PATTERNS.items():
        out = out.when(match.rlike(f"^(?:{pattern})$"), name)
    return out


def people(text: Column) -> Column:
    """An array of ``word, kind, gender`` in the words' order: what is a given or a family name in the text, each word once."""

    def person(name: Column) -> Column:
        words = F.split(F.regexp_replace(name, rf"^{_TITLE}\.? ", ""), " ")
        first, second = words[0], F.get(words, F.lit(1))
        gender = F.coalesce(*[F.when(name.rlike(rf"^{_one_of(_TITLES[g])}(?!\p{{L}})"), g) for g in "mf"], *[F.when(first.rlike(f"^{_one_of(_KNOWN[g])}$"), g) for g in "mf"], F.lit("n"))
        given = second.isNotNull() | first.rlike(f"^{_FIRST}$")
        alone = F.struct(first.alias("word"), F.when(given, "given").otherwise("family").alias("kind"), F.when(given, gender).otherwise("").alias("gender"))
        return F.array(alone, F.struct(second.alias("word"), F.lit("family").alias("kind"), F.lit("").alias("gender")))

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), person))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x["word"].isNotNull())))


def _lead(match: Column, kind: Column) -> Column:
    """The part before what is replaced: a secret's label, the fixed start of an access key."""
    return F.when(kind == "secret", F.regexp_extract(match, r"^(?i:[a-z_-]+)\s*[=:]\s*\"?", 0)).when(kind == "key", F.substring(match, 1, 4)).otherwise("")


def _face(kind: Column, body: Column) -> Column:
    """What all spellings of an entity share; ``body`` is what follows the lead. Secrets and keys keep their case."""
    return (
        F.when(kind.isin("secret", "key"), body)
        .when(kind == "family", F.regexp_replace(F.lower(body), _WOMAN_ENDING, ""))
        .when(kind.isin("email", "ip", "given"), F.lower(body))
        .otherwise(F.lower(F.regexp_replace(body, r"[^\p{L}\p{N}]", "")))
    )


def _number(stream: Column, at: Column | int) -> Column:
    """The number 0 to 65535 that four hex digits of the digest say, from the place ``at`` (0, 1, ...) on, which wraps."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(stream, (at * 3) % 124 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _letters(ch: Column, number: Column, hexadecimal: Column) -> Column:
    """A letter or digit like ``ch``."""
    def of(alphabet: str) -> Column:
        return F.substr(F.lit(alphabet), (number % len(alphabet) + 1).cast("int"), F.lit(1))

    return (
        F.when(ch.rlike(r"^\d$"), of("0123456789"))
        .when(hexadecimal & ch.rlike("^[a-f]$"), of("abcdef"))
        .when(ch.rlike("^[A-Z]$"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(ch.rlike(r"^\p{IsCyrillic}$"), F.when(ch == F.upper(ch), of("АБВГДЕЖЗИКЛМНОПРСТУФ")).otherwise(of("абвгдежзиклмнопрстуф")))
        .when(ch.rlike(r"^\p{IsGreek}$"), of("αβγδεζηθικλμνξοπρστυφχψω"))
        .when(ch.rlike(r"^\p{L}$") & (ch != F.lower(ch)), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(ch.rlike(r"^\p{L}$"), of("abcdefghijklmnopqrstuvwxyz"))
        .otherwise(ch)
    )


def luhn(digits: Column) -> Column:
    """The sum, modulo 10, that is 0 for a number with a valid check digit."""
    n = F.length(digits)
    def worth(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b) % 10


def mod97(account: Column) -> Column:
    """The remainder that is 1 for a bank account number (without spaces) with valid check digits."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    digits = F.transform(F.split(turned, "(?!^|$)"), lambda c: F.ascii(c) - F.when(c.rlike("^[A-Z]$"), 55).otherwise(48))
    return F.aggregate(digits, F.lit(0), lambda sofar, d: (sofar * F.when(d > 9, 100).otherwise(10) + d) % 97)


def stream_of(kind: Column, canon: Column, attempt: Column, key: Column) -> Column:
    """128 hex digits that only who has the key can tell."""
    return F.sha2(F.concat_ws("\x1f", key, kind, canon, attempt.cast("string"), key), 512)


def _indexed(body: Column, counted: str) -> Column:
    """For each character of ``body`` a struct of ``ch`` and ``at``: how many of the ``counted`` kind stand up to it."""
    def one(i: Column) -> Column:
        return F.struct(F.substr(body, i, F.lit(1)).alias("ch"), F.length(F.regexp_replace(F.substr(body, F.lit(1), i), counted, "")).alias("at"), i.alias("i"))

    return F.transform(F.sequence(F.lit(1), F.length(body)), one)


def _by_character(body: Column, stream: Column, hexadecimal: Column, keep_from: Column) -> Column:
    """Letters and digits replaced one by one, separators kept, and what stands from ``keep_from`` on kept."""
    return F.array_join(F.transform(_indexed(body, r"[^\p{L}\p{N}]"), lambda x: F.when(x["i"] >= keep_from, x["ch"]).otherwise(_letters(x["ch"], _number(stream, x["at"]), hexadecimal))), "")


def _by_digit(body: Column, stream: Column, digit: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """Digits replaced by ``digit(index from 1, number of digits, old, random)``, everything else kept."""
    n = F.length(F.regexp_replace(body, r"\D", ""))
    return F.array_join(F.transform(_indexed(body, r"\D"), lambda x: F.when(x["ch"].rlike(r"^\d$"), digit(x["at"], n, x["ch"], _number(stream, x["at"]))).otherwise(x["ch"])), "")


def _new_body(x: Column) -> Column:
    """What stands in for ``x.body``."""
    kind, body, stream, match = x["kind"], x["body"], x["stream"], x["match"]
    never = F.length(body) + 1
    endless = F.substr(F.repeat(stream, F.ceil(F.length(body) / 128).cast("int")), F.lit(1), F.length(body))

    def phone(index: Column, n: Column, old: Column, number: Column) -> Column:
        national = index - F.greatest(n - 10, F.lit(0))
        return F.when(national <= 0, old).when(national.isin(1, 4), (number % 8 + 2).cast("string")).otherwise((number % 10).cast("string"))

    def card(index: Column, n: Column, old: Column, number: Column) -> Column:
        return F.when(index == 1, old).when(index == n, "0").otherwise((number % 10).cast("string"))

    octets = F.concat_ws(".", *[(_number(stream, 3 * k) % 254 + 1).cast("string") for k in range(4)])
    top = F.length(body) - F.length(F.substring_index(body, ".", -1)) + 1  # an address keeps its top-level domain

    def syllables(script: str, many: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), many), lambda k: _pick(_MIDDLE[script], _number(stream, k * 4 + 1))), "")

    def given(gender: str, script: str) -> Column:  # each attempt has more to draw from
        made = F.concat(_pick(_BEGIN[script], _number(stream, 1)), syllables(script, x["attempt"]), _pick(_LAST[gender, script], _number(stream, 3)))
        return F.when(x["attempt"] == 0, _pick(_GIVEN[gender, script], _number(stream, 17))).otherwise(made)

    def family(script: str) -> Column:
        made = F.concat(_pick(_BEGIN[script], _number(stream, 1)), syllables(script, x["attempt"] + 2), _pick(_END["m", script], _number(stream, 3)))
        return F.concat(made, F.when(F.lower(body).rlike(_WOMAN_ENDING), "а").otherwise("")) if script == "cyrillic" else made

    woman = (x["gender"] == "f") | (x["gender"] == "n") & (_number(stream, 5) % 2 == 0)
    cyrillic = body.rlike(r"\p{IsCyrillic}")
    return (
        F.when((kind == "secret") & (F.length(body) > LONG), endless)
        .when(kind == "phone", _by_digit(body, stream, phone))
        .when(kind == "card", _by_digit(body, stream, card))
        .when(kind == "ip", octets)
        .when(kind == "given", F.when(woman & cyrillic, given("f", "cyrillic")).when(cyrillic, given("m", "cyrillic")).when(woman, given("f", "latin")).otherwise(given("m", "latin")))
        .when(kind == "family", F.when(cyrillic, family("cyrillic")).otherwise(family("latin")))
        .when(kind == "iban", F.concat(F.substr(body, F.lit(1), F.lit(2)), _by_character(F.substr(body, F.lit(3)), stream, F.lit(False), never)))
        .when((kind == "email") & (x["attempt"] > 2), F.concat(F.substr(F.translate(stream, "0123456789", "ghijklmnop"), F.lit(101), x["attempt"] - 1), _by_character(body, stream, F.lit(False), top)))
        .otherwise(_by_character(body, stream, kind.isin("secret") & body.rlike("^[0-9a-f]+$"), F.when(kind == "email", top).otherwise(never)))
    )


def draw(found: Column, attempt: Callable[[Column], Column], key: Column) -> Column:
    """For each ``match, kind, gender`` a struct of ``match, kind, gender, canon, new, drawn``: also what all its
    spellings share, its surrogate, and what the surrogate's spellings share. ``kind`` is null for what only looks like
    an entity.

    The steps are nested so that each builds on the fields of the one before, not on repeated expressions.
    """
    def also(array: Column, *fields: str, **new: Callable[[Column], Column]) -> Column:
        return F.transform(array, lambda x: F.struct(*[x[f].alias(f) for f in fields], *[make(x).alias(n) for n, make in new.items()]))

    def real(x: Column) -> Column:
        plain = F.regexp_replace(x["match"], r"[ -]", "")
        return F.when((x["kind"] == "card") & (luhn(plain) != 0) | (x["kind"] == "iban") & (mod97(plain) != 1), None).otherwise(x["kind"])

    def checked(x: Column) -> Column:
        plain = F.regexp_replace(x["new"], r"[ -]", "")
        blank = F.concat(F.substr(plain, F.lit(1), F.lit(2)), F.lit("00"), F.substr(plain, F.lit(5)))
        account = F.concat(F.substr(x["new"], F.lit(1), F.lit(2)), F.lpad((98 - mod97(blank)).cast("string"), 2, "0"), F.substr(x["new"], F.lit(5)))
        card = F.concat(F.substr(x["new"], F.lit(1), F.length(x["new"]) - 1), ((10 - luhn(plain)) % 10).cast("string"))
        return F.when(x["kind"] == "card", card).when(x["kind"] == "iban", account).otherwise(x["new"])

    rows = also(found, "match", "gender", kind=real, lead=lambda x: _lead(x["match"], x["kind"]))
    rows = also(rows, "match", "gender", "kind", "lead", body=lambda x: F.substr(x["match"], F.length(x["lead"]) + 1))
    rows = also(rows, "match", "gender", "kind", "lead", "body", canon=lambda x: F.concat(F.when(x["kind"] == "given", F.concat(x["gender"], F.lit(":"))).otherwise(""), _face(x["kind"], x["body"])))
    rows = also(rows, "match", "gender", "kind", "lead", "body", "canon", attempt=attempt)
    rows = also(rows, "match", "gender", "kind", "lead", "body", "canon", "attempt", stream=lambda x: stream_of(x["kind"], x["canon"], x["attempt"], key))
    rows = also(rows, "match", "gender", "kind", "lead", "canon", new=lambda x: F.when(x["kind"].isNull(), x["match"]).otherwise(F.concat(x["lead"], _new_body(x))))
    rows = also(rows, "match", "gender", "kind", "lead", "canon", new=checked)
    return also(rows, "match", "kind", "gender", "canon", "new", drawn=lambda x: _face(x["kind"], F.substr(x["new"], F.length(x["lead"]) + 1)))


class _Helpers:
    """Names for helper columns that no input has."""

    def __init__(self):
        own = uuid.uuid4().hex
        self.sorted, self.names, self.pattern, self.found, self.tie, self.attempts, self.key = (f"{n}_{own}" for n in ("sorted", "names", "pattern", "found", "tie", "attempts", "key"))


def _searched(docs: DataFrame, text: Column, at: _Helpers) -> DataFrame:
    """The documents with the pattern that finds their entities, and ``match, kind, gender`` of each in its order."""
    docs = docs.withColumn(at.sorted, F.when(text.rlike(NAME), people(text)))
    before = lambda x, k: (k == 0) | (x["word"] != F.element_at(F.col(at.sorted), F.greatest(k, F.lit(1)))["word"])
    docs = docs.withColumn(at.names, F.map_from_entries(F.transform(F.filter(F.col(at.sorted), before), lambda x: F.struct(x["word"], F.struct(x["kind"], x["gender"])))))
    words = F.concat(F.lit(ANY + r"|(?=\p{Lu})(?<!\p{L})(?:"), F.array_join(F.map_keys(at.names), "|"), F.lit(r")(?!\p{L})"))
    docs = docs.withColumn(at.pattern, F.when(F.size(at.names) > 0, words).when(text.rlike(HINT), ANY))
    named = lambda m: F.try_element_at(F.col(at.names), m)
    found = F.transform(F.regexp_extract_all(text, F.col(at.pattern), F.lit(0)), lambda m: F.struct(m.alias("match"), F.coalesce(named(m)["kind"], kind_of(m)).alias("kind"), F.coalesce(named(m)["gender"], F.lit("")).alias("gender")))
    return docs.withColumn(at.found, found).drop(at.sorted, at.names)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, canon, match, gender``: the distinct entities of the corpus, each with one of its spellings."""
    at = _Helpers()
    rows = _searched(docs.select(F.col(text_col).cast("string").alias("text")), F.col("text"), at)
    found = rows.select(F.inline(F.array_distinct(at.found))).groupBy("match", "kind", "gender").agg(F.lit(0).alias("n"))
    drawn = found.select(F.inline(draw(F.array(F.struct("match", "kind", "gender")), lambda _: F.lit(0), F.lit("")))).where("kind IS NOT NULL")
    return drawn.groupBy("kind", "canon", "gender").agg(F.min("match").alias("match"))


def _shown_to(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the key in the column ``name``: the value of a subquery, of which the plan's text has the number alone."""
    held = rows.sparkSession.createDataFrame([(key,)], f"`{name}` string")
    return rows.withColumn(name, held.select(name).scalar())


def attempts(found: DataFrame, key: str) -> DataFrame | None:
    """``kind, canon, attempt`` of the entities that must draw again so that surrogates are distinct; None if none must."""
    now = cut(found.withColumn("attempt", F.lit(0)))
    redrawn = False
    while True:
        shown = _shown_to(now, key, "key")
        drawn = cut(shown.select("kind", "canon", "attempt", draw(F.array(F.struct("match", "kind", "gender")), lambda _: F.col("attempt"), F.col("key"))[0]["drawn"].alias("drawn")))
        holders = drawn.groupBy("kind", "drawn").agg(F.min(F.struct("attempt", "canon")).alias("holder"), F.count("*").alias("n"))
        clash = drawn.join(holders.where("n > 1"), ["kind", "drawn"]).where(F.col("holder.canon") != F.col("canon")).select("kind", "canon")
        real = now.select("kind", F.when(F.col("kind") == "given", F.substr("canon", F.lit(3))).otherwise(F.col("canon")).alias("drawn"))
        clash = cut(clash.union(drawn.join(real, ["kind", "drawn"], "left_semi").select("kind", "canon")).distinct())
        if clash.isEmpty():
            return now.where("attempt > 0").select("kind", "canon", "attempt") if redrawn else None
        redrawn = True
        now = cut(now.join(clash.withColumn("again", F.lit(1)), ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again"))


def key_of(spark: SparkSession) -> str:
    """The session's key; drawn at random where none is set."""
    if not (key := spark.conf.get(KEY, None)):
        spark.conf.set(KEY, key := secrets.token_hex(32))
    return key


def replace_pii(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """The documents with a surrogate for every entity in ``text_col``."""
    key, at, columns = key or key_of(docs.sparkSession), _Helpers(), docs.columns
    text = F.col(text_col).cast("string")
    again = attempts(entities(docs, text_col), key)
    rows = _searched(docs, text, at)
    if again is not None:  # the entities that drew again, by the texts that mention them
        mention = _searched(docs.select(text.alias("text"), F.xxhash64(text).alias(at.tie)), F.col("text"), at).select(at.tie, F.inline(draw(F.array_distinct(at.found), lambda _: F.lit(0), F.lit(""))))
        redrawn = mention.join(again, ["kind", "canon"]).groupBy(at.tie).agg(F.map_from_entries(F.collect_set(F.struct("match", "attempt"))).alias(at.attempts))
        rows = rows.withColumn(at.tie, F.xxhash64(text)).join(redrawn, at.tie, "left")
    else:
        rows = rows.withColumn(at.attempts, F.lit(None).cast("map<string,int>"))
    rows = _shown_to(rows, key, at.key)
    drawn = draw(F.col(at.found), lambda x: F.coalesce(F.try_element_at(F.col(at.attempts), x["match"]), F.lit(0)), F.col(at.key))
    new = F.array_join(F.zip_with(F.split(text, F.col(at.pattern), -1), drawn, lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit("")))), "")
    return rows.withColumn(text_col, F.when(F.col(at.pattern).isNotNull(), new).otherwise(text)).select(*columns)
