"""String rules: contact fields, names, addresses, tags and sentences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.blank import blank_to_null, has_items, has_text

# Endings that names lose, in order; state ranges of postal codes; language codes.
NAME_ENDINGS = [", inc.", ", inc", " inc.", " inc", " llc", " corp"]
STATE_RANGES = [("DC", 20001, 20099), ("DC", 20200, 20599), ("MD", 20600, 21999), ("VA", 22000, 24699), ("VA", 20100, 20199)]


def phone(raw: Column, keep_other: bool = True) -> Column:
    """``(AAA) BBB-CCCC`` for ten digits (or eleven with a leading 1); others stay, or become null."""
    digits = F.regexp_replace(F.regexp_replace(raw, r"\D", ""), r"^1(\d{10})$", "$1")
    shaped = F.concat(F.lit("("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4))
    return F.when(F.length(digits) == 10, shaped).otherwise(raw if keep_other else F.lit(None).cast("string"))


def first_phone(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, r"\+?1?[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}", 0))


def first_email(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0))


#: A day's name, short or long, and a span of hours of the same line.
_CLOCK = r"\d{1,2}(?::\d{2})?\s*[aApP][mM]"
HOURS = rf"(?:{'|'.join(f'{d[:3]}(?:{d[3:]})?' for d in ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'))})[ ,\u2013-]+{_CLOCK}\s*(?:-|\u2013|to)\s*{_CLOCK}"
URL = r"https?://[^\s)>\"']+"


def all_hours(text: Column) -> Column:
    """Every span of hours after a day's name, as it stands there, with semicolons between; null without one."""
    return blank_to_null(F.array_join(F.regexp_extract_all(text, F.lit(HOURS), F.lit(0)), "; "))


def first_url(text: Column) -> Column:
    """The first address of the web, without the marks that end a sentence."""
    return blank_to_null(F.regexp_replace(F.regexp_extract(text, URL, 0), "[.,;:!?]+$", ""))


def slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 60)


def record_id(source: Column, name: Column) -> Column:
    """Not unique: two records of one source and slug share it, so rows carry an ordinal besides."""
    return F.concat(F.lit("org_"), source, F.lit("__"), slug(name))


def clean_name(name: Column) -> Column:
    """The form in which names are compared."""
    out = F.lower(F.trim(name))
    for ending in NAME_ENDINGS:
        out = F.regexp_replace(out, ending.replace(".", r"\.") + "$", "")
    out = F.regexp_replace(out, "[\u2018\u2019`]", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[.,:;!?]", ""), r"\s+", " "))


def street_number(address: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.trim(address), r"^(\d+)\s", 1))


def last_zip(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(\d{5})\b"), F.lit(1)), F.lit(-1))


def without_distance(address: Column) -> Column:
    """An address without a trailing ``1.2 mi`` or country."""
    return F.regexp_replace(F.regexp_replace(address, r"\s+\d+\.\d+\s+mi$", ""), r"\s+USA\s*$", "")


def city_of(address: Column) -> Column:
    """The part before the state and postal code: capitalised and of more than one letter, else null."""
    parts = F.split(address, ",")
    part = F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-2))).when(F.size(parts) == 2, F.try_element_at(parts, F.lit(-1)))
    city = F.trim(F.regexp_replace(F.regexp_replace(part, r"\b\d{5}(-\d{4})?\b", ""), r"\b(MD|VA|DC)\b", ""))
    return F.when(city.rlike("^[A-Z].+"), city)


def state_of_zip(zip_code: Column) -> Column:
    number = F.substring(zip_code, 1, 5).try_cast("int")
    out = F
    for state, low, high in STATE_RANGES:
        out = out.when((F.length(zip_code) >= 5) & number.between(low, high), state)
    return out


def canonical_state(state: Column) -> Column:
    """Upper case for the three states served, other values only trimmed."""
    return F.when(F.lower(F.trim(state)).isin("va", "md", "dc"), F.upper(F.trim(state))).otherwise(F.trim(state))


def url_key(url: Column) -> Column:
    """What addresses of one page share: https, no ``www.``, no trailing slash, lower case."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "/+$", ""), "^http://", "https://"), r"^https://www\.", "https://")


def full_address(address: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """The address with city, state and postal code where it doesn't hold them already."""
    def also(c: Column, known: Column) -> Column:
        return F.when(has_text(c) & ~known, c)

    return F.concat_ws(", ", address, also(city, F.contains(F.lower(address), F.lower(city))), also(state, F.contains(address, state)), also(zip_code, F.contains(address, zip_code)))


def tidy(text: Column) -> Column:
    """Dashes between clauses become commas; a leading comma goes."""
    return F.regexp_replace(F.regexp_replace(text, "\\s*\u2014\\s*", ", "), r"^\s*,\s*", "")


def tags_by_pattern(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The tags whose pattern the text has, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(pattern), F.lit(tag)) for pattern, tag in rules]))


def tags_by_list(text: Column, names: dict[str, str]) -> Column:
    """A comma list through a map from parts of words to tags: distinct, in order, unknown items left out."""
    def one(item: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(F.lower(item), F.lit(part)), F.lit(tag)) for part, tag in names.items()], F.lit(None).cast("string"))

    return F.array_distinct(F.filter(F.transform(F.split(text, ","), one), lambda x: x.isNotNull()))


def joined(separator: str, *parts: Column) -> Column:
    """The parts that aren't blank, with ``separator`` between them."""
    return F.concat_ws(separator, *[blank_to_null(p) for p in parts])


def coded(values: Column, codes: dict[str, str]) -> Column:
    """Names to codes; an unknown name gives its first two letters in lower case."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.transform(values, lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), F.substring(F.lower(x), 1, 2)))


def services_of(values: Column, aliases: dict[str, str], requirements: list[str], default: str = "food_pantry") -> Column:
    """Services by their canonical names without requirement tags, distinct and in order; the default for none."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    named = F.transform(values, lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), F.lower(x)))
    kept = F.array_distinct(F.filter(named, lambda x: ~x.isin(requirements)))
    return F.when(has_items(kept), kept).otherwise(F.array(F.lit(default)))


def localized(translations: Column, lang: Column, field: str, english: Column) -> Column:
    """A translated field where there is one for the language, the English one elsewhere."""
    return F.when(lang == "en", english).otherwise(F.coalesce(F.try_element_at(translations, lang)[field], english))


def interface_text(key: Column, lang: Column, table: dict[str, dict[str, str]]) -> Column:
    """A label in the language, else in English, else its key. ``table``: the languages' words of each key."""
    words = F.create_map(*[x for k, by in table.items() for x in (F.lit(k), F.create_map(*[F.lit(x) for p in by.items() for x in p]))])
    own = F.try_element_at(words, key)
    return F.coalesce(F.try_element_at(own, lang), F.try_element_at(own, F.lit("en")), key)


def interpolated(template: Column, **values: Column) -> Column:
    """``{{name}}`` replaced by the value of that name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value.cast("string"))
    return template


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", *parts))


def combined_text(raw: Column, page: Column, page_limit: int = 3000, limit: int = 4000) -> Column:
    """A record's text and that of its page, within the lengths an extraction service takes."""
    return F.substring(F.concat_ws("\n--- page ---\n", raw, F.substring(page, 1, page_limit)), 1, limit)


def occurs_in(value: Column, source: Column) -> Column:
    """True if every word of ``value`` that has a digit stands in ``source``: a guard against invented hours."""
    return ~F.exists(F.split(value, r"[\s,;]+"), lambda w: w.rlike(r"\d") & ~F.contains(F.lower(source), F.lower(w)))


def explanation(walk: Column, stop: Column, state: Column, requirements: Column, languages: Column, spoken: Column) -> Column:
    """Why a place was suggested, as one sentence."""
    shared = F.get(F.filter(languages, lambda x: F.array_contains(spoken, x) & (x != "en")), F.lit(0))
    without_id = ~F.array_contains(requirements, "appointment_required") & (F.array_contains(requirements, "no_id_required") | ~F.array_contains(requirements, "photo_id"))
    out = F.concat_ws(
        ", ",
        F.when(walk <= 20, F.concat(walk.cast("string"), F.lit(" min walk"))).when(stop.isNotNull(), F.concat(F.lit("near "), F.substring_index(stop, " (", 1))),
        F.when(state == "open", "open now").when(state == "opens_today", "opens today"),
        F.when(without_id, "no ID needed"),
        F.when(shared == "es", "Spanish spoken").when(shared == "am", "Amharic spoken"),
    )
    return F.when(out != "", F.concat(out, F.lit("."))).otherwise("")


def mode_label(walk: Column, summary: Column, stop: Column, transit: Column, drive: Column, walkable: int = 20) -> Column:
    """The best way to get there, as a label."""
    return (
        F.when(walk <= walkable, F.concat(walk.cast("string"), F.lit(" min walk")))
        .when(has_text(summary), summary)
        .when(has_text(stop), F.concat(F.lit("near "), stop))
        .when(transit <= 40, F.concat(transit.cast("string"), F.lit(" min by transit")))
        .otherwise(F.concat(drive.cast("string"), F.lit(" min drive")))
    )
