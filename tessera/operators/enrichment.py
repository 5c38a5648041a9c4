"""Filling records: tags from notes, checked extraction results, template texts and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.blank import blank_to_null, has_items, has_text

# Words that notes are searched for; texts that say nothing; names that hint at who is served.
NOTE_LANGUAGES = [("spanish|espanol", "Spanish"), ("amharic", "Amharic"), ("french", "French"), ("arabic", "Arabic"), ("chinese|mandarin", "Chinese"), ("korean", "Korean")]
EMPTY_ELIGIBILITY = ["everyone welcome. bring nothing.", "n/a", "no food assistance services listed.", ""]
EMPTY_HERO = ["N/A", "n/a", ""]
NAME_HINTS = ["iskcon", "islamic", "muslim", "sikh", "jewish", "korean", "ethiopian", "chinese", "vietnamese", "latino", "hispanic"]
TONES = {"open": 0.9, "walk_in": 0.7, "appointment": 0.45, "other": 0.6}
DIRECTORY_URL = {"cafb": "https://www.capitalareafoodbank.org/find-food/"}

HERO = {
    "open": ["Walk in, no papers asked.", "Come by any open day without papers."],
    "walk_in": ["Walk in during open hours.", "No appointment, just come by."],
    "delivery": ["Food brought to your door."],
    "hot_meals": ["Warm meals, served on site."],
    "mobile_pantry": ["A pantry that comes to your street."],
    "default": ["Groceries for people nearby.", "Food help for the neighbourhood."],
}
ELIGIBILITY = {"no_id": "No ID or papers are needed.", "id_address": "Bring a photo ID and proof of address.", "id": "Bring a photo ID.", "income": "You may be asked about income.", "default": "Call ahead to hear what to bring."}


def _has(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def requirements_from_days(appointment: list[Column], residents: list[Column], notes: list[Column]) -> Column:
    """Tags from a column for each weekday: yes or no to appointments, yes to residents only, and free notes.

    Notes are read in order: "id" anywhere asks for an ID unless something was said about it before; "no id" adds that
    none is needed even then.
    """
    def says(columns: list[Column], word: str) -> Column:
        return F.exists(F.array(*[F.coalesce(F.lower(c), F.lit("")) for c in columns]), lambda x: x == word)

    base = F.array_compact(F.array(F.when(says(appointment, "yes"), "appointment_required"), F.when(says(appointment, "no"), "walk_in"), F.when(says(residents, "yes"), "proof_of_address")))

    def read(found: Column, note: Column) -> Column:
        known = F.array_contains(found, "no_id_required") | F.array_contains(found, "photo_id")
        found = F.when(F.contains(note, F.lit("id")) & ~known, F.array_append(found, F.lit("photo_id"))).otherwise(found)
        return F.when(F.contains(note, F.lit("no id")) & ~F.array_contains(found, "no_id_required"), F.array_append(found, F.lit("no_id_required"))).otherwise(found)

    return F.aggregate(F.array(*[F.coalesce(F.lower(n), F.lit("")) for n in notes]), base, read)


def languages_from_notes(*notes: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *notes))
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for p, n in NOTE_LANGUAGES]))


def checked(results: DataFrame, source: str = "combined_text", banned: list[str] | None = None) -> DataFrame:
    """Extraction results with what can't be trusted set to null.

    Columns tone, hero_copy, hours, guide, donate_url, volunteer_url, eligibility and the text they were drawn from.
    Hours need a word of more than two letters that occurs in the text, addresses must occur whole, bullets have at most
    100 characters, copy that says nothing goes, and so does a tone at either end of the scale.
    """
    text = F.lower(source)
    tone = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("tone")))
    hero = F.trim("hero_copy")
    bad = F.startswith(F.lower(hero), F.lit("nourishing")) | hero.isin(EMPTY_HERO) | (F.length(hero) < 5)
    for word in banned or []:
        bad = bad | F.contains(F.lower(hero), F.lit(word))
    words = F.filter(F.split("hours", r"[\s,\-:]+"), lambda w: F.length(w) > 2)
    return results.withColumns(
        {
            "tone": F.when((tone < 0.99) & (tone > 0.01), tone),
            "hero_copy": F.when(~bad, F.col("hero_copy")),
            "hours": F.when(F.exists(words, lambda w: F.contains(text, F.lower(w))), F.col("hours")),
            "guide": F.filter(F.coalesce("guide", F.array().cast("array<string>")), lambda b: F.length(b) <= 100),
            **{c: F.when(F.contains(F.col(source), F.col(c)), F.col(c)) for c in ("donate_url", "volunteer_url")},
            "eligibility": F.when(~F.lower(F.trim("eligibility")).isin(EMPTY_ELIGIBILITY), F.col("eligibility")),
        }
    )


def merge_results(records: DataFrame, results: DataFrame, key: str, sets: list[str], texts: list[str], flags: list[str], urls: list[str]) -> DataFrame:
    """Records with extraction results: sets united in order, hours only where there are none, texts where the result has
    any, flags set but never cleared."""
    other = results.select(key, *[F.col(c).alias(f"__{c}") for c in [*sets, *texts, *flags, *urls, "hours"]])
    empty = F.array().cast("array<string>")
    out = records.join(other, key, "left")
    made = {c: F.array_union(F.coalesce(c, empty), F.coalesce(f"__{c}", empty)) for c in sets}
    made |= {"hours": F.when(has_text(F.col("hours")), F.col("hours")).otherwise(F.coalesce(blank_to_null(F.col("__hours")), F.col("hours")))}
    made |= {c: F.coalesce(f"__{c}", c) for c in texts}
    made |= {c: F.col(c) | F.coalesce(f"__{c}", F.lit(False)) for c in flags}
    made |= {c: F.coalesce(blank_to_null(F.col(f"__{c}")), F.col(c)) for c in urls}
    return out.withColumns(made).drop(*[c for c in out.columns if c.startswith("__")])


def _choice(values: list[str], number: Column) -> Column:
    """One of the values by a number of the record, so that a record always gets the same."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def template_hero(services: Column, requirements: Column, number: Column) -> Column:
    walk_in, free = _has(requirements, "walk_in"), _has(requirements, "no_id_required")
    out = F.when(walk_in & free, _choice(HERO["open"], number)).when(walk_in, _choice(HERO["walk_in"], number))
    for service in ("delivery", "hot_meals", "mobile_pantry"):
        out = out.when(_has(services, service), _choice(HERO[service], number))
    return out.otherwise(_choice(HERO["default"], number))


def template_guide(requirements: Column) -> Column:
    """Three steps of a first visit."""
    return F.array(
        F.when(_has(requirements, "walk_in"), "Walk in during open hours.").when(_has(requirements, "appointment_required"), "Call ahead for an appointment.").otherwise("Check the hours before you come."),
        F.when(_has(requirements, "no_id_required"), "Leave your papers at home.").when(_has(requirements, "photo_id") & _has(requirements, "proof_of_address"), "Bring a photo ID and proof of address.").when(_has(requirements, "photo_id"), "Bring a photo ID.").otherwise("Bring an ID if you have one."),
        F.lit("Bring bags to carry food home."),
    )


def template_eligibility(requirements: Column) -> Column:
    return (
        F.when(_has(requirements, "no_id_required"), ELIGIBILITY["no_id"])
        .when(_has(requirements, "photo_id") & _has(requirements, "proof_of_address"), ELIGIBILITY["id_address"])
        .when(_has(requirements, "photo_id"), ELIGIBILITY["id"])
        .when(_has(requirements, "income_verification"), ELIGIBILITY["income"])
        .otherwise(ELIGIBILITY["default"])
    )


def template_tone(requirements: Column) -> Column:
    walk_in = _has(requirements, "walk_in")
    return F.when(walk_in & _has(requirements, "no_id_required"), TONES["open"]).when(walk_in, TONES["walk_in"]).when(_has(requirements, "appointment_required"), TONES["appointment"]).otherwise(TONES["other"])


def cultural_note(name: Column, languages: Column) -> Column:
    """Whom a place serves, by its name, else by its languages: several, or one other than English and Spanish."""
    out = F
    for hint in NAME_HINTS:
        out = out.when(F.contains(F.lower(name), F.lit(hint)), F.lit(f"Rooted in the {hint} community."))
    other = F.filter(F.coalesce(languages, F.array().cast("array<string>")), lambda x: x != "English")
    one = F.get(other, F.lit(0))
    return out.when(F.size(other) >= 2, F.concat(F.lit("Several languages: "), F.array_join(F.slice(other, 1, 3), ", "), F.lit("."))).when((F.size(other) == 1) & (one != "Spanish"), F.concat(one, F.lit(" is spoken.")))


def defaults(records: DataFrame) -> DataFrame:
    """Food types of pantries, websites of sources that have a directory page, and where the copy came from."""
    site = F.create_map(*[F.lit(x) for p in DIRECTORY_URL.items() for x in p])
    return records.withColumns(
        {
            "food_types": F.when(~has_items(F.col("food_types")) & _has(F.col("services"), "food_pantry"), F.array(F.lit("canned_goods"))).otherwise(F.col("food_types")),
            "website": F.when(has_text(F.col("website")), F.col("website")).otherwise(F.try_element_at(site, F.col("source"))),
            "extracted_by": F.coalesce(blank_to_null(F.col("extracted_by")), F.when(has_text(F.col("hero_copy")), "model").otherwise("template")),
        }
    )
