"""Opening hours: parsing, schedules, and what is open when. Built-in array functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.blank import has_items, has_text

DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
NAMES = {"mon": "monday", "tue": "tuesday", "wed": "wednesday", "thu": "thursday", "fri": "friday", "sat": "saturday", "sun": "sunday"}
#: First and last hour of service of each weekday, Monday first.
SERVICE = [(5, 23)] * 4 + [(5, 24), (7, 24), (8, 23)]
_TIME = r"(?i)(\d{1,2})(?::(\d{2}))?\s*(am|pm|a\.m\.|p\.m\.)?"


def minutes(clock: Column) -> Column:
    """Minutes since midnight of ``HH:MM``."""
    parts = F.split(clock, ":")
    return F.get(parts, F.lit(0)).cast("int") * 60 + F.get(parts, F.lit(1)).cast("int")


def twelve_hour(clock: Column) -> Column:
    """``9am``, ``1:30pm``."""
    total = minutes(clock)
    hour, minute = F.floor(total / 60) % 24, total % 60
    shown = F.when(hour % 12 == 0, F.lit(12).cast("long")).otherwise(hour % 12).cast("string")
    return F.concat(shown, F.when(minute > 0, F.concat(F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))).otherwise(""), F.when(hour >= 12, "pm").otherwise("am"))


def _bound(value: Column, rule) -> Column:
    """``rule`` of a value that is worked out once, however often the rule names it; as a mere column it would be at each place."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def _clock(hour: Column, minute: Column, half: Column) -> Column:
    """``HH:MM`` of an hour and minute, whole numbers, and ``am``, ``pm`` or nothing."""
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    return F.when(hour.between(0, 23) & minute.between(0, 59), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))


def clocks(text: Column) -> Column:
    """``HH:MM`` of each time in a text like ``9``, ``9:30 am`` or ``2 p.m.``; null for what is no time of day."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(_TIME), F.lit(k)).alias(n) for k, n in ((1, "h"), (2, "m"), (3, "half"))])
    told = F.transform(parts, lambda t: F.struct(t["h"].cast("int").alias("h"), F.coalesce(t["m"].try_cast("int"), F.lit(0)).alias("m"), F.lower(F.replace(t["half"], F.lit("."), F.lit(""))).alias("half")))
    return F.transform(told, lambda t: _clock(t["h"], t["m"], t["half"]))


def parse_hours(raw: Column) -> Column:
    """``array<struct<day, open, close, note>>``, an entry for each day that a clause with two times names.

    Clauses are cut at commas and semicolons; the first two times open and close; what follows them, if longer than
    three characters, is the note. A range of days names its two ends only. Null where nothing can be read.
    """
    clauses = F.filter(F.transform(F.split(raw, r"[,;]\s*"), lambda x: F.trim(x)), lambda x: x != "")

    def day_of(word: Column) -> Column:
        return F.coalesce(*[F.when(word.isin(d, name), F.lit(d)) for d, name in NAMES.items()])

    def read(part: Column) -> Column:
        return F.struct(
            F.filter(F.transform(F.transform(F.regexp_extract_all(part, F.lit("([a-zA-Z]+)"), F.lit(1)), F.lower), day_of), lambda d: d.isNotNull()).alias("days"),
            clocks(part).alias("times"),
            F.trim(F.regexp_replace(F.regexp_extract(part, rf"{_TIME}.*?{_TIME}(.*)$", 7), r"^[;:,\- ]+", "")).alias("rest"),
        )

    def entries(x: Column) -> Column:
        open_, close = F.get(x["times"], F.lit(0)), F.get(x["times"], F.lit(1))
        note = F.when(F.length(x["rest"]) > 3, x["rest"])
        days = F.when((F.size(x["times"]) >= 2) & open_.isNotNull() & close.isNotNull(), x["days"]).otherwise(F.array().cast("array<string>"))
        return F.transform(days, lambda d: F.struct(d.alias("day"), open_.alias("open"), close.alias("close"), note.alias("note")))

    found = F.flatten(F.transform(F.transform(clauses, read), entries))
    return _bound(found, lambda x: F.when(has_items(x), x))


def schedule(entries: Column, raw: Column) -> Column:
    """Entries by day, ``map<day, array<struct<start, end, note>>>``, with the text they come from."""
    def by_day(known: Column) -> Column:
        def slots(day: Column) -> Column:
            return F.transform(F.filter(known, lambda e: e["day"] == day), lambda e: F.struct(e["open"].alias("start"), e["close"].alias("end"), e["note"].alias("note")))

        return _bound(F.array_distinct(F.transform(known, lambda e: e["day"])), lambda days: F.map_from_arrays(days, F.transform(days, slots)))

    return F.struct(raw.alias("raw"), F.coalesce(F.contains(F.lower(raw), F.lit("appointment")), F.lit(False)).alias("by_appointment"), _bound(entries, by_day).alias("days"))


def open_on(day: str, entries: Column, raw: Column) -> Column:
    """Whether a place is open on a weekday. Without any hours it is taken to be open; text without entries is searched."""
    text = F.lower(raw)
    named = F.contains(text, F.lit(day))
    if day in DAYS[:5]:
        named = named | F.contains(text, F.lit("weekday")) | (F.contains(text, F.lit("mon")) & F.contains(text, F.lit("fri")))
    told = _bound(entries, lambda known: F.when(has_items(known), F.exists(known, lambda e: e["day"] == day)))
    return F.coalesce(told, ~has_text(raw) | F.coalesce(named, F.lit(False)))


def _on(day: str):
    return lambda e: e["day"] == day


def open_status(entries: Column, raw: Column, weekday: Column, now: Column) -> Column:
    """``struct<state, label>`` at a weekday (0 Monday) and minute of the day.

    Open for the first slot of today that holds the minute; opening today for the first that is still to come, whichever
    stands first; else the first slot of the next day with any; unknown without hours.
    """
    days = F.array(*[F.lit(d) for d in DAYS])
    full = F.create_map(*[F.lit(x) for d, n in NAMES.items() for x in (d, n.capitalize())])
    appointment = F.coalesce(F.contains(F.lower(raw), F.lit("appointment")), F.lit(False))

    def found(entries: Column) -> Column:
        slots = F.filter(entries, lambda e: e["day"] == F.get(days, weekday))
        first = F.get(F.filter(slots, lambda e: (minutes(e["open"]) > now) | (minutes(e["close"]) > now)), F.lit(0))
        ahead = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda k: F.exists(entries, lambda e: e["day"] == F.get(days, (weekday + k) % 7)))
        around = F.lit(True)
        for d in DAYS:
            one = F.get(F.filter(entries, _on(d)), F.lit(0))
            around = around & F.coalesce((one["open"] == "00:00") & one["close"].isin("23:59", "24:00"), F.lit(False))
        return F.struct(entries.alias("entries"), has_items(entries).alias("known"), around.alias("around"), first.alias("first"), F.get(ahead, F.lit(0)).alias("step"))

    def told(x: Column) -> Column:
        first, step = x["first"], x["step"]
        opening = first.isNotNull() & (minutes(first["open"]) > now)
        next_day = F.get(days, (weekday + step) % 7)
        next_slot = F.get(F.filter(x["entries"], lambda e: e["day"] == next_day), F.lit(0))
        state = F.when(~x["known"], "unknown").when(x["around"], "open").when(opening, "opens_today").when(first.isNotNull(), "open").when(step.isNotNull(), "opens_this_week").otherwise("closed_long")
        label = (
            F.when(~x["known"], F.when(appointment, "By appointment, call ahead").otherwise("Call for hours"))
            .when(x["around"], "Open 24/7")
            .when(opening, F.concat(F.lit("Opens today at "), twelve_hour(first["open"]), F.when(first["note"].isNotNull(), F.concat(F.lit(" - "), first["note"])).otherwise("")))
            .when(first.isNotNull(), F.concat(F.lit("Open now - closes "), twelve_hour(first["close"])))
            .when(step.isNotNull(), F.concat(F.when(step == 1, "Tomorrow").otherwise(F.element_at(full, next_day)), F.lit(" "), twelve_hour(next_slot["open"])))
            .otherwise("Call for hours")
        )
        return F.struct(state.alias("state"), label.alias("label"))

    return _bound(_bound(entries, found), told)


def reachable_hours(has_metro: Column) -> Column:
    """Hours of the week (0 is Monday midnight) at which the metro runs; none without a metro."""
    hours = [24 * day + h for day, (a, b) in enumerate(SERVICE) for h in range(a, b)]
    return F.when(has_metro, F.array(*[F.lit(h) for h in hours])).otherwise(F.array().cast("array<int>"))


def day_label(start: Column, now: Column, far: str = "MMMM d") -> Column:
    """``Today``, ``Tomorrow``, a weekday within the week, else the date."""
    away = F.datediff(start, now)
    return F.when(away == 0, "Today").when(away == 1, "Tomorrow").when((start - now) < F.expr("INTERVAL 7 DAYS"), F.date_format(start, "EEEE")).otherwise(F.date_format(start, far))


def window_label(start: Column, end: Column, now: Column) -> Column:
    return F.concat(day_label(start, now), F.lit(" "), F.date_format(start, "h:mm a"), F.lit("\u2013"), F.date_format(end, "h:mm a"))


def minutes_until(start: Column, now: Column) -> Column:
    return F.timestamp_diff("MINUTE", now, start)


def day_progress(minute: Column) -> Column:
    return minute / F.lit(1440.0)


def fresh(fetched: Column, now: Column, seconds: int) -> Column:
    """True while less than ``seconds`` have passed since ``fetched``."""
    return F.coalesce(now.cast("timestamp").cast("long") - fetched.cast("timestamp").cast("long") < seconds, F.lit(False))


def iso(at: Column) -> Column:
    """A timestamp as ISO text in UTC, by the second; the session's zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ago(at: Column, now: Column) -> Column:
    """How long before (``5 minutes ago``) or after (``in 2 days``) now, in the largest unit, rounded; months have 30 days."""
    seconds = F.unix_seconds(now) - F.unix_seconds(at)
    size = F.abs(seconds)
    # From how many seconds on each unit is used, and its length.
    units = [(31_536_000, 31_536_000, "year"), (2_592_000, 2_592_000, "month"), (86_400, 86_400, "day"), (3_600, 3_600, "hour"), (60, 60, "minute"), (0, 1, "second")]
    text = F
    for least, length, name in units:
        n = F.round(size / length).cast("long")
        text = text.when(size >= least, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s")))
    return F.when(seconds >= 0, F.concat(text, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), text))


def freshness(tier: Column) -> Column:
    """``struct<tone, promote, call_first>`` of a place's confidence tier; unknown tiers and null as ``unknown``."""
    # Tones of the tiers.
    tone = F.when(tier.isin("verified", "fresh"), "sage").when(tier.isin("likely", "recent"), "mustard").otherwise("stone")
    sure = F.coalesce(tier.isin("verified", "fresh", "likely", "recent"), F.lit(False))
    return F.struct(tone.alias("tone"), sure.alias("promote"), (~sure).alias("call_first"))
