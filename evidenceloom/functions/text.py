"""Column functions over titles, names, urls and documents."""

from __future__ import annotations

import functools
import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide which titles are equal and what is dropped
STOP_WORDS = [
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "und", "mit", "im", "in", "am", "an", "um", "auf", "bei", "fuer", "von", "vom",
    "zum", "zur", "the", "a", "an", "and", "of", "at", "with", "omu", "omdtu", "omeu", "omenglu", "ov", "odf", "df", "oful",
]
GENERIC_TITLE_WORDS = ["event", "events", "veranstaltung", "veranstaltungen", "termin", "termine", "programm", "kalender", "highlights"]
NON_EVENT = (
    r"(?iu)(sommerferien|weihnachtsferien|semesterferien|ferienbeginn|schulfrei|hinweis auf|öffnungszeiten|betriebsurlaub|geschlossen|entfällt"
    r"|kein training|kein kurs|keine probe|(?U)\bwiedereröffnung\b|\bneueröffnung\b|jetzt (wieder )?geöffnet)"
)
CLICKBAIT = r"(?i)\s*[-–—|/]*\s*(fast ausverkauft|ausverkauft|tickets? (jetzt )?sichern|jetzt tickets?( kaufen)?)\s*$"
DECORATION = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2764}\x{FE0F}]"
GENERIC_LOCATIONS = [
    "linz", "linz innenstadt", "innenstadt", "innenstadt linz", "stadt linz", "stadtgebiet linz", "linz-urfahr", "urfahr", "zentrum", "online",
    "oberösterreich", "österreich", "austria", "wien", "linz, austria", "linz, österreich", "verschiedene orte", "diverse", "tba", "t.b.a.",
]
ADDRESS_ONLY = r"(?iu)^\s*[\w.\-/ ]{0,40}?(straße|strasse|gasse|weg|platz|ring|allee)\s+\d+[a-z]?\b"
VENUE_STOP_TOKENS = ["linz", "wien", "der", "die", "das", "und", "am", "im", "an"]
STREET = r"(?iU)\b\w+(straße|strasse|gasse|weg|platz|ring|allee)\s+\d+"
ORGANISATION_WORDS = [
    "verein", "e.v.", "ev", "gmbh", "og", "kg", "club", "pfarre", "kirche", "universität", "uni", "institut", "verband", "chor", "schule",
    "zentrum", "haus", "bar", "café", "cafe", "theater", "museum", "galerie", "stadt", "linz", "team", "gruppe", "band", "orchester", "kulturverein",
]
RECURS = (
    r"(?iU)\b(jede[nrm]?\s|wöchentlich|monatlich|täglich|vierzehntägig|14-?tägig|alle\s+(zwei|drei|vier|zwölf|14)\s"
    r"|(montags|dienstags|mittwochs|donnerstags|freitags|samstags|sonntags))"
)
#: Words of explicit starting times, with hour and minute.
BEGINS = r"(?iU)\b(?:konzert|veranstaltungs|vorstellungs)beginn\s*:?\s*(\d{1,2})[:.](\d{2})(?:\s*uhr)?\b"


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, dict.fromkeys(words)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def rarely(text: Column, pattern: str, change: Callable[[str], str]) -> Column:
    """change(text) where the pattern stands in the text, by a batch function that gets no other text."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(change, na_action="ignore")

    odd = text.rlike(pattern)
    return F.when(odd, run(F.when(odd, text))).otherwise(text)


@functools.cache
def _foldings() -> tuple[str, str, str, str]:
    """Letters whose compatible decomposition has one ASCII character, and these; a class of those that have more, and what these become."""
    one, many = [], []
    for code in [*range(0x80, 0x3400), *range(0xA600, 0xAB70), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if plain:
            (one if len(plain) == 1 else many).append((chr(code), plain))
    letters, ascii_ = ("".join(x) for x in zip(*one, strict=True))
    ranges: list[list[int]] = []
    for code in (ord(c) for c, _ in many):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return letters, ascii_, "[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in ranges) + "]", "\x01".join(f"{c}\x02{p}" for c, p in many)


def fold(text: Column) -> Column:
    """Lower case with umlauts spelled out, in ASCII by compatible decomposition; what has none goes. Plain titles cost no more than the lower case."""
    letters, ascii_, odd, becomes = _foldings()
    s = F.lower(text)
    for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(umlaut), F.lit(plain))
    long = F.str_to_map(F.lit(becomes), F.lit("\x01"), F.lit("\x02"))
    spelled = F.when(s.rlike(odd), F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(long, c), c)), "")).otherwise(s)
    return F.when(s.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(spelled, letters, ascii_), r"[^\x00-\x7F]", "")).otherwise(s)


def title_words(title: Column) -> Column:
    """The words of a normalised title; null for null."""
    return F.filter(F.split(F.regexp_replace(fold(title), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def normalize_title(title: Column) -> Column:
    return F.array_join(title_words(title), " ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Entities unescaped twice (all of HTML's, by a batch function over the texts that have an ampersand), white space collapsed."""
    return collapse(rarely(text, "&", lambda t: html.unescape(html.unescape(t))))


def clean_title(title: Column, venue: Column) -> Column:
    """Without decoration, selling words and the venue's name at the end, also with the city behind it (if four characters are left)."""

    def without(t: Column) -> Column:
        v = F.lower(F.trim(venue))
        ends = lambda x: F.coalesce(F.lower(t).endswith(x) & (F.length(t) - F.length(x) >= 4), F.lit(False))
        city = F.concat(v, F.lit(" linz"))
        cut = F.when(F.coalesce(F.length(v), F.lit(0)) == 0, 0).when(ends(v), F.length(v)).when(ends(city), F.length(city)).otherwise(0)
        return F.when(cut > 0, F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - cut), r"[ \-–—|,/]+$", "")).otherwise(t)

    return let(collapse(F.regexp_replace(F.regexp_replace(title, DECORATION, " "), CLICKBAIT, "")), without)


def recurs(description: Column) -> Column:
    """Whether a text uses the words of a recurrence."""
    return description.rlike(RECURS)


def explicit_start(starts: Column, description: Column, day_only: Column) -> Column:
    """The start, or the one that a text names as the performance's, if only the day was known or they are six hours apart at most."""
    hour, minute = (F.regexp_extract(F.coalesce(description, F.lit("")), BEGINS, i).try_cast("int") for i in (1, 2))
    day = F.date_trunc("day", F.from_utc_timestamp(starts, "Europe/Vienna"))
    named = F.to_utc_timestamp(day + F.make_dt_interval(F.lit(0), hour, minute), "Europe/Vienna")
    close = day_only | (F.abs(F.unix_seconds(named) - F.unix_seconds(starts)) <= 6 * 3600)
    says = F.coalesce(description.rlike(BEGINS), F.lit(False))
    return F.when(says, F.when((hour <= 23) & (minute <= 59) & close, named).otherwise(starts)).otherwise(starts)


def is_placeholder(title: Column, source_name: Column) -> Column:
    """Nothing left of the title but generic words, numbers and the source's own name."""
    own = F.filter(title_words(title), lambda w: ~w.rlike("^[0-9]+$") & ~w.isin(*GENERIC_TITLE_WORDS))
    return F.size(F.array_except(own, F.coalesce(title_words(source_name), F.array().cast("array<string>")))) == 0


def is_non_event(title: Column) -> Column:
    return title.rlike(NON_EVENT)


def is_generic_location(name: Column) -> Column:
    low = collapse(F.lower(name))
    return low.isin(*GENERIC_LOCATIONS) | low.rlike(ADDRESS_ONLY)


def is_distinctive(name: Column) -> Column:
    """Specific enough for an asymmetric match: two long words, or one of six letters."""
    long = F.filter(F.regexp_extract_all(F.lower(name), F.lit(r"([\w\x{00E4}\x{00F6}\x{00FC}\x{00DF}]+)"), F.lit(1)), lambda w: (F.length(w) >= 4) & ~w.isin(*VENUE_STOP_TOKENS))
    return (F.size(long) >= 2) | ((F.size(long) == 1) & (F.length(F.get(long, F.lit(0))) >= 6))


def is_private(address: Column, organizer: Column) -> Column:
    """A street address with a number and an organiser that looks like a person's name."""
    words = F.filter(F.split(F.trim(organizer), r"\s+"), lambda w: w != "")
    named = F.forall(words, lambda w: ~F.regexp_replace(F.lower(w), r"^[.,()]+|[.,()]+$", "").isin(*ORGANISATION_WORDS) & w.rlike(r"^\p{Lu}"))
    return F.coalesce(address.rlike(STREET) & F.size(words).between(2, 3) & named, F.lit(False))


def compound_name_pattern(name: str) -> str:
    """Words joined by at most one blank or hyphen, at the end of a word."""
    import re

    return "(?iU)" + r"[-\s]?".join(re.escape(w) for w in re.split(r"[-\s]+", name.strip()) if w) + r"(?<=\w)(?!\w)"


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def domain_suffixes(host: Column) -> Column:
    """The host and every parent of it with two labels or more: what may be known instead."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags."""
    s = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    return clean_text(F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def haystack(*columns: Column) -> Column:
    """Lower-case letter runs of several texts."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit(r"(\p{L}+)"), F.lit(1))


def clean_tag(name: Column) -> Column:
    """Lower case, collapsed; null if empty, longer than 60, over three words, or with parentheses or a line break."""
    low = collapse(F.lower(name))
    bad = (low == "") | (F.length(low) > 60) | (F.size(F.split(low, " ")) > 3) | name.rlike(r"[()\n]")
    return F.when(~bad, low)
