"""Pair scores from columns: trigrams, titles, venues, claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTO_MERGE, GREY_ZONE, SECOND_OPINION = 0.80, 0.50, 0.65


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the whole text, two blanks before and one after it."""
    p = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def word_trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, each padded by itself."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def word_trigram_run(text: Column) -> Column:
    """The same in their order, with repeats."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def extent_similarity(grams: Column, run: Column) -> Column:
    """Largest Jaccard similarity between a set of trigrams and those of a continuous part of a run of trigrams.

    A best part begins and ends with a common trigram, or it would do better without its ends; so only such parts are tried.
    """
    places = F.filter(F.transform(run, lambda x, i: F.when(F.array_contains(grams, x), i)), lambda i: i.isNotNull())

    def part(i: Column, j: Column) -> Column:
        piece = F.array_distinct(F.slice(run, i + 1, j - i + 1))
        common = F.size(F.array_intersect(piece, grams))
        return common / (F.size(grams) + F.size(piece) - common)

    tried = F.transform(places, lambda i: F.array_max(F.transform(F.filter(places, lambda j: j >= i), lambda j: part(i, j))))
    return F.coalesce(F.array_max(tried), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set's members in the other."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def title_similarity(trigrams_a: Column, words_a: Column, trigrams_b: Column, words_b: Column) -> Column:
    """Larger of trigram Jaccard and capped word containment: never enough to merge by containment alone."""
    cap = F.when(F.least(F.size(F.array_distinct(words_a)), F.size(F.array_distinct(words_b))) == 1, 0.60).otherwise(0.72)
    return F.greatest(jaccard(trigrams_a, trigrams_b), containment(words_a, words_b) * cap)


def time_score(a: Column, b: Column, known: Column) -> Column:
    minutes = F.abs(F.unix_micros(a) - F.unix_micros(b)) / 60e6
    return F.when(~F.coalesce(known, F.lit(False)), 0.5).when(minutes <= 30, 1.0).when(minutes <= 180, 0.4).otherwise(0.0)


def venue_score(venue_a: Column, venue_b: Column, cell_a: Column, cell_b: Column) -> Column:
    both = venue_a.isNotNull() & venue_b.isNotNull()
    return F.when(venue_a == venue_b, 1.0).when(both, 0.0).when((cell_a != "") & (cell_a == cell_b), 0.8).otherwise(0.5)


def url_score(a: Column, b: Column) -> Column:
    host = lambda u: F.when(F.contains(u, F.lit("//")), F.get(F.split(u, "/"), F.lit(2)))
    plain = lambda u: F.regexp_replace(u, "/+$", "")
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.4).when(plain(a) == plain(b), 1.0).when((host(a) != "") & (host(a) == host(b)), 0.6).otherwise(0.4)


def pair_score(title: Column, time: Column, venue: Column, organizer: Column, url: Column) -> Column:
    return 0.35 * title + 0.25 * time + 0.20 * venue + 0.10 * organizer + 0.10 * url


def classify(score: Column) -> Column:
    return F.when(score > AUTO_MERGE, "merge").when(score >= GREY_ZONE, "adjudicate").otherwise("distinct")


def token_similarity(token: Column, word: Column) -> Column:
    """1 if equal; 0.75 if the word ends in the token and up to three letters; else trigram Jaccard."""
    at = F.instr(F.reverse(word), F.reverse(token))  # letters after the last occurrence, plus one
    return F.when(token == word, 1.0).when((F.length(token) >= 4) & (at > 0) & (at - 1 <= 3), 0.75).otherwise(jaccard(trigrams(token), trigrams(word)))


def near_token(token: str, word: Column, n_grams: Column) -> Column:
    """token_similarity of a known token, from the number of the word's trigrams: no arrays are built for each token."""
    own = sorted({f"  {token} "[i : i + 3] for i in range(len(token) + 1)})
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    common = sum((F.contains(padded, F.lit(g)).cast("int") for g in own), F.lit(0))
    at = F.instr(F.reverse(word), F.lit(token[::-1]))
    ends = (at > 0) & (at <= 4) if len(token) >= 4 else F.lit(False)
    return F.when(word == token, 1.0).when(ends, 0.75).otherwise(common / (len(own) + n_grams - common))


def relatedness(cosine: Column) -> Column:
    """Calibrated relatedness of two unit vectors: a logistic of their cosine."""
    return 1.0 / (1.0 + F.exp((0.366 - cosine) / 0.098))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)

