"""Text functions as columns: everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in a query.
QUERY_STOPWORDS = (
    "a an and any are as at be by can do for from get give has have how i in is it its me my of on or please the "
    "then there this to want was we what when where which will with would you your"
).split()
# Words that carry no content in a description.
DESCRIPTION_STOPWORDS = (
    "a an and any are as at be by can for from has have in including is it its of on or that the their them this to "
    "up was which with given before yet not already across current specific chosen full each how soon than if may "
    "also per when where who will would"
).split()
# Informal spellings.
INFORMAL = {
    "restaurant": "resto",
    "restaurants": "restos",
    "reservation": "resrvation",
    "reserve": "resrve",
    "available": "availabe",
    "availability": "availablity",
    "grocery": "grocry",
    "groceries": "grocerys",
    "delivery": "delivry",
    "deliver": "delivr",
    "cancel": "cancle",
    "order": "ordr",
    "please": "pls",
    "tonight": "2nite",
    "tomorrow": "tmrw",
    "table": "tabel",
    "product": "prodct",
    "products": "prodcts",
    "essentials": "essentails",
    "discount": "discnt",
    "offers": "offrs",
    "menu": "menue",
    "basket": "baskt",
    "checkout": "chekout",
    "track": "trak",
    "search": "serch",
    "near": "nr",
    "my": "me",
}


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")


def tokenize(text: Column) -> Column:
    """camelCase split, lower case, runs of a-z and 0-9; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(split_camel(text)), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def char_ngrams(token: Column, n: int = 3) -> Column:
    """n-grams of ``#token#``; the padded token itself where it is no longer than n."""
    padded = F.concat(F.lit("#"), token, F.lit("#"))
    return F.when(F.length(padded) <= n, F.array(padded)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
    )


def content_terms(text: Column) -> Column:
    """Distinct tokens in order, without one-letter ones and stop words."""
    return F.array_distinct(F.array_except(F.filter(tokenize(text), lambda t: F.length(t) >= 2), _strings(QUERY_STOPWORDS)))


def term_overlap(terms: Column, target: Column) -> Column:
    """The terms, in order, that are tokens of the target."""
    return F.array_intersect(terms, tokenize(target))


def keywords(text: Column, limit: int = 8) -> Column:
    """The first distinct content words of a description: letters and hyphens, three characters or more."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z\-]+"), F.lit(0))
    return F.slice(F.array_except(F.filter(found, lambda t: F.length(t) >= 3), _strings(DESCRIPTION_STOPWORDS)), 1, limit)


def humanize_identifier(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(split_camel(name), r"[_\-.:/]+", " "), r"\s+", " ")))


def action_phrase(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(split_camel(name), r"[_\-.]+", " ")))


def object_phrase(name: Column) -> Column:
    """The action phrase without its first word, unless it has no other."""
    parts = words(action_phrase(name))
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), " ")).otherwise(F.array_join(parts, " "))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters or 1.3 a word, whichever is more; 0 for nothing."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.greatest(F.floor(F.length(text) / 4), F.floor(F.size(words(text)) * F.lit(13) / F.lit(10)), F.lit(1).cast("long"))
    ).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def typo_map(text: Column, salt: str = "") -> Column:
    """Informal spellings, else two letters swapped at a place that a hash of the text picks; lower case."""
    table = F.create_map(*(F.lit(x) for pair in INFORMAL.items() for x in pair))
    bare = lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")

    def swapped(word: Column, draw: Column) -> Column:
        pos = F.lit(1) + draw % (F.length(word) - 3)
        return F.concat(
            F.substring(word, F.lit(1), pos), F.substring(word, pos + 2, F.lit(1)), F.substring(word, pos + 1, F.lit(1)), F.substring(word, pos + 3, F.length(word))
        )

    def with_swap(plain: Column) -> Column:
        draw = lambda start: F.conv(F.substring(F.md5(F.concat(F.lit(salt), plain)), start, 7), 16, 10).cast("int")
        marked = let(words(plain), lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        place = lambda ms: let(F.filter(ms, lambda m: F.length(m["w"]) > 4), lambda long: F.get(long, draw(1) % F.size(long))["i"])
        changed = lambda ms, at: F.transform(ms, lambda m: F.when(m["i"] == at, swapped(m["w"], draw(9))).otherwise(m["w"]))
        return let(marked, lambda ms: let(place(ms), lambda at: F.array_join(changed(ms, at), " ")))

    def typo(parts: Column) -> Column:
        known = F.exists(parts, lambda w: F.array_contains(_strings(list(INFORMAL)), bare(w)))
        informal = F.lower(F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(table, bare(w)), w)), " "))
        plain = F.lower(F.array_join(parts, " "))
        swappable = (F.length(plain) > 8) & F.exists(parts, lambda w: F.length(F.lower(w)) > 4)
        return F.when(known, informal).when(swappable, let(plain, with_swap)).otherwise(plain)

    return F.regexp_replace(let(words(text), typo), "[?.]+$", "")


def score_band(score: Column) -> Column:
    return F.when(score >= 0.85, "very high").when(score >= 0.70, "high").when(score >= 0.55, "moderate").otherwise("low")
