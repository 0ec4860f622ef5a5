"""Whether a request speaks of another machine, or names a brand: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import serials as S
from quarry.functions import text as T


def normal(c: Column) -> Column:
    """lower case without accents; whatever is no letter a-z or digit is one blank. Null is empty."""
    return F.trim(F.regexp_replace(F.lower(T.fold(c)), "[^a-z0-9]+", " "))


def model_words(name: Column, brands: list[str]) -> Column:
    """the distinct words of 2 characters or more of a machine's name that name no brand."""
    words = F.array_distinct(F.filter(F.split(normal(name), " "), lambda w: F.length(w) >= 2))
    return F.array_except(words, F.array(*[F.lit(b) for b in brands]).cast("array<string>"))


def machine_changed(serial: Column, model: Column, active_serial: Column, active_model: Column, brands: list[str]) -> Column:
    """the serial is not the active one, or the models have no word in common, or both have numbers and none in common. What either side
    does not say (null, empty or brand words alone) changes nothing."""
    number = lambda words: F.filter(words, lambda w: w.rlike("^[0-9]+$"))
    apart = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    new, old = S.cleaned(serial), S.cleaned(active_serial)
    a, b = model_words(model, brands), model_words(active_model, brands)
    return ((new != "") & (old != "") & (new != old)) | apart(a, b) | apart(number(a), number(b))


def declared_brand(quote: Column, brand: Column, message: Column, groups: list[list[str]]) -> Column:
    """the message holds the quoted words, or a name of the brand's group of aliases: one word as a whole word, several as they stand.
    An empty quote and a brand of no group declare nothing. Groups are a few names each."""
    text, said = normal(message), normal(quote)
    declared = (said != "") & F.contains(text, said)
    for group in groups:
        named = F.lit(False)
        for alias in group:
            named = named | (F.contains(text, F.lit(alias)) if " " in alias else F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {alias} ")))
        declared = declared | (normal(brand).isin(*group) & named)
    return declared
