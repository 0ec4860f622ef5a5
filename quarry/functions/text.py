"""Text functions of catalog search, as Column -> Column: no Python runs on the rows.

Accents are folded with translate over Latin-1 and Latin Extended-A (letters that decompose to one base letter); what decomposes to
several letters, or not at all, is kept. `fold_exact` is the Unicode version, in Arrow batches, for other scripts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _fold_map() -> tuple[str, str]:
    pairs = []
    for i in range(0xC0, 0x180):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(i):
            pairs.append((chr(i), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_map()

#: Italian words that say nothing about a part.
STOPWORDS = (
    "il lo la i gli le un uno una di del della dello dei delle degli da dal dalla in nel nella con per su e ed o che mi serve vorrei cerco cercare "
    "avere trovare pezzo ricambio ricambi codice dell all nell sull dall quell l un d c"
).split()
#: Further words left out of ranked search.
EMPTY_WORDS = (
    "anche ancora bisogno ho hai ha abbiamo avrei servono servirebbe serviva vorrei volevo cerco cercavo trattore trattorino macchina mezzo coso cosa "
    "affare aggeggio quello quella quelli quelle questo questa dove come quando metti mette mettere si ci va vanno sono sta stanno mio mia miei mie tuo "
    "tipo tutto tutti poi pure allora non no ok grazie ciao altro altra altri gli al alla ai agli sul sulla nei negli per tra fra sempre solo proprio "
    "fatto fatta intendo intendevo dicevo chiamato chiama sarebbe credo penso"
).split()
#: Words that a part's type leaves out.
TYPE_WORDS = ["mm", "x", "m", "p", "z", "kpl", "dx", "sx", "rh", "lh", "re", "li", "a", "d"]


def fold(c: Column) -> Column:
    """without accents."""
    return F.translate(F.coalesce(c, F.lit("")), FOLD_FROM, FOLD_TO)


@F.pandas_udf(StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    """F1 for all of Unicode: compatibility decomposition without combining marks."""
    return s.fillna("").map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def stem(c: Column) -> Column:
    """a final vowel goes from words of 4 letters or more, then an h from what still has 4."""
    return _stem_plain(F.lower(fold(c)))


def _stem_plain(w: Column) -> Column:
    """stem of what is lower case without accents; each step names its input once, so that nested uses don't multiply the plan."""
    return F.regexp_replace(F.regexp_replace(w, r"(?s)^(.{3,})[aeiou]$", "$1"), r"(?s)^(.{3,})h$", "$1")


def _in(c: Column, words: list[str]) -> Column:
    return c.isin(*sorted(set(words)))


def keywords(c: Column, most: int = 6) -> Column:
    """stems of the words that count, in order; words with digits stay as they are."""
    raw = F.split(F.coalesce(c, F.lit("")), r"[^0-9A-Za-zÀ-ÿ./-]+")
    based = F.transform(F.filter(raw, lambda w: w != ""), lambda w: F.lower(fold(w)))
    kept = F.filter(based, lambda w: ~_in(w, STOPWORDS) & (F.length(w) >= 2))
    return F.slice(F.transform(kept, lambda w: F.when(w.rlike("[0-9]"), w).otherwise(_stem_plain(w))), 1, most)


def normalize(c: Column) -> Column:
    """lower case without accents, dotted abbreviations closed up."""
    t = F.lower(fold(c))
    t = F.regexp_replace(t, r"\bp\.\s?t\.\s?o\b\.?", " pto ")
    return F.regexp_replace(t, r"\bs\.\s?a\.\s?c\b\.?", " sac ")


def _tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(normalize(c), F.lit("([a-z0-9]+)")), lambda w: ~w.rlike("^[0-9]+$") & (F.length(w) >= 2) & ~_in(w, STOPWORDS + EMPTY_WORDS))


def words(c: Column) -> Column:
    """the distinct stems of significant words."""
    return F.array_distinct(F.transform(_tokens(c), _stem_plain))


def numbers(c: Column) -> Column:
    """numbers in order, with a point."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:[.,]\d+)?)")), lambda n: F.replace(n, F.lit(","), F.lit(".")))


def is_subsequence(short: Column, long: Column) -> Column:
    """short's elements occur in long in this order."""
    return F.aggregate(long, F.lit(0), lambda i, x: F.when((i < F.size(short)) & (F.get(short, i) == x), i + 1).otherwise(i)) == F.size(short)


def looks_like_code(w: Column) -> Column:
    """F13."""
    return w.rlike(r"^[0-9][0-9a-z./-]{5,}$") & (F.contains(w, F.lit(".")) | w.rlike("^[0-9]+$"))


def part_type(c: Column) -> Column:
    """a description without measures, marks, side and notes."""
    t = F.regexp_replace(F.lower(fold(c)), r"\(.*?\)", " ")
    t = F.get(F.split(t, r"\s-\s"), F.lit(0))
    t = F.regexp_replace(t, r"[/.,\"'°\-]", " ")
    return F.array_join(F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~w.rlike("[0-9]") & ~_in(w, TYPE_WORDS)), " ")


def unrepeated(c: Column) -> Column:
    """"A B A B" becomes "A B"."""
    w = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    half = F.floor(F.size(w) / 2).cast("int")
    twice = (F.size(w) > 1) & (F.size(w) % 2 == 0) & (F.slice(w, F.lit(1), F.greatest(half, F.lit(1))) == F.slice(w, half + 1, F.greatest(half, F.lit(1))))
    return F.array_join(F.when(twice, F.slice(w, F.lit(1), half)).otherwise(w), " ")


def head_word(c: Column) -> Column:
    """F16: the stem of the first significant word, null without one."""
    return _stem_plain(F.get(_tokens(c), F.lit(0)))


def stem_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), stem(c))


def context(*cs: Column) -> Column:
    """what is not empty, joined by ' / '."""
    return F.concat_ws(" / ", *[F.nullif(c, F.lit("")) for c in cs])


def side(c: Column) -> Column:
    """the side a description names; left is tried first."""
    return F.when(c.rlike(r"(?i)\bL\.?\s?H\b|\bLEFT\b"), "sinistro").when(c.rlike(r"(?i)\bR\.?\s?H\b|\bRIGHT\b"), "destro")


def base_name(c: Column) -> Column:
    """a description up to its first digit, quote, diameter sign or "standard", without trailing signs and mm."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(t, r"(?s)([0-9\"Ø]|\bstandard\b).*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\s+\-/.,:;(]*(\bmm\b)?[\s+\-/.,:;(]*$", ""), r"\s+", " "))


def expand_models(c: Column) -> Column:
    """"MB 205, 280 , 350" -> [MB 205, MB 280, MB 350]: a bare number takes the first item's prefix; null if an item is neither."""
    items = F.transform(F.split(c, ","), lambda x: F.trim(x))
    prefix = F.regexp_extract(F.get(items, F.lit(0)), r"^([A-Za-z]+[ -]?)[0-9]", 1)
    out = F.transform(items, lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(prefix, x)).otherwise(x))
    good = F.forall(items, lambda x: x.rlike(r"^[0-9]+$") | x.rlike(r"^[A-Za-z]+[ -]?[0-9]+$")) & (prefix != "")
    return F.when(good, out)


def models_in_text(c: Column, prefix: str) -> Column:
    """model numbers after a prefix, with later ones shortened to their last digits: "HD-125 45 55" -> 125, 145, 155."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"\b{prefix}[ -]?([0-9]{{2,3}}(?:[ ,&/]+[0-9]{{2,3}})*)\b"), F.lit(1))
    first = F.get(found, F.lit(0))
    nums = F.regexp_extract_all(F.coalesce(first, F.lit("")), F.lit("([0-9]+)"))
    lead = F.get(nums, F.lit(0))
    return F.transform(nums, lambda n: F.when(F.length(n) < F.length(lead), F.concat(F.substring(lead, F.lit(1), F.length(lead) - F.length(n)), n)).otherwise(n))


def note_models(c: Column) -> Column:
    """models listed after "MOD."."""
    said = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)MOD\.\s*(.+)", 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(said, "[-,/]"), lambda x: F.trim(x)), lambda x: x != "")))


def quantities(qty: Column, models: Column) -> Column:
    """"(10-12-14)" zipped to the models, where there are as many; else null."""
    n = F.split(F.regexp_replace(qty, r"[()\s]", ""), "-")
    return F.when(F.size(n) == F.size(models), F.map_from_arrays(models, n))


def arrow_interval(c: Column) -> Column:
    """"sn: 00001→00905" -> {00001, 00905}; an open end is null, as is text without an arrow."""
    said = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*(?i:sn\s*:)?\s*\(?|\)?\s*$", "")
    ends = F.split(said, "→|->", 2)
    end = lambda i: F.nullif(F.trim(F.get(ends, F.lit(i))), F.lit(""))
    return F.when(F.size(ends) == 2, F.struct(end(0).alias("low"), end(1).alias("high")))


def name_and_interval(c: Column) -> Column:
    """F27 in a name: "Tigre 2000 (-> 15-09599)" -> name and interval."""
    tail = F.regexp_extract(c, r"(\([^()]*(?:→|->)[^()]*\))\s*$", 1)
    return F.struct(F.trim(F.regexp_replace(c, r"\s*\([^()]*(?:→|->)[^()]*\)\s*$", "")).alias("name"), F.when(tail != "", arrow_interval(tail)).alias("interval"))


def clean(c: Column) -> Column:
    """HTML to text: tags go, the common entities are read, white space is collapsed."""
    t = F.regexp_replace(c, r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def drawing_url(base: str, catalog: Column, table: Column) -> Column:
    """base/catalog/dis/sq<table>.gif, with the catalog encoded."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.replace(F.url_encode(catalog), F.lit("+"), F.lit("%20")), F.lit("/dis/sq"), table.cast("string"), F.lit(".gif"))


def italian_number(c: Column) -> Column:
    """"1.234,5" -> 1234.5; null where it is no number."""
    return F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def first_integer(c: Column) -> Column:
    """the first run of digits."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)", 1), F.lit("")).try_cast("long")


def spaced(c: Column) -> Column:
    """"5105DF" -> "5105 DF"."""
    return F.regexp_replace(c, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ")


def after_arrow(c: Column) -> Column:
    """F32: what follows the last "->"."""
    return F.trim(F.element_at(F.split(c, "->"), -1))


def pack_id(*cs: Column) -> Column:
    """F33."""
    return F.concat_ws(":", *[c.cast("string") for c in cs])


def unpack_id(c: Column, i: int) -> Column:
    return F.get(F.split(c, ":"), F.lit(i))


#: What a user says who goes on to another machine.
ANOTHER_MACHINE = (
    "un'altra macchina", "altra macchina", "un altro trattore", "altro trattore", "cambiamo macchina", "nuova macchina", "un'altra domanda su",
    "passiamo a(?:d)? un'?altra?", "passiamo al(?:la)? (?:macchina|trattore)",
)


def asks_another_machine(c: Column) -> Column:
    """the text speaks of another machine."""
    return c.rlike(rf"(?i)\b({'|'.join(ANOTHER_MACHINE)})\b")


def position_number(c: Column) -> Column:
    """"11.2" -> 11."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d+)", 1), F.lit("")).try_cast("int")


def evaluation_words(c: Column) -> Column:
    """words of 3 letters or more, without the last letter of those over 4."""
    found = F.regexp_extract_all(F.lower(fold(c)), F.lit("([a-z]{3,})"))
    return F.array_distinct(F.transform(found, lambda w: F.when(F.length(w) > 4, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def natural_key(*cs: Column) -> Column:
    """Pieces between _ - . and blanks; numbers compare as numbers and come before letters."""
    pieces = F.filter(F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), r"[_\-.\s]+") for c in cs])), lambda p: p != "")
    digits = lambda p: p.rlike("^[0-9]+$")
    return F.transform(pieces, lambda p: F.struct(F.when(digits(p), 0).otherwise(1).alias("kind"), F.when(digits(p), p.try_cast("long")).otherwise(0).alias("n"), F.when(digits(p), F.lit("")).otherwise(F.upper(p)).alias("s")))


def token_keys(w: Column) -> Column:
    """Two tokens match (equal, or one the start of the other, the shorter of 4 letters or more and at most 2 fewer) if and only if one is among the
    other's keys: itself and its forms without the last one or two letters, if these have 4."""
    n = F.length(w)
    return F.filter(F.array(w, F.when(n >= 5, F.substring(w, F.lit(1), n - 1)), F.when(n >= 6, F.substring(w, F.lit(1), n - 2))), lambda k: k.isNotNull())


def token_match(a: Column, b: Column) -> Column:
    """J13 for two columns."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(short) >= 4) & (F.length(long) - F.length(short) <= 2) & F.startswith(long, short))
