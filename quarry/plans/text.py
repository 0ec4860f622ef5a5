"""Queries of the text and serial functions, over strings that the tables give or that are built from their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import serials as S
from quarry.functions import text as T
from quarry.operators.ordering import global_rank
from quarry.registry import query
from quarry.sources.tables import load


def padded(key: str, digits: int):
    """A key with zeros before it up to so many digits; longer keys stay whole, where lpad would cut them."""
    text = F.col(key).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0"))


def _list(words: list[str]) -> str:
    return "[" + ",".join("'" + w + "'" for w in sorted(set(words))) + "]"


STOP, MORE, TYPES = _list(T.STOPWORDS), _list(T.STOPWORDS + T.EMPTY_WORDS), _list(T.TYPE_WORDS)
FOLD = f"translate({{}}, '{T.FOLD_FROM}', '{T.FOLD_TO}')"


def _fold(x: str) -> str:
    return FOLD.format(f"coalesce({x}, '')")


def _stem(x: str) -> str:
    """SQL of stem() over text that is folded and lower-case already."""
    cut = f"(CASE WHEN length({x}) >= 4 AND right({x}, 1) IN ('a','e','i','o','u') THEN left({x}, length({x}) - 1) ELSE {x} END)"
    return f"(CASE WHEN length({cut}) >= 4 AND right({cut}, 1) = 'h' THEN left({cut}, length({cut}) - 1) ELSE {cut} END)"


def _normal(x: str) -> str:
    t = f"lower({_fold(x)})"
    t = f"regexp_replace({t}, '\\bp\\.\\s?t\\.\\s?o\\b\\.?', ' pto ', 'g')"
    return f"regexp_replace({t}, '\\bs\\.\\s?a\\.\\s?c\\b\\.?', ' sac ', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all({_normal(x)}, '[a-z0-9]+'), lambda w: NOT regexp_full_match(w, '[0-9]+') AND length(w) >= 2 AND NOT list_contains({MORE}, w))"


WORDS_SQL = "SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents"


def _words(spark, d):
    return load(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").distinct()


@query(f"SELECT word, strip_accents(word) AS folded FROM ({WORDS_SQL}) WHERE word <> ''")
def f1_fold_accents(spark, d):
    return _words(spark, d).select("word", T.fold(F.col("word")).alias("folded"))


@query(f"SELECT word, strip_accents(word) AS folded FROM ({WORDS_SQL}) WHERE word <> ''")
def f1_fold_exact(spark, d):
    return _words(spark, d).select("word", T.fold_exact("word").alias("folded"))


@query(f"SELECT word, {_stem('low')} AS stem FROM (SELECT word, lower({_fold('word')}) AS low FROM ({WORDS_SQL}) WHERE word <> '')")
def f2_stem(spark, d):
    return _words(spark, d).select("word", T.stem(F.col("word")).alias("stem"))


@query(f"""SELECT item_id, array_to_string(list_transform(list_filter(list_transform(list_filter(regexp_split_to_array(text, '[^0-9A-Za-zÀ-ÿ./-]+'), lambda w: w <> ''), lambda w: lower({_fold('w')})),
  lambda w: NOT list_contains({STOP}, w) AND length(w) >= 2), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN w ELSE {_stem('w')} END)[1:6], ' ') AS keywords FROM benchmark""")
def f3_keywords(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query(f"SELECT doc_id, md5({_normal('text')}) AS normal FROM documents")
def f4_normalize(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal"))


@query(f"SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_transform({_tokens('text')}, lambda w: {_stem('w')}))), ' ')) AS words FROM documents")
def f5_words(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(T.words(F.col("text"))), " ")).alias("words"))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[0-9]+([.,][0-9]+)?'), lambda n: replace(n, ',', '.')), ' ') AS numbers FROM documents")
def f6_numbers(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), " ").alias("numbers"))


@query("SELECT p_partkey, regexp_matches(p_partkey::VARCHAR, array_to_string(regexp_extract_all(p_size::VARCHAR, '.'), '.*')) AS inside FROM part")
def f7_subsequence(spark, d):
    chars = lambda c: F.split(F.col(c).cast("string"), "")
    return load(spark, d, "part").select("p_partkey", T.is_subsequence(chars("p_size"), chars("p_partkey")).alias("inside"))


@query("""SELECT p_partkey, CASE WHEN regexp_full_match(s, '[A-Za-z][0-9]{4,7}') THEN upper(s[1]) END AS letter, CASE WHEN regexp_full_match(s, '[A-Za-z][0-9]{4,7}') THEN s[2:]::BIGINT END AS n
  FROM (SELECT p_partkey, lower(p_name[1]) || (p_partkey * 37)::VARCHAR AS s FROM part)""")
def f8_letter_serial(spark, d):
    s = F.concat(F.lower(F.substring("p_name", 1, 1)), (F.col("p_partkey") * 37).cast("string"))
    return load(spark, d, "part").select("p_partkey", S.letter_key(s).alias("k")).select("p_partkey", "k.letter", "k.n")


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey END AS n FROM part")
def f9_tail_serial(spark, d):
    s = F.when(F.col("p_partkey") % 9 == 0, F.lit("08-x1")).otherwise(F.concat(F.lit("08-"), padded("p_partkey", 6)))
    return load(spark, d, "part").select("p_partkey", S.tail_key(s).alias("n"))


SERIAL = "p_brand || '-wt ' || CASE WHEN p_partkey % 3 = 0 THEN lpad(p_partkey::VARCHAR, 5, '0') WHEN p_partkey % 3 = 1 THEN 'x' || (p_partkey % 1000)::VARCHAR ELSE 'abc' END"


def _serial():
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, F.lpad(k.cast("string"), 5, "0")).when(k % 3 == 1, F.concat(F.lit("x"), (k % 1000).cast("string"))).otherwise("abc")
    return F.concat("p_brand", F.lit("-wt "), tail)


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(s, '[0-9]{{5}}$') THEN left(s, length(s) - 5) WHEN regexp_matches(s, '[0-9]$') THEN regexp_extract(s, '^(.*?)([0-9]+)$', 1) END AS prefix,
  CASE WHEN regexp_matches(s, '[0-9]{{5}}$') THEN right(s, 5)::BIGINT WHEN regexp_matches(s, '[0-9]$') THEN regexp_extract(s, '^(.*?)([0-9]+)$', 2)::BIGINT END AS n
  FROM (SELECT p_partkey, upper(regexp_replace({SERIAL}, '[\\s\\-_.]', '', 'g')) AS s FROM part)""")
def f10_split_serial(spark, d):
    return load(spark, d, "part").select("p_partkey", S.split_serial(_serial()).alias("k")).select("p_partkey", "k.prefix", "k.n")


@query("SELECT p_partkey, 'WVT' AS prefix, unnest([10000 + p_partkey, 50000 + p_size])::BIGINT AS n FROM part")
def f11_catalog_starts(spark, d):
    s = F.concat(F.lit("WVT"), (F.col("p_partkey") + 10000).cast("string"), F.lit(" / "), (F.col("p_size") + 50000).cast("string"))
    return load(spark, d, "part").select("p_partkey", F.inline(S.catalog_starts(s, 18)))  # keys of any length: WVT100000 is no 1 before five digits


@query(f"SELECT p_partkey, regexp_full_match(s, '[0-9]+') AS digits, length(s) >= 15 AS whole FROM (SELECT p_partkey, upper(regexp_replace(CASE WHEN p_size < 10 THEN p_partkey::VARCHAR ELSE {SERIAL} || 'zz' END, '[\\s\\-_.]', '', 'g')) AS s FROM part)")
def f12_serial_kind(spark, d):
    s = F.when(F.col("p_size") < 10, F.col("p_partkey").cast("string")).otherwise(F.concat(_serial(), F.lit("zz")))
    return load(spark, d, "part").select("p_partkey", S.digits_only(s).alias("digits"), S.is_full_frame_number(s).alias("whole"))


@query("SELECT p_partkey, regexp_full_match(s, '[0-9][0-9a-z./-]{5,}') AND (contains(s, '.') OR regexp_full_match(s, '[0-9]+')) AS code FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2.0112.' || p_partkey WHEN 1 THEN '11' || lpad(p_partkey::VARCHAR, 6, '0') WHEN 2 THEN '9abc-' || p_partkey ELSE p_name END AS s FROM part)")
def f13_looks_like_code(spark, d):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.concat(F.lit("2.0112."), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("11"), F.lpad(k.cast("string"), 6, "0"))).when(k % 4 == 2, F.concat(F.lit("9abc-"), k.cast("string"))).otherwise(F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", T.looks_like_code(s).alias("code"))


@query(f"""SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_split_to_array(regexp_replace(lower({_fold("p_name || ' 25 x 32 (nota) d/sx kpl''s - RH'")}), '\\(.*?\\)', ' ', 'g'), '\\s-\\s')[1], '[/.,"''°\\-]', ' ', 'g'), '\\s+'),
  lambda w: w <> '' AND NOT regexp_matches(w, '[0-9]') AND NOT list_contains({TYPES}, w)), ' ') AS type FROM part""")
def f14_part_type(spark, d):
    return load(spark, d, "part").select("p_partkey", T.part_type(F.concat("p_name", F.lit(" 25 x 32 (nota) d/sx kpl's - RH"))).alias("type"))


@query("SELECT p_partkey, p_name AS name FROM part")
def f15_unrepeated(spark, d):
    twice = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", "p_name")).otherwise(F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", T.unrepeated(twice).alias("name"))


@query(f"SELECT item_id, {_stem('w')} AS head FROM (SELECT item_id, {_tokens('text')}[1] AS w FROM benchmark)")
def f16_head_word(spark, d):
    return load(spark, d, "benchmark").select("item_id", T.head_word(F.col("text")).alias("head"))


@query("SELECT p_partkey, concat_ws(' / ', nullif(CASE WHEN p_size > 25 THEN p_type ELSE '' END, ''), nullif(p_brand, ''), CASE WHEN p_size % 2 = 0 THEN p_name END) AS context FROM part")
def f17_context(spark, d):
    return load(spark, d, "part").select("p_partkey", T.context(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_name"))).alias("context"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'sinistro' WHEN 1 THEN 'destro' WHEN 2 THEN 'sinistro' END AS side FROM part")
def f18_side(spark, d):
    tail = F.element_at(F.array(F.lit(" L.H. RH"), F.lit(" Right"), F.lit(" left"), F.lit(" elh")), F.col("p_size") % 4 + 1)
    return load(spark, d, "part").select("p_partkey", T.side(F.concat("p_name", tail)).alias("side"))


@query("SELECT p_partkey, p_name AS base FROM part")
def f19_base_name(spark, d):
    tail = F.element_at(F.array(F.lit(" 215.6x222.4"), F.lit(" + mm 0.25"), F.lit(" STANDARD")), F.col("p_size") % 3 + 1)
    return load(spark, d, "part").select("p_partkey", T.base_name(F.concat("p_name", tail)).alias("base"))


@query("SELECT p_partkey, array_to_string(['MB ' || (200 + p_size), 'MB ' || (300 + p_size)], ';') AS models FROM part")
def f24_expand_models(spark, d):
    s = F.concat(F.lit("MB "), (F.col("p_size") + 200).cast("string"), F.lit(" , "), (F.col("p_size") + 300).cast("string"))
    return load(spark, d, "part").select("p_partkey", F.array_join(T.expand_models(s), ";").alias("models"))


@query("SELECT p_partkey, '85;85F;' || (90 + p_size) AS models FROM part WHERE p_size < 9 UNION ALL SELECT p_partkey, (90 + p_size) || ';' || '85;85F' FROM part WHERE p_size >= 10 UNION ALL SELECT p_partkey, '85;85F;99' FROM part WHERE p_size = 9")
def f23_note_models(spark, d):
    return load(spark, d, "part").select("p_partkey", F.array_join(T.note_models(F.concat(F.lit("(2) mod. 85 - 85F, "), (F.col("p_size") + 90).cast("string"))), ";").alias("models"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS second FROM part")
def f25_quantity_list(spark, d):
    q = F.concat(F.lit("(10-"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ")").otherwise("-3)"))
    return load(spark, d, "part").select("p_partkey", F.element_at(T.quantities(q, F.array(F.lit("A"), F.lit("B"))), "B").alias("second"))


@query("SELECT p_partkey, '125;1' || lpad((p_size % 90 + 10)::VARCHAR, 2, '0') || ';155' AS models FROM part")
def f26_models_in_text(spark, d):
    s = F.concat(F.col("p_name"), F.lit(" HD-125 "), (F.col("p_size") % 90 + 10).cast("string"), F.lit(" & 55"))
    return load(spark, d, "part").select("p_partkey", F.array_join(T.models_in_text(s, "HD"), ";").alias("models"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN lpad(p_size::VARCHAR, 5, '0') END AS low, CASE WHEN p_partkey % 3 <> 2 THEN '15-' || p_partkey END AS high FROM part WHERE p_partkey % 3 > 0 OR TRUE")
def f27_arrow_interval(spark, d):
    k = F.col("p_partkey")
    low, high = F.when(k % 3 != 1, F.lpad(F.col("p_size").cast("string"), 5, "0")).otherwise(""), F.when(k % 3 != 2, F.concat(F.lit("15-"), k.cast("string"))).otherwise("")
    return load(spark, d, "part").select("p_partkey", T.arrow_interval(F.concat(F.lit("sn: "), low, F.lit("→"), high)).alias("i")).select("p_partkey", "i.low", "i.high")


@query("SELECT p_partkey, p_name AS name, CASE WHEN p_size > 20 THEN '15-' || p_size END AS high FROM part")
def f27_name_interval(spark, d):
    s = F.when(F.col("p_size") > 20, F.concat("p_name", F.lit(" (-> 15-"), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", T.name_and_interval(s).alias("x")).select("p_partkey", "x.name", "x.interval.high")


@query("SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<script\\b(?s:.*?)</script>|<style\\b(?s:.*?)</style>|<!--(?s:.*?)-->|<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS body FROM pages")
def f28_clean_html(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(T.clean(F.col("html"))).alias("body"))


@query("SELECT p_partkey, 'https://parts.example.org/cat/' || replace(replace(p_name, ' ', '%20'), '#', '%23') || '/dis/sq' || p_partkey || '.gif' AS url FROM part")
def f29_drawing_url(spark, d):
    return load(spark, d, "part").select("p_partkey", T.drawing_url("https://parts.example.org/cat", F.col("p_name"), F.col("p_partkey")).alias("url"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 1000 + p_size + 0.5 END::DOUBLE AS number, p_size::BIGINT AS first FROM part")
def f30_numbers(spark, d):
    s = F.when(F.col("p_size") % 10 == 0, F.lit("n.d.")).otherwise(F.concat(F.lit(" 1."), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(",5 ")))
    return load(spark, d, "part").select("p_partkey", T.italian_number(s).alias("number"), T.first_integer(F.concat(F.lit("pos."), F.col("p_size").cast("string"), F.lit(".7"))).alias("first"))


@query("SELECT p_partkey, p_partkey || ' DF ' || p_size AS spaced FROM part")
def f31_spacing(spark, d):
    return load(spark, d, "part").select("p_partkey", T.spaced(F.concat(F.col("p_partkey").cast("string"), F.lit("DF"), F.col("p_size").cast("string"))).alias("spaced"))


@query("SELECT p_partkey, p_brand AS vin FROM part")
def f32_after_arrow(spark, d):
    return load(spark, d, "part").select("p_partkey", T.after_arrow(F.concat("p_name", F.lit(" -> x -> "), "p_brand")).alias("vin"))


@query("SELECT p_partkey, p_brand || ':' || p_size || ':' || p_partkey AS id, p_size::VARCHAR AS middle FROM part")
def f33_pack_id(spark, d):
    packed = load(spark, d, "part").select("p_partkey", T.pack_id(F.col("p_brand"), F.col("p_size"), F.col("p_partkey")).alias("id"))
    return packed.select("*", T.unpack_id(F.col("id"), 1).alias("middle"))


SAID = ("Cambiamo macchina?", "un'altra domanda su questo", "passiamo al trattore", "passiamo ad un'altra", "un diverso modello", "un mezzo nuovo", "altro trattore")


@query(
    "SELECT conv_id, turn, regexp_matches(coalesce(text, '') || ' ' || (["
    + ", ".join("'" + x.replace("'", "''") + "'" for x in SAID)
    + f"])[(conv_id + turn) % {len(SAID)} + 1], '(?i)\\b("
    + "|".join(T.ANOTHER_MACHINE).replace("'", "''")
    + ")\\b') AS asks FROM conversations"
)
def f36_another_machine(spark, d):
    said = F.element_at(F.array(*map(F.lit, SAID)), ((F.col("conv_id") + F.col("turn")) % len(SAID) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), said)
    return load(spark, d, "conversations").select("conv_id", "turn", T.asks_another_machine(text).alias("asks"))


@query("SELECT p_partkey, 'Part ' || p_partkey || ' - ' || p_name || ' (' || p_type || ')' AS rich, p_name AS base FROM part")
def f38_texts(spark, d):
    return load(spark, d, "part").select("p_partkey", F.format_string("Part %d - %s (%s)", "p_partkey", "p_name", "p_type").alias("rich"), F.col("p_name").alias("base"))


@query("SELECT p_partkey, p_size AS n FROM part")
def f40_position_number(spark, d):
    return load(spark, d, "part").select("p_partkey", T.position_number(F.concat(F.col("p_size").cast("string"), F.lit(".2"))).alias("n"))


@query(f"SELECT item_id, md5(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower({_fold('text')}), '[a-z]{{3,}}'), lambda w: CASE WHEN length(w) > 4 THEN left(w, length(w) - 1) ELSE w END))), ' ')) AS words FROM benchmark")
def f43_evaluation_words(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.md5(F.array_join(F.array_sort(T.evaluation_words(F.col("text"))), " ")).alias("words"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size % 12, CASE WHEN p_size % 2 = 0 THEN 'B' ELSE 'C' END, p_partkey) AS place FROM part")
def o4_natural_order(spark, d):
    name = F.concat((F.col("p_size") % 12).cast("string"), F.lit("_"), F.when(F.col("p_size") % 2 == 0, "B").otherwise("c"))
    return global_rank(load(spark, d, "part").select("p_partkey", T.natural_key(name).alias("key")), F.col("key"), F.col("p_partkey")).select("p_partkey", "place")
