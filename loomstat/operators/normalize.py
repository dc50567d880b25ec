"""Row normalisation: codes, dates, classes of sources, text cleaning, redaction, record rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_word, cases, reasons
from .sizes import sent

# Rules from a source's name to its class, in order, and the weight of each class.
SOURCE_RULES = [("click", "news"), ("view", "community"), ("purchase", "official"), ("signup", "advocacy"), ("error", "system")]
CLASS_WEIGHT = {"news": 0.8, "community": 0.5, "official": 1.0, "advocacy": 0.6, "system": 0.4}
DATE_FORMATS = ["dd MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "yyyyMMdd"]
# Redaction: patterns in the common subset of regex dialects, with their markers, in this order.
SCRUB = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[PHONE]"),
    (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[SSN]"),
    (r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}", "[PHONE]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]"),
    (r"[0-9]{16}", "[CARD]"),
]
MARKER_TYPES = ["EMAIL", "PHONE", "SSN", "IP", "CARD"]


def pad_region(code: Column) -> Column:
    """A five-character code, zeros on the left."""
    return F.lpad(F.trim(code.cast("string")), 5, "0")


def classify(name: Column, rules: list[tuple[str, str]], otherwise: str = "other", regex: bool = True) -> Column:
    """The class of the first rule whose pattern is found in the name, case-insensitive."""
    low = F.lower(name)
    return cases([(low.rlike(p) if regex else low.contains(p), c) for p, c in rules], otherwise)


def source_weight(name: Column, exact: dict[str, float], rules: list[tuple[str, str]], weights: dict[str, float], default: float = 0.3) -> Column:
    """Reliability of a source: an exact entry, else the weight of the first rule's class, else the default."""
    pairs = [(F.lower(name) == k, F.lit(v)) for k, v in exact.items()]
    pairs += [(F.lower(name).contains(p), F.lit(weights[c])) for p, c in rules]
    return cases(pairs, default)


def parse_date(text: Column, formats: list[str] | None = None) -> Column:
    """The first format that fits; null if none does. A leading weekday, as in RFC 822, is left out."""
    text = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats or DATE_FORMATS])


def date_in_text(text: Column) -> Column:
    """The first ISO or US date in free text, as a timestamp."""
    iso = F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    us = F.regexp_extract(text, r"([0-9]{2}/[0-9]{2}/[0-9]{4})", 1)
    return F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), F.try_to_timestamp(us, F.lit("MM/dd/yyyy")))


def html_to_text(html: Column) -> Column:
    """Tags dropped, common entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))


def clean_text(text: Column) -> Column:
    """URLs dropped, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"https?://[^ \t\n\r]+", ""), r"[ \t\n\r]+", " "))


def title_body(title: Column, body: Column, chars: int = 500) -> Column:
    """"title. body", or whichever there is, cut to so many characters."""
    return F.substring(F.concat_ws(". ", F.nullif(title, F.lit("")), F.nullif(body, F.lit(""))), 1, chars)


def scrub(text: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Typed markers in place of personal data."""
    for p, marker in patterns or SCRUB:
        text = F.regexp_replace(text, p, marker)
    return text


def scrub_counts(text: Column) -> list[Column]:
    """Markers of each type in a scrubbed text."""
    clean = scrub(text)
    return [F.regexp_count(clean, F.lit(rf"\[{m}\]")).cast("long").alias(f"n_{m.lower()}") for m in MARKER_TYPES]


def redact_terms(text: Column, terms: list[str], mark: str = "[redacted]") -> Column:
    return F.regexp_replace(text, any_word(terms), mark)


def has_term(text: Column, terms: list[str], whole: bool = True) -> Column:
    return text.rlike(any_word(terms, whole))


def region_in_text(text: Column, default: str) -> Column:
    """An explicit five-digit code, else the default."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\b([0-9]{5})\b", 1), F.lit("")), F.lit(default))


def gazetteer_matches(df: DataFrame, gazetteer: DataFrame, text: str, key: str) -> DataFrame:
    """(key, place, region) for every place name found as a word in the text. Words of the text meet names by an equi-join, so neither side is scanned for each row of the other; names are single words."""
    words = df.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))).alias("place"))
    return words.join(gazetteer, "place")


TOKEN = r"[\p{L}\p{N}]+"
#: So many first words of names at most are looked for in the text's row; they come to the driver.
MOST_FIRSTS = 5_000


def name_trie(gazetteer: DataFrame, most_words: int) -> tuple[DataFrame, DataFrame]:
    """A gazetteer (name, entity, kind) as two tables: of first words, with the numbers of words that names with it have; and of whole names by their words.

    Names count by their words (letters and digits, in small letters): those without a word or of more than most_words are left out. Of names with the same words the first entity stays.
    """
    words = F.regexp_extract_all(F.lower("name"), F.lit(TOKEN), F.lit(0))
    names = gazetteer.select(words.alias("words"), "entity", "kind").where(F.size("words").between(1, most_words))
    names = names.groupBy(F.array_join("words", " ").alias("phrase"), "words").agg(F.min(F.struct("entity", "kind")).alias("e"))
    firsts = names.groupBy(F.element_at("words", 1).alias("first")).agg(F.collect_set(F.size("words")).alias("lengths"))  # most_words at most
    return firsts, names.select("phrase", "e.entity", "e.kind")


def name_matches(df: DataFrame, gazetteer: DataFrame, text: str, key: str, most_words: int = 8) -> DataFrame:
    """(key, entity, kind, start, words): names of one or several words in each whole text, from the left, the longest first, none over another; start and words count the text's words from 0.

    First words of names, if they are not too many, are told from other words in the text's row, so only places where a name can begin become rows.
    A text's words meet the trie's first words by an equi-join, are extended by as many words as names with that first word have, and these phrases meet the names by another. So a
    row yields at most most_words phrases for each word, whatever the gazetteer's size. Null texts have no names; keys that repeat are one text each only if they differ.
    """
    firsts, names = name_trie(gazetteer, most_words)
    own = "loomstat_key"
    rows = df.select(F.col(key).alias(own), F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    few = [r["first"] for r in firsts.select("first").limit(MOST_FIRSTS + 1).collect()]
    places = F.transform("tokens", lambda w, i: F.struct(w.alias("first"), i.alias("at")))
    if len(few) <= MOST_FIRSTS:
        places = F.filter(places, lambda x: x["first"].isin(*few))
    places = F.transform(places, lambda x: F.struct(x["first"].alias("first"), x["at"].alias("at"), F.slice("tokens", x["at"] + 1, most_words).alias("ahead")))
    # Outer, and filtered after: a filter on the array would be pushed below, and find all words twice.
    rows = rows.select(own, F.inline_outer(places)).where("first is not null")
    begun = rows.join(sent(firsts), "first").select(own, "at", "ahead", F.explode("lengths").alias("words")).where(F.size("ahead") >= F.col("words"))
    met = begun.withColumn("phrase", F.array_join(F.slice("ahead", 1, F.col("words")), " ")).join(sent(names), "phrase")
    found = met.groupBy(own).agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("start"), (-F.col("words")).alias("less"), "entity", "kind"))).alias("all"))

    def taken(acc, x):
        free = x["start"] >= acc["end"]
        return F.when(free, F.struct((x["start"] - x["less"]).alias("end"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)

    none = F.struct(F.lit(0).alias("end"), F.from_json(F.lit("[]"), "array<struct<start:int,less:int,entity:string,kind:string>>").alias("out"))
    kept = found.select(own, F.inline(F.aggregate("all", none, taken, lambda acc: acc["out"])))
    return kept.select(F.col(own).alias(key), "entity", "kind", "start", (-F.col("less")).alias("words"))


def submission_errors(text: Column, region: Column, category: Column, ts: Column, as_of: Column, categories: list[str]) -> Column:
    return reasons(
        [
            (F.length(F.trim(text)) < 10, "text_too_short"),
            (F.length(text) > 2000, "text_too_long"),
            (~region.rlike("^[0-9]{5}$"), "bad_region"),
            (~category.isin(*categories), "bad_category"),
            (ts > as_of, "future_date"),
        ]
    )
