"""Personal data by weak supervision, with DataFrame functions only.

Base patterns (e-mail, IP address, card, phone) are always spans. Further candidates (credentials, access keys, local phone numbers,
written-out e-mails, social security numbers, names after a title or that a table of given names proposes) get votes of labelers: shape, context, gazetteer (an equi-join
of their words with a table), character variety and counter-evidence. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, and a
logistic model on the votes, the span (its kind, length, digits and capitals) and the words beside it, fitted to the resulting probabilities, decides for each candidate.
Texts are read once: a narrow table of base spans and candidates is written, and the rest works on that.
"""

from __future__ import annotations

from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

LOCAL = "[A-Za-z0-9._%+-]"
# Each pattern finds just what its plain form in the comment finds from the left; guards and possessive repeats keep it linear and free of recursion.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"  # [0-9]([\x20-]?[0-9])+ of 14 to 19 digits
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")
NAME_WORD = r"\p{Lu}[\p{L}\p{M}'-]++"
# Keywords of credentials, in any case, and their values: a quoted one runs to its closing quote (of the same kind, on the same line), any other one to white space.
KEYWORD = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)(?i:[_-]?(?:access[_-]?)?(?:key|id))?[\"']?[\x20\t]*+(?::=|=>|[=:])[\x20\t]*+"
QUOTED = "|".join(rf"{q}(?=(?:[^{q}\\\n]|\\.){{6}})[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}" for q in ('"', "'"))
BARE = r"(?:\"(?![^\"\n]*\")|'(?![^'\n]*'))?+[^\s\"']\S{5,}+"
# Values have no longest length: a span ends where the value ends.
MORE = {
    "secret": rf"(?<![A-Za-z]){KEYWORD}(?:{QUOTED}|{BARE})|(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![A-Za-z0-9])",
    "phone_local": r"(?<![0-9+.(])(?<![0-9][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])(?![\x20.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "email_text": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "name": rf"(?<![\p{{L}}\p{{M}}])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?\x20{NAME_WORD}(?:\x20{NAME_WORD})?+",
}
# Common given names (which propose names wherever they stand) and words of credentials, used if no tables are given.
GIVEN_NAMES = [
    "alice", "andrew", "charles", "david", "elizabeth", "emma", "george", "james", "jennifer", "john", "laura", "linda", "mary", "michael", "patricia", "richard", "robert", "sarah", "susan", "william",
    "andreas", "anna", "claudia", "frank", "hans", "ingrid", "jürgen", "julia", "karl", "klaus", "martin", "matthias", "peter", "petra", "sabine", "stefan", "thomas", "ursula", "uwe", "wolfgang",
    "alain", "camille", "chantal", "claire", "élodie", "françois", "isabelle", "jacques", "jean", "julien", "louis", "luc", "michel", "monique", "nathalie", "nicolas", "paul", "philippe", "pierre", "sophie",
    "alejandro", "ana", "antonio", "carlos", "carmen", "diego", "elena", "fernando", "isabel", "javier", "josé", "juan", "lucía", "luis", "manuel", "maría", "maria", "miguel", "pablo", "sofia",
]
CREDENTIAL_WORDS = ["password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "akia", "asia"]
#: Given names at most: the driver reads them, and each task holds them as a set.
MOST_NAMES = 100_000
#: A gazetteer, or list of rows that it knows, of at most so many rows is sent to every executor; a longer one is joined by a shuffle.
MOST_SENT = 200_000
# Words that the context labelers look for.
CUES = r"(?i)(password|passwd|secret|token|credential|login|key|call|phone|tel|fax|mobile|contact|mail|write|ssn|social|security|name|signed|regards|dear)[^A-Za-z0-9]{0,6}$"
AGAINST = r"(?i)(example|sample|dummy|placeholder|version|page|isbn|order|ticket)[^A-Za-z0-9]{0,6}$"
LABELERS = ("shape", "context", "gazetteer", "variety", "against")
SPAN = "array<struct<s:int,e:int,kind:string,t:string>>"
#: Buckets of the span classifier's features: kind, length, share of digits, share of capitals, word before, word after.
BUCKETS = (len(MORE), 4, 4, 4, 3, 3)


def spans(text: str, kind: str, pattern: str | Column, guard: Column, df: DataFrame, column: str | None = None) -> DataFrame:
    """df with a column (named as the kind): all matches, left to right, with code-point positions."""
    column = column or kind
    found = f"found_{column}"
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    df = df.withColumn(found, F.when(guard, F.regexp_extract_all(F.col(text), pattern, F.lit(0))))
    gaps = F.zip_with(F.split(F.col(text), pattern, -1), F.col(found), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        one = F.struct(s.cast("int").alias("s"), (s + F.length(x["m"])).cast("int").alias("e"), F.lit(kind).alias("kind"), x["m"].alias("t"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct((s + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    none = F.from_json(F.lit("[]"), SPAN)
    built = F.aggregate(gaps, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return df.withColumn(column, F.when(F.size(found) > 0, built).otherwise(none)).drop(found)


def given_spans(df: DataFrame, text: str, given: list[str]) -> DataFrame:
    """df with a column given: where a word with a capital is one of these names (in small letters), it and up to two such words after it.

    The words of each text are looked up in a set; only texts that hold a name are searched for its places.
    """
    words = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rf"(?<![\p{{L}}\p{{M}}'-]){NAME_WORD}"), F.lit(0)))
    df = df.withColumn("held", F.filter(words, lambda w: F.lower(w).isin(given)))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}'-])(?:"), F.array_join("held", "|"), F.lit(rf")(?![\p{{L}}\p{{M}}'-])(?:\x20{NAME_WORD}){{0,2}}+"))
    return spans(text, "name", pattern, F.size("held") > 0, df, "given").drop("held")


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with a column for each base kind: its spans, without those that fail the kind's test."""
    t = F.col(text)
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    df = spans(text, "email", EMAIL, t.contains("@"), df)
    df = spans(text, "ip", IP, t.rlike(r"[0-9]\.[0-9]"), df)
    df = spans(text, "card", CARD, t.rlike("[0-9]"), df)
    df = spans(text, "phone", PHONE, t.contains("+"), df)
    df = df.withColumn("ip", F.filter("ip", lambda x: x["t"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")))
    df = df.withColumn("card", F.filter("card", lambda x: luhn(digits(x["t"]))))
    return df.withColumn("phone", F.filter("phone", lambda x: F.length(digits(x["t"])).between(10, 15)))


def luhn(digits: Column) -> Column:
    """Do the digits pass the Luhn test?"""
    return F.call_function("luhn_check", digits)


def bucket(x: Column, bounds: tuple[float, ...]) -> Column:
    """How many of the bounds x reaches."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds[1:]), F.when(x >= bounds[0], 1).otherwise(0))


def word_class(x: Column) -> Column:
    """0: no letter there, 1: small letters, 2: a capital."""
    return F.when(x.rlike(r"^\p{Lu}"), 2).when(x.rlike(r"^\p{L}"), 1).otherwise(0)


def candidates(df: DataFrame, text: str, given: list[str]) -> DataFrame:
    """df with columns base and voted: candidates beyond the base spans, apart from each other and from these (but a secret may hold base spans).

    Each has v: votes (-1, 0, 1) of all labelers but the gazetteer, f: feature buckets, words: what the gazetteer is asked for.
    """
    t = F.col(text)
    guards = {
        "secret": t.contains("=") | t.contains(":") | t.contains("AKIA") | t.contains("ASIA"),
        "phone_local": t.rlike(r"[0-9]{3}[\x20.)-]"),
        "ssn": t.rlike(r"-[0-9]{2}-"),
        "email_text": t.contains("(at)") | t.contains("[at]"),
        "name": t.rlike(r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\b"),
    }
    for kind, pattern in MORE.items():
        df = spans(text, kind, pattern, guards[kind], df)
    df = given_spans(df, text, given) if given else df
    df = df.withColumn("base", F.concat(*KINDS))
    df = df.withColumn("more", F.array_sort(F.concat(*MORE, *(["given"] if given else []))))
    apart = lambda x, other: ~F.exists(other, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    df = df.withColumn("more", F.filter("more", lambda x: apart(x, F.filter("base", lambda b: (x["kind"] != "secret") | (b["s"] <= x["s"])))))
    first = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, F.when(F.size(acc) > 0, -1).otherwise(F.lit(None)))["e"] > x["s"]), acc).otherwise(F.concat(acc, F.array(x)))
    df = df.withColumn("more", F.when(F.size("more") > 1, F.aggregate("more", F.from_json(F.lit("[]"), SPAN), first)).otherwise(F.col("more")))

    def votes(x: Column) -> Column:
        before = F.substring(t, F.greatest(x["s"] - 31, F.lit(1)), F.least(x["s"], F.lit(32)))
        yes = lambda c, no=0: F.when(c, 1).otherwise(no)
        shape = yes(x["t"].rlike(r"[0-9]{2}|(?i)^(mr|mrs|ms|dr|herr|frau|mme|sr|sra)\b|\(at\)|\[at\]") | ((x["kind"] == "name") & x["t"].contains(" ")), -1)
        context = yes(before.rlike(CUES) | x["t"].rlike(rf"^{KEYWORD}"))
        variety = yes(F.size(F.array_distinct(F.split(x["t"], ""))) >= 8, -1)
        against = F.when(before.rlike(AGAINST), -1).otherwise(0)
        share = lambda pattern: F.length(F.regexp_replace(x["t"], pattern, "")) / F.length(x["t"])
        kind = F.array_position(F.array(*[F.lit(k) for k in MORE]), x["kind"]) - 1
        sides = [word_class(F.regexp_extract(before, r"([^\s]+)\s*$", 1)), word_class(F.regexp_extract(F.substring(t, x["e"] + 1, F.lit(16)), r"^\s*(\S+)", 1))]
        features = [kind, bucket(F.length(x["t"]), (12, 24, 48)), bucket(share("[^0-9]"), (0.001, 0.3, 0.7)), bucket(share(r"\P{Lu}"), (0.001, 0.3, 0.7)), *sides]
        low = F.lower(x["t"])
        words = F.array_distinct(F.concat(F.split(low, r"[^\p{L}\p{M}]+"), F.array(F.substring(low, 1, 4))))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), F.array(shape, context, variety, against).alias("v"), F.array(*[f.cast("int") for f in features]).alias("f"), words.alias("words"))

    return df.withColumn("voted", F.transform("more", votes))


def default_gazetteer(spark: SparkSession) -> DataFrame:
    """Given names and words for credentials: (word), in small letters."""
    return spark.createDataFrame([(w,) for w in GIVEN_NAMES + CREDENTIAL_WORDS], "word string")


def given_names(names: DataFrame | None) -> list[str]:
    """The different words of a table of given names (column name), in small letters; words that no text can hold as one are left out."""
    if names is None:
        return GIVEN_NAMES
    found = names.select(F.lower("name").alias("name")).where(F.col("name").rlike(r"^\p{L}[\p{L}\p{M}'-]+$")).distinct().limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names")
    return sorted(r["name"] for r in found)


def survey(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), gazetteer: DataFrame | None = None, names: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """One row for each input row, written in the shared folder: id, n_<kind>, base, voted (s, e, kind, v: votes of LABELERS, f: feature buckets), keep_<column>, and text if asked for."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    df = candidates(base_spans(rows, "text"), "text", given_names(names))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    bare = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    carried = ["id", *(["text"] if with_text else []), *[f"keep_{c}" for c in keep]]
    found = cut(df.select(*carried, *counts, bare.alias("base"), "voted", F.monotonically_increasing_id().alias("row")))
    gazetteer = default_gazetteer(docs.sparkSession) if gazetteer is None else gazetteer
    known_words = gazetteer.select(F.lower("word").alias("word")).where("word <> ''").distinct()
    sent = lambda df: F.broadcast(df) if df.count() <= MOST_SENT else df
    asked = found.where(F.size("voted") > 0).select("row", F.posexplode("voted").alias("k", "x")).select("row", "k", F.explode("x.words").alias("word"))
    known = cut(asked.join(sent(known_words), "word").groupBy("row").agg(F.collect_set("k").alias("known")))  # places in one text
    met = found.join(sent(known.withColumnRenamed("row", "known_row")), F.col("row") == F.col("known_row"), "left")
    hit = lambda k: F.when(F.array_contains(F.coalesce("known", F.array().cast("array<int>")), k), 1).otherwise(0)
    votes = lambda x, k: F.array(x["v"][0], x["v"][1], hit(k), x["v"][2], x["v"][3])
    voted = F.transform("voted", lambda x, k: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), votes(x, k).alias("v"), x["f"].alias("f")))
    return met.withColumn("voted", voted).drop("known", "known_row", "row")


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """The probability that a candidate with these votes is personal data: two classes, labelers independent within each; by expectation-maximisation."""
    if not counts:
        return {}
    n = len(LABELERS)
    p = {v: 1 / (1 + exp(-sum(v))) for v in counts}
    for _ in range(rounds):
        weight = [1.0, 1.0]
        table = [[{x: 0.5 for x in (-1, 0, 1)} for _ in range(n)] for _ in (0, 1)]
        for v, c in counts.items():
            for k, share in ((0, 1 - p[v]), (1, p[v])):
                weight[k] += c * share
                for j in range(n):
                    table[k][j][v[j]] += c * share
        like = {}
        for v in counts:
            logs = [log(weight[k]) + sum(log(table[k][j][v[j]] / (weight[k] + 0.5)) for j in range(n)) for k in (0, 1)]
            like[v] = 1 / (1 + exp(min(700.0, max(-700.0, logs[0] - logs[1]))))
        p = like
    return p


def fit(found: DataFrame, rounds: int = 400, rate: float = 1.0) -> list[float]:
    """Weights of the span classifier from what survey() found: bias, for each labeler one for a vote for and one for a vote against, and one for each feature bucket.

    Counts of different (votes, features) come to the driver: less than 3 ** 5 times the product of BUCKETS, whatever the input.
    """
    rows = found.select(F.explode("voted").alias("x")).groupBy(F.col("x.v").alias("v"), F.col("x.f").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[tuple[int, ...], int] = {}
    for r in rows:
        counts[tuple(r["v"])] = counts.get(tuple(r["v"]), 0) + r["n"]
    target = reliabilities(counts)
    pairs = [(tuple(r["v"]), tuple(r["f"]), float(r["n"]), target[tuple(r["v"])]) for r in rows]
    return logistic(pairs, rounds, rate)


def logistic(pairs: list[tuple[tuple[int, ...], tuple[int, ...], float, float]], rounds: int, rate: float) -> list[float]:
    """Weights fitted to (votes, feature buckets, number, probability); each labeler is believed a little from the start, and weights are drawn to that."""
    n_votes = len(LABELERS)
    size = 1 + 2 * n_votes + sum(BUCKETS)
    prior = np.zeros(size)
    prior[1 : 1 + n_votes], prior[1 + n_votes : 1 + 2 * n_votes] = 2.0, -2.0
    if not pairs:
        return prior.tolist()
    x = np.zeros((len(pairs), size))
    x[:, 0] = 1
    first = np.concatenate(([0], np.cumsum(BUCKETS)[:-1])) + 1 + 2 * n_votes
    for k, (v, f, _, _) in enumerate(pairs):
        x[k, 1 : 1 + n_votes], x[k, 1 + n_votes : 1 + 2 * n_votes] = np.equal(v, 1), np.equal(v, -1)
        x[k, first + np.array(f)] = 1
    n, y = np.array([p[2] for p in pairs]), np.array([p[3] for p in pairs])
    share = n / n.sum()
    w = prior.copy()
    for _ in range(rounds):
        w -= rate * (x.T @ (share * (1 / (1 + np.exp(-x @ w)) - y)) + 0.002 * (w - prior))
    return w.tolist()


def decided(found: DataFrame, weights: list[float]) -> DataFrame:
    """found with column found: base spans and accepted candidates, sorted by start, then kind as listed; base sorted alike."""

    def logit(x: Column) -> Column:
        out, at = F.lit(weights[0]), 1 + 2 * len(LABELERS)
        for k in range(len(LABELERS)):
            out = out + F.when(x["v"][k] == 1, weights[1 + k]).when(x["v"][k] == -1, weights[1 + len(LABELERS) + k]).otherwise(0.0)
        for k, size in enumerate(BUCKETS):
            out = out + F.array(*[F.lit(w) for w in weights[at : at + size]])[x["f"][k]]
            at += size
        return out

    order = {k: n for n, k in enumerate((*KINDS, *MORE))}
    number = lambda kind: F.coalesce(*[F.when(kind == k, n) for k, n in order.items()])
    by_place = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(x["s"].alias("s"), number(x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    fine = F.transform(F.filter("voted", lambda x: logit(x) >= 0), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    return found.withColumn("found", by_place(F.concat("base", fine))).withColumn("base", by_place(F.col("base"))).drop("voted")


def find(
    docs: DataFrame, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), gazetteer: DataFrame | None = None, names: DataFrame | None = None
) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, found) for every row, and the columns named in keep.

    base and found: arrays of (s, e, kind) with code-point positions, end exclusive; found holds the base spans and the accepted candidates, sorted
    by start, then kind as listed. weights: of fit(); else fitted to these rows. gazetteer: words that a labeler knows (column word); names: given names
    that propose a name wherever they stand with a capital (column name, at most MOST_NAMES). Null text counts as empty; ids may be null
    or repeat, and each row has its own result; texts may be of any length, and a span ends where the value ends; other columns may have any names.
    """
    found = survey(docs, id_col, text_col, keep, gazetteer, names)
    out = decided(found, fit(found) if weights is None else weights)
    return out.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], "base", "found", *[F.col(f"keep_{c}").alias(c) for c in keep])


def listed(xs: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: str, xs: str) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans by the first one's."""
    t = F.col(text)

    def add(acc: Column, x: Column) -> Column:
        longer = F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out")
        )
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(longer)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.col(xs), start, add, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return F.when(F.size(xs) > 0, whole).otherwise(t)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gazetteer: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """The input rows with all spans found in the text replaced; null texts stay null; other columns, whatever their names, as they are; repeated rows stay repeated; any text length."""
    columns = docs.columns
    own = {c: f"loomstat_{k}" for k, c in enumerate(columns)}
    rows = docs.select(*[F.col(c).alias(own[c]) for c in columns], F.col(text_col).isNull().alias("loomstat_null"))
    rest = tuple(own[c] for c in columns if c not in (id_col, text_col))
    found = survey(rows, own[id_col], own[text_col], (*rest, "loomstat_null"), gazetteer, names, with_text=True)
    out = decided(found, fit(found))
    made = {id_col: F.col("id"), text_col: F.when(~F.col("keep_loomstat_null"), redacted("text", "found"))}
    return out.select(*[made.get(c, F.col(f"keep_{own[c]}")).alias(c) for c in columns])
