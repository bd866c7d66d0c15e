"""Personal data and the terms that reveal it (operator 4); Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sealcheck.llm.common import KEY, row_key, whole_row
from sealcheck.session import cut_lineage

# Fixed values of the query's contract. Possessive repeats and the guard before a run change no match: what follows
# a run cannot be part of it, so a start inside a run fails when its first place does.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
IP_PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
TERM = r"\p{L}{3,}+"
DISCLOSURE = 0.8
SUPPORT = 1
SIEVE = 1 << 17
SPAN = "array<struct<kind:string,s:int,e:int,v:string>>"


def located(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern with their place in code points: the lengths between and of the matches, added up."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(F.filter(steps, lambda x: x["h"].isNotNull()), start, lambda a, x: F.struct(
        (a["at"] + x["g"] + F.length(x["h"])).alias("at"),
        F.array_append(a["out"], F.struct(F.lit(kind).alias("kind"), (a["at"] + x["g"]).alias("s"),
                                          (a["at"] + x["g"] + F.length(x["h"])).alias("e"), x["h"].alias("v"))).alias("out")), lambda a: a["out"])


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def sound(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(IP_PARTS)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def base_spans(text: Column, kind: str) -> Column:
    found = F.when(text.rlike(GUARD[kind]), F.filter(located(text, BASE[kind], kind), lambda x: sound(kind, x["v"])))
    return F.coalesce(found, F.array().cast(SPAN))


def _words(text: Column) -> Column:
    """The different words of a text, letters lowered."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _outside(text: Column, base: Column) -> Column:
    """The text with a blank in place of its base spans."""
    order = F.array_sort(base, lambda a, b: a["s"] - b["s"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(
        a["out"], F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0))), F.lit(" ")).alias("out"))
    return F.aggregate(order, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def _marked(text: Column, terms: Column, base: Column) -> Column:
    """Every place in the text where one of `terms` is a whole word clear of the base spans."""
    steps = F.zip_with(F.split(text, TERM, -1), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s, e = a["at"] + x["g"], a["at"] + x["g"] + F.length(x["h"])
        hit = F.array_contains(terms, F.lower(x["h"])) & ~F.exists(base, lambda b: (b["s"] < e) & (s < b["e"]))
        span = F.struct(F.lit("term").alias("kind"), s.alias("s"), e.alias("e"), F.lower(x["h"]).alias("v"))
        return F.struct(e.alias("at"), F.when(hit, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))
    return F.aggregate(F.filter(steps, lambda x: x["h"].isNotNull()), start, step, lambda a: a["out"])


def revealing_terms(rows: DataFrame, disclosure: float, support: int) -> DataFrame:
    """(term): what reveals some entity, from rows of text_id, text, base and entities; see find_personal_data."""
    total = rows.count()
    words = F.explode(_words(F.col("text"))).alias("term")
    terms = rows.select(words).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    # Copies of a text are one row with their number.
    copies = rows.filter(F.size("entities") > 0).groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.first(
        F.struct("text", "base", "entities")).alias("x")).select("text_id", "n", "x.*")
    copies = cut_lineage(copies.select("text_id", "n", "entities", _words(_outside(F.col("text"), F.col("base"))).alias("words")))
    named = copies.select("text_id", "n", F.explode("entities").alias("entity"))
    counted = named.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts"))
    # Entities of one text only have equal counts with all its terms: one stands for them.
    lone = F.when(F.col("texts") == 1, F.concat(F.lit("="), "text_id")).otherwise(F.col("entity"))
    named = named.select("text_id", "entity").join(counted, "entity").groupBy("text_id").agg(F.collect_set(F.struct(lone.alias("entity"), "n_e")).alias("held"))
    # No pair can be stronger than one whose entity never stands without the term.
    hopeful = F.filter("held", lambda h: F.log2((total + 1) / (F.col("n_t") + 1)) >= disclosure * F.log2(total / h["n_e"]))
    pairs = (copies.select("text_id", "n", F.explode("words").alias("term")).join(terms, "term").join(named, "text_id")
             .select("term", "n_t", "n", F.explode(hopeful).alias("h")))
    joint = pairs.groupBy("term", "h.entity").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("texts"), F.first("n_t").alias("n_t"), F.first("h.n_e").alias("n_e"))
    pmi = F.log2((F.col("n_te") + F.col("n_e") / total) * total / ((F.col("n_t") + 1) * F.col("n_e")))
    return joint.filter((F.col("n_e") < total) & (F.col("texts") >= support) & (pmi >= disclosure * F.log2(total / F.col("n_e")))).select("term").distinct()


def _sieve(terms: DataFrame) -> Column:
    """Whether the hash of `term` is one of those of `terms`, told by a table of bits of fixed size.

    Words of other hashes need not travel; those that stay are joined with the terms themselves.
    """
    place = F.pmod(F.xxhash64("term"), F.lit(64 * SIEVE))
    word, bit = F.floor(place / 64).cast("int"), (place % 64).cast("int")
    found = terms.groupBy(word.cast("long").alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    every = terms.sparkSession.range(SIEVE).join(found, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    bits = cut_lineage(every.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("bits")))
    return F.call_function("shiftright", F.get(bits.scalar(), word), bit).bitwiseAND(F.lit(1).cast("long")) == 1


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """One row per document: doc_id, base and terms, arrays of (kind, s, e, v) with code point places, end exclusive.

    Base spans are the four kinds of the contract. A protected entity is the value of a base span (letters
    lowered, else digits only). The corpus tells how strongly a term of the texts that hold an entity reveals it: with
    rows counted, PMI = log2(P(e|t) / P(e)) against the information content IC = -log2 P(e), P(e) = n(e) / N. One
    observation at P(e) is added to those of the term, P(e|t) = (n(t,e) + P(e)) / (n(t) + 1), so that a single
    meeting weighs less than many, and still decides when it says enough. A term reveals an entity if
    PMI >= disclosure * IC; `support` can ask for more different texts that hold both. Every occurrence of a term
    that reveals some entity is a span of kind `term`, in all documents. A term is counted once in a row.

    Null text is empty and has no span. Equal rows each get their spans. An empty table gives no row. A term that
    touches a base span is part of it and left out. Columns other than doc_id and text are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), row_key("doc_id", "text").alias(KEY), F.md5(text).alias("text_id"))
    rows = rows.withColumn("base", F.concat(*[base_spans(F.col("text"), k) for k in BASE]))
    entity = lambda x: F.concat(x["kind"], F.lit(":"), F.when(x["kind"] == "email", F.lower(x["v"])).otherwise(F.regexp_replace(x["v"], "[^0-9.]", "")))
    rows = cut_lineage(rows.withColumn("entities", F.array_distinct(F.transform("base", entity))))
    strong = cut_lineage(revealing_terms(rows, disclosure, support))
    held = rows.select(KEY, F.explode(_words(F.col("text"))).alias("term")).filter(_sieve(strong)).join(strong, "term").groupBy(KEY).agg(F.collect_set("term").alias("held"))
    found = F.when(F.col("held").isNull(), F.array().cast(SPAN)).otherwise(_marked(F.col("text"), F.col("held"), F.col("base")))
    return rows.join(held, KEY, "left").select("doc_id", KEY, "base", found.alias("terms"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with text rewritten: base spans give way to their kind in brackets, revealing terms to [term].

    Where spans overlap the one that starts first stands, the longer of two that start together. Null text stays
    null; other columns are kept.
    """
    spans = find_personal_data(docs, **options).select(KEY, F.array_sort(F.concat("base", "terms"), lambda a, b: F.when(
        a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"])).alias("spans")).dropDuplicates([KEY])
    packed = docs.select(whole_row(docs), row_key("doc_id", "text").alias(KEY)).join(spans, KEY, "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("row.text")
    step = lambda a, x: F.when(x["s"] < a["at"], a).otherwise(F.struct(
        x["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out")))
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return packed.select(F.col("row").withField("text", clean).alias("row")).select("row.*")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
