"""Benchmark decontamination by template windows, in DataFrame functions alone.

Texts are brought to templates: numbers, units after numbers, and names become
typed placeholders, everything else lower-case words without punctuation.
Every window of WINDOW template tokens of the benchmark and of the documents is
hashed, so that any run of WINDOW equal tokens meets; windows of few words are
hashed with what their placeholders stand for.  The hash join gives alignments
of a document and an item, which
are then compared token by token.  Placeholders only count where the slots are
consistent: equal values of the item stand for equal values of the document
and the other way round.  A re-parameterised question thus matches, and a text
that merely has numbers in the same places doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved, small_side

WINDOW = 8
#: Different words that a benchmark window of WINDOW tokens needs; placeholders count only by what they stand for.
LEAST_WORDS = 4
#: The share of an item's tokens that a document must have in the item's order.
LEAST_SHARE = 0.5

# Units that may follow a number.
UNITS = (
    "kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "ft", "feet", "foot", "inch", "inches", "mile", "miles", "yard", "yards",
    "meter", "meters", "metre", "metres", "kilometers", "kilometres", "centimeters", "grams", "kilograms", "pounds", "ounces", "tons",
    "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "ms", "sec", "second", "seconds", "min", "minute", "minutes",
    "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kmh", "hz", "khz", "mhz", "ghz",
    "w", "kw", "v", "a", "n", "j", "kj", "pa", "kpa", "k", "c", "f", "percent", "dollar", "dollars", "cent", "cents", "euro", "euros",
)

# Both patterns take time in proportion to the text: a number is begun once, at its own start, and never given back.
_NUMBER = r"[0-9]++(?:[.,:/][0-9]++)*+"
# A look at the next character spares most places the look behind.
_START = r"(?=[0-9])(?<![0-9])(?<![0-9][.,:/])"
_MEASURE = rf"{_START}{_NUMBER} ?((?i:{'|'.join(UNITS)}))\b"
#: Capitalised words after a small letter, digit, comma or semicolon and a blank: not at a sentence's start.
_NAME = r"([\p{Ll}0-9,;] )(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*+)"


def _named(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("§"), F.lit(" ")), _NAME, "$1 §n ")


def _split(t: Column) -> Column:
    """The words and placeholders of a text, lower-cased; the text is worked out once."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(t), r"[^a-z0-9\p{L}\p{N}§]+", " "), " "), "")


def tokens(text: Column) -> Column:
    """The template of a text as an array of words and the placeholders §n, §d and §u."""
    t = F.regexp_replace(_named(text), _MEASURE, " §d §u ")
    return _split(F.regexp_replace(t, _NUMBER, " §d "))


def exact(text: Column) -> Column:
    """The template with what each placeholder stands for behind it, token by token in the same places."""
    t = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "§ʘ", "  "), _NAME, "$1 §n$2§e ")
    # Behind each sign either a run of names, whose blanks are joined, or the text after it.
    part = lambda s, k: F.when(k == 0, s).when(s.startswith("n"), F.concat(F.lit("§"), F.translate(s, " ", "ʘ"))).otherwise(F.substr(s, F.lit(2)))
    t = F.array_join(F.transform(F.split(t, "§"), part), "")
    t = F.regexp_replace(t, _MEASURE.replace(_NUMBER, f"({_NUMBER})"), " §d$1 §u$2 ")
    t = F.regexp_replace(t, rf"(?<!§d){_START}({_NUMBER})", " §d$1 ")
    return _split(F.regexp_replace(t, "(?<=[0-9])[.,:/](?=[0-9])", "ʘ"))


def slots(text: Column) -> Column:
    """What the placeholders of each kind stand for, in the order of the text."""
    small = lambda c: F.transform(c, lambda x: F.lower(x))
    clean = F.translate(F.coalesce(text, F.lit("")), "§", " ")
    return F.struct(
        small(F.regexp_extract_all(clean, F.lit(_NAME), 2)).alias("n"),
        small(F.regexp_extract_all(_named(text), F.lit(_NUMBER), 0)).alias("d"),
        small(F.regexp_extract_all(_named(text), F.lit(_MEASURE), 1)).alias("u"),
    )


def _windows(t: Column, length: int) -> Column:
    """(at, key) of every window of ``length`` tokens."""
    at = F.when(F.size(t) >= length, F.sequence(F.lit(0), F.size(t) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(t, i + 1, length)).alias("key")))


def _slot_value(t: Column, values: Column, at: Column) -> Column:
    """The value behind the placeholder at a place of a template, with its kind before it; null for a word."""
    kind = F.get(t, at)
    rank = F.size(F.filter(F.slice(t, F.lit(1), at + 1), lambda x: x == kind)) - 1
    name = lambda k: F.concat(F.lit(f"{k}:"), F.get(values[k], rank))
    return F.when(kind == "§n", name("n")).when(kind == "§d", name("d")).when(kind == "§u", name("u"))


def leaks(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """A row for every document and benchmark item that it holds: doc_id, item_id, item_tokens, matched_tokens, share, slots, slots_consistent.

    An item matches where at least ``least_share`` of its template tokens stand
    in the document in the item's order, at the alignments that share a window.
    Items shorter than a window are found as a whole.  Placeholders count only
    if their values map one to one, at all alignments or else at one of them.
    Windows with less than LEAST_WORDS different words (or items that are
    shorter and have less than two) can't be told from chance as templates:
    they are looked for with their numbers, units and names as they stand, and
    not at all if that gives less than LEAST_WORDS different tokens.

    Null and empty texts hold nothing and are found nowhere; rows with a null
    id are ignored; rows that repeat an id are compared each, and their best
    match is returned once.  Very long texts are read whole, in time that
    grows as they do.  Of equally good alignments it doesn't matter which one
    counts.  Other columns are ignored; empty tables give no rows.
    """
    bench = benchmark.filter("item_id is not null").select("item_id", tokens(F.col("text")).alias("bt"), exact(F.col("text")).alias("be"), slots(F.col("text")).alias("bv")).filter(F.size("bt") > 0)
    bench = saved(bench, "benchmark")
    own = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = sorted(r["n"] for r in bench.filter(F.size("bt") < WINDOW).select(F.size("bt").alias("n")).distinct().collect())
    words = lambda t: F.size(F.array_distinct(F.filter(t, lambda x: ~x.startswith("§"))))

    lengths = [WINDOW, *short]
    sides = None
    for n in lengths:
        of = bench.filter(F.size("bt") == n) if n < WINDOW else bench
        at = F.explode(_windows(F.col("bt"), n)).alias("w")
        of = of.select("item_id", "bt", "be", at)
        own_words = words(F.slice("bt", F.col("w.at") + 1, n))
        filled = F.slice("be", F.col("w.at") + 1, n)
        enough = own_words >= (LEAST_WORDS if n == WINDOW else 2)
        alike = F.size(F.col("be")) == F.size("bt")
        key = F.when(enough, F.col("w.key")).when(alike & (F.size(F.array_distinct(filled)) >= LEAST_WORDS), F.xxhash64(filled))
        of = of.select("item_id", F.col("w.at").alias("item_at"), key.alias("key"), (~enough).alias("filled")).filter("key is not null")
        sides = of if sides is None else sides.union(of)
    sides = saved(sides, "benchmark-windows")
    every = [_windows(F.col("t"), n) for n in lengths]
    # Only a benchmark with such windows makes the documents' windows be hashed twice.
    if sides.filter("filled").limit(1).count():
        every += [_windows(F.col("e"), n) for n in lengths]
    seen = own.select("doc_id", tokens(F.col("text")).alias("t"), exact(F.col("text")).alias("e")).select("doc_id", F.explode(F.flatten(F.array(*every)) if len(every) > 1 else every[0]).alias("w"))
    hits = seen.select("doc_id", F.col("w.at").alias("at"), F.col("w.key").alias("key")).join(small_side(sides.drop("filled")), "key")
    hits = saved(hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")

    # Each document with a hit is brought to its template once, however many items and shifts it has.
    some = own.join(small_side(hits.select("doc_id").distinct()), "doc_id").select("doc_id", tokens(F.col("text")).alias("t"), exact(F.col("text")).alias("e"), slots(F.col("text")).alias("v"))
    some = saved(some, "templates")
    # An array's word and its bookkeeping take about 40 bytes.
    pairs = some.join(small_side(hits), "doc_id").join(small_side(bench, size=120 * F.size("bt")), "item_id")
    places = F.filter(F.sequence(F.lit(0), F.size("bt") - 1), lambda k: (k + F.col("shift") >= 0) & (F.get("bt", k) == F.get("t", F.greatest(k + F.col("shift"), F.lit(0)))))
    pairs = pairs.withColumn("places", places)
    slot_places = F.filter("places", lambda k: F.get("bt", k).startswith("§"))
    value = lambda t, e, v, at: F.when(F.size(t) == F.size(e), F.get(e, at)).otherwise(_slot_value(F.col(t), F.col(v), at))
    filled = F.transform(slot_places, lambda k: F.struct(value("bt", "be", "bv", k).alias("b"), value("t", "e", "v", k + F.col("shift")).alias("d")))
    pairs = pairs.select("doc_id", "item_id", F.size("bt").alias("item_tokens"), F.filter("places", lambda k: ~F.get("bt", k).startswith("§")).alias("words"), slot_places.alias("slot_places"), filled.alias("filled"))
    different = lambda c, side: F.size(F.array_distinct(F.transform(c, lambda x: x[side])))
    one_to_one = lambda c: (different(c, "b") == F.size(F.array_distinct(c))) & (different(c, "d") == F.size(F.array_distinct(c)))
    pairs = pairs.withColumn("alone", F.when(one_to_one(F.col("filled")), F.size("slot_places")).otherwise(0))
    spots = pairs.groupBy("doc_id", "item_id", "item_tokens").agg(*(F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("words", "slot_places", "filled")), F.max("alone").alias("alone"))
    # A document may hold an item more than once, with other values each time: then one alignment's slots count.
    together = one_to_one(F.col("filled"))
    consistent = together | (F.col("alone") > 0)
    n_slots = F.when(together | (F.col("alone") == 0), F.size("slot_places")).otherwise(F.col("alone"))
    matched = F.size("words") + F.when(consistent, n_slots).otherwise(0)
    out = spots.select("doc_id", "item_id", "item_tokens", matched.alias("matched_tokens"), (matched / F.col("item_tokens")).alias("share"), n_slots.alias("slots"), consistent.alias("slots_consistent"))
    return out.filter(F.col("share") >= least_share)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns unchanged. Rows with a null doc_id stay."""
    found = saved(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(small_side(found), "doc_id", "left_anti").select(*docs.columns)
