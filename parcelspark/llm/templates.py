"""Benchmark decontamination by template windows, in DataFrame operations only.

Texts become word lists in which numbers, names and units are typed placeholders. Every
window of ``width`` template words has a hash. Document windows that a fixed-size bitmap of the benchmark's
hashes lets through are hash-joined to the benchmark's windows. Matches that lie on one diagonal
(document place minus item place) are one occurrence; an occurrence counts only if its slots are consistent:
each value of the item stands for one value of the document throughout. So a question with other
numbers or names is found, and text that merely has the same placeholders is not.

Definitions
* Words: the text cut at white space, marks trimmed from both ends, words of marks only left out.
* Number: begins with a digit. Unit: one of UNITS after a number. Name: a capital letter followed by a small letter.
  At the beginning of a text or after a word that ends with . ! ? or : such a word can be a name or a plain word: it has both codes.
  Items have a window for each choice of codes; documents have two, one with all such words plain and one with all of them names.
* An item shorter than ``width`` words is one window of its own length.
* Windows with more than ``width - literals`` placeholders (an item's own shorter window: more than half), and items below ``least``
  words, match only verbatim, but for case: they have the hash of their lower-cased words.
* An occurrence is judged three times: by its verbatim windows, by those with plain words at beginnings, and by all.
* A document is contaminated by an item if the places found cover at least ``coverage`` of the item's windows, or of those that can match
  with other values, or if an occurrence has at least ``run`` consecutive words of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelspark.session import materialise

#: Units of measure, as written after a number.
UNITS = [
    "%", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "lb", "lbs", "pound", "pounds",
    "ounce", "ounces", "oz", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "min", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degrees", "mph", "kmh", "kw", "watts", "volts",
]
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…–—¿¡"
NUMBER, NAME, UNIT = 1, 2, 3
#: Kinds of windows: all words as they are, plain words at beginnings, names at beginnings.
VERBATIM, PLAIN, NAMED = 0, 1, 2
#: Bits of the bitmap, a fixed size.
MAP_BITS = 1 << 19
#: Benchmark windows up to this number of rows are broadcast (about 200 bytes each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 40_000


def _digit(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def with_template(rows: DataFrame, text: str) -> DataFrame:
    """Rows with ``words`` (trimmed, as written), ``template`` (hash of each word or placeholder code), ``starts`` (places of
    words that are plain there and may be names) and ``named`` (the template with names there)."""
    pieces = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\r\f\v   ", " " * 8), " ")
    rows = rows.withColumn("pieces", F.filter(pieces, lambda x: F.btrim(x, F.lit(MARKS)) != ""))
    rows = rows.withColumn("words", F.transform("pieces", lambda x: F.btrim(x, F.lit(MARKS))))

    def shaped(word: Column) -> Column:
        second = F.substring(word, 2, 1)
        return (((word >= "A") & (word < "[")) | ((word >= "À") & (word < "ß"))) & (((second >= "a") & (second < "{")) | (second >= "ß"))

    def code(word: Column, at: Column) -> Column:
        literal = F.xxhash64(F.lower(word))
        before = F.get(F.col("pieces"), at - 1)
        capital = ((word >= "A") & (word < "[")) | ((word >= "À") & (word < "ß"))
        second = F.substring(word, 2, 1)
        inside = (at > 0) & ~F.substring(before, -1, 1).isin(".", "!", "?", ":") & (((second >= "a") & (second < "{")) | (second >= "ß"))
        after_number = F.coalesce(_digit(F.get(F.col("words"), at - 1)), F.lit(False))
        return (F.when(_digit(word), F.lit(NUMBER).cast("long"))
                .when(capital, F.when(inside, F.lit(NAME).cast("long")).otherwise(literal))
                .when(after_number & F.lower(word).isin(UNITS), F.lit(UNIT).cast("long"))
                .otherwise(literal))

    rows = rows.withColumn("template", F.transform("words", code))
    every = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("starts", F.filter(every, lambda i: ~F.get(F.col("template"), i).between(NUMBER, UNIT) & shaped(F.get(F.col("words"), i))))
    return rows.withColumn("named", F.transform("template", lambda t, i: F.when(F.array_contains("starts", i), F.lit(NAME).cast("long")).otherwise(t))).drop("pieces")


def _places(template: Column, width: int) -> Column:
    """Places of all windows of ``width`` words; none if there are fewer words."""
    return F.when(F.size(template) >= width, F.sequence(F.lit(0), F.size(template) - width)).otherwise(F.array().cast("array<int>"))


def _hashes(template: Column, places: Column, width: int) -> Column:
    """Hashes of the windows of ``width`` words at ``places``."""
    return F.transform(places, lambda i: F.xxhash64(F.lit(width), *(F.get(template, i + k) for k in range(width))))


def _values(words: Column, at: Column, width: int | Column) -> Column:
    return F.transform(F.slice(words, at + 1, width), lambda w: F.xxhash64(F.lower(w)))


def benchmark_windows(benchmark: DataFrame, width: int, literals: int, least: int) -> tuple[DataFrame, list[tuple[int, bool]]]:
    """Windows of all distinct item texts, and the window lengths in use (``width`` and those of shorter items) with
    whether any of that length match verbatim only."""
    items = benchmark.filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    items = materialise(with_template(items, "text").withColumn("n", F.least(F.size("words"), F.lit(width))).filter(F.col("n") > 0), "templates-items")
    lengths = sorted(row.n for row in items.select("n").distinct().collect())  # at most width values
    parts = []
    for n in lengths:
        own = items.filter(F.col("n") == n).select("item_id", "words", "template", "starts", F.explode(_places(F.col("template"), n)).alias("item_at"))
        own = own.select("item_id", "item_at", F.slice("template", F.col("item_at") + 1, n).alias("window"), _values(F.col("words"), F.col("item_at"), n).alias("item_values"),
                         F.filter(F.transform("starts", lambda i: i - F.col("item_at")), lambda i: i.between(0, n - 1)).alias("starts"))
        few = n - literals if n == width else n // 2
        # a window for each choice of codes, at most ``few`` of them names
        slotted = lambda codes: F.size(F.filter(codes, lambda t: t.between(NUMBER, UNIT)))
        named = lambda codes, at: F.transform(codes, lambda t, i: F.when(i == at, F.lit(NAME).cast("long")).otherwise(t))
        choices = F.aggregate("starts", F.array("window"), lambda have, at: F.concat(have, F.filter(F.transform(have, lambda codes: named(codes, at)), lambda codes: slotted(codes) <= few)))
        choices = F.filter(choices, lambda codes: slotted(codes) <= few) if n >= least else F.array().cast("array<array<long>>")
        own = own.withColumn("choices", choices)
        own = own.withColumn("literal", F.size("choices") == 0).withColumn("codes", F.explode(F.when(F.col("literal"), F.array("item_values")).otherwise(F.col("choices"))))
        slots = F.transform("codes", lambda t: t.between(NUMBER, UNIT))
        parts.append(own.select("item_id", "item_at", F.xxhash64(F.lit(n), *(F.get("codes", F.lit(k)) for k in range(n))).alias("hash"), slots.alias("slots"), "item_values", "literal",
                                (F.col("codes") == F.col("window")).alias("plain"), F.lit(n).alias("n")))
    windows = parts[0] if parts else None
    for part in parts[1:]:
        windows = windows.unionByName(part)
    if windows is None:
        return None, []
    windows = materialise(windows, "templates-windows")
    kinds = {row.n: row.literal for row in windows.groupBy("n").agg(F.max("literal").alias("literal")).collect()}
    return windows, sorted(kinds.items())


def _bitmap(windows: DataFrame) -> DataFrame:
    """One row: MAP_BITS bits as an array of longs, set at the windows' hashes."""
    place = F.col("hash").bitwiseAND(F.lit(MAP_BITS - 1))
    words = windows.groupBy(F.shiftright(place, 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits"))
    every = windows.sparkSession.range(MAP_BITS // 64).join(words, "id", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("map"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 8, literals: int = 5,
                 least: int = 5, coverage: float = 0.5, run: int = 13) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_found, n_windows, share, exact.

    ``n_found`` of the item's ``n_windows`` windows are in the document; ``exact`` if all of them with the item's own values.
    Null texts and texts without windows match nothing; items of equal text count once, under the smallest id; rows of one document id are
    one document, null ids too. Other columns are not read. No items or no documents give no rows.
    """
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_found long, n_windows long, share double, exact boolean"
    windows, lengths = benchmark_windows(benchmark.select("item_id", "text"), width, literals, least)
    if windows is None:
        return spark.createDataFrame([], schema)
    few = windows.count() <= BROADCAST_ROWS
    texts = with_template(docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")), "text").drop("text")
    texts = texts.withColumn("map", _bitmap(windows).scalar())
    found = []
    for n, literal in lengths:
        touched = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.filter(F.sequence(p - (n - 1), p), lambda i: (i >= 0) & (i <= F.size("words") - n)))))
        rows = texts.withColumn(f"places{PLAIN}", _places(F.col("template"), n)).withColumn(f"places{NAMED}", touched)
        rows = rows.withColumn(f"hashes{PLAIN}", _hashes(F.col("template"), F.col(f"places{PLAIN}"), n)).withColumn(f"hashes{NAMED}", _hashes(F.col("named"), F.col(f"places{NAMED}"), n))
        if literal:
            rows = rows.withColumn("plain_words", F.transform("words", lambda w: F.xxhash64(F.lower(w)))).withColumn(f"places{VERBATIM}", F.col(f"places{PLAIN}"))
            rows = rows.withColumn(f"hashes{VERBATIM}", _hashes(F.col("plain_words"), F.col(f"places{VERBATIM}"), n))

        def passing(kind: int, n: int = n) -> Column:
            hashes, places = F.col(f"hashes{kind}"), F.col(f"places{kind}")
            there = lambda i: F.get(F.col("map"), F.shiftright(F.get(hashes, i).bitwiseAND(F.lit(MAP_BITS - 1)), 6).cast("int"))
            every = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))
            kept = F.filter(every, lambda i: F.getbit(there(i), F.get(hashes, i).bitwiseAND(F.lit(63)).cast("int")) == 1)
            return F.transform(kept, lambda i: F.struct(F.get(hashes, i).alias("hash"), F.get(places, i).alias("doc_at"), _values(F.col("words"), F.get(places, i), n).alias("values"), F.lit(kind).alias("kind")))

        hits = F.concat(*(passing(kind) for kind in ((VERBATIM,) if literal else ()) + (PLAIN, NAMED)))
        found.append(rows.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.*"))
    hits = found[0]
    for part in found[1:]:
        hits = hits.unionByName(part)
    pairs = hits.join(F.broadcast(windows) if few else windows, "hash")
    slots = F.filter(F.arrays_zip("slots", "item_values", "values"), lambda z: z["slots"])
    same, basic = F.col("values") == F.col("item_values"), F.col("plain") & (F.col("kind") == PLAIN)
    judged = F.array_compact(F.array(F.when(same, F.lit(VERBATIM)), F.when(basic & ~F.col("literal"), F.lit(PLAIN)), F.when(~F.col("literal"), F.lit(NAMED))))
    pairs = pairs.filter(~F.col("literal") | same).select(
        "doc_id", "item_id", "item_at", "n", "literal", (F.col("doc_at") - F.col("item_at")).alias("diagonal"), same.alias("same"),
        F.transform(slots, lambda z: F.struct(z["item_values"].alias("own"), z["values"].alias("here"))).alias("slots"), judged.alias("judged"))
    pairs = pairs.withColumn("judged", F.explode("judged"))
    # sets are bounded by the length of an item
    occurrence = pairs.groupBy("doc_id", "item_id", "diagonal", "judged").agg(
        F.sort_array(F.collect_set(F.struct("item_at", "literal"))).alias("places"), F.min("same").alias("same"), F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    steady = F.size(F.array_distinct(F.transform("slots", lambda s: s["own"]))) == F.size("slots")
    # windows side by side from one place on; the first and the last of them tell, as places are distinct and sorted
    far = F.greatest(F.lit(run) - F.col("n"), F.lit(0))
    long_run = F.exists(F.transform("places", lambda p, j: F.coalesce(F.get(F.col("places"), j + far)["item_at"] == p["item_at"] + far, F.lit(False))), lambda x: x) & (F.col("n") == width)
    by_item = (occurrence.filter(steady).select("doc_id", "item_id", "same", long_run.alias("long_run"), F.explode("places").alias("place"))
               .groupBy("doc_id", "item_id", "place").agg(F.max("same").alias("same"), F.max("long_run").alias("long_run"))
               .groupBy("doc_id", "item_id").agg(F.count("*").alias("n_found"), F.count_if(~F.col("place.literal")).alias("free_found"), F.min("same").alias("same"), F.max("long_run").alias("long_run")))
    sizes = windows.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"), F.countDistinct(F.when(~F.col("literal"), F.col("item_at"))).alias("n_free"))
    share = F.col("n_found") / F.col("n_windows")
    enough = (share >= coverage) | ((F.col("n_free") > 0) & (F.col("free_found") >= coverage * F.col("n_free"))) | F.col("long_run")
    return (by_item.join(F.broadcast(sizes) if few else sizes, "item_id").filter(enough)
            .select("doc_id", "item_id", "n_found", "n_windows", share.alias("share"), (F.col("same") & (F.col("n_found") == F.col("n_windows"))).alias("exact")))
