"""Benchmark items in documents, also with other numbers, names and units.

DataFrame expressions only. Texts become tokens (runs of letters and digits); a token is a literal,
lower-cased, or a typed placeholder: a number, a unit, a name. Tokens of one placeholder that follow
each other are one slot, so names and numbers of any length are one position. Windows of six
positions, or of a shorter item's whole length, with at least three literals, are hashed on both sides
and joined. Windows of a document and an item that stand in line (same difference of positions) make
an alignment; alignments of nearby differences are one occurrence, in which words were added or left out.

An occurrence counts if its slots are filled consistently over all its alignments: the values at
the item's slots map to the document's so that at least ``LEAST_CONSISTENT`` per cent of the slots
agree with their value's commonest partner, both ways. A document is reported with an item if
consistent occurrences cover at least ``LEAST_COVERED`` per cent of the item's windows.

An item none of whose windows has three literals says too little without its values: its windows
are those of its own words, and it is found as it stands only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import materialize, small_side, without

WINDOW, LEAST_LITERAL, LEAST_COVERED, LEAST_CONSISTENT = 6, 3, 30, 80
#: Positions by which the alignments of one occurrence may differ from the next; at most half an item.
DRIFT = 10
#: Numbers as words; units; and words that are no names though they often begin a sentence. English, German, French, Spanish.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half quarter dozen twice "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante soixante cent mille "
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil millones"
).split()
UNITS = (
    "mm cm km kg mg ml lb lbs oz ft mph kmh inch inches foot feet yard yards mile miles meter meters metre metres centimeter centimeters kilometer kilometers gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees celsius fahrenheit "
    "zentimeter kilometern gramm kilogramm pfund sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
    "mètre mètres centimètre centimètres kilomètre kilomètres gramme grammes kilogramme kilogrammes seconde secondes heure heures jour jours semaine semaines mois an ans année années pourcent degré degrés "
    "metro metros centímetro centímetros kilómetro kilómetros gramo gramos kilogramo kilogramos litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados"
).split()
NO_NAMES = (
    "a an the if in on at by of to and or but for from with as is are was were be this that these those it its he she they we you i his her their our your my what which who whom whose when where why how each every some all both there then than so not no do does did has have had can could will would shall should may might let find given suppose consider how many much after before during while since because however solve compute calculate determine show prove evaluate simplify "
    "der die das ein eine einer und oder aber wenn in im an am auf zu von mit für ist sind war waren es er sie wir ihr wie was wer wo wann warum nicht kein den dem des als bei nach vor "
    "le la les un une des du de et ou mais si dans sur à par pour avec est sont était il elle ils elles nous vous je ce cette ces que qui quoi où quand comment pourquoi ne pas "
    "el los las una unos unas y o pero si en por para con es son era fue él ella ellos nosotros ustedes este esta estos que quien qué cómo cuándo dónde no al del"
).split()
NUMBER, UNIT, NAME = "\x01number", "\x01unit", "\x01name"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _kind(w: Column) -> Column:
    """The placeholder or literal that stands for a token."""
    low = F.lower(w)
    first = F.substring(w, 1, 1)
    listed = F.when(low.isin(NUMBERS), NUMBER).when(low.isin(UNITS), UNIT)
    name = ((F.char_length(w) == 1) | (F.upper(w) != w)) & ~low.isin(NO_NAMES)
    plain = F.when(low.isin(NUMBERS + UNITS), listed).otherwise(low)
    capital = (w < "[") | ((w >= "\x80") & (F.lower(first) != first))
    return F.when((w >= "a") & (w < "\x80"), plain).when(w < ":", NUMBER).when(capital & name & ~low.isin(NUMBERS + UNITS), NAME).otherwise(plain)


# The windows are exploded with the outer form: for the other one the optimizer would put a filter on
# the array below the projection that makes it, and evaluate it there a second time, unshared.


def _positions(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``kinds``, one to a position, in place of ``text``: runs of one placeholder are one."""
    keep = [c for c in rows.columns if c != text]
    each = rows.select(*keep, F.transform(tokens(F.col(text)), _kind).alias("_k"))
    return each.select(*keep, F.filter("_k", lambda k, i: (k >= "\x02") | (i == 0) | (F.get("_k", i - 1) != k)).alias("kinds"))


def _valued(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``kinds`` and ``values``, a position's words, lower-cased, in place of ``text``."""
    keep = [c for c in rows.columns if c != text]
    words = rows.select(*keep, tokens(F.col(text)).alias("_w"))
    each = words.select(*keep, "_w", F.transform("_w", _kind).alias("_k"))
    begins = F.filter(F.transform("_k", lambda k, i: F.when((k >= "\x02") | (i == 0) | (F.get("_k", i - 1) != k), i)), lambda i: i.isNotNull())
    begun = each.select(*keep, "_w", "_k", begins.alias("_b"))
    value = F.transform("_b", lambda b, i: F.lower(F.array_join(F.slice("_w", b + 1, F.coalesce(F.get("_b", i + 1), F.size("_w")) - b), " ")))
    return begun.select(*keep, F.transform("_b", lambda b: F.get("_k", b)).alias("kinds"), value.alias("values"))


def _windows(hashed: DataFrame, length: int, *keep: str) -> DataFrame:
    """``(keep, pos, w)``: hashes of the windows of ``h``, an array of the positions' own hashes."""
    one = lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(length)])
    every = F.when(F.size("h") >= length, F.transform(F.sequence(F.lit(0), F.size("h") - length), one)).otherwise(F.array().cast("array<bigint>"))
    return hashed.withColumn("_every", every).select(*keep, F.posexplode_outer("_every").alias("pos", "w")).where("w is not null")


def _index(items: DataFrame) -> DataFrame:
    """``(item_id, pos, w, length, verbatim)``: the windows by which an item is looked for."""
    length = F.least(F.size("kinds"), F.lit(WINDOW))
    sized = items.withColumn("length", length).where("length > 0")
    places = F.sequence(F.lit(0), F.size("kinds") - F.col("length"))
    literals = lambda p: F.size(F.filter(F.slice("kinds", p + 1, F.col("length")), lambda k: k >= "\x02"))
    telling = F.filter(places, lambda p: literals(p) >= LEAST_LITERAL)
    told = sized.withColumn("telling", telling).withColumn("verbatim", F.size("telling") == 0)
    chosen = told.select("item_id", "kinds", "values", "length", "verbatim", F.explode(F.when(F.col("verbatim"), places).otherwise(F.col("telling"))).alias("pos"))
    hashes = F.transform(F.slice(F.when(F.col("verbatim"), F.col("values")).otherwise(F.col("kinds")), F.col("pos") + 1, F.col("length")), lambda k: F.xxhash64(k))
    parts = chosen.withColumn("h", hashes)
    w = reduce(lambda rest, n: F.when(F.col("length") == n, F.xxhash64(*[F.get("h", F.lit(k)) for k in range(n)])).otherwise(rest), range(1, WINDOW), F.xxhash64(*[F.get("h", F.lit(k)) for k in range(WINDOW)]))
    return parts.select("item_id", "pos", w.alias("w"), "length", "verbatim")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, windows, coverage, slots, changed, consistency, kind)`` per contaminated pair.

    windows counts the item's windows that were found; slots their placeholders, changed those with
    another value in the document; kind is verbatim or reparameterised. Null and empty texts, and
    items without letters or digits, match nothing; a row without doc_id or item_id can't be
    reported. Rows that repeat a doc_id are searched each, and reported once with the best coverage,
    then the most changes; rows that repeat an item_id are one item with the windows of all. Empty
    tables give no rows; other columns are ignored. A text costs some 200 bytes a word while its row is worked on.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    named = named.withColumn("version", F.xxhash64("text"))
    given = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null")
    items = materialize(_valued(given, "text"), "items")
    index = materialize(_index(items), "item-windows")
    sizes = index.groupBy("item_id").agg(F.count_distinct("pos").alias("of"))
    used = sorted((r.verbatim, r.length) for r in index.select("verbatim", "length").distinct().collect())  # at most twelve

    found = []
    for verbatim, length in used:
        kinds = _positions(named, "text").select("doc_id", "version", F.transform("kinds", lambda k: F.xxhash64(k)).alias("h"))
        values = _valued(named, "text").select("doc_id", "version", F.transform("values", lambda v: F.xxhash64(v)).alias("h"))
        windows = _windows(values if verbatim else kinds, length, "doc_id", "version").withColumnRenamed("pos", "doc_pos")
        own = index.where((F.col("verbatim") == verbatim) & (F.col("length") == length)).select("item_id", F.col("pos").alias("item_pos"), "w")
        found.append(windows.join(small_side(own, 40), "w").select("doc_id", "version", "item_id", "doc_pos", "item_pos", F.lit(length).alias("length")))
    if not found:
        none = named.limit(0).withColumn("item_id", F.lit(0).cast("long"))
        return none.selectExpr("doc_id", "item_id", "0L as windows", "0D as coverage", "0L as slots", "0L as changed", "0D as consistency", "'' as kind")
    hits = reduce(DataFrame.unionByName, found)
    aligned = hits.groupBy("doc_id", "version", "item_id", "length", (F.col("doc_pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("item_pos").alias("found"))
    aligned = materialize(aligned, "alignments")

    pair = ["doc_id", "version", "item_id"]
    lengths = items.groupBy("item_id").agg(F.max(F.size("kinds")).alias("n"))
    by_shift = Window.partitionBy(*pair).orderBy("shift")
    apart = F.col("shift") - F.lag("shift").over(by_shift) > F.least(F.lit(DRIFT), F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    placed = aligned.join(small_side(lengths, 16), "item_id").withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int"))
    placed = materialize(placed.withColumn("occurrence", F.sum("_new").over(by_shift)).drop("_new", "n"), "occurrences")

    key = [*pair, "occurrence"]
    covered = placed.select(*key, "shift", F.size("found").alias("support"), F.explode(F.array_distinct(F.flatten(F.transform("found", lambda p: F.sequence(p, p + (F.col("length") - 1)))))).alias("p"))
    slots = items.select("item_id", F.posexplode(F.arrays_zip("kinds", "values")).alias("p", "v")).where(F.col("v.kinds") < "\x02").select("item_id", "p", F.col("v.values").alias("theirs")).distinct()
    asked = materialize(covered.join(small_side(slots, 60), ["item_id", "p"]).withColumn("at", F.col("p") + F.col("shift")), "slots")
    #: A document's words are read once, whatever the number of its alignments, and only the asked ones go on.
    wanted = asked.groupBy("doc_id", "version").agg(F.collect_set("at").alias("ats"))
    texts = named.join(small_side(wanted.select("doc_id").distinct(), 16), "doc_id", "left_semi").dropDuplicates(["doc_id", "version"])
    told = _valued(texts, "text").join(wanted, ["doc_id", "version"]).select("doc_id", "version", F.explode(F.transform("ats", lambda p: F.struct(p.alias("at"), F.get("values", p).alias("ours")))).alias("t")).select("doc_id", "version", "t.*")
    met = asked.join(told, ["doc_id", "version", "at"])
    single = met.groupBy(*key, "p", "theirs").agg(F.max_by("ours", F.struct("support", -F.col("shift"))).alias("ours"))
    pairs = single.groupBy(*key, F.col("theirs").alias("a"), F.col("ours").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ways = [pairs.groupBy(*key, x).agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0)).alias("changed")) for x in ("a", "b")]
    shares = [w.groupBy(*key).agg((F.sum("most") / F.sum("n")).alias(f"share{i}"), F.sum("n").alias(f"slots{i}"), F.sum("changed").alias(f"changed{i}")) for i, w in enumerate(ways)]
    filled = shares[0].join(shares[1].drop("slots1", "changed1"), key).select(*key, F.least("share0", "share1").alias("consistency"), F.col("slots0").alias("slots"), F.col("changed0").alias("changed"))

    judged = placed.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")).join(filled, key, "left")
    judged = materialize(judged.withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") * 100 >= LEAST_CONSISTENT), "judged")
    per = judged.select(*pair, F.explode("found").alias("p")).groupBy(*pair).agg(F.count_distinct("p").alias("windows"))
    summed = judged.groupBy(*pair).agg(F.sum(F.coalesce("slots", F.lit(0))).alias("slots"), F.sum(F.coalesce("changed", F.lit(0))).alias("changed"), F.min("consistency").alias("consistency"))
    rated = per.join(summed, pair).join(small_side(sizes, 24), "item_id").withColumn("coverage", F.col("windows") / F.col("of"))
    enough = rated.where(F.col("windows") * 100 >= F.col("of") * LEAST_COVERED)
    best = enough.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("windows", "coverage", "slots", "changed", "consistency"), F.struct("coverage", "changed", "version")).alias("b"))
    return best.select("doc_id", "item_id", "b.*", F.when(F.col("b.changed") > 0, "reparameterised").otherwise("verbatim").alias("kind"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all rows of such a doc_id go."""
    return without(docs, contamination(docs, benchmark), "doc_id")
