"""Benchmark decontamination by canonical templates: typed placeholders, a hash join of windows, consistent slots.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Words of a window. A shorter item is one window of all its words; with fewer than LEAST it has none.
WINDOW, LEAST = 8, 3
#: A template window needs so many words that are no placeholders.
LITERALS = 5
#: An item is leaked by so many of its windows at one alignment, or by half of them if that is fewer.
ENOUGH = 6
#: The windows of the benchmark are broadcast up to so many rows (of about 50 bytes), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000

# Units that make a placeholder after a number.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "ounce", "ounces",
    "pound", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour",
    "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
    "mph", "kmh", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "v", "a", "j", "kj", "kcal", "k", "c", "f",
]

_WORDS = r"[\p{L}\p{M}]+|\d+(?:[.,]\d+)*"
#: Placeholders are words themselves, so a text and its canonical form have as many words.
NUMBER, UNIT, NAME = "0", "qzunitzq", "qznamezq"
_PLACEHOLDERS = f"'{NUMBER}', '{UNIT}', '{NAME}'"
#: The form of an item's windows of lower-cased words.
PLAIN = 2


def _numbered(text: Column) -> Column:
    """Numbers, and units right after them, as placeholders."""
    out = F.regexp_replace(text, r"\d+(?:[.,]\d+)*", NUMBER)
    return F.regexp_replace(out, rf"(?i)(?<={NUMBER}[ -]?)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])", UNIT)


def canonical(text: Column) -> Column:
    """The template of a text: typed placeholders for numbers, units and names (a capital and a small letter first), the rest in lower case."""
    return F.lower(F.regexp_replace(_numbered(text), r"(?<![\p{L}\p{M}])\p{Lu}\p{Ll}[\p{L}\p{M}]*", NAME))


def plain(text: Column) -> Column:
    """The same without placeholders for names: what the template of a text in one case is."""
    return F.lower(_numbered(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORDS), F.lit(0))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda t: F.xxhash64(t))


def _document_windows(docs: DataFrame, sizes: list[int], form: Column) -> DataFrame:
    """(doc_id, size, pos, h) of every window of ``sizes`` words of ``form``, the whole texts or their templates."""
    hashed = docs.select("doc_id", _hashes(form).alias("hs"))
    places = hashed.select("doc_id", "hs", F.explode(F.expr(f"if(size(hs) < {sizes[0]}, cast(array() as array<int>), sequence(0, size(hs) - {sizes[0]}))")).alias("pos"))
    hashes = {k: f"xxhash64({', '.join(f'get(hs, pos + {i})' for i in range(k))})" for k in sizes}  # as of an array, but without making one
    if len(sizes) == 1:
        return places.select("doc_id", F.lit(sizes[0]).alias("size"), "pos", F.expr(hashes[sizes[0]]).alias("h"))
    every = [f"named_struct('size', {k}, 'h', if(pos + {k} <= size(hs), {h}, null))" for k, h in hashes.items()]
    return places.select("doc_id", "pos", F.explode(F.expr(f"array({', '.join(every)})")).alias("w")).select("doc_id", "w.size", "pos", "w.h").filter("h is not null")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, item_pos, h, form): the windows of each item's template (form 0), of its form for documents in one case (1), and of its lower-cased words (PLAIN)."""
    text = F.col("text")
    shaped = benchmark.select("item_id", words(canonical(text)).alias("a"), words(plain(text)).alias("b"), words(F.lower(text)).alias("c"))
    live = shaped.filter(F.size("a") >= LEAST).withColumn("size", F.least(F.lit(WINDOW), F.size("a")))
    forms = live.select("item_id", "size", F.posexplode(F.array("a", "b", "c")).alias("form", "ws"))
    cut = forms.select("item_id", "size", "form", F.posexplode(F.expr("transform(sequence(0, size(ws) - size), i -> slice(ws, i + 1, size))")).alias("item_pos", "w"))
    literal = F.expr(f"form = {PLAIN} or size(filter(w, t -> t not in ({_PLACEHOLDERS}))) >= least(size, {LITERALS})")
    hashed = cut.filter(literal).select("item_id", "size", "item_pos", "form", F.expr("xxhash64(transform(w, t -> xxhash64(t)))").alias("h"))
    return hashed.groupBy("item_id", "size", "item_pos", "h", (F.col("form") == PLAIN).alias("verbatim")).agg(F.min("form").alias("form"))


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per leaked (doc_id, item_id): kind, cover, n_matched, n_windows, first_word.

    Texts are cut into windows of WINDOW words twice: as lower-cased words, and as templates, in which numbers, units after
    them and names are typed placeholders. Windows of documents and items meet in a hash join. A pair is a leak if enough
    of the item's windows of one family match at one alignment (a difference of positions): ENOUGH, or half of them if that
    is fewer. Lower-cased words need no more: such a pair is ``exact``. By templates each value of a placeholder in the item
    must stand for one value in the document wherever it recurs in matched windows; the pair is ``exact`` if all have the
    item's values, else ``template``. Every alignment with enough windows is judged; of those that hold, an exact one is
    given, else that with most windows, the earliest of equal ones. Items also have template windows in which names are plain words, which documents without capitals, or all
    in capitals, match. first_word is where the item starts in the document, in words.

    Null or very short texts have no windows. Repeated rows of a document count once. Empty tables give no rows. Extra
    columns are ignored. The windows of documents are never shuffled while the benchmark's have at most BROADCAST_ROWS
    rows; each (document, item) pair is then aggregated.
    """
    index = scratch.keep(benchmark_windows(benchmark), "windows")
    sizes = sorted(r.size for r in index.select("size").distinct().collect()) or [WINDOW]  # at most WINDOW numbers
    at = lambda form: F.countDistinct(F.when(form, F.col("item_pos")))
    per_form = index.groupBy("item_id").agg(at(F.col("form") == 0).alias("n0"), at(~F.col("verbatim")).alias("n1"), at(F.col("verbatim")).cast("long").alias("n_plain"))
    totals = per_form.select("item_id", "n_plain", F.when(F.col("n0") > 0, F.col("n0")).otherwise(F.col("n1")).cast("long").alias("n_windows"))
    small = index.count() <= BROADCAST_ROWS
    side = lambda df: F.broadcast(df) if small else df
    source = docs.select("doc_id", "text").filter("doc_id is not null")

    def hits(form: Column, verbatim: bool) -> DataFrame:
        met = _document_windows(source, sizes, form).join(side(index.filter(F.col("verbatim") == verbatim)), ["size", "h"])
        return met.select("doc_id", "item_id", "size", "item_pos", "verbatim", (F.col("pos") - F.col("item_pos")).alias("shift"))

    every = hits(F.lower("text"), True).unionByName(hits(canonical(F.col("text")), False)).distinct()
    found = every.groupBy("doc_id", "item_id", "size", "verbatim", "shift").agg(F.collect_list("item_pos").alias("matched"))  # of one item
    enough = (
        found.withColumn("n_matched", F.size("matched").cast("long"))
        .join(side(totals), "item_id")
        .withColumn("n_windows", F.when(F.col("verbatim"), F.col("n_plain")).otherwise(F.col("n_windows")))
        .filter(f"n_matched >= least({ENOUGH}, ceil(n_windows / 2))")
    )
    pairs = scratch.keep(enough, "leaks")
    exact = pairs.filter("verbatim").withColumn("same", F.lit(1))
    maybe = pairs.filter("not verbatim").join(exact, ["doc_id", "item_id"], "left_anti")
    slots = _slots(maybe, docs, benchmark)
    judged = slots.groupBy("doc_id", "item_id", "shift").agg(F.min((F.col("lo") == F.col("hi")).cast("int")).alias("consistent"), F.min(((F.col("lo") == F.col("item_value")) & (F.col("hi") == F.col("item_value"))).cast("int")).alias("same"))
    good = maybe.join(judged, ["doc_id", "item_id", "shift"], "left").withColumn("same", F.coalesce("same", F.lit(1))).filter("same = 1 or consistent = 1").drop("consistent")
    best = exact.unionByName(good).groupBy("doc_id", "item_id").agg(F.max(F.struct("same", "n_matched", (-F.col("shift")).alias("back"), "n_windows")).alias("m")).select("doc_id", "item_id", "m.*")
    return best.select(
        "doc_id", "item_id", F.when(F.col("same") == 1, "exact").otherwise("template").alias("kind"), F.least(F.lit(1.0), F.col("n_matched") / F.col("n_windows")).alias("cover"), "n_matched", "n_windows",
        (-F.col("back")).cast("long").alias("first_word"),
    )


def _slots(pairs: DataFrame, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift, type, item_value, lo, hi): the least and the greatest value that a placeholder's value has in the document.

    Only places within matched windows are compared, where both sides have the same placeholder or the document has the item's word in another case.
    """
    some = docs.select("doc_id", "text").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    d = some.select("doc_id", words(F.lower("text")).alias("doc_words"), words(canonical(F.col("text"))).alias("doc_forms"))
    i = benchmark.filter("item_id is not null").select("item_id", words(F.lower("text")).alias("item_words"), words(canonical(F.col("text"))).alias("item_forms"))
    covered = pairs.withColumn("places", F.expr("array_distinct(flatten(transform(matched, p -> sequence(p, p + size - 1))))"))
    return (
        covered.join(d, "doc_id").join(i, "item_id")
        .select(
            "doc_id", "item_id", "shift",
            F.explode(F.expr(
                "filter(transform(places, i -> struct(item_forms[i] as type, item_words[i] as item_value, try_element_at(doc_words, cast(i + shift + 1 as int)) as doc_value, "
                f"try_element_at(doc_forms, cast(i + shift + 1 as int)) as doc_type)), x -> x.type in ({_PLACEHOLDERS}) and (x.doc_type = x.type or x.doc_value = x.item_value))"
            )).alias("s"),
        )
        .groupBy("doc_id", "item_id", "shift", "s.type", "s.item_value")
        .agg(F.min("s.doc_value").alias("lo"), F.max("s.doc_value").alias("hi"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, all columns unchanged. Rows without doc_id stay."""
    names = docs.columns
    gone = scratch.keep(leaks(docs, benchmark, scratch).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in names])


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))
