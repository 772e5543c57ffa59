"""One form for texts that look the same.

Texts are exploded to positioned code points, joined with a broadcast table that holds each code point's
decomposition, width form or look-alike and its combining class, put in canonical order of marks, recomposed
and put together again.  The table is built by rule from the Unicode character data that Python ships, and
from the short lists of look-alike letters below; it has at most one row per code point of Unicode, so its
size is bounded.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.salting import salted_join
from ..sources.tables import materialize

# Letters of other scripts and the letters of the same shape, in pairs.
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅКМНОРСТУХІЈԌԚԜҮаеорсухіјѕԁԛԝһ", "ABESKMHOPCTYXIJGQWYaeopcyxijsdqwh"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲ", "ABEZHIKMNOPTYXCjoc"),
    "Armenian": ("ՕՏսօոց", "OSuonq"),
    "kanji": ("二工八力夕卜口", "ニエハカタトロ"),
    "hiragana": ("へり", "ヘリ"),
}
_RADICALS = ((0x2E80, 0x2FDF),)
_JAMO = {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFFA0, 0xFFDD)}


def _invisible(o: int) -> bool:
    return unicodedata.category(chr(o)) == "Cf" or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def _decomposed(o: int) -> str:
    """The canonical decomposition after the width form, radical, space or look-alike of a code point."""
    c = chr(o)
    if _invisible(o):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag in ("<wide>", "<narrow>") or any(a <= o <= b for a, b in _RADICALS) or 0xFF00 <= o <= 0xFFEF or o == 0x2011:
        c = unicodedata.normalize("NFKC", c)
        c = _JAMO.get(o, c)
    c = unicodedata.normalize("NFD", c)
    return "".join(_like().get(x, x) for x in c)


@lru_cache(maxsize=1)
def _like() -> dict[str, str]:
    out = {}
    for a, b in LOOK_ALIKES.values():
        out |= dict(zip(a, b, strict=True))
    return out


@lru_cache(maxsize=1)
def code_points() -> list[tuple[str, str, str]]:
    """(code point, its decomposition, the combining class of each part as a character) of all that are not their own form, are marks or conjoin."""
    out = []
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o <= 0xDFFF or 0xAC00 <= o <= 0xD7A3:  # Hangul syllables decompose by arithmetic
            continue
        c = chr(o)
        d = _decomposed(o)
        if d != c or unicodedata.combining(c) or 0x1100 <= o <= 0x11FF:
            out.append((c, d, "".join(_class(x) for x in d)))
    return out


def _class(c: str) -> str:
    """The combining class as a character: . for none, J for conjoining letters."""
    k = unicodedata.combining(c)
    return chr(0x100 + k) if k else "J" if 0x1100 <= ord(c) <= 0x11FF else "."


@lru_cache(maxsize=1)
def _unordered() -> str:
    """A pattern for two neighbouring classes of which the later is the lower."""
    classes = sorted({x for _, _, m in code_points() for x in m if x not in ".J"})
    return "|".join(f"[{classes[i + 1]}-{classes[-1]}]{x}" for i, x in enumerate(classes[:-1]))


def _table(spark: SparkSession) -> DataFrame:
    """cp, to, classes: the broadcast table, at most one row per code point of Unicode."""
    return F.broadcast(spark.createDataFrame(code_points(), "cp string, to string, classes string"))


def _recompose(c: Column) -> Column:
    """NFC, by the ICU library that Spark ships for its collations."""
    return F.when(c.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False)))


def _ordered(texts: DataFrame) -> DataFrame:
    """Texts (k0, k1, s) whose marks are out of order: the marks after each starter sorted by their class, stably."""
    points = texts.select("k0", "k1", F.posexplode(F.split("s", "")).alias("pos", "cp")).filter("cp <> ''")
    points = points.join(_table(texts.sparkSession).select("cp", F.substring("classes", 1, 1).alias("c")), "cp", "left").withColumn("c", F.when(F.col("c").isNull() | F.col("c").isin(".", "J"), "").otherwise(F.col("c")))
    w = W.partitionBy("k0", "k1").orderBy("pos")
    points = points.withColumn("starter", F.sum((F.col("c") == "").cast("int")).over(w))
    whole = F.array_sort(F.collect_list(F.struct("starter", "c", "pos", "cp")))
    return points.groupBy("k0", "k1").agg(F.array_join(F.transform(whole, lambda x: x["cp"]), "").alias("s"))


def keyed(rows: DataFrame, text: str) -> DataFrame:
    """rows with k0 and k1, together 128 bits that stand for the text."""
    return rows.withColumns({"k0": F.xxhash64(text), "k1": F.xxhash64(F.lit(1), text)})


def one_form(texts: DataFrame, text: str) -> DataFrame:
    """(k0, k1, form) of the distinct values of column *text*, keyed as by keyed(); equal forms look the same.

    Letter case, punctuation, accents, digits and the amount of white space stay.  Null has no form.  A text of
    ASCII only is its own form, as no ASCII character has a row in the table, and is not exploded.
    """
    spark = texts.sparkSession
    values = keyed(texts.select(F.col(text).cast("string").alias("value")).filter("value is not null"), "value").distinct()
    plain = values.filter("octet_length(value) = length(value)").select("k0", "k1", F.col("value").alias("form"))
    todo = values.filter("octet_length(value) > length(value)")
    todo = todo.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k0", "k1")
    points = todo.select("k0", "k1", F.posexplode(F.split("value", "")).alias("pos", "cp"))
    points = points.join(_table(spark), "cp", "left").select("k0", "k1", "pos", F.coalesce("to", "cp").alias("c"), F.coalesce("classes", F.lit(".")).alias("m"))
    whole = points.groupBy("k0", "k1").agg(F.array_sort(F.collect_list(F.struct("pos", "c", "m"))).alias("a"))
    rebuilt = whole.select("k0", "k1", F.array_join(F.transform("a", lambda x: x["c"]), "").alias("s"), F.array_join(F.transform("a", lambda x: x["m"]), "").alias("m"))
    marks = F.col("m").rlike("[^.]")
    rebuilt = materialize(rebuilt.select("k0", "k1", "s", marks.alias("marks"), (marks & F.col("m").rlike(_unordered())).alias("unordered")), "rebuilt")
    ordered = rebuilt.filter("not unordered").unionByName(_ordered(rebuilt.filter("unordered")).withColumns({"marks": F.lit(True), "unordered": F.lit(True)}))
    return plain.unionByName(ordered.select("k0", "k1", F.when(F.col("marks"), _recompose(F.col("s"))).otherwise(F.col("s")).alias("form")))


def alike_pairs(rows: DataFrame, group: list[str], row: str, text: str, chunk_rows: int = 2_000) -> DataFrame:
    """(group, row_a, row_b), row_a < row_b: rows of one group whose texts look the same but are not the same string.

    Texts and forms are compared by 128 bits of hash.  Only forms with several texts are joined.  The rows of a text are
    gathered into chunks of about chunk_rows first: copies of one text are never paired with each other, and a text that
    a third of all rows share is spread over its chunks.  Pairs of chunks are spread over all tasks before they are
    expanded, so a task writes chunk_rows ** 2 pairs at a time at most; the number of pairs itself is what is asked for.
    """
    kept = rows.select(*group, F.col(row).alias("row"), F.col(text).cast("string").alias("value")).filter("value is not null and row is not null")
    forms = materialize(one_form(kept, "value").select("k0", "k1", F.xxhash64("form").alias("f0"), F.xxhash64(F.lit(1), "form").alias("f1")), "forms")
    hashed = materialize(keyed(kept, "value").select(*group, "row", "k0", "k1").distinct(), "rows")
    variants = hashed.groupBy(*group, "k0", "k1").agg(F.count("*").alias("n")).join(forms, ["k0", "k1"])
    variants = materialize(variants, "looks")
    several = variants.groupBy(*group, "f0", "f1").agg(F.count("*").alias("texts")).filter("texts > 1").drop("texts")
    variants = materialize(variants.join(several, [*group, "f0", "f1"], "left_semi"), "variants")
    placed = salted_join(hashed, variants.withColumn("chunks", F.ceil(F.col("n") / chunk_rows)), [*group, "k0", "k1"], "n", "row", hot_rows=50 * chunk_rows)
    gathered = placed.groupBy(*group, "f0", "f1", "k0", "k1", F.pmod(F.xxhash64("row"), F.col("chunks")).alias("chunk")).agg(F.collect_list("row").alias("members"))
    gathered = materialize(gathered, "chunks")
    a = gathered.select(*group, "f0", "f1", F.struct("k0", "k1").alias("ka"), F.col("chunk").alias("ca"), F.col("members").alias("ma"))
    b = gathered.select(*group, "f0", "f1", F.struct("k0", "k1").alias("kb"), F.col("chunk").alias("cb"), F.col("members").alias("mb"))
    pairs = a.join(b, [*group, "f0", "f1"]).filter("ka < kb").repartition("ka", "kb", "ca", "cb")
    pairs = pairs.select(*group, F.explode("ma").alias("x"), "mb").select(*group, "x", F.explode("mb").alias("y"))
    return pairs.select(*group, F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b")).filter("row_a < row_b").distinct()
