"""Quality rules by divergence: a document's character classes and common words against those of its language.

DataFrame functions only, no row leaves its task: words, windows and histograms are arrays of one row. Each select
gives names to what later ones use more than once, so nothing is computed twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import materialize

#: White space between words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8
#: Common words of a language, at most.
TOP = 20
#: Classes of characters beside white space; what is in none, small letters above all, is the last class.
CLASSES = (r"\p{Lu}", r"\p{Nd}", r".,;:!?'\"()\-", r"#*$%&|<>")
BLANKS = (" ", "\n", "\t")
#: Small letters and white space, most of a text and in none of CLASSES: taken out before these are counted.
COMMON = r"[a-zß-öø-ÿ\s]+"


def _count(text: Column, inside: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{inside}]+", ""))


def _classes(text: Column, marks: Column) -> Column:
    """Counts of white space and of CLASSES; marks: the text without COMMON."""
    solid = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, text)
    return F.array(F.length(text) - F.length(solid), *[_count(marks, x) for x in CLASSES])


def _with_rest(counts: Column, total: Column) -> Column:
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0), lambda a, x: a + x)))


def letter_words(text: Column) -> Column:
    """The lower-case words of letters."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, marks (the text without COMMON), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: counted over
    the whole text (null: empty)."""
    found = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c for c in ("lang", "row") if c in docs.columns and c not in (id_col, text_col)])
    found = found.withColumn("marks", F.regexp_replace("text", COMMON, ""))
    others = [c for c in found.columns if c not in (id_col,)]
    found = found.select("*", F.array_remove(F.split("text", SPACE, -1), "").alias("words"), F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    found = found.select(
        id_col,
        *others,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("marks", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    kept = [c for c in found.columns if c != "hashes"]

    def joined(hashes: Column, step: int) -> Column:
        """The hashes of twice as many words, from those of `step` words."""
        n = F.greatest(F.size(hashes) - step, F.lit(0))
        return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))

    step = 1
    while step < WINDOW:
        made = joined(F.col("hashes"), step)
        if 2 * step == WINDOW:  # texts in which no half of a window comes twice, most of them, have no window twice
            made = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), made).otherwise(F.array().cast("array<bigint>"))
        found = found.select(*kept, made.alias("hashes"))
        step *= 2
    found = found.withColumnRenamed("hashes", "windows")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.when(repeats, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>"))
    found = found.select(*kept, pairs.alias("pairs"))
    twice = F.filter("pairs", lambda p, k: (F.get("pairs", k - 1)["hash"] == p["hash"]) | (F.get("pairs", k + 1)["hash"] == p["hash"]))
    found = found.select(*kept, F.sort_array(F.transform(twice, lambda p: p["at"])).alias("at"))
    covered = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW))).cast("long"))
    return found.select(*kept, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def language_references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, longest: int = 6, min_docs: int = 20) -> DataFrame:
    """lang, classes (shares), words (the top most frequent of up to `longest` letters), shares (of these, and of all other
    words last), over all documents.

    Languages with fewer than min_docs documents have none; every other has one row. Ties in frequency go by the word.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.select("lang", "text", F.regexp_replace("text", COMMON, "").alias("marks"))
    counted = counted.select("lang", F.length("text").alias("chars"), _classes(F.col("text"), F.col("marks")).alias("classes"))
    width = len(CLASSES) + 1
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(width)]
    classes = counted.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), *sums).where(f"docs >= {min_docs} AND chars > 0")
    known = [F.col(f"c{i}") / F.col("chars") for i in range(width)]
    classes = classes.select("lang", F.array(*known, F.greatest(F.lit(0.0), 1 - reduce(Column.__add__, known))).alias("classes"))
    words = rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    words = words.select("lang", F.when(F.length("word") <= longest, F.col("word")).otherwise("").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang", "part"))
    first = words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64)))
    order = [(F.col("word") == "").asc(), F.desc("n"), F.col("word")]  # the empty word stands for all long ones
    first = first.select("lang", "word", "n", total.alias("total"), F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)).alias("place")).where(f"place <= {top}")
    best = first.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    whole = best.groupBy("lang").agg(
        F.sum(F.when(F.col("place") == 1, F.col("total"))).alias("total"),
        F.sort_array(F.collect_list(F.when((F.col("at") <= top) & (F.col("word") != ""), F.struct("at", "word", "n")))).alias("best"),
    )
    shares = F.transform("best", lambda x: x["n"] / F.col("total"))
    whole = whole.select("lang", F.transform("best", lambda x: x["word"]).alias("words"), F.concat(shares, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))).alias("shares"))
    return classes.join(whole, "lang").select("lang", "classes", "words", "shares")


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance (root of the divergence in bits, 0 to 1) of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0)) + F.when(b > 0, b * F.log2(b / m)).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x) / 2))


def quality_rules(docs: DataFrame, references: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_class_distance: float = 0.33, max_word_distance: float = 0.42, min_chars: int = 200, min_words: int = 50, longest: int = 6, whole_row: bool = False) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept;
    if asked, also row, a struct of all columns.

    docs: id, text, lang. base_failed: under 20 words, or over 30 % of words in repeated windows. kept: not base_failed,
    and no distance over its limit. A distance is null, and judges nothing, for a text under min_chars characters or
    min_words words of letters, or a language (or null) without a reference. references: language_references(docs) by
    default; a row of about 1 KB for each language, broadcast, its words in the plan as well. A null text is empty and fails. Whole texts are counted, however long; repeated
    rows agree; an empty table gives no rows. Columns other than these are neither read nor returned.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("lang").alias("lang"), *([F.struct(*docs.columns).alias("row")] if whole_row else []))
    if references is None:
        references = materialize(language_references(own, longest=longest), "references")
    common = sorted({w for r in references.select("words").collect() for w in r["words"]})
    found = measures(own, "id").join(F.broadcast(references), "lang", "left")
    base = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(["row"] if whole_row else [])]
    long_enough = F.col("classes").isNotNull() & (F.length("text") >= min_chars)
    found = found.select(*base, "classes", "words", "shares", F.length("text").alias("chars"), F.when(long_enough, _classes(F.col("text"), F.col("marks"))).alias("counts"), F.when(long_enough, letter_words(F.col("text"))).alias("own"))
    found = found.select(
        *base,
        "classes",
        "shares",
        F.transform(_with_rest(F.col("counts"), F.col("chars")), lambda x: x / F.col("chars")).alias("own_classes"),
        F.size("own").alias("n_own"),
        F.array_remove(F.transform("own", lambda w: F.when(w.isin(common), F.array_position("words", w)).otherwise(F.lit(0).cast("long"))), 0).alias("hits"),
    )
    counts = F.array(*[(F.size("hits") - F.size(F.array_remove("hits", b))) / F.col("n_own") for b in range(1, TOP + 1)])
    counts = F.concat(F.slice(counts, F.lit(1), F.size("shares") - 1), F.array((F.col("n_own") - F.size("hits")) / F.col("n_own")))
    found = found.select(*base, F.when(F.col("own_classes").isNotNull(), jensen_shannon(F.col("own_classes"), F.col("classes"))).alias("class_distance"), F.when(F.col("n_own") >= min_words, jensen_shannon(counts, F.col("shares"))).alias("word_distance"))
    found = found.select(*base, ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"), "class_distance", "word_distance")
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    # A row number, which is never negative, makes the verdict one that Catalyst doesn't copy below the selects: there a
    # filter on it would hold every step as many times as the next one names it.
    row = F.monotonically_increasing_id() >= 0
    return found.select("*", (~F.col("base_failed") & ~far & row).alias("kept")).withColumnRenamed("id", id_col)
