"""Quality rules: counts of words, symbols and repeats, and the distance of a text from its language's usual histograms.

Everything is a DataFrame expression. One pass over the texts makes a narrow table of counts; the references
are sums of that table by language; the verdict joins the two.

Defined results: a null text counts as empty; an empty text has zeros and fails the base rules; a null or
unknown language has a reference of its own (made from all its texts) and no common words; repeated rows are
judged alike; an empty table gives an empty table; columns other than doc_id, text and lang are not looked at; texts of any length are counted whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, word_array

#: Words that are frequent in any prose of a language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on are as with his they at be this from have or by not but".split(),
    "fr": "de la le et les des en un une est que dans qui du il au pour pas sur se par plus ce avec sont ne".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er so dass aus".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo como más pero sus le ya".split(),
}

#: Character classes: what is left when all else is dropped.
CLASSES = {
    "upper": "[^A-Z]+",
    "lower": "[^a-z]+",
    "digit": "[^0-9]+",
    "symbol": "[^#*$%&|<>]+",
    "point": r"""[^.,;:!?'"()\-]+""",
    "wide": r"[\x00-\x7F]+",
}

MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5
#: Shorter texts have histograms (of classes, of common words) too noisy to be judged.
JUDGED_FROM_WORDS = 50
JUDGED_WORDS_FROM = 100
MAX_CLASS_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.5


def _kept_chars(text: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


def counts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang, the base counts and the histograms of every text (null: empty)."""
    text = F.col("_text")
    df = docs.select(*(keep or ["doc_id", "lang"]), F.coalesce("text", F.lit("")).alias("_text"))
    df = df.withColumn("_words", word_array(text))
    words = F.col("_words")
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "_grams": F.when(
                F.size(words) >= 3,
                F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
            ),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")),
            "_hits": F.filter(F.transform(words, F.lower), lambda w: w.isin(*sorted({y for x in COMMON_WORDS.values() for y in x}))),
        }
    )
    # Where any hash repeats, windows are told apart by two.
    second = lambda i: F.xxhash64(F.lit(1), F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    same = lambda a, b: (a["g"] == b["g"]) & (a["h"] == b["h"])
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), second(i).alias("h"), i.alias("i"))))))
    pairs = F.col("_sorted")
    df = df.withColumn(
        "_starts",
        F.array_sort(
            F.transform(
                F.filter(pairs, lambda x, i: same(F.get(pairs, i + 1), x) | same(F.when(i > 0, F.get(pairs, i - 1)), x)),
                lambda x: x["i"],
            )
        ),
    )
    starts = F.col("_starts")
    covered = F.aggregate(F.transform(starts, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    hits = F.col("_hits")
    lists = reduce(lambda a, b: a.when(F.col("lang") == b, F.array(*map(F.lit, COMMON_WORDS[b]))), COMMON_WORDS, F)
    return df.withColumn("_list", lists).select(
        *(keep or ["doc_id", "lang"]),
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _kept_chars(text, CLASSES["symbol"]).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(starts.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.array(*[_kept_chars(text, x) for x in CLASSES.values()]).alias("class_counts"),
        F.transform("_list", lambda w: F.size(F.filter(hits, lambda x: x == w)).cast("long")).alias("common_counts"),
    )


def _share(counts_: Column, total: Column) -> Column:
    return F.transform(counts_, lambda x: x / total)


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance (the divergence's square root, in bits: 0 to 1) of two histograms of one length that each sum to 1."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)))  # rounding may leave less than 0


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, b: a + b)


def quality_rules(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, judged_from: int = JUDGED_FROM_WORDS, judged_words_from: int = JUDGED_WORDS_FROM) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, both distances (null where there is nothing to judge) and kept.

    The reference of a language is the summed histogram of all its texts that pass the base rules.
    """
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT_SHARE) * F.col("n_words"))
    df = cut(counts(docs).withColumn("base_failed", base_failed), "quality-counts")
    n, m = len(CLASSES), max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.get("class_counts", F.lit(i))).alias(f"c{i}") for i in range(n)] + [F.sum(F.get("common_counts", F.lit(i))).alias(f"w{i}") for i in range(m)]
    refs = df.filter(~F.col("base_failed")).groupBy(F.col("lang").alias("_lang")).agg(*sums, F.sum("n_words").alias("_n"))
    c, w = F.array(*[F.col(f"c{i}") for i in range(n)]), F.array(*[F.col(f"w{i}") for i in range(m)])
    refs = refs.withColumn("_ct", _total(c)).select(
        "_lang",
        F.when(F.col("_ct") > 0, _share(c, F.col("_ct"))).alias("_ref_class"),
        F.when(F.col("w0").isNotNull() & (F.col("_n") > 0), F.concat(_share(w, F.col("_n")), F.array(1 - _total(w) / F.col("_n")))).alias("_ref_word"),
    )
    df = df.join(cut(refs, "quality-references"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    df = df.withColumns({"_ct": _total(F.col("class_counts")), "_wt": _total(F.col("common_counts"))})
    enough, enough_words = F.col("n_words") >= judged_from, F.col("n_words") >= judged_words_from
    df = df.withColumns(
        {
            "class_distance": F.when(enough & (F.col("_ct") > 0) & F.col("_ref_class").isNotNull(), jensen_shannon(_share(F.col("class_counts"), F.col("_ct")), F.col("_ref_class"))),
            "word_distance": F.when(
                enough_words & F.col("_ref_word").isNotNull() & F.col("common_counts").isNotNull(),
                jensen_shannon(F.concat(_share(F.col("common_counts"), F.col("n_words")), F.array(1 - F.col("_wt") / F.col("n_words"))), F.col("_ref_word")),
            ),
        }
    )
    usual = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return df.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & usual).alias("kept")
    )
