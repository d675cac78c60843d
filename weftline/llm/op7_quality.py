"""Quality rules: base rules, then divergence from the language's reference.

A document that passes the base rules is compared with its language: the
histogram of its character classes, and that of its common words, against the
mean histograms of all passing documents of the language, by Jensen-Shannon
distance (base 2, 0 to 1).  Short documents are not judged, nor are languages
with few documents.  The text is read once; features are kept, and the
references and verdicts come from them.  DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import SPACE_CHARS, ascii_lower, let, words
from weftline.session import materialize, spread

#: Base rules.
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Twelve of the most common words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
#: Guards: characters and words from which a document is judged, documents from which a language is.
MIN_CHARS, MIN_JUDGED_WORDS, MIN_REFERENCE = 200, 100, 20
#: Class distances within which documents make the next, better means.
RADII = (0.2, 0.12)
#: A document is rejected beyond the first class distance, or beyond both others.
MAX_CLASS, BOTH_CLASS, BOTH_WORD = 0.3, 0.17, 0.22


def repeated_words(word_list: Column) -> Column:
    """How many words stand in a three-word window that the list holds twice or more.

    Windows are compared by 64-bit hashes.  Only lists with a repeated window are
    sorted; in a sorted list equal windows are neighbours.
    """
    n = F.size(word_list)
    spans = let(word_list, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def starts(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twin = lambda s: F.array_sort(
            F.transform(
                F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])).alias("twin"))), lambda x: x["twin"]),
                lambda x: x["i"],
            )
        )
        return let(ordered, twin)

    def covered(s: Column) -> Column:
        # each start covers three words, less those that the start before it covers
        return F.aggregate(F.transform(s, lambda i, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), i - F.get(s, k - 1)))), F.lit(0), lambda a, x: a + x)

    count = let(spans, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(starts(h), covered)))
    return F.when(n < 4, F.lit(0)).otherwise(count).cast("long")


def class_counts(text: Column, inked: Column, rest: Column) -> Column:
    """Characters of a text by class: small letters, white space, capitals, digits, marks, others.

    ``inked`` counts what is no white space, ``rest`` is the text without small letters and white space.
    """
    return let(
        F.struct(
            F.length(text).alias("all"),
            inked.alias("inked"),
            F.length(rest).alias("rest"),
            F.length(F.regexp_replace(rest, r"\P{Lu}+", "")).alias("upper"),
            F.length(F.regexp_replace(rest, r"\P{Nd}+", "")).alias("digit"),
            F.length(F.regexp_replace(rest, r"[^.,;:!?'\"()\-]+", "")).alias("mark"),
        ),
        lambda c: F.transform(F.array(c["inked"] - c["rest"], c["all"] - c["inked"], c["upper"], c["digit"], c["mark"], c["rest"] - c["upper"] - c["digit"] - c["mark"]), lambda x: x.cast("double")),
    )


def common_counts(word_list: Column, text: Column, lang: Column) -> Column:
    """How often each common word of the language occurs, then all other words; null without a list.

    The text is put in lower case as a whole before it is split, not word by word.
    """
    every = sorted({w for ws in COMMON.values() for w in ws})

    def of(own: list[str]):
        listed = F.array(*[F.lit(w) for w in own])
        tally = lambda got: F.transform(listed, lambda c: F.size(F.filter(got, lambda w: w == c)).cast("double"))
        with_rest = lambda n: F.concat(n, F.array(F.size(word_list) - F.aggregate(n, F.lit(0.0), lambda a, x: a + x)))
        return lambda got: let(tally(got), with_rest)

    found = F.filter(words(ascii_lower(text)), lambda w: w.isin(every))
    cases = F.when(F.lit(False), F.lit(None).cast("array<double>"))
    for name, own in COMMON.items():
        cases = cases.when(lang == name, let(found, of(own)))
    return cases


def normal(counts: Column) -> Column:
    """Counts as shares; null where there are none."""
    return let(counts, lambda c: let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda s: F.when(s > 0, F.transform(c, lambda x: x / s))))


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two distributions over the same bins."""
    part = lambda a, b: F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2), F.lit(0.0), lambda s, x: s + x)))


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with the base counts and the two histograms; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(*keep, text.alias("_text"), F.col("lang").alias("_lang"))
    split = read.withColumns({"_words": words(F.col("_text")), "_rest": F.regexp_replace("_text", r"[\p{Ll}\x20\x09-\x0D]+", "")})
    counted = split.withColumn("_inked", F.length(F.array_join("_words", "")))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return counted.select(
        *keep,
        "_lang",
        F.size("_words").cast("long").alias("n_words"),
        F.col("_inked").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_rest", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        normal(class_counts(F.col("_text"), F.col("_inked"), F.col("_rest"))).alias("_classes"),
        normal(common_counts(F.col("_words"), F.col("_text"), F.col("_lang"))).alias("_common"),
    )


def _references(of: DataFrame) -> DataFrame:
    """The mean histograms of each language with enough documents: one row a language."""
    mean = lambda name, bins: F.array(*[F.coalesce(F.avg(F.get(name, i)), F.lit(0.0)) for i in range(bins)])
    means = of.groupBy(F.col("_lang").alias("_ref")).agg(F.count("*").alias("_docs"), mean("_classes", 6).alias("_ref_classes"), mean("_common", len(COMMON["en"]) + 1).alias("_ref_common"))
    return means.filter(F.col("_docs") >= MIN_REFERENCE).drop("_docs")


def _measure(held: DataFrame, known: DataFrame) -> DataFrame:
    joined = held.join(known, F.col("_lang").eqNullSafe(F.col("_ref")), "left")
    far = lambda name, guard: F.when(guard & F.col(f"_ref_{name}").isNotNull(), divergence(F.col(f"_{name}"), F.col(f"_ref_{name}")))
    distances = {
        "class_distance": far("classes", F.col("word_chars") >= MIN_CHARS),
        "word_distance": far("common", (F.col("n_words") >= MIN_JUDGED_WORDS) & F.col("_common").isNotNull()),
    }
    return joined.withColumns(distances).drop("_ref", "_ref_classes", "_ref_common")


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the base counts, the distances and the verdict of every row."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    held = materialize(features(spread(docs), keep).withColumn("base_failed", failed), "features")
    sound = held.filter(~F.col("base_failed") & (F.col("word_chars") >= MIN_CHARS))
    known = materialize(_references(sound), "references")
    for radius in RADII:  # junk bends the means; the next ones are of the documents near the last
        known = materialize(_references(_measure(sound, known).filter(F.col("class_distance") <= radius)), "references")
    measured = _measure(held, known)
    by_class, by_word = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    odd = (by_class > MAX_CLASS) | ((by_class > BOTH_CLASS) & (by_word > BOTH_WORD))
    return measured.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "word_distance")


def quality_documents(docs: DataFrame) -> DataFrame:
    """The digest of the rules for every row of ``docs``.

    Nulls: a null text has no words and fails; null languages are one language
    without common words; a null doc_id is kept.  Equal rows get equal verdicts.
    An empty table gives no rows.  Of ``docs`` only doc_id, text and lang are read.
    """
    return judge(docs, ["doc_id"]).withColumns({c: F.round(c, 4) for c in ("class_distance", "word_distance")})


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they were.

    The rows are written beside their features, so no text is shuffled.  Nulls: a
    null text has no words and its row goes; a null language or doc_id is no reason
    to go.  Equal rows go or stay together.  All columns are kept, of any name.  An
    empty table gives no rows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__wf_row"), "text", "lang")
    return judge(rows, ["__wf_row"]).filter("kept").select("__wf_row.*")
