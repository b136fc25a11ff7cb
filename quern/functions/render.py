"""Results as lines of text, for people and language models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def error_line(error: Exception) -> str:
    """What is shown in place of a result."""
    return str(error)


# How many words a summary names, and the lines before rows; {0} stands for a query.
NAMED_WORDS = 8
FOUND, NONE = {"keyword": "matching {0}", "term": "matching the term {0}"}, {"keyword": "No matches for {0}", "term": "Nothing found containing a word matching {0}", "semantic": "No semantic matches for {0}"}


def summary_lines(summary: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """query_id and the line above a response's rows: how many there are, how many are shown, and the commonest words. kind: keyword, term or semantic."""
    counted = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"))
    said = summary.join(counted, "query_id", "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    query = F.concat(F.lit("'"), "query", F.lit("'"))
    scope = F.when(F.size("collections") > 0, F.concat(F.lit(" in "), F.array_join("collections", ", "))).otherwise("")

    def line(pattern: str):
        before, after = pattern.split("{0}")
        return F.concat(F.lit(before), query, F.lit(after))

    some = F.concat(F.lit("Top "), F.col("shown"), F.lit(" by similarity for "), query, scope, F.lit(":"))
    if kind != "semantic":
        more = F.when(F.col("total") > F.col("shown"), F.concat(F.lit("\nShowing first "), F.col("shown"), F.lit(":"))).otherwise("")
        words = F.lit("")
        if kind == "term":
            named = F.array_join(F.transform(F.slice("matched_words", 1, NAMED_WORDS), lambda w: F.concat(w["word"], F.lit(" ("), w["count"], F.lit(")"))), ", ")
            rest = F.when(F.size("matched_words") > NAMED_WORDS, F.concat(F.lit("\n  …and "), F.size("matched_words") - NAMED_WORDS, F.lit(" more distinct words."))).otherwise("")
            words = F.when(F.size("matched_words") > 0, F.concat(F.lit("\nMatched words: "), named, rest)).otherwise("")
        some = F.concat(F.lit("Found "), F.col("total"), F.lit(" text(s)"), scope, F.lit(" "), line(FOUND[kind]), F.lit("."), words, more)
    return said.select("query_id", F.when(F.col("shown") > 0, some).otherwise(F.concat(line(NONE[kind]), scope, F.lit("."))).alias("line"))


def cite():
    return F.when(F.coalesce("number", F.lit("")) != "", F.col("number")).otherwise(F.col("id_in_book").cast("string"))


def collection_lines(collections: DataFrame) -> DataFrame:
    """`- slug: title — n texts` of list_collections()."""
    return collections.select("slug", F.concat(F.lit("- "), "slug", F.lit(": "), "english_title", F.lit(" — "), F.format_number("n", 0), F.lit(" texts")).alias("line"))


def chapter_lines(chapters: DataFrame) -> DataFrame:
    return chapters.select("*", F.concat(F.lpad(F.coalesce(F.floor("babID").cast("string"), F.lit("—")), 6, " "), F.lit("  "), F.col("english_title")).alias("line"))


def hit_lines(rows: DataFrame) -> DataFrame:
    """`- title #number — grade — snippet`, with matched words and similarity where there are any."""
    words = F.when(F.col("matched_words").isNotNull(), F.concat(F.lit("  ["), F.array_join("matched_words", " | "), F.lit("]"))).otherwise("")
    near = F.when(F.col("similarity").isNotNull(), F.format_string("  (similarity %.2f)", "similarity")).otherwise("")
    return rows.select("*", F.concat(F.lit("- "), "title", F.lit(" #"), cite(), T.grade_tag(F.col("grade")), words, near, F.lit(" — "), "snippet").alias("line"))


def record_lines(records: DataFrame) -> DataFrame:
    """A text with its narrator, unmarked Arabic, chain and reference."""
    chain = F.transform("chain", lambda n: F.concat(F.lit("  "), (n["position"] + 1).cast("string"), F.lit(". "), F.when(n["tooltip"] != "", n["tooltip"]).otherwise(n["inline_name"]), F.when(n["role"] != "", F.concat(F.lit("  ("), n["role"], F.lit(")"))).otherwise("")))
    arabic = F.when(F.coalesce("arabic", F.lit("")) != "", F.concat(F.lit("\nArabic:\n"), T.without_markup(F.col("arabic"))))
    parts = F.concat_ws("\n", F.concat("english_title", F.lit(" #"), cite(), T.grade_tag(F.col("grade"))), F.nullif(F.col("narrator"), F.lit("")), F.nullif(F.col("text"), F.lit("")), arabic, F.when(F.size("chain") > 0, F.concat(F.lit("Chain of narration:\n"), F.array_join(chain, "\n"))), F.concat(F.lit("Reference: "), F.col("reference")))
    return records.select("*", parts.alias("line"))
