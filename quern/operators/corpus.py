"""The corpus: one row a text, numbered without a global sort, and lookups in it."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.fixed import COLLECTIONS, NICKNAMES, TITLE_PREFIXES
from quern.operators.ordinal import numbered
from quern.operators.patterns import any_of
from quern.operators.sizes import settled


class SearchError(Exception):
    """An answer that is an error: kind is unknown_collection, not_found or unavailable."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def collection_dimension(spark) -> DataFrame:
    """The known collections: slug, load_order, tier, english_title."""
    return spark.createDataFrame([(s, i, t, e) for i, (s, t, e) in enumerate(COLLECTIONS)], "slug string, load_order int, tier int, english_title string")


def leading_int(c):
    """A text's numeric prefix, or 0: how a text column sorts as a number."""
    return F.coalesce(F.expr("try_cast(regexp_extract(%s, '^\\\\s*([+-]?[0-9]+)', 1) AS bigint)" % c), F.lit(0))


def ordinals(keys: DataFrame) -> DataFrame:
    """Rows (collection, bookNumber, babID, arabicURN) with id_in_book: their place in the collection.

    Places come from ranges of the whole order, so neither a collection nor a book is ever one task's, and only keys are
    shuffled.
    """
    by = [leading_int("bookNumber").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in ("bookNumber", "babID", "arabicURN"))]
    return numbered(keys, "collection", by, "id_in_book")


def build(source: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """The corpus of a source table: ordinals within collections, corpus_idx over all, narrator split off, grades ranked.

    corpus_idx is the ordinal plus the sizes of the collections before: a sum over as
    many rows as there are collections, and no sort of the whole table. Null texts
    become empty; rows of unknown collections are left out, as are collections without rows.
    """
    dim = dimension if dimension is not None else collection_dimension(source.sparkSession)
    sizes = source.groupBy(F.col("collection").alias("slug")).count().join(F.broadcast(dim), "slug")
    before = F.sum("count").over(Window.orderBy("load_order").rowsBetween(Window.unboundedPreceding, -1))  # a row a collection
    offsets = sizes.select("slug", "tier", F.coalesce(before, F.lit(0)).alias("offset"))
    numbered = ordinals(source.select("collection", "bookNumber", "babID", "arabicURN"))
    split = T.split_narrator(F.coalesce("englishText", F.lit("")))
    grades = source.select("englishgrade1").distinct().select(F.col("englishgrade1").alias("raw"), T.grade_tier(T.grade_class(F.col("englishgrade1"))).alias("grade_tier"))
    ranked = source.withColumn("parts", split).join(numbered.select("arabicURN", "id_in_book"), "arabicURN")
    joined = ranked.join(F.broadcast(offsets), ranked["collection"] == offsets["slug"]).join(grades, F.col("englishgrade1").eqNullSafe(F.col("raw")), "left")
    return joined.select(
        (F.col("offset") + F.col("id_in_book") - 1).alias("corpus_idx"), "collection", "id_in_book", F.col("arabicURN").alias("global_id"), F.floor("babID").cast("int").alias("chapter_id"),
        F.coalesce("arabicText", F.lit("")).alias("arabic"), F.col("parts.narrator").alias("narrator"), F.col("parts.body").alias("text"), F.coalesce("hadithNumber", F.lit("")).alias("number"),
        F.coalesce("bookNumber", F.lit("")).alias("book"), F.col("englishURN").alias("urn"), F.coalesce("arabicgrade1", F.lit("")).alias("arabic_grade"), F.coalesce("englishgrade1", F.lit("")).alias("grade"), "grade_tier", "tier",
    )


def chapters(source: DataFrame) -> DataFrame:
    """One row a chapter of a book, its titles the greatest non-blank ones; book and chapter number are kept apart."""
    title = lambda c: F.coalesce(F.max(F.when(F.trim(c) != "", F.col(c))), F.lit(""))
    return source.groupBy("collection", "bookNumber", "babID").agg(title("englishBabName").alias("english_title"), title("arabicBabName").alias("arabic_title"))


def list_collections(corpus: DataFrame, dimension: DataFrame) -> DataFrame:
    """Collections with rows: slug, title (the slug where none is known), count, by slug."""
    counted = corpus.groupBy(F.col("collection").alias("slug")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(settled(dimension), "slug", "left").select("slug", F.coalesce("english_title", "slug").alias("english_title"), "n").orderBy("slug")


def books(chapters: DataFrame, collection: str) -> DataFrame:
    """A collection's chapters by number, from chapters(); SearchError of kind unknown_collection if it has none."""
    found = chapters.where(F.col("collection") == collection)
    if not found.limit(1).count():
        raise SearchError("unknown_collection", f"unknown collection {collection!r}")
    return found.select("collection", F.floor("babID").cast("int").alias("id"), "bookNumber", "babID", "english_title", "arabic_title").orderBy(leading_int("bookNumber"), "bookNumber", "babID")


def get(corpus: DataFrame, dimension: DataFrame, collection: str, number: str, site: str = "") -> DataFrame:
    """The one record that a number names; SearchError of kind unknown_collection, or not_found with the numbers there are."""
    key = corpus.sparkSession.createDataFrame([(0, collection, str(number))], "key_id long, collection string, key string")
    found = lookup(corpus, key).drop("key_id", "rule")
    if not found.limit(1).count():
        n = corpus.where(F.col("collection") == collection).agg(F.max("id_in_book")).first()[0]
        if n is None:
            raise SearchError("unknown_collection", f"unknown collection {collection!r}")
        raise SearchError("not_found", f"no {number} in {collection}; its ordinals are 1 to {n}")
    return record(found, dimension, site)


def lookup(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """The row that each (key_id, collection, key) names, by the first rule that finds one.

    Rules: the whole number; a part of a number with commas; digits followed by letters,
    alphabetically first; the ordinal. Each rule is an equality, so it is one hash join. Texts are
    fetched only for the rows that are found.
    """
    key = keys.select("key_id", "collection", T.stripped(F.col("key")).alias("key")).where("key <> ''").withColumn("k", T.squashed(F.col("key")))
    number = T.squashed(F.col("number"))
    forms = corpus.select("corpus_idx", "collection", "id_in_book", "number").withColumn("n", number).select(
        "*", F.flatten(F.array(
            F.array(F.struct(F.lit(1).alias("rule"), F.col("n").alias("k"), F.lit("").alias("tie"))),
            F.when(F.col("number").contains(","), F.transform(F.split("number", ","), lambda p: F.struct(F.lit(2).alias("rule"), T.squashed(p).alias("k"), F.lit("").alias("tie")))).otherwise(F.array()),
            F.when(F.col("n").rlike(r"^[0-9]+\p{L}+$"), F.array(F.struct(F.lit(3).alias("rule"), F.regexp_extract("n", "^([0-9]+)", 1).alias("k"), F.col("n").alias("tie")))).otherwise(F.array()),
            F.array(F.struct(F.lit(4).alias("rule"), F.col("id_in_book").cast("string").alias("k"), F.lit("").alias("tie"))),
        )).alias("some"),
    ).select("*", F.explode("some").alias("form"))
    as_number = F.expr("CAST(try_cast(key AS bigint) AS string)")
    asked = key.select("key_id", "collection", F.explode(F.array(F.struct(F.lit(False).alias("ordinal"), F.col("k")), F.struct(F.lit(True).alias("ordinal"), as_number.alias("k")))).alias("a")).select("key_id", "collection", "a.ordinal", F.col("a.k").alias("k"))
    found = forms.select("corpus_idx", "collection", "id_in_book", "form.rule", F.col("form.k").alias("k"), "form.tie").join(settled(asked), ["collection", "k"]).where((F.col("rule") == 4) == F.col("ordinal"))
    best = F.row_number().over(Window.partitionBy("key_id").orderBy("rule", "tie", "id_in_book"))
    named = found.withColumn("best", best).where("best = 1").select("key_id", "rule", "corpus_idx")
    return corpus.join(settled(named), "corpus_idx").select("key_id", "rule", *corpus.columns)


def drawn(corpus: DataFrame, k: int, seed: int, by: str | None = None, key: str = "corpus_idx") -> DataFrame:
    """k rows (of each value of `by`), each as likely as any other: those of the least keyed hash of their key.

    The draw depends on the seed and on which rows there are, not on how they are laid out, and draws of parts merge: the
    k least of a whole are among the k least of its parts. So each task keeps k rows, and no table is sorted.
    """
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    lots = corpus.withColumn("__lot", lot)
    if by is None:
        return lots.orderBy("__lot").limit(k).drop("__lot")
    place = F.row_number().over(Window.partitionBy(by).orderBy("__lot"))
    return lots.withColumn("__place", place).where(F.col("__place") <= k).drop("__lot", "__place")


def random_row(corpus: DataFrame, collection: str | None = None, seed: int | None = None) -> DataFrame:
    """One row drawn evenly over rows, the same for the same seed."""
    rows = corpus if collection is None else corpus.where(F.col("collection") == collection)
    return drawn(rows, 1, secrets.randbits(63) if seed is None else seed)


def record(corpus: DataFrame, dimension: DataFrame, site: str = "") -> DataFrame:
    """Rows as they are shown: title, chain, and a reference of site, collection and citation."""
    named = corpus.join(settled(dimension.select(F.col("slug").alias("collection"), "english_title")), "collection", "left")
    reference = F.concat(F.lit(f"{site}/" if site else ""), F.col("collection"), F.lit(":"), T.citation(F.col("number"), F.col("id_in_book")))
    return named.select("corpus_idx", "collection", "id_in_book", "number", F.coalesce("english_title", "collection").alias("english_title"), "narrator", "text", "arabic", "grade", T.narrators(F.col("arabic")).alias("chain"), reference.alias("reference"))


def citation_aliases(dimension: DataFrame) -> DataFrame:
    """alias and slug: the names that citations may use for a collection.

    A name is a slug or a title, whole or less any number of its leading prefixes. No
    prefix begins another, so a name's run of them falls apart in one way. A name that
    several collections have means the last of them by slug, a nickname its own always.
    """
    prefix = "|".join(TITLE_PREFIXES)
    names = dimension.select("slug", F.explode(F.array("slug", "english_title")).alias("name")).select("slug", T.title_key(F.col("name")).alias("name"))
    run = names.withColumn("run", F.regexp_extract_all(F.regexp_extract("name", f"^(?:{prefix})+", 0), F.lit(prefix), F.lit(0)))
    shorter = F.transform(F.sequence(F.lit(0), F.size("run")), lambda i: F.substring(F.col("name"), F.length(F.array_join(F.slice("run", F.lit(1), i), "")) + 1, F.length("name")))
    known = dimension.sparkSession.createDataFrame(sorted(NICKNAMES.items()), "alias string, nicknamed string")
    aliases = run.select("slug", F.explode(shorter).alias("alias")).where("alias <> ''").groupBy("alias").agg(F.max("slug").alias("slug"))
    return aliases.join(known, "alias", "full").select("alias", F.coalesce("nicknamed", "slug").alias("slug"))


def parse_references(references: DataFrame, aliases: DataFrame) -> DataFrame:
    """reference, slug and number of citations such as `Title #12a`; unknown titles are left out."""
    pattern = r"(?s)^(.+?)\s*#?\s*([0-9][0-9a-zA-Z,\s]*?)\s*$"
    parts = references.withColumns({"alias": T.title_key(F.regexp_extract(T.stripped(F.col("reference")), pattern, 1)), "number": F.regexp_extract(T.stripped(F.col("reference")), pattern, 2)})
    return parts.join(settled(aliases), "alias").select("reference", "slug", "number")


def seed_relevance(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """query, collection, number of rows in chapters whose titles match a pattern of the query; Latin case is ignored in English titles."""
    titles, key = chapters(rows), ["collection", "bookNumber", "babID"]
    english = any_of(titles, key, "english_title", patterns, fold=True)
    matched = english.unionByName(any_of(titles, key, "arabic_title", patterns)).select("query", *key).distinct()
    return rows.join(settled(matched), key).where("coalesce(hadithNumber, '') <> ''").select("query", "collection", F.col("hadithNumber").alias("number")).distinct()
