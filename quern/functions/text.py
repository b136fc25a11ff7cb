"""Text expressions. Each takes and returns columns and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.decompose import bound, to_ascii
from quern.functions.fixed import ARABIC, CONNECTIVES, GRADE_TIERS, LAST_TIER, MARKER, MARKS, NARRATOR, ROMAN_EXTENDED, ROMAN_FROM, ROMAN_LATIN, ROMAN_PAIRS, ROMAN_TO, SKELETON_PAIRS


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def every(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes, of two characters at least."""
    return F.filter(every(F.lower(c), "[a-z0-9']+"), lambda t: F.length(t) >= 2)


def query_words(c: Column) -> Column:
    """Lower-case words without connectives; the whole string if nothing else is left."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: (w != "") & ~w.isin(*CONNECTIVES))
    whole = stripped(F.lower(c))
    return F.when(F.size(words) > 0, words).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def narrators(c: Column) -> Column:
    """The chain as an array of (position, id, role, tooltip, inline_name)."""
    parts = F.arrays_zip(*(every(c, NARRATOR, g).alias(n) for g, n in ((1, "id"), (2, "role"), (3, "tooltip"), (4, "inline_name"))))
    return F.transform(
        parts,
        lambda x, i: F.struct(
            i.cast("int").alias("position"), x["id"].cast("int").alias("id"), x["role"].alias("role"), x["tooltip"].alias("tooltip"), stripped(x["inline_name"]).alias("inline_name")
        ),
    )


def without_markup(c: Column) -> Column:
    """Narrators' inline names in place of their tags, and no other markers."""
    return stripped(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), NARRATOR, "$4"), MARKER, ""))


def clean(c: Column) -> Column:
    """Paragraph tags as line ends, at most one blank line, no outer white space."""
    return stripped(F.regexp_replace(F.regexp_replace(c, "<p>", "\n"), r"\n{3,}", "\n\n"))


def split_narrator(c: Column) -> Column:
    """(narrator, body): the first line is the narrator if it ends in a colon and has at most 200 characters."""
    work = F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"^(<p>\s*)+", "")
    at = F.instr(work, "\n")
    line = stripped(F.substring(work, F.lit(1), at - 1))
    has = (at > 0) & line.endswith(":") & (F.length(line) <= 200)
    return F.when(has, F.struct(line.alias("narrator"), clean(F.substring(work, at + 1, F.length(work))).alias("body"))).otherwise(F.struct(F.lit("").alias("narrator"), clean(c).alias("body")))


def snippet(text: Column, query: Column, radius: int = 80) -> Column:
    """The surroundings of the query's first place in the text, or the text's head."""
    at = F.instr(F.lower(text), F.lower(query))
    start = F.greatest(at - 1 - radius, F.lit(0))
    end = F.least(at - 1 + F.length(query) + radius, F.length(text))
    around = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(at == 0, head(text, 2 * radius)).otherwise(around)


def head(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def squashed(c: Column) -> Column:
    """A number without spaces, in lower case."""
    return F.lower(F.replace(c, F.lit(" "), F.lit("")))


def citation(number: Column, ordinal: Column) -> Column:
    """The number's first comma part without white space, or the ordinal."""
    raw = F.when(F.coalesce(number, F.lit("")) != "", number).otherwise(ordinal.cast("string"))
    return F.regexp_replace(F.split(raw, ",")[0], r"\s+", "")


def eval_key(number: Column) -> Column:
    return F.lower(stripped(F.split(F.coalesce(number, F.lit("")), ",")[0]))


def grade_class(raw: Column) -> Column:
    """A grade's class; of a JSON list the grade of its first entry."""
    text = F.coalesce(raw, F.lit(""))
    parsed = F.from_json(text, "array<struct<grade:string>>")
    is_list = F.regexp_replace(text, r"^\s+", "").startswith("[{") & parsed.isNotNull() & (F.size(parsed) > 0) & F.try_parse_json(text).isNotNull()
    folded = F.lower(F.regexp_replace(to_ascii(F.when(is_list, F.coalesce(parsed[0]["grade"], F.lit(""))).otherwise(text)), "['`]", ""))
    return bound(folded, _class_of)


def _class_of(folded: Column) -> Column:
    return (
        F.when(folded.contains("maudu") | folded.contains("fabricated"), "maudu")
        .when(folded.contains("hasan sahih") | folded.contains("sahih hasan"), "hasan_sahih")
        .when(folded.contains("muttafaqun") | folded.contains("sahih"), "sahih")
        .when(folded.contains("hasan"), "hasan")
        .when(folded.contains("daif") | folded.contains("weak"), "daif")
        .otherwise("ungraded")
    )


def grade_tier(cls: Column) -> Column:
    return bound(cls, lambda c: F.coalesce(*(F.when(c == k, v) for k, v in GRADE_TIERS.items()), F.lit(LAST_TIER)))


def grade_tag(grade: Column) -> Column:
    return F.when(stripped(F.coalesce(grade, F.lit(""))) != "", F.concat(F.lit(" — "), stripped(grade))).otherwise("")


def arabic_words(c: Column) -> Column:
    """Runs of Arabic letters after marks are taken out."""
    return every(F.regexp_replace(F.coalesce(c, F.lit("")), MARKS, ""), ARABIC)


def latin_words(c: Column) -> Column:
    return every(F.coalesce(c, F.lit("")), "[A-Za-z]+")


def romanised(c: Column) -> Column:
    """Arabic, Persian and Urdu letters as Latin ones, and Latin letters without marks; all else is dropped."""
    spelt = dict(ROMAN_PAIRS) | ROMAN_LATIN | {chr(0x671 + i): x.strip("-") for i, x in enumerate(ROMAN_EXTENDED) if chr(0x671 + i) not in ROMAN_FROM}
    single = {a: b for a, b in zip(ROMAN_FROM, ROMAN_TO, strict=False)} | {a: b for a, b in spelt.items() if len(b) == 1}
    none = ROMAN_FROM[len(ROMAN_TO) :] + "".join(a for a, b in spelt.items() if not b)
    out = c
    for a, b in spelt.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    whole = to_ascii(F.translate(out, "".join(single) + none, "".join(single.values())))
    return F.when(c.rlike(r"[^\x00-\x7F]"), whole).otherwise(c)  # plain words are as they are


def skeletons(roman: Column) -> Column:
    """The distinct consonant skeletons of romanised text; the letter @ is read as h, as t and as nothing."""
    s = F.lower(roman)
    for a, b in SKELETON_PAIRS:
        s = F.replace(s, F.lit(a), F.lit(b))
    read = (F.regexp_replace(F.regexp_replace(F.replace(s, F.lit("@"), F.lit(x)), "[aeiouwyv]|[^a-z]", ""), r"(.)\1+", "$1") for x in ("h", "t", ""))
    return F.filter(F.array_distinct(F.array(*read)), lambda x: x != "")


def index_skeletons(word: Column) -> Column:
    """A word's skeletons, and those with D and dh read as z."""
    with_z = lambda roman: F.replace(F.replace(roman, F.lit("D"), F.lit("z")), F.lit("dh"), F.lit("z"))
    return bound(romanised(word), lambda roman: F.array_union(skeletons(roman), skeletons(with_z(roman))))


def query_skeletons(word: Column) -> Column:
    return bound(romanised(word), skeletons)


def embedding_text(narrator: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.nullif(narrator, F.lit("")), F.nullif(text, F.lit("")))


def title_key(c: Column) -> Column:
    """A title or slug as it is compared in citations."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[‘’'._\\-\\s]", "")


def without_tags(c: Column) -> Column:
    """Text without tags, white space collapsed."""
    return stripped(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))


def without_wrappers(c: Column) -> Column:
    """Arabic text for display: narrators' names alone, no section wrappers, no direction marks."""
    named = F.regexp_replace(c, r"(?s)\[narrator[^\]]*\](.*?)\[/narrator\]", "$1")
    return stripped(F.regexp_replace(named, r"\[/?(?:pre)?matn\]|[\x{200E}\x{200F}]", ""))
