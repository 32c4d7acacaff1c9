"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a French question, and verbs that do so in queries of four words and more.
QUESTION_WORDS = ("quels", "quelles", "quel", "quelle", "comment", "où", "ou", "pourquoi", "combien", "qui", "que", "quoi", "lesquels", "lesquelles")
QUESTION_VERBS = ("sont", "est", "ont", "a", "contient", "contiennent", "donne", "donnent", "montre", "montrent", "liste", "trouve", "trouver", "cherche", "chercher", "indique")
#: Words that are no keywords.
STOP_WORDS = tuple(
    "le la les un une des du de et ou qui que quoi dont où quels quelles quel quelle sont est sur pour dans en par avec sans plus moins très bien tous tout cette ces ce cet mon ma mes ton ta "
    "ses notre nos leur leurs je tu il elle nous vous ils elles me te se y ne pas au aux à a ont été être avoir fait faire comme si mais car donc ni entre vers chez aussi même autres autre "
    "données dataset datasets donnees".split()
)
#: Prefixes and words that a friendly table name leaves out.
NAME_PREFIXES = ("fr-en-", "fr_en_", "data_", "export_", "raw_", "dataset_", "file_", "table_")
NAME_SKIP = ("fr", "en", "de", "la", "le", "les", "du", "des", "et")


def row_text(columns: Sequence[str], separator: str = " | ", labelled: bool = True, max_chars: int | None = None) -> Column:
    """``col: value | ...`` of a row, nulls left out; plain values with ``labelled=False``."""
    parts = []
    for name in columns:
        value = F.col(f"`{name}`").cast("string")
        value = F.substring(value, 1, max_chars) if max_chars else value
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value) if labelled else value))
    return F.concat_ws(separator, *parts)


def naming_signature(name: Column) -> Column:
    """(original, first_word, word_count, has_underscore, char_count) of a name."""
    words = F.filter(F.split(F.regexp_replace(name, "[_\\-]", " "), r"\s+"), lambda w: w != "")
    return F.struct(
        name.alias("original"), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("first_word"), F.size(words).alias("word_count"),
        name.contains("_").alias("has_underscore"), F.length(name).alias("char_count"),
    )


def article_signature(name: Column) -> Column:
    """(first_word, parts, capitals): first blank-separated word, parts between hyphens, capital letters."""
    return F.struct(F.split(name, " ")[0].alias("first_word"), F.size(F.split(name, "-")).alias("parts"), F.regexp_count(name, F.lit("[A-Z]")).alias("capitals"))


def property_name(name: Column) -> Column:
    """A name of letters, digits and single underscores: ``col_`` goes before a first character that is no letter."""
    clean = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9]", "_"), "_+", "_")
    clean = F.regexp_replace(clean, "^_|_$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").when(~clean.rlike("^[a-zA-Z]"), F.concat(F.lit("col_"), clean)).otherwise(clean)


def friendly_name(file_name: Column) -> Column:
    """The first three telling words of a file name, capitalised; short acronyms stay; ``Data`` if nothing is left."""
    name = F.regexp_replace(file_name, r"\.[^.]*$", "")
    for prefix in NAME_PREFIXES:
        name = F.regexp_replace(name, f"(?i)^{prefix}", "")  # names the column once, so that the expression stays small
    words = F.filter(F.split(F.regexp_replace(name, "_[a-f0-9]{6,}$", ""), r"[-_\s]+"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*NAME_SKIP))
    shown = F.transform(words, lambda w: F.when((F.upper(w) == w) & w.rlike("[A-Z]") & (F.length(w) <= 5), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))))
    return F.when(F.size(words) > 0, F.array_join(F.slice(shown, 1, 3), " ")).otherwise("Data")


def pascal_name(file_name: Column) -> Column:
    """The words of a file name, joined with capitals."""
    words = F.filter(F.split(F.regexp_replace(file_name, r"\.[^.]*$", ""), "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")


def map_file_to_entity(file_name: Column, entities: Sequence[str]) -> Column:
    """The first entity whose cleaned name holds, or is held by, the file's; else the file's name with capitals."""
    own = F.regexp_replace(F.lower(F.regexp_replace(file_name, r"\.[^.]*$", "")), "[^a-z0-9]", "")
    found = None
    for entity in entities:
        key = "".join(c for c in entity.lower() if c.isalnum())
        hit = own.contains(key) | F.lit(key).contains(own) & (own != "")
        found = F.when(hit, entity) if found is None else found.when(hit, entity)
    return pascal_name(file_name) if found is None else found.otherwise(pascal_name(file_name))


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut between words and ended by ``...``; null is empty."""
    head = F.substring(text, 1, limit - 3)
    return F.when(text.isNull(), "").when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head, r"\s\S*$", ""), F.lit("...")))


def file_size(size: Column) -> Column:
    """Bytes as text with a unit."""
    out, step = F.when(size.isNull(), "N/A").when(size < 1024, F.format_string("%d B", size.cast("long"))), 1024.0
    for unit in ("KB", "MB", "GB"):
        out = out.when(size < step * 1024, F.format_string(f"%.1f {unit}", size / step))
        step *= 1024
    return out.otherwise(F.format_string("%.1f TB", size / step))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.replace(F.lower(F.trim(text)), F.lit("?"), F.lit("")), r"\s+"), lambda w: w != "")


def is_question(text: Column) -> Column:
    """True for text that asks: it ends in ``?``, has a question word, a verb among four words or more, or six words."""
    words = _words(text)
    among = lambda values: F.arrays_overlap(words, F.array(*[F.lit(v) for v in values]))
    return F.coalesce(F.rtrim(text).endswith("?") | among(QUESTION_WORDS) | (among(QUESTION_VERBS) & (F.size(words) >= 4)) | (F.size(words) >= 6), F.lit(False))


def keywords(text: Column, most: int = 5) -> Column:
    """Up to ``most`` distinct words of more than two characters, without stop words, in order."""
    words = F.split(F.replace(F.replace(F.lower(text), F.lit("?"), F.lit("")), F.lit(","), F.lit(" ")), r"\s+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))), 1, most)


def filter_map(text: Column) -> Column:
    """``k=v, k=v`` as a map with trimmed keys and values; parts without ``=`` are left out."""
    parts = F.filter(F.split(text, ","), lambda p: p.contains("="))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.regexp_replace(p, "^[^=]*=", "")))))


def short_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, length)


def french_number(text: Column) -> Column:
    """A number with a decimal comma and blanks between thousands; null if it can't be read."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s  ]", ""), ",", ".").try_cast("double")


def iso_timestamp(text: Column) -> Column:
    """A timestamp from ISO text with ``T``, or from its first ten characters as a date; else null."""
    return F.coalesce(F.when(text.contains("T"), F.try_to_timestamp(text)), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def relationship_sentence(start: Column, end: Column, start_column: Column, end_column: Column, method: Column, matches: Column) -> Column:
    """What links two tables, in words."""
    how = F.when(method == "name", F.lit("by similar names")).when(method == "values", F.format_string("by %d shared values", matches.cast("long"))).otherwise(F.concat(F.lit("by "), method))
    return F.concat(start, F.lit(" and "), end, F.lit(" are linked through "), start_column, F.lit(" and "), end_column, F.lit(" "), how)
