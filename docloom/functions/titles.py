"""Choosing a title: embedded metadata, then a heading, then the file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.metadata import MONTHS
from docloom.functions.text import collapse, strip
from docloom.settings import DEFAULTS, Settings

# Fixed values.
DEFAULT_TITLE = "Untitled document"
SHORTEST, LONGEST = 3, 120
CONFIDENCE = {"metadata": 0.9, "heading": 0.75, "filename": 0.4, "default": 0.0}
EXTENSION = r"(?i)\.[a-z0-9]{2,5}$"
JUNK = (
    r"(?i)^(?:microsoft\s+(?:word|excel|powerpoint)\s*-|untitled(?![\p{L}\p{N}_])|document\d*$|doc\d*$|slide\s*\d+$|presentation\d*$)"
)
DATE_FORMS = (
    r"^\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}$",
    r"(?i)^\d{1,2}\s+[a-z]+\.?,?\s+\d{2,4}$",
    r"(?i)^[a-z]+\.?\s+\d{1,2},?\s+\d{2,4}$",
    r"(?i)^[a-z]+\s+\d{4}$",
)


def base_name(filename: Column) -> Column:
    return F.regexp_extract(F.replace(filename, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)


def stem(filename: Column) -> Column:
    return F.regexp_replace(base_name(filename), EXTENSION, "")


def looks_like_filename(title: Column, filename: Column) -> Column:
    lowered = F.lower(title)
    name = F.lower(base_name(F.coalesce(filename, F.lit(""))))
    named = ((name != "") & (lowered == name)) | ((stem(name) != "") & (lowered == stem(name)))
    return named | (~title.rlike(r"\s") & title.rlike(r"[_\-]"))


def is_junk_title(title: Column, filename: Column) -> Column:
    cleaned = collapse(title)
    return (F.length(cleaned) < SHORTEST) | cleaned.rlike(EXTENSION) | cleaned.rlike(JUNK) | looks_like_filename(cleaned, filename)


def looks_like_date(text: Column) -> Column:
    candidate = strip(text)
    shaped = candidate.rlike(DATE_FORMS[0])
    for form in DATE_FORMS[1:]:
        shaped = shaped | candidate.rlike(form)
    names = F.array(*[F.lit(name) for name in MONTHS])
    found = F.regexp_extract_all(F.lower(candidate), F.lit("[a-z]+"), F.lit(0))
    return shaped & (F.size(F.array_except(found, names)) == 0)


def acceptable_heading(text: Column) -> Column:
    cleaned = collapse(text)
    return F.length(cleaned).between(SHORTEST, LONGEST) & cleaned.rlike(r"[\p{L}\p{Nl}\p{No}]") & ~looks_like_date(cleaned)


def heading_candidate(blocks: Column) -> Column:
    """First acceptable heading of page one, else the largest print among its top third."""
    first_page = F.array_sort(
        F.transform(
            F.filter(blocks, lambda b: b["page"] == 1),
            lambda b: F.struct(b["order"].alias("order"), b["type"].alias("type"), b["text"].alias("text"), b["font_size"].alias("font_size")),
        )
    )
    headings = F.filter(first_page, lambda b: (b["type"] == "heading") & acceptable_heading(b["text"]))
    top = F.slice(first_page, F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(first_page) / 3).cast("int")))
    printed = F.filter(top, lambda b: b["font_size"].isNotNull() & acceptable_heading(b["text"]))
    largest = F.array_min(F.transform(printed, lambda b: F.struct((-b["font_size"]).alias("size"), b["order"].alias("order"), b["text"].alias("text"))))
    return collapse(F.coalesce(F.get(headings, 0)["text"], largest["text"]))


def clean_filename(filename: Column) -> Column:
    spaced = collapse(F.regexp_replace(stem(filename), r"[_\-.]+", " "))

    def cased(word: Column) -> Column:
        shouted = (F.upper(word) == word) & (F.lower(word) != word) & (F.length(word) > 1)
        return F.when(shouted, word).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2)))))

    usable = (F.length(spaced) >= SHORTEST) & ~spaced.rlike(r"^[\d\s]+$")
    return F.when(usable, F.array_join(F.transform(F.split(spaced, " "), cased), " "))


def suggest_title(embedded: Column, blocks: Column, filename: Column) -> Column:
    """Struct ``(title, source, confidence)`` of the best available title."""

    def option(title: Column, source: str) -> Column:
        return F.when(title.isNotNull(), F.struct(title.alias("title"), F.lit(source).alias("source"), F.lit(CONFIDENCE[source]).alias("confidence")))

    from_metadata = F.when(embedded.isNotNull() & (embedded != "") & ~is_junk_title(embedded, filename), F.substring(collapse(embedded), 1, LONGEST))
    from_filename = F.substring(clean_filename(F.when(filename != "", filename)), 1, LONGEST)
    return F.coalesce(
        option(from_metadata, "metadata"),
        option(heading_candidate(blocks), "heading"),
        option(from_filename, "filename"),
        option(F.lit(DEFAULT_TITLE), "default"),
    )


def choose_title(current_source: Column, heuristic: Column, model_title: Column, settings: Settings = DEFAULTS) -> Column:
    """A user's own title stays (null result); a weak heuristic yields to the model's title."""
    weak = (heuristic["confidence"] < settings.title_llm_threshold) & model_title.isNotNull()
    model = F.struct(model_title.alias("title"), F.lit("llm").alias("source"), F.lit(settings.llm_title_confidence).alias("confidence"))
    return F.when(current_source != "user", F.when(weak, model).otherwise(heuristic))
