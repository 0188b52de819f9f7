"""Column functions over text: cleaning, section paths and priors, layouts of blocks and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of section titles, replaced in this order.
SECTION_SPELLINGS = (
    ("acknowledgments", "acknowledgements"),
    ("acknowledgment", "acknowledgements"),
    ("acknowledgement", "acknowledgements"),
    ("conflict of interest", "competing interests"),
    ("conflicts of interest", "competing interests"),
    ("authors' contributions", "author contributions"),
    ("author contribution", "author contributions"),
    ("availability of data and materials", "data availability"),
    ("data and materials availability", "data availability"),
    ("ethical approval", "ethics"),
    ("ethics approval", "ethics"),
    ("ethics statement", "ethics"),
    ("ethical considerations", "ethics"),
)
# Factors of sections by field group, and of sections that speak against any field.
RAISED = {
    "condition_study_type": {"study design": 1.08, "methods": 1.03, "background": 1.02},
    "demographics": {
        "demographics": 1.10, "eligibility": 1.08, "inclusion": 1.08, "exclusion": 1.08, "participants": 1.06,
        "participant": 1.06, "patients": 1.04, "patient": 1.04, "study population": 1.04, "population": 1.03,
    },
    "eligibility": {
        "eligibility": 1.10, "inclusion": 1.10, "exclusion": 1.10, "participants": 1.06, "participant": 1.06,
        "patients": 1.04, "patient": 1.04, "study population": 1.04, "population": 1.03,
    },
}
LOWERED = {
    "references": 0.85, "acknowledgements": 0.90, "funding": 0.90, "competing interests": 0.90, "author contributions": 0.90,
    "data availability": 0.92, "ethics": 0.95, "supplementary": 0.95, "appendix": 0.95,
}
# Spellings of a missing answer, narrow and wide.
NARROW_MISSING = ("", "NOT SPECIFIED", "NAN")
WIDE_MISSING = ("", "nan", "none", "not specified", "['not specified']", '["not specified"]')
NOT_SPECIFIED = "Not Specified"


def clean(text: Column) -> Column:
    """Null as empty; every run of Unicode white space one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def clean_ascii(text: Column) -> Column:
    """As ``clean``, for ASCII white space only."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " "))


def strip(text: Column) -> Column:
    """Null as empty; Unicode white space off both ends, kept inside."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def cap(text: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.left(text, F.lit(n))


def path_text(path: Column) -> Column:
    """A section path as ``a > b``; missing paths are empty."""
    return F.array_join(F.coalesce(path, F.array().cast("array<string>")), " > ")


def normal_path(path: Column) -> Column:
    """A section path for the priors: joined, cleaned, lower-cased, spellings unified one after another."""
    start = clean(F.lower(path_text(path)))
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), SECTION_SPELLINGS, start)


def prior(path: Column, field: str) -> Column:
    """The factor of a normalised path: its largest raising factor, at least 1, times its smallest lowering one."""
    up = [F.when(F.contains(path, F.lit(term)), F.lit(f)).otherwise(F.lit(1.0)) for term, f in RAISED[field].items()]
    down = [F.when(F.contains(path, F.lit(term)), F.lit(f)).otherwise(F.lit(1.0)) for term, f in LOWERED.items()]
    return F.greatest(*up) * F.least(*down)


def missing(text: Column) -> Column:
    """The narrow test for a missing answer."""
    return F.upper(strip(text)).isin(*NARROW_MISSING)


def missing_wide(text: Column) -> Column:
    """The wide test for a missing answer; null counts as missing."""
    return F.lower(strip(text)).isin(*WIDE_MISSING)


def mentions_age(text: Column) -> Column:
    """Whether a number from 15 to 99 stands alone in the text."""
    return F.coalesce(text, F.lit("")).rlike(r"\b1[5-9]\b|\b[2-9]\d\b")


def near_age_word(text: Column, start: Column, stop: Column) -> Column:
    """Whether an age word stands within 30 characters of the span."""
    first = F.greatest(start - 30, F.lit(0))
    return F.substring(text, first + 1, stop + 30 - first).rlike(r"(?i)year|yr|age|old")


def word_count(text: Column) -> Column:
    """Runs of non-white-space characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def wordy_paragraphs(title: Column, paragraphs: Column, least: int = 15) -> Column:
    """The paragraphs of a section; of one without a title, only those of at least ``least`` words."""
    untitled = strip(title) == ""
    return F.filter(paragraphs, lambda p: ~untitled | (word_count(p) >= least))


def long_entities(entities: Column, least: int = 3) -> Column:
    """The entities of at least ``least`` characters."""
    return F.filter(entities, lambda e: F.char_length(e) >= least)


# Layouts.


def embedding_text(path: Column, kind: Column, text: Column) -> Column:
    return F.concat(F.lit("Section path: "), path_text(path), F.lit("\nBlock type: "), F.coalesce(kind, F.lit("text")), F.lit("\nText: "), clean(text))


def training_text(path: Column, text: Column) -> Column:
    return F.concat(F.lit("Section: "), strip(path), F.lit("\nText: "), strip(text))


def context_piece(path: Column, text: Column) -> Column:
    return F.concat(F.lit("Section: "), path_text(path), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def routed_piece(index: Column, path: Column, text: Column) -> Column:
    where = F.coalesce(F.nullif(path_text(path), F.lit("")), F.lit("Unknown section"))
    return F.concat(F.lit("[Block "), index.cast("string"), F.lit("]\nSection: "), where, F.lit("\n"), F.coalesce(text, F.lit("")))


def headed_context(title: Column, abstract: Column, keywords: Column, body: Column, label: str, empty: str = "", empty_body: str = "") -> Column:
    """Title, abstract and keywords above the selected body."""
    listed = F.array_join(F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), clean), lambda k: k != ""), ", ")
    part = lambda value, other: F.coalesce(F.nullif(value, F.lit("")), F.lit(other))
    return F.concat(
        F.lit("Title:\n"), part(clean(title), empty), F.lit("\n\nAbstract:\n"), part(clean(abstract), empty),
        F.lit("\n\nKeywords:\n"), part(listed, empty), F.lit(f"\n\n{label}:\n"), part(F.coalesce(body, F.lit("")), empty_body),
    )
