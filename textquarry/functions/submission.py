"""Submission columns: ids, lists, conditions, eligibility criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NOT_SPECIFIED, clean

# The columns of a submission in order, and other names of field groups.
COLUMNS = ("conditions", "study_type", "sex", "minimum_age", "maximum_age", "eligibility_criteria", "pmcids")
FIELD_ALIASES = {
    "condition": "condition_study_type",
    "condition_and_study_type": "condition_study_type",
    "condition_&_study_type": "condition_study_type",
    "study_type": "condition_study_type",
    "demographic": "demographics",
    "eligibility_criteria": "eligibility",
    "overall_irrelevant": "irrelevant",
}


def article_id(text: Column) -> Column:
    """The first run of digits, with or without the prefix PMC before it; else the cleaned text."""
    cleaned = clean(text.cast("string"))
    found = F.regexp_extract(cleaned, r"(?i)(?:PMC)?(\d+)", 1)
    return F.when(found != "", found).otherwise(cleaned)


def id_order(column: Column) -> list[Column]:
    """Sort keys: numeric ids by number, then the others as text."""
    number = F.when(column.rlike(r"^\d{1,38}$"), column.try_cast("decimal(38,0)"))
    return [number.asc_nulls_last(), column.asc_nulls_last()]


def field_name(text: Column) -> Column:
    """A field group by any of its names."""
    name = F.translate(F.lower(F.trim(text)), "- ", "__")
    for other, known in FIELD_ALIASES.items():
        name = F.when(name == other, known).otherwise(name)
    return name


def listed(text: Column) -> Column:
    """A string of items, at semicolons, bullets or stars, as a list; empty and ``Not Specified`` give none."""
    cleaned = clean(text)
    tidy = lambda x: F.trim(F.regexp_replace(clean(x), r"^[- ]+", ""))
    items = F.filter(F.transform(F.split(cleaned, r"\s*(?:;|\n|•|\*)\s*"), tidy), lambda x: x != "")
    return F.when((cleaned == "") | (F.lower(cleaned) == "not specified"), F.array().cast("array<string>")).otherwise(items)


def cleaned_list(items: Column) -> Column:
    """A list's cleaned, non-empty items; null gives none."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), clean), lambda x: x != "")


def quoted_list(items: Column) -> Column:
    """The list as Python writes it: single quotes, or double ones around items with an apostrophe and no double quote."""

    def quoted(x: Column) -> Column:
        safe = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def conditions(items: Column) -> Column:
    return quoted_list(F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(NOT_SPECIFIED))))


def criteria(heading: str, items: Column) -> Column:
    """``Heading: * a; * b.``, items without marks at their end; ``Heading: * Not Specified.`` for none."""
    tidy = F.filter(F.transform(items, lambda x: F.regexp_replace(clean(x), r"[ ;.]+$", "")), lambda x: x != "")
    some = F.concat(F.lit(f"{heading}: "), F.array_join(F.transform(tidy, lambda x: F.concat(F.lit("* "), x)), "; "), F.lit("."))
    return F.when(F.size(tidy) > 0, some).otherwise(f"{heading}: * {NOT_SPECIFIED}.")


def eligibility(inclusion: Column, exclusion: Column) -> Column:
    return F.concat(criteria("Inclusion Criteria", inclusion), F.lit(" "), criteria("Exclusion Criteria", exclusion))


def submission(results: DataFrame) -> DataFrame:
    """One row a document from doc_id and the replies ``cond``, ``demo`` and ``elig`` (structs, null where none came)."""
    or_else = lambda value, other: F.coalesce(F.nullif(clean(value), F.lit("")), F.lit(other))
    given = lambda value, other: F.when(value.isNull(), F.lit(other)).otherwise(clean(value))
    row = {
        "conditions": conditions(listed(F.col("cond.conditions"))),
        "study_type": given(F.col("cond.study_type"), "OBSERVATIONAL"),
        "sex": given(F.col("demo.sex"), "Other"),
        "minimum_age": or_else(F.col("demo.minimum_age"), NOT_SPECIFIED),
        "maximum_age": or_else(F.col("demo.maximum_age"), NOT_SPECIFIED),
        "eligibility_criteria": eligibility(cleaned_list(F.col("elig.inclusion_criteria")), cleaned_list(F.col("elig.exclusion_criteria"))),
        "pmcids": article_id(F.col("doc_id")),
    }
    return results.select(*[row[name].alias(name) for name in COLUMNS])
