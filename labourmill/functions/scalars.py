"""Column functions of the job feeds and skills: column in, column out, no Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from labourmill.functions import lookups

_BLANK = r"^\s+|\s+$"


def literal_map(pairs: list[tuple[str, str]]) -> Column:
    """A map literal; of equal keys the last counts."""
    return F.create_map(*[F.lit(x) for pair in dict(pairs).items() for x in pair])


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, _BLANK, "")


def strip_html(text: Column) -> Column:
    """Tags replaced by a space each, then stripped; null: empty."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))


def parse_salary_range(text: Column) -> Column:
    """Struct (min, max) of the numbers of three digits or more; none: zeros."""
    digits = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), "[  ,]", ""), F.lit(r"(\d{3,})"), F.lit(1))
    numbers = F.transform(digits, lambda d: d.cast("double"))
    return F.struct(F.coalesce(F.array_min(numbers), F.lit(0.0)).alias("min"), F.coalesce(F.array_max(numbers), F.lit(0.0)).alias("max"))


def country_to_iso(country: Column) -> Column:
    """Two letters: of the name table, else the first two, upper case. Null or empty: US."""
    raw = F.when(F.coalesce(country, F.lit("")) == "", F.lit("US")).otherwise(country)
    return F.substring(F.coalesce(F.try_element_at(literal_map(lookups.COUNTRIES), F.lower(raw)), F.upper(raw)), 1, 2)


def series_group(code: Column) -> Column:
    return F.when(F.length(code) >= 4, F.concat(F.substring(code, 1, 2), F.lit("00"))).otherwise("")


def join_list(items: Column, separator: str, keep_empty: bool = False) -> Column:
    """Items joined; null and (unless kept) empty ones left out."""
    kept = F.filter(items, lambda x: x.isNotNull() if keep_empty else x.isNotNull() & (x != ""))
    return F.coalesce(F.array_join(kept, separator), F.lit(""))


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "yes", "1"), F.lit(False))


def to_int(text: Column, default: int = 1) -> Column:
    """The number that the text is, else the default. Text with a fraction isn't one."""
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("int")), F.lit(default))


def _contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def _first_list(text: Column, lists: list[tuple[str, list[str]]]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for value, parts in lists:
        out = out.when(_contains_any(text, parts), F.lit(value))
    return out


def classify_employer(organization: Column) -> Column:
    """Type by the first list of name parts with one in the name; else Other."""
    return F.coalesce(_first_list(F.lower(F.coalesce(organization, F.lit(""))), lookups.EMPLOYERS), F.lit("Other"))


def extract_skills(text: Column, terms: list[str] | None = None) -> Column:
    """The terms that the text has anywhere in it, also within words; in the terms' order.

    Each term is looked for by itself; ``terms.extract_terms`` takes large dictionaries in one pass.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    listed = F.array(*[F.lit(t) for t in dict.fromkeys(terms or lookups.TERMS)])
    return F.transform(F.array(low), lambda t: F.filter(listed, lambda term: F.contains(t, term)))[0]


def classify_skill_type(skill: Column) -> Column:
    low = F.lower(skill)
    return F.when(low.isin(lookups.KNOWLEDGE), "knowledge").when(low.isin(lookups.COMPETENCE), "competence").otherwise("skill")


def skill_category(label: Column, chain: Column) -> Column:
    """Category by label, else by the first chain step that is a known group, else by the words of
    the chain, else Other. ``chain`` may be null or empty."""
    steps = F.transform(F.coalesce(chain, F.array().cast("array<string>")), lambda s: F.lower(s))
    groups = literal_map(lookups.GROUPS)
    group = F.get(F.filter(F.transform(steps, lambda s: F.try_element_at(groups, s)), lambda c: c.isNotNull()), F.lit(0))
    return F.coalesce(
        F.try_element_at(literal_map(lookups.LABELS), strip(F.lower(F.coalesce(label, F.lit(""))))), group, _first_list(F.array_join(steps, " "), lookups.CHAIN_WORDS), F.lit("Other")
    )


def normalize_text(text: Column) -> Column:
    return strip(F.lower(text))


def skill_key(label: Column, raw: Column) -> Column:
    return F.coalesce(label, raw)


def title_case(text: Column) -> Column:
    """A capital after everything that isn't a letter."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")


def posting_month(date_text: Column) -> Column:
    """yyyy-MM of a date text; null if that is shorter."""
    return F.when(F.length(date_text) >= 7, F.substring(date_text, 1, 7))


def salary_basis(min_salary: Column) -> Column:
    return F.when(min_salary != 0, "Per Month").otherwise("Per Year")


def content_key(*values: Column) -> Column:
    """SHA-256 of the values as a JSON array of texts."""
    return F.sha2(F.to_json(F.array(*[v.cast("string") for v in values])), 256)


def parse_model_json(text: Column, schema: str) -> Column:
    """The JSON of a model's answer without code fences; text that isn't JSON gives nulls."""
    return F.from_json(strip(F.regexp_replace(text, r"```(?:json)?", "")), schema, {"mode": "PERMISSIVE"})


def compact_number(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", F.round(n / 1_000_000, 1)), F.lit("M")))
        .when(n >= 1000, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def type_bucket(skill_type: Column) -> Column:
    low = F.lower(F.coalesce(skill_type, F.lit("")))
    return F.when(F.contains(low, F.lit("knowledge")), "knowledge").when(F.contains(low, F.lit("skill")), "skill").when(F.contains(low, F.lit("competence")), "competence").otherwise("other")


def round_half_up(x: Column) -> Column:
    """As browsers do: the next whole number above x - 0.5."""
    return F.floor(x + 0.5).cast("long")
