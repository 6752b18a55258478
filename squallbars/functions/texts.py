"""Text classification and parsing as native column expressions.

Functions over ``low`` or ``up`` take text folded by ``lowered`` or ``uppered``. Callers fold in a
``select`` of their own, so a long text is folded once however many needles are looked up in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallbars.functions import vocab

Rules = list[tuple[list[str], list[str], str]]


def lowered(c: Column) -> Column:
    """Lower-case text; a missing value reads as the word 'none'."""
    return F.coalesce(F.lower(c), F.lit("none"))


def folded(df: DataFrame, text: str, **more: str) -> DataFrame:
    """Add ``_low`` and ``_up`` forms of a text column, and a lower-case form per ``name=column``."""
    return df.select("*", lowered(F.col(text)).alias("_low"), uppered(F.col(text)).alias("_up"),
                     *[lowered(F.col(c)).alias(n) for n, c in more.items()])


def uppered(c: Column) -> Column:
    return F.coalesce(F.upper(c), F.lit("NONE"))


def keyword_hits(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])


def keyword_counts(low: Column, classes: dict[str, list[str]]) -> dict[str, Column]:
    return {name: keyword_hits(low, words) for name, words in classes.items()}


def best_class(low: Column, classes: dict[str, list[str]]) -> Column:
    """Class with most keywords contained; the first class wins ties; none gives OTHER."""
    ranked = [F.struct(n.alias("hits"), F.lit(-i).alias("place"), F.lit(name).alias("name"))
              for i, (name, n) in enumerate(keyword_counts(low, classes).items())]
    none = F.struct(F.lit(0).alias("hits"), F.lit(1).alias("place"), F.lit("OTHER").alias("name"))
    return F.array_max(F.array(*ranked, none))["name"]


def first_rule(up: Column, rules: Rules, default: Column | None = None) -> Column:
    """Label of the first rule whose required needles all, and alternatives any, occur."""
    out = None
    for needed, any_of, label in rules:
        tests = [F.contains(up, F.lit(n)) for n in needed]
        if any_of:
            tests.append(reduce(lambda a, b: a | b, [F.contains(up, F.lit(n)) for n in any_of]))
        test = reduce(lambda a, b: a & b, tests)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out if default is None else out.otherwise(default)


def main_event(up: Column) -> Column:
    return first_rule(up, vocab.MAIN_EVENT_RULES)


def event_type(up: Column) -> Column:
    return first_rule(up, vocab.EVENT_TYPE_RULES, F.lit("OTHER"))


def specific_type(up: Column) -> Column:
    return first_rule(up, vocab.SPECIFIC_TYPE_RULES, F.lit("OTHER"))


def specific_name(up: Column, indicator: Column) -> Column:
    """Title rules, else the indicator without its trailing period words, else null."""
    name = uppered(indicator)
    cleaned = F.initcap(F.trim(F.regexp_replace(name, r"(?i)\s+(MOM|YOY|QOQ|ANNUAL|FLASH|PREL|FINAL).*", "")))
    fallback = F.when(~name.isin(vocab.UNINFORMATIVE_INDICATORS), cleaned)
    return first_rule(up, vocab.SPECIFIC_NAME_RULES, fallback)


def release_period(period: Column) -> Column:
    text = uppered(period)
    return (F.when(text.rlike("|".join(vocab.MONTH_TOKENS)), "M")
            .when(text.rlike("|".join(vocab.QUARTER_TOKENS)), "Q"))


def release_stage(up: Column) -> Column:
    return first_rule(up, [(["PREL"], [], "Preliminary"), (["FLASH"], [], "Flash"), (["FINAL"], [], "Final")])


def calculation_period(up: Column) -> Column:
    return first_rule(up, [(["MOM"], [], "MoM"), (["QOQ"], [], "QoQ"), (["YOY"], [], "YoY")])


def mentions(low: Column, word: str) -> Column:
    return F.contains(low, F.lit(word)).cast("int")


def is_calendar(indicator: Column) -> Column:
    return F.coalesce((indicator == "Calendar").cast("int"), F.lit(0))


def lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(key, F.lit(""))), F.lit(default))


def economic_value(c: Column) -> Column:
    """Number from text: separators and currency signs dropped, '%' divides by 100, else the first number."""
    text = F.translate(F.trim(c), ",$€£", "")
    bare = F.replace(text, F.lit("%"), F.lit(""))
    as_percent = bare.try_cast("double") / 100.0
    first = F.regexp_extract(text, r"-?\d+\.?\d*", 0).try_cast("double")
    return F.when(text.contains("%"), as_percent).otherwise(F.coalesce(text.try_cast("double"), first))


def detail_field(detail: Column, field: str) -> Column:
    """Text after 'field:' up to the next bar; null when absent."""
    hit = F.regexp_extract(detail, field + r":\s*([^|]+)", 1)
    return F.when(hit != "", hit)


def field_names(c: Column) -> Column:
    """Every 'words:' token. A token starts at the first letter of its run of letters and blanks, so the
    look-behind lets the scan try each run once instead of once per letter."""
    return F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z\s])\s*+([A-Za-z][A-Za-z\s]*+:)"), F.lit(1))


def html_escape(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit("N/A"))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def valid_offset(c: Column) -> Column:
    """UTC offset in hours; anything that is no number in -12..14 falls back to 0."""
    number = c.try_cast("double")
    return F.when(number.between(-12, 14), number).otherwise(F.lit(0.0))
