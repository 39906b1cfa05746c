"""Scalar rules of the case register as Column builders: headers, severities, dates, keys, labels, gates, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell texts that mean a missing value.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]

#: Words for severity grades.
SEVERITY_WORDS = {
    "none": 1, "nil": 1, "nearmiss": 1, "near miss": 1, "no harm": 1, "noharm": 1,
    "negligible": 1, "insignificant": 1, "minimal": 1,
    "low": 2, "minor": 2, "slight": 2,
    "moderate": 3, "medium": 3, "significant": 3,
    "major": 4, "high": 4, "severe": 4, "serious": 4,
    "catastrophic": 5, "death": 5, "fatal": 5, "extreme": 5, "critical": 5,
}

#: Least confidence and margin of each confidence level.
CONFIDENCE_LEVELS = {"exploring": (0.10, 0.00), "preparing": (0.25, 0.02), "acting_on_it": (0.35, 0.04)}

DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd"]
BORDERLINE = 0.02


def squash(name: Column) -> Column:
    """A header's letters a-z and digits, lower-cased."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_STRINGS), c)


def severity(raw: Column) -> Column:
    """1 to 5: a number (truncated), else a known word, else 3."""
    number = raw.try_cast("double")
    number = F.when(~F.isnan(number), number)
    words = F.create_map(*[F.lit(x) for pair in SEVERITY_WORDS.items() for x in pair])
    word = F.try_element_at(words, F.lower(F.trim(raw)))
    grade = F.coalesce(number, word.cast("double"), F.lit(3.0))
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), grade)).cast("int")


def date(raw: Column) -> Column:
    """The first of DATE_FORMATS that fits, else null. Each value is read by itself."""
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS])


def case_key(text: Column) -> Column:
    """16 hex digits that stand for a case's text; white space and case don't matter."""
    return F.substr(F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256), F.lit(1), F.lit(16))


def fingerprint(keys: Column) -> Column:
    """16 hex digits that stand for a set of case keys."""
    return F.substr(F.sha2(F.array_join(F.array_sort(keys), "|"), 256), F.lit(1), F.lit(16))


def gated_label(source: Column, label: Column, candidate: Column, confidence: Column, margin: Column, min_confidence: Column, min_margin: Column) -> Column:
    """The label shown at a level: a person's own always, else the candidate if it is sure enough."""
    sure = (confidence >= min_confidence) & (margin >= min_margin)
    return F.when(source == "human", label).when(sure & candidate.isNotNull(), candidate)


def reason(own: Column, rival: Column, rival_id: Column, agree: Column) -> Column:
    """One line on why a case is in its group. own and rival are rounded to two places by the caller."""
    shown = lambda c: F.format_string("%.2f", c)
    margin = own - rival
    return (
        F.when(margin < BORDERLINE, F.concat(F.lit("borderline: group "), rival_id, F.lit(" is nearly as close ("), shown(rival), F.lit(" against "), shown(own), F.lit(")")))
        .when(agree == 3, F.concat(F.lit("its three nearest cases share the group; similarity to the centre "), shown(own)))
        .when(agree == 0, F.concat(F.lit("none of its three nearest cases shares the group; placed by similarity "), shown(own)))
        .otherwise(F.concat(agree, F.lit(" of its three nearest cases share the group; similarity "), shown(own), F.lit(", ahead by "), shown(margin)))
    )


def verdict(passed: Column) -> Column:
    return F.when(passed == 3, "structure found").when(passed == 2, "usable, with caveats").otherwise("weak")


#: Phrases of answers that are no labels.
NOT_A_LABEL = r"(?i)\b(i (cannot|can't|am|will)|as an ai|sure|here('| i)s|the (group|reports|answer)|these reports|noun phrase|sorry)\b"


#: Characters that are taken off both ends of an answer.
AROUND_LABEL = "\"'“”‘’ \t.:;-–—*#"


def clean_label(raw: Column) -> Column:
    """A generated label made presentable, or null: first line, 2 to 6 words, at most 46 characters, no digits, no sentence."""
    line = F.trim(F.split(F.btrim(raw, F.lit(" \t\r\n")), r"\r\n|\r|\n").getItem(0))
    text = F.regexp_replace(F.btrim(line, F.lit(AROUND_LABEL)), r"\s+", " ")
    n = F.size(F.split(text, " "))
    commas = F.char_length(text) - F.char_length(F.replace(text, F.lit(","), F.lit("")))
    inner_stop = F.contains(F.substr(text, F.lit(1), F.char_length(text) - 1), F.lit("."))
    fine = (text != "") & ~F.regexp_like(text, F.lit(NOT_A_LABEL)) & ~F.regexp_like(text, F.lit("[0-9]")) & (F.char_length(text) <= 46)
    fine = fine & n.between(2, 6) & (commas <= 1) & ~inner_stop
    return F.when(fine, F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2))))
