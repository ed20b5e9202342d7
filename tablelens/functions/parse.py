"""Text parsers as pure column expressions: a value that does not fit gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tokens that a delimited file uses for "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
INTEGER = r"^\s*[+-]?\d{1,19}\s*$"
BOOLEAN = r"^(?:True|TRUE|true|False|FALSE|false)$"

_CLOCK = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?"
_MONTH = (r"(?i)(?=(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
          r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b)([a-z]{3})[a-z]*")
_DATE_START = r"^\s*(?:\d{1,4}[-/. ]|\d{4}\s*$|\d{8}\s*$|\d{1,2}(?:st|nd|rd|th) |[A-Za-z]{3,9}\.? \d)"
_ISO = rf"^\s*\d{{4}}(?:-\d{{1,2}}(?:-\d{{1,2}}{_CLOCK})?)?\s*$"
_SLASHED = rf"^\s*(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}{_CLOCK})\s*$"
_COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})\s*$"
_NUMERIC_DATE = rf"^\s*(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})({_CLOCK})\s*$"
_MONTH_FIRST = rf"^\s*{_MONTH}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\s*$"
_DAY_FIRST = rf"^\s*(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH}[ ,-]+(\d{{4}})\s*$"


def strip(c: Column) -> Column:
    """Remove all surrounding white space, not only blanks."""
    return F.btrim(c, F.lit(_BLANKS))


def fold_category(c: Column) -> Column:
    """The form under which spellings of one category meet."""
    return F.lower(strip(c))


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


def parse_number(c: Column) -> Column:
    """Decimal or exponent notation and infinities; no thousands separators, no type suffixes."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def _ntz(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def _rewrite(c: Column, pattern: str, form: str) -> Column:
    return F.regexp_replace(c, pattern, form).try_cast("timestamp_ntz")


def _named(c: Column, pattern: str, form: str) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, pattern, form), F.lit("MMM d yyyy")).cast("timestamp_ntz")


def parse_timestamp(c: Column) -> Column:
    """Dates in mixed notations as TIMESTAMP_NTZ.

    Each notation is recognised by a pattern first and then rewritten to ISO form, so that a value of
    another shape never reaches a parser that throws; one short pattern turns most other texts away.
    Ambiguous day/month pairs are read month first and day first only where that fails. Bare clock times
    and words such as "now" are not dates, since their value would depend on the day of the run.
    """
    return F.when(c.rlike(_DATE_START), (
        F.when(c.rlike(_ISO), c.try_cast("timestamp_ntz"))
        .when(c.rlike(_SLASHED), _rewrite(c, _SLASHED, "$1-$2-$3"))
        .when(c.rlike(_COMPACT), _rewrite(c, _COMPACT, "$1-$2-$3"))
        .when(c.rlike(_NUMERIC_DATE), F.coalesce(_rewrite(c, _NUMERIC_DATE, "$3-$1-$2$4"),
                                                 _rewrite(c, _NUMERIC_DATE, "$3-$2-$1$4")))
        .when(c.rlike(_MONTH_FIRST), _named(c, _MONTH_FIRST, "$1 $2 $3"))
        .when(c.rlike(_DAY_FIRST), _named(c, _DAY_FIRST, "$2 $1 $3"))
    ))
