"""Text functions of the survey cleaners."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing value, in surveys and in common CSV readers.
NULL_TOKENS = ("", "nan", "NaN", "N/A", "n/a", "NA", "null", "None", "-")
CSV_NULLS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "NULL")

# Spellings that are replaced as a whole.
PLATFORM_ALIASES = {"Insta": "Instagram", "Ig": "Instagram", "Fb": "Facebook", "Yt": "Youtube", "X": "Twitter", "Tik Tok": "Tiktok"}
COUNTRY_ALIASES = {"Usa": "United States", "Us": "United States", "United States Of America": "United States", "Uk": "United Kingdom"}
ORDINALS = {"Low": 1, "Medium": 2, "High": 3}
MALE, FEMALE = ("male", "m", "man"), ("female", "f", "woman")


# What the rules take off the names of columns, and what parts the words of a slug.
LEADING_NUMBER, PUNCTUATION, NO_SLUG = r"^\s*\d+\.\s*", r"[^\w\s]", r"[^a-z0-9]+"
# Fixed value: a number in a phrase.
NUMBER_IN_PHRASE = r"(\d+\.?\d*)"


def snake_case(name: str) -> str:
    """A column name without its leading number and punctuation, in lower case, words joined by ``_``."""
    words = re.sub(PUNCTUATION, "", re.sub(LEADING_NUMBER, "", name).lower()).split()
    return "_".join(words)


def unique_names(names: Iterable[str]) -> list[str]:
    """The names, with a number behind those that have come before."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind that Unicode knows."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def null_tokens(c: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Stripped, and null where what is left stands for a missing value. Case counts."""
    s = strip(c)
    return F.when(~s.isin(*tokens), s)


def title_case(c: Column) -> Column:
    """Each run of letters with its first in upper and the others in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def replaced(c: Column, aliases: Mapping[str, str]) -> Column:
    """Whole values that are aliases replaced."""
    out = c
    for old, new in aliases.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def category(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """A category: stripped, inner white space to one blank, title case, aliases replaced."""
    return replaced(title_case(F.regexp_replace(strip(c), r"(?U)\s+", " ")), aliases or {})


def gender(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin(*MALE), "Male").when(low.isin(*FEMALE), "Female").when(c.isNotNull(), "Other")


def name_list(c: Column) -> Column:
    """The names of a comma-separated list, in title case; none for null."""
    parts = F.filter(F.split(c, ","), lambda p: strip(p) != "")
    return F.coalesce(F.transform(parts, lambda p: title_case(strip(p))), F.array().cast("array<string>"))


def slug(name: str) -> str:
    return "_".join(filter(None, re.split(NO_SLUG, name.lower())))


def duration_hours(c: Column) -> Column:
    """Hours of a phrase: less than n is n / 2 (0.5 without a number), more than n is n + 1, two numbers their mean, one itself."""
    s = F.lower(c)
    numbers = F.transform(F.regexp_extract_all(s, F.lit(NUMBER_IN_PHRASE), 1), lambda x: x.cast("double"))
    one, two = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    return (
        F.when(s.contains("less"), F.coalesce(one / 2, F.lit(0.5)))
        .when(s.contains("more") & one.isNotNull(), one + 1)
        .when(two.isNotNull(), (one + two) / 2)
        .otherwise(one)
    )


def ordinal(c: Column, values: Mapping[str, int] = ORDINALS) -> Column:
    out = F.lit(None).cast("int")
    for name, n in values.items():
        out = F.when(c == name, n).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode's NFKC, stripped. Spark has no such function, so this one runs in Arrow batches."""
    return s.map(lambda v: unicodedata.normalize("NFKC", v).strip(), na_action="ignore")


def format_bytes(n: float) -> str:
    """A size for people to read."""
    power = 0
    while n >= 1024 and power < 4:
        n, power = n / 1024, power + 1
    return f"{n:.1f} {'KMGT'[power - 1] if power else ''}B"
