"""Text cleaning shared by lookup, vehicle and web jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Accented letters and their plain forms, one to one.
ACCENTED = "ÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝáàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def unaccent(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def norm_upper(c: Column) -> Column:
    """Upper case without accents; whatever is not a letter or digit parts the words."""
    return F.trim(F.regexp_replace(F.upper(unaccent(F.coalesce(c, F.lit("")))), "[^A-Z0-9]+", " "))


def norm_lower(c: Column) -> Column:
    """Lower case without accents, white space squeezed."""
    return squeeze(F.lower(unaccent(F.coalesce(c, F.lit("")))))


def filled(*options: Column) -> Column:
    """First option that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(o), F.lit("")) for o in options])


def compact(c: Column) -> Column:
    """White space goes."""
    return F.regexp_replace(c, "\\s+", "")


def mask_tail(c: Column, visible: int) -> Column:
    """Stars but for the last characters of a compact text; short values are starred whole."""
    n = F.length(c)
    return F.when(n <= visible, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.repeat(F.lit("*"), n - visible), F.right(c, F.lit(visible)))
    )


def host_of(url: Column) -> Column:
    """Host of a URL in lower case without a leading www."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.regexp_replace(host, "^www\\.", "")


def years_in(c: Column) -> Column:
    """Years 1900-2099 named in a text, as an array."""
    return F.transform(
        F.regexp_extract_all(c, F.lit("(19\\d{2}|20\\d{2})"), F.lit(1)), lambda y: y.cast("int")
    )


def matching_characters(a: str, b: str) -> int:
    """Characters in the longest common block (the first in a, then in b) and, in turn, on either side of it.

    A longer block is looked for only where one is left to find, and stretches without a common
    character are passed over, equal ones are counted at once.
    """
    found, open_ = 0, [(a, b)]
    while open_:
        x, y = open_.pop()
        if set(x).isdisjoint(y):
            continue
        if x == y:
            found += len(x)
            continue
        best = start = 0
        for i in range(len(x)):
            while i + best < len(x) and x[i : i + best + 1] in y:
                best, start = best + 1, i
        at = y.find(x[start : start + best])
        found += best
        open_ += [(x[:start], y[:at]), (x[start + best :], y[at + best :])]
    return found


@F.pandas_udf(T.DoubleType())
def matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters; 0 for two empty texts. Equal pairs of a batch are counted once."""
    known: dict[tuple[str, str], float] = {}
    for pair in zip(a, b):
        if pair not in known:
            x, y = pair
            known[pair] = 2.0 * matching_characters(x, y) / (len(x) + len(y)) if x or y else 0.0
    return pd.Series([known[pair] for pair in zip(a, b)])
