"""Plate text: normalisation, pattern quality, validation, correction variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vestigo.functions.numbers import clamp, rnd

# Legal plate patterns and their base scores.
OLD_4L3N = "^[A-Z]{4}[0-9]{3}$"
OLD_3L4N = "^[A-Z]{3}[0-9]{4}$"
MERCOSUL = "^[A-Z]{3}[0-9][A-Z][0-9]{2}$"
SCORE_4L3N, SCORE_3L4N, SCORE_MERCOSUL = 0.9, 0.85, 0.95

# Characters text readers confuse, with their alternatives.
CONFUSABLE = {
    "O": ["0"],
    "0": ["O"],
    "I": ["1", "L"],
    "1": ["I", "L"],
    "L": ["I", "1"],
    "S": ["5"],
    "5": ["S"],
    "Z": ["2"],
    "2": ["Z"],
}

# Issue texts.
ISSUE_SHORT = "Comprimento insuficiente"
ISSUE_LONG = "Comprimento excessivo"
ISSUE_PATTERN = "Padrão de placa não reconhecido"
ISSUE_CHECK = "Check-digit Mercosul falhou (pode ser válido)"


def norm_plate(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[^A-Z0-9]", "")


def legal_pattern(c: Column) -> Column:
    return c.rlike(OLD_3L4N) | c.rlike(MERCOSUL)


def letters_in(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Z]", ""))


def digits_in(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def pattern_quality(c: Column) -> Column:
    """How plate-like an already normalised text is, 0 to 1."""
    n = F.length(c)
    return (
        F.when(n == 0, 0.0)
        .when(legal_pattern(c), 1.0)
        .when((n == 7) & (letters_in(c) >= 2) & (digits_in(c) >= 2), 0.6)
        .when(n == 7, 0.35)
        .when(n.between(5, 8), 0.2)
        .otherwise(0.05)
    )


def bbox_likelihood(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Plate-likeness of a box from its aspect ratio; 0.35 if any side is missing."""
    aspect = F.greatest(F.lit(1.0), x2 - x1) / F.greatest(F.lit(1.0), y2 - y1)
    return (
        F.when(x1.isNull() | y1.isNull() | x2.isNull() | y2.isNull(), 0.35)
        .when((aspect < 1.2) | (aspect > 10.0), 0.05)
        .otherwise(F.greatest(F.lit(0.1), 1.0 - F.least(F.lit(1.0), F.abs(aspect - 3.5) / 4.0)))
    )


def spaceless(c: Column) -> Column:
    """The validator's own cleaning: case and spaces only, so a hyphen still fails."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), " ", "")


_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def shape(c: Column) -> Column:
    """Letters as L, digits as D, anything else as it is; no regular expression needed."""
    return F.translate(c, _LETTERS + _DIGITS, "L" * 26 + "D" * 10)


def validator_pattern(c: Column) -> Column:
    s = shape(c)
    return (
        F.when(s == "LLLLDDD", "old_4l3n")
        .when(s == "LLLDDDD", "old_3l4n")
        .when(s == "LLLDLDD", "mercosul")
        .otherwise("invalid")
    )


def confusable_count(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, "".join(CONFUSABLE), ""))


def check_sum_ok(c: Column) -> Column:
    """Weighted sum (2..6) of the first five characters, modulo 9, against the last two digits."""
    total = F.lit(0)
    for i in range(5):
        ch = F.substring(c, i + 1, 1)
        value = F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 64)
        total = total + value * (i + 2)
    return (total % 9) == (F.substring(c, 6, 2).try_cast("int") % 9)


def with_validation(df: DataFrame, text: str, out: str = "v", strict: bool = False) -> DataFrame:
    """Add a struct (pattern, valid, score, suspicious, issues) for a cleaned text column.

    Built in steps, so that each intermediate value is computed once per row; the closing generator
    keeps later filters on the verdict from re-deriving it.
    """
    c = F.col(text)
    base = (
        F.when(F.col("_pattern") == "old_4l3n", SCORE_4L3N)
        .when(F.col("_pattern") == "old_3l4n", SCORE_3L4N)
        .when(F.col("_pattern") == "mercosul", SCORE_MERCOSUL)
    )
    known, mercosul = F.col("_pattern") != "invalid", F.col("_pattern") == "mercosul"
    suspicious, checked = F.col("_suspicious"), F.col("_checked")
    steps = (
        df.withColumn("_pattern", validator_pattern(c))
        .withColumn("_base", base)
        .withColumn("_suspicious", F.when(known, confusable_count(c)).otherwise(0))
        .withColumn("_checked", F.when(mercosul, F.coalesce(check_sum_ok(c), F.lit(False))).otherwise(False))
        .withColumn("_soft", F.col("_base") - 0.1 * suspicious + F.when(checked, 0.05).otherwise(0.0))
    )
    hard = F.lit(strict) & (suspicious > 0)
    raw = F.when(hard, F.col("_base") - 0.2).otherwise(F.col("_soft"))
    length_issue = (
        F.when(F.length(c) < 7, ISSUE_SHORT).when(F.length(c) > 8, ISSUE_LONG).when(~known, ISSUE_PATTERN)
    )
    word = "caracteres suspeitos detectados" if strict else "caracteres potencialmente OCR-confuso"
    issues = F.array_compact(
        F.array(
            length_issue,
            F.when(suspicious > 0, F.concat_ws(" ", suspicious.cast("string"), F.lit(word))),
            F.when(mercosul & ~checked & ~hard, F.lit(ISSUE_CHECK)),
        )
    )
    verdict = F.struct(
        F.col("_pattern").alias("pattern"),
        (known & ~hard & (F.col("_soft") >= 0.5)).alias("valid"),
        F.when(known, clamp(raw, 0.0, 1.0)).otherwise(0.0).alias("score"),
        suspicious.alias("suspicious"),
        issues.alias("issues"),
    )
    return steps.select(*df.columns, F.explode(F.array(verdict)).alias(out))


def _alternatives(ch: Column) -> Column:
    """Characters to put in place of `ch`: its confusables, or itself."""
    alts = F.array(ch)
    for source, others in CONFUSABLE.items():
        alts = F.when(ch == source, F.array(*[F.lit(o) for o in others])).otherwise(alts)
    return alts


def all_position_variants(c: Column) -> Column:
    """Every text made by replacing each confusable character; at most 2^8 per plate."""
    return F.aggregate(
        F.split(c, ""),
        F.array(F.lit("")),
        lambda heads, ch: F.flatten(
            F.transform(heads, lambda head: F.transform(_alternatives(ch), lambda alt: F.concat(head, alt)))
        ),
    )


def neighbour_variants(c: Column) -> Column:
    """Texts that differ from the input in one or two confusable positions."""

    def one_swap(text: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length(text)),
                lambda i: F.transform(
                    F.filter(
                        _alternatives(F.substring(text, i, F.lit(1))),
                        lambda alt: alt != F.substring(text, i, F.lit(1)),
                    ),
                    lambda alt: F.concat(
                        F.substring(text, F.lit(1), i - 1), alt, F.substring(text, i + 1, F.length(text))
                    ),
                ),
            )
        )

    first = one_swap(c)
    return F.array_except(F.array_distinct(F.concat(first, F.flatten(F.transform(first, one_swap)))), F.array(c))


def slot_hint(c: Column) -> Column:
    """Shape of a fragment; whatever is neither letter nor digit shows as a question mark."""
    marked = F.regexp_replace(F.regexp_replace(c, "[^\\p{L}\\p{N}]", "?"), "\\p{L}", "L")
    return F.regexp_replace(marked, "\\p{N}", "D")


def norm_fragment(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]", "")


def letters_of(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^\\p{L}]", ""))


def digits_of(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^\\p{N}]", ""))


def fragment_kind(c: Column) -> Column:
    n = F.length(c)
    return (
        F.when(n <= 0, "indefinido")
        .when(n == 1, "caractere_isolado")
        .when(n == 2, "par_de_caracteres")
        .when(n <= 4, "fragmento_curto")
        .otherwise("fragmento_parcial")
    )


def keep_fragment(c: Column, confidence: Column, support: Column, sources: Column) -> Column:
    """Short fragments need any backing; longer ones a mixed shape, confidence or a second engine."""
    n = F.length(c)
    mixed = (letters_of(c) > 0) & (digits_of(c) > 0)
    backed = (support >= 1) | (sources >= 1)

    def strong(floor: float) -> Column:
        return mixed | (confidence >= floor) | (support >= 2)

    return (
        F.when((n < 1) | (n > 6), False)
        .when(n == 1, (confidence >= 18.0) | backed)
        .when(n == 2, (confidence >= 16.0) | backed)
        .when(n == 3, strong(32.0))
        .when(n == 4, strong(36.0))
        .otherwise(strong(46.0))
    )


def fragment_priority(c: Column, confidence: Column, support: Column, sources: Column) -> Column:
    n = F.length(c)
    mixed = (letters_of(c) > 0) & (digits_of(c) > 0)
    total = (
        F.when(n <= 2, 3.2).when(n <= 4, 2.0).otherwise(1.1)
        + F.least(F.lit(5.0), support * 1.6)
        + F.least(F.lit(3.0), sources * 0.55)
        + F.least(F.lit(9.0), confidence / 12.0)
        + F.when(mixed, 1.3).when(n <= 2, 0.8).otherwise(0.2)
    )
    return F.when(n <= 0, 0.0).otherwise(rnd(total, 4))
