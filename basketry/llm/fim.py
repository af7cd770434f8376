"""Fill-in-middle rewriting: a counted-quantifier regular expression cuts each text in one match.

A unit is a word with the white space before it, or white space alone at the end. ``regexp_count`` gives a
text's number of units; the two cut points come from a hash of the row's id. The pattern is then built for
the row: ``unit{a}`` and ``unit{b-a}``, both possessive, so the engine loops over the units without a stack or
a way back, and one match has prefix, middle and suffix. All of it is built-in functions on whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Possessive throughout: a unit matches in one way only.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
SEED, FIM_PERCENT, SPM_PERCENT = "42", 50, 80


def draws(id_col: Column, seed: str, n: int) -> list[Column]:
    """``n`` (at most 8) unsigned 32-bit numbers from the sha256 of ``seed:id``; a null id is the empty text."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def cut_pattern(first: Column, second: Column) -> Column:
    """A row's pattern: groups of ``first`` and ``second`` units and the rest."""
    return F.concat(F.lit(rf"(?s)\A({UNIT}{{"), first, F.lit(rf"}}+)({UNIT}{{"), second, F.lit(r"}+)(.*+)\z"))


def fill_in_middle(df: DataFrame, id_col: str, text_col: str, seed: str = SEED, fim_percent: int = FIM_PERCENT,
                   spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row (id, n, form, prefix_chars, middle_chars, output) per row of ``df``.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); the character counts are
    null for plain. A null text is empty; an empty text, or one that has a mark already, stays plain. Rows of
    one id and text are cut alike, null ids as the empty id; an empty table gives no rows; other columns are
    ignored. Texts are cut whole, at any length.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("id"), seed, 4)
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long")).withColumns({"c1": h1 % (F.col("n") + 1), "c2": h2 % (F.col("n") + 1)})
    plain = (F.col("text") == "") | F.col("text").rlike(MARKS) | (h3 % 100 >= fim_percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    # no mark occurs in such a text, and no two marks overlap, so a mark set by the match splits it again
    at = F.least("c1", "c2")
    marked = F.regexp_replace("text", cut_pattern(at, F.greatest("c1", "c2") - at), F.lit(f"$1{MIDDLE}$2{MIDDLE}$3"))
    rows = rows.withColumn("parts", F.when(F.col("form") != "plain", F.split(marked, MIDDLE, -1)))
    prefix, middle, suffix = (F.col("parts")[i] for i in range(3))
    p, s, m = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))
    output = (F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text")))
    return rows.select("id", "n", "form", F.length(prefix).cast("long").alias("prefix_chars"),
                       F.length(middle).cast("long").alias("middle_chars"), output.alias("output"))


def restore(output: Column | str, form: Column | str) -> Column:
    """The text that ``fill_in_middle`` rewrote, from its output and form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, MARKS, -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
