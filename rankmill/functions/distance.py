"""Edit distance with transpositions as a Catalyst expression, and the keys on which near words meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters deleted at most from either word before they meet.
MAX_EDITS = 2


def osa(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b, no place being edited twice.

    Rows of the usual table are folded over the letters of b; the state holds the last two rows and the last letter.
    """
    wide = F.length(a)
    places = F.when(wide > 0, F.sequence(F.lit(1), wide)).otherwise(F.array().cast("array<int>"))
    letters = F.filter(F.split(b, ""), lambda c: c != "")
    start = F.struct(F.sequence(F.lit(0), wide).alias("row"), F.sequence(F.lit(0), wide).alias("above"), F.lit("").alias("seen"), F.lit(0).alias("j"))

    def step(state: Column, letter: Column) -> Column:
        row, above, j = state["row"], state["above"], state["j"] + 1

        def cell(line: Column, i: Column) -> Column:
            own, before = F.substring(a, i, F.lit(1)), F.substring(a, i - 1, F.lit(1))
            plain = F.least(F.get(line, i - 1) + 1, F.get(row, i) + 1, F.get(row, i - 1) + F.when(own == letter, 0).otherwise(1))
            swapped = (i > 1) & (j > 1) & (own == state["seen"]) & (before == letter)
            return F.concat(line, F.array(F.when(swapped, F.least(plain, F.get(above, i - 2) + 1)).otherwise(plain)))

        return F.struct(F.reduce(places, F.array(j), cell).alias("row"), row.alias("above"), letter.alias("seen"), j.alias("j"))

    return F.reduce(letters, start, step, lambda state: F.get(state["row"], wide))


def deletions(word: Column) -> Column:
    """The word and all that remains of it after one or two deletions: words within two edits share one of these."""

    def drop(w: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, cuts).otherwise(F.array().cast("array<string>"))

    once = F.array_distinct(drop(word))
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, drop))))
