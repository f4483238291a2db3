"""Body-mass index, and dilutions C1 * V1 = C2 * V2 solved for one unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each unknown, by its number: its name, the two factors above and the divisor.
_SOLVED = {1: ("C1", "c2", "v2", "v1"), 2: ("V1", "c2", "v2", "c1"), 3: ("C2", "c1", "v1", "v2"), 4: ("V2", "c1", "v1", "c2")}

# Messages.
NOT_POSITIVE = "Error: Weight and height must be positive numbers!"
ZERO_DIVISOR = "Error: {} cannot be zero, run again."


def bmi_error(kg: Column, m: Column) -> Column:
    """The message for a weight or height that isn't positive, else null."""
    return F.when((kg <= 0) | (m <= 0), NOT_POSITIVE)


def bmi(kg: Column, m: Column) -> Column:
    """kg by squared m, to two places, half to even; null where bmi_error speaks."""
    return F.when((kg > 0) & (m > 0), F.bround(kg / (m * m), 2))


def bmi_category(value: Column) -> Column:
    """The category of a rounded index."""
    return F.when(value < 18.5, "Underweight").when(value < 25, "Normal weight").when(value < 30, "Overweight").when(value.isNotNull(), "Obese")


def dilution(choice: Column, c1: Column, v1: Column, c2: Column, v2: Column) -> Column:
    """The unknown that choice names (1 C1, 2 V1, 3 C2, 4 V2); null for a divisor of 0 or another choice."""
    given = {"c1": c1, "v1": v1, "c2": c2, "v2": v2}
    whens = [(choice == n, F.try_divide(given[a] * given[b], given[d])) for n, (_, a, b, d) in _SOLVED.items()]
    return reduce(lambda out, w: out.when(*w), whens[1:], F.when(*whens[0]))


def dilution_error(choice: Column, c1: Column, v1: Column, c2: Column, v2: Column) -> Column:
    """The message for a divisor of 0, else null."""
    given = {"c1": c1, "v1": v1, "c2": c2, "v2": v2}
    whens = [((choice == n) & (given[d] == 0), F.lit(ZERO_DIVISOR.format(d.upper()))) for n, (_, _, _, d) in _SOLVED.items()]
    return reduce(lambda out, w: out.when(*w), whens[1:], F.when(*whens[0]))
