"""Vector expressions on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vector size of a corpus, and the text form of a missing vector.
DEFAULT_DIM = 768
MISSING_VECTOR = "[]"


def format_vector(vector: Column) -> Column:
    """Numbers separated by one space, as a CSV cell. NULL stays NULL."""
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), " ")


def parse_vector(text: Column, lenient: bool = False) -> Column:
    """``"[0.1 -0.2]"`` or ``"0.1 -0.2"`` to ``array<double>``; NULL to ``[]``.

    Text that is no number is an error, or a NULL element if ``lenient``.
    """
    filled = F.coalesce(text, F.lit(MISSING_VECTOR))
    bare = F.btrim(filled, F.lit("[]"))
    numbers = F.array_remove(F.split(bare, r"\s+", -1), "")
    if lenient:
        return F.transform(numbers, lambda t: t.try_cast("double"))
    return numbers.cast("array<double>")


def fit_dimension(vector: Column, dim: int = DEFAULT_DIM) -> Column:
    """Cut to ``dim`` or pad with zeros on the right. NULL gives the zero vector."""
    present = F.coalesce(vector, F.array().cast("array<double>"))
    return F.slice(F.concat(present, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def as_float32(vector: Column) -> Column:
    return vector.cast("array<float>")


def dot_product(left: Column, right: Column) -> Column:
    """Dot product of two columns, summed in double precision.

    Interpreted per element; ``operators.search`` uses matrix products instead
    when one side is a batch of queries.
    """
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def round_float32(number: Column, digits: int) -> Column:
    """A float32 number as a double rounded half up, as ``round`` does, without decimals for every number.

    24 bits times a power of ten up to ``10**5`` are exact in double precision, so halves are seen as such.
    """
    if not 0 <= digits <= 5:
        raise ValueError("0 to 5 digits")
    wide, unit = number.cast("double"), 10.0**digits
    exact = F.signum(wide) * (F.floor(F.abs(wide) * unit + 0.5).cast("double") / unit) + F.lit(0.0)
    return F.when((F.abs(wide) >= 2.0**-16) & (F.abs(wide) < 2.0**24), exact).otherwise(F.round(wide, digits))
