"""How a cell is read: as text, as a number, as a date, as blank or padded. Native expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[ \t\r\n]*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?[ \t\r\n]*\z"
INFINITE = r"(?i)^[ \t\r\n]*[-+]?inf(inity)?[ \t\r\n]*\z"
NOT_A_NUMBER = r"(?i)^[ \t\r\n]*[-+]?nan[ \t\r\n]*\z"
ASCII = r"^[\x00-\x7F]*\z"
MAX_INT = 2147483647

WHOLE = {"tinyint", "smallint", "int", "bigint"}
FRACTION = {"float", "double"}


def stored(dtype: str) -> str:
    """The storage word of a Spark type."""
    if dtype in ("tinyint", "smallint", "int"):
        return "integer"
    if dtype == "bigint":
        return "integer64"
    if dtype in FRACTION or dtype.startswith("decimal"):
        return "double"
    return {"string": "character", "boolean": "logical", "date": "Date"}.get(dtype, "POSIXct" if dtype.startswith("timestamp") else dtype)


def is_text(dtype: str) -> bool:
    return dtype == "string" or dtype.startswith(("varchar", "char"))


def is_number(dtype: str) -> bool:
    return dtype in WHOLE or dtype in FRACTION or dtype.startswith("decimal")


def number_text(x: Column) -> Column:
    """A double with 15 significant digits, never in scientific notation, without trailing zeros."""
    shown = F.format_string("%.14e", x)
    size = F.abs(x)
    plain = (
        F.when(size >= 1e22, shown.try_cast("decimal(38,0)").cast("string"))
        .when(size >= 1e7, shown.try_cast("decimal(38,15)").cast("string"))
        .when(size >= 1e-15, shown.try_cast("decimal(38,30)").cast("string"))
        .otherwise(shown.try_cast("decimal(38,37)").cast("string"))
    )
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+\z", "")).otherwise(plain)
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), "NaN")
        .when(x == float("inf"), "Inf")
        .when(x == float("-inf"), "-Inf")
        .when(x == 0, "0")
        .when((size < 1e15) & (F.floor(x) == x), x.cast("bigint").cast("string"))  # up to 15 digits, so nothing is rounded
        .otherwise(plain)
    )


def value_text(c: Column, dtype: str, date_format: str | None = None) -> Column:
    """The cell as text: numbers as number_text, dates in their format, text as it is."""
    if is_text(dtype):
        return c
    if dtype in WHOLE:
        return c.cast("string")
    if is_number(dtype):
        return number_text(c.cast("double"))
    if dtype == "boolean":
        return F.upper(c.cast("string"))
    if dtype == "date" or dtype.startswith("timestamp"):
        return F.date_format(c, java_format(date_format) if date_format else ("yyyy-MM-dd" if dtype == "date" else "yyyy-MM-dd HH:mm:ss"))
    return c.cast("string")


def is_blank(c: Column) -> Column:
    """Text of spaces only: space, tab, CR, LF in ASCII text, any Unicode space in other text. Null is not blank."""
    return F.when(c.rlike(ASCII), c.rlike(r"^[ \t\r\n]*\z")).otherwise(c.rlike(r"(?U)^\s*\z"))


def trimmed(c: Column) -> Column:
    return F.when(c.rlike(ASCII), F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+\z", "")).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+\z", ""))


def is_padded(c: Column) -> Column:
    return ~is_blank(c) & (c != trimmed(c))


@dataclass(frozen=True)
class Number:
    """A column read as numbers: the value, and whether it is lost or not finite in its class."""

    value: Column
    lost: Column
    not_finite: Column


def read_number(c: Column, dtype: str, whole: bool) -> Number:
    """c as a double; lost where the class (whole numbers of 32 bits, or doubles) cannot hold what is written."""
    if is_number(dtype):
        value = c.cast("double")
        inexact = (value.cast("decimal(38,0)") != c.cast("decimal(38,0)")) if dtype == "bigint" else F.lit(False)
    elif is_text(dtype):
        plain, infinite, nan = c.rlike(NUMBER), c.rlike(INFINITE), c.rlike(NOT_A_NUMBER)
        sign = F.when(F.trim(c).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        value = F.when(plain, F.regexp_replace(c, r"[ \t\r\n]+", "").try_cast("double")).when(infinite, sign).when(nan, F.lit(float("nan")))
        inexact = ~(plain | infinite | nan)
    elif dtype == "boolean":
        value, inexact = c.cast("int").cast("double"), F.lit(False)
    else:
        value, inexact = F.lit(None).cast("double"), c.isNotNull()
    endless = F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    lost = F.coalesce(inexact, F.lit(False))
    if whole:
        lost = lost | F.coalesce(~endless & ((F.floor(value).cast("double") != value) | (F.abs(value) > MAX_INT)), F.lit(False))
    return Number(value, lost & ~endless & c.isNotNull(), endless & c.isNotNull())


#: strptime's conversions and the pattern letters of the same meaning (fixed values).
PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "p": "a", "I": "hh", "%": "%"}


def java_format(written: str) -> str:
    """A strptime format as a Spark datetime pattern; unknown conversions are a ValueError."""
    out, k = "", 0
    written = written.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S")
    while k < len(written):
        if written[k] == "%":
            if k + 1 >= len(written) or written[k + 1] not in PATTERNS:
                raise ValueError(f"date format {written!r} has a conversion that is not known")
            out += PATTERNS[written[k + 1]]
            k += 2
        else:
            out += f"'{written[k]}'" if written[k].isalpha() else "''" if written[k] == "'" else written[k]
            k += 1
    return out


def reads_as_date(c: Column, written: str) -> Column:
    """Text that is a date as the format writes it: it reads back as itself."""
    pattern = java_format(written)
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit(pattern)), pattern) == c, F.lit(False))


#: Names of POSIX classes, which Java writes otherwise (fixed values).
POSIX = ("alpha", "digit", "alnum", "upper", "lower", "punct", "space", "blank", "cntrl", "graph", "print", "xdigit")


def java_pattern(pattern: str) -> str:
    """A POSIX extended pattern for Java's engine; an unknown class is a ValueError."""
    for name in POSIX:
        pattern = pattern.replace(f"[:{name}:]", r"\p{XDigit}" if name == "xdigit" else rf"\p{{{name.title()}}}")
    if "[:" in pattern:
        raise ValueError(f"pattern {pattern!r} has a class that is not known")
    return pattern


def decimal_places(text: Column) -> Column:
    """Digits after the point of a number's text."""
    return F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(F.lit(0))


def holds(c: Column, dtype: str, codes: list[str]) -> Column:
    """The cell is one of the codes: as numbers where it is stored as numbers, as text otherwise."""
    if is_number(dtype):
        numbers = [float(x) for x in codes if _is_number(x)]
        if dtype in WHOLE:
            whole = [int(x) for x in numbers if x == int(x) and abs(x) < 2**63]
            return F.coalesce(c.isin(whole), F.lit(False)) if whole else F.lit(False)
        return F.coalesce(c.cast("double").isin(numbers), F.lit(False)) if numbers else F.lit(False)
    if not codes:
        return F.lit(False)
    return F.coalesce(value_text(c, dtype).isin(codes), F.lit(False))


def _is_number(text: str) -> bool:
    try:
        return float(text) == float(text) and "_" not in text
    except ValueError:
        return False


def no(c: Column) -> Column:
    """c, with null as false."""
    return F.coalesce(c, F.lit(False))


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
