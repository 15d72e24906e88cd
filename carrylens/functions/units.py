"""Fixed-point units, guarded arithmetic and hex/address column expressions.

Everything here returns a ``Column`` so it stays inside whole-stage codegen;
no Python UDF is used anywhere in the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Fixed values of the on-chain unit conventions.
WAD = 1e18  # token amounts, health factor
RAY = 1e27  # rates and indices
BASE = 1e8  # account values in base currency
BPS = 1e4  # ltv, liquidation threshold, reserve factor, curve parameters
SECONDS_PER_YEAR = 31_536_000.0
ZERO_ADDRESS = "0x" + "0" * 40

EXACT = DecimalType(38, 0)


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scale(c: str | Column, unit: float) -> Column:
    """Raw fixed-point integer -> DOUBLE in natural units (PF-2, SC-8)."""
    return col_(c).cast("double") / F.lit(float(unit))


def exact(c: str | Column) -> Column:
    """Cast an integer amount to DECIMAL(38,0) so sums are exact and cannot
    overflow a 64-bit accumulator on very large or very skewed groups (T25)."""
    return col_(c).cast(EXACT)


def exact_sum(c: str | Column) -> Column:
    return F.sum(exact(c))


def real_sum(c: str | Column) -> Column:
    """Sum of a DOUBLE that doesn't depend on the order of rows or partitions
    (T25): every value is taken to 12 decimals and summed exactly."""
    return F.sum(col_(c).cast("decimal(38,12)")).cast("double")


def weighted_mean(c: str | Column, weight: str | Column) -> Column:
    """``sum(c * weight) / sum(weight)`` by exact sums and one division."""
    return safe_div(real_sum(col_(c) * col_(weight)), real_sum(weight))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """``a / NULLIF(b, 0)``: NULL instead of an ANSI divide-by-zero error (T1)."""
    b = col_(b)
    return F.when(b != 0, col_(a) / b)


def pos_div(a: str | Column, b: str | Column) -> Column:
    """``CASE WHEN b > 0 THEN a / b END`` (PF-10, second form)."""
    b = col_(b)
    return F.when(b > 0, col_(a) / b)


def r8(c: Column) -> Column:
    """Round a derived ratio to 8 places; float results of different engines
    are only comparable after rounding."""
    return F.round(c, 8)


def apr_to_apy(apr: str | Column, n: float = SECONDS_PER_YEAR) -> Column:
    """Per-second compounding ``(1 + apr/n)^n - 1`` (J-12), written as
    ``expm1(n * log1p(apr / n))`` which keeps the digits the naive power
    loses (T3)."""
    return F.expm1(F.lit(float(n)) * F.log1p(col_(apr) / F.lit(float(n))))


def address_from_id(c: str | Column, lead: str = "") -> Column:
    """Integer id -> lower-case 0x-prefixed 20-byte hex address; ``lead`` is a
    fixed first part, so that ids of several kinds never meet."""
    return F.concat(F.lit("0x" + lead), F.lpad(F.lower(F.hex(col_(c))), 40 - len(lead), "0"))


def address_from_topic(c: str | Column) -> Column:
    """32-byte topic word -> address: last 40 hex digits, lower case (SC-10)."""
    return F.concat(F.lit("0x"), F.lower(F.right(col_(c), F.lit(40))))


def word_from_address(c: str | Column) -> Column:
    """Address -> left-padded 32-byte word, 0x-prefixed (SC-11)."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.substring(col_(c), 3, 40)), 64, "0"))


def word_limbs(word: str | Column) -> list[Column]:
    """A 64-hex-digit word (no prefix) as four unsigned 64-bit limbs, most
    significant first, each the decimal-digit string ``conv`` returns.
    ``conv`` handles exactly 16 hex digits without overflow; a wider
    conversion would raise under ANSI.  Each limb is one ``substring`` of
    the input, so decoding stays a small expression."""
    w = col_(word)
    return [F.conv(F.substring(w, 1 + 16 * k, 16), 16, 10) for k in range(4)]


def word_to_decimal(word: str | Column) -> Column:
    """uint256 word -> DECIMAL(38,0) when the value fits 128 bits (enough for
    any token amount), else NULL (Hard 1).  ``try_*`` keeps ANSI from raising."""
    l0, l1, l2, l3 = (x.cast(DecimalType(20, 0)) for x in word_limbs(word))
    fits = (l0 == 0) & (l1 == 0)
    two64 = F.lit("18446744073709551616").cast(DecimalType(20, 0))
    hi = F.try_multiply(l2.cast(EXACT), two64)
    return F.when(fits, F.try_add(hi, l3).cast(EXACT))


def word_to_double(word: str | Column) -> Column:
    """uint256 word -> DOUBLE over the full 256-bit range."""
    out = None
    for k, limb in enumerate(word_limbs(word)):
        term = limb.cast("double") * F.lit(float(2 ** (64 * (3 - k))))
        out = term if out is None else out + term
    return out


def hex64(c: str | Column) -> Column:
    """The 64 hex digits of a 0x-prefixed 32-byte word (a topic)."""
    return F.substring(col_(c), 3, 64)


def word_at(data: str | Column, i: int) -> Column:
    """The i-th 32-byte word (0-based) of a 0x-prefixed ABI blob (SC-12)."""
    return F.substring(col_(data), 3 + 64 * i, 64)


def n_words(data: str | Column) -> Column:
    """Number of whole 32-byte words in a 0x-prefixed blob."""
    return F.floor((F.length(col_(data)) - F.lit(2)) / 64).cast("int")


def bit_is_set(bitmap: str | Column, i: int | Column) -> Column:
    """Bit test on a DECIMAL(38,0) bitmap (Hard 2).  The bitmap is split by
    integral division and remainder, both exact, into 32-bit limbs."""
    b = col_(bitmap).cast(EXACT)
    word, half = (F.lit(str(2**n)).cast(EXACT) for n in (64, 32))
    low, high = b % word, F.call_function("div", b, word)
    limbs = F.array((low % half).cast("bigint"), F.call_function("div", low, half), F.pmod(high, F.lit(2**32)), F.shiftrightunsigned(high, 32))
    i = F.lit(i) if isinstance(i, int) else i
    return F.getbit(F.get(limbs, F.floor(i / 32).cast("int")), F.pmod(i, F.lit(32)).cast("int")) == 1


def hex_bit_is_set(bitmap: str | Column, i: int | Column) -> Column:
    """Bit test on a bitmap of 32 hex digits, which holds all 128 bits."""
    i = F.lit(i) if isinstance(i, int) else i
    digit = F.conv(F.substring(col_(bitmap), F.lit(32) - F.floor(i / 4).cast("int"), F.lit(1)), 16, 10).cast("int")
    return F.getbit(digit, F.pmod(i, F.lit(4)).cast("int")) == 1


def hex_set_bits(bitmap: str | Column, width: int = 128) -> Column:
    """ARRAY<INT> of the set bit positions of a bitmap of 32 hex digits."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: hex_bit_is_set(bitmap, i))


def hex_bitmap(high: str | Column, low: str | Column) -> Column:
    """Two BIGINT limbs -> 32 lower-case hex digits, which hold all 128 bits."""
    return F.lower(F.concat(F.lpad(F.hex(col_(high)), 16, "0"), F.lpad(F.hex(col_(low)), 16, "0")))


def set_bits(bitmap: str | Column, width: int = 128) -> Column:
    """ARRAY<INT> of the set bit positions of a bitmap (SC-13)."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: bit_is_set(bitmap, i))
