"""Column expressions used by all operators. Bad input gives null, never a failed job."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Token transfer event, a fixed value: topic of Transfer(address,address,uint256).
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
ZERO_ADDRESS = "0x" + "0" * 40


def hex_word(c: Column) -> Column:
    """Canonical form of an unsigned 256-bit hex number, with or without ``0x``: 64 lower-case digits.

    Text order of the result is numeric order. Null for anything that isn't a number of at most 256 bits.
    """
    return F.lpad(F.nullif(F.regexp_extract(F.lower(c), "^(?:0x)?0*([0-9a-f]{1,64})$", 1), F.lit("")), 64, "0")


def hex_to_decimal(c: Column) -> Column:
    """decimal(38,0) of a hex number of at most 30 significant digits, else null (see :func:`hex_to_text`)."""
    digits = F.lpad(F.nullif(F.regexp_extract(F.lower(c), "^(?:0x)?0*([0-9a-f]{1,30})$", 1), F.lit("")), 30, "0")
    part = lambda at: F.conv(F.substring(digits, at, 15), 16, 10).cast("decimal(20,0)")
    return (part(1) * F.lit(16**15).cast("decimal(19,0)") + part(16)).cast("decimal(38,0)")


def packed(c: Column) -> Column:
    """Binary form of a text, half as long for ``0x`` and an even number of lower-case hex digits; see :func:`unpacked`."""
    raw = F.unhex(F.substring(c, 3, 1 << 30))
    return F.when(F.concat(F.lit("0x"), F.lower(F.hex(raw))) == c, F.concat(F.lit(b"\x01"), raw)).otherwise(F.concat(F.lit(b"\x00"), F.encode(c, "UTF-8")))


def unpacked(b: Column) -> Column:
    """The text that :func:`packed` has made binary."""
    rest = F.substring(b, 2, 1 << 30)
    return F.when(F.substring(b, 1, 1) == F.lit(b"\x01"), F.concat(F.lit("0x"), F.lower(F.hex(rest)))).otherwise(F.decode(rest, "UTF-8"))


def packs(columns: StructType, but: Iterable[str] = ()) -> tuple[dict[str, Column], dict[str, Column]]:
    """What packs all texts and lists of texts of a table, except those of ``but``, and what unpacks them, by column."""
    there, back = {}, {}
    for f in columns.fields:
        c, kind = F.col("`" + f.name.replace("`", "``") + "`"), f.dataType.simpleString()
        if f.name in but or kind not in ("string", "array<string>"):
            continue
        there[f.name], back[f.name] = (packed(c), unpacked(c)) if kind == "string" else (F.transform(c, packed), F.transform(c, unpacked))
    return there, back


def word_to_decimal(word: Column) -> Column:
    return hex_to_decimal(word)


#: Base-10^9 digits of 2^(16 k), least first: constants of the conversion below.
_LIMBS, _DIGITS, _BASE = 16, 9, 10**9


def _carried(sums: list[Column], digits: int = 9) -> Column:
    """Decimal text of the number with base-10^``digits`` digits ``sums`` (least first), which may exceed the base.

    A fold over the digits, so that each carry is computed once.
    """
    wide, base = "decimal(38,0)", F.lit(10**digits).cast(f"decimal({digits + 1},0)")
    start = F.struct(F.lit(0).cast(wide).alias("carry"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        t = s + acc["carry"]
        rest = t % base
        carry = ((t - rest) / base).cast(wide)  # exact, as nothing is left over
        return F.struct(carry.alias("carry"), F.concat(F.lpad(rest.cast("bigint").cast("string"), digits, "0"), acc["text"]).alias("text"))

    return F.aggregate(F.array(*(s.cast(wide) for s in sums)), start, step, lambda r: F.regexp_replace(F.concat(r["carry"].cast("string"), r["text"]), "^0+(?=.)", ""))


def _from_limbs(limbs: list[Column], digits: int = _DIGITS) -> Column:
    """``limbs``: 16-bit digits (or sums of them), most significant first."""
    sums = []
    for d in range(digits):
        terms = [limb.cast("decimal(28,0)") * F.lit((2 ** (16 * k) // _BASE**d) % _BASE).cast("decimal(10,0)") for k, limb in enumerate(reversed(limbs)) if (2 ** (16 * k) // _BASE**d) % _BASE]
        sums.append(reduce(lambda a, b: a + b, terms) if terms else F.lit(0))
    return _carried(sums)


def limbs(word: Column) -> list[Column]:
    """The sixteen 16-bit digits of a canonical word as bigint, most significant first."""
    return [F.conv(F.substring(word, 4 * k + 1, 4), 16, 10).cast("bigint") for k in range(_LIMBS)]


def word_to_text(word: Column) -> Column:
    """Exact decimal text of a canonical word, all 256 bits. Numbers below 2^64 take one conversion."""
    low = F.conv(F.substring(word, 49, 16), 16, 10)
    return F.when(word.startswith("0" * 48), low).when(word.isNotNull(), _wide_text(word))


def _wide_text(word: Column) -> Column:
    """Five digits of 60 bits, whose products with base-10^18 digits of their powers fit 38 decimal places."""
    parts = [F.conv(F.substring(word, max(1, 50 - 15 * k), 15 if k < 4 else 4), 16, 10).cast("decimal(19,0)") for k in range(5)]
    sums = []
    for d in range(5):
        own = [(p, (2 ** (60 * k) // 10 ** (18 * d)) % 10**18) for k, p in enumerate(parts)]
        sums.append(reduce(lambda a, b: a + b, [(p * F.lit(c).cast("decimal(18,0)")).cast("decimal(38,0)") for p, c in own if c]))
    return _carried(sums, 18)


def sum_words(word: Column) -> Column:
    """Aggregate: exact decimal text of the sum of canonical words, as ``groupBy().agg(sum_words(...))``."""
    return _from_limbs([F.sum(x) for x in limbs(word)], _DIGITS + 1)


def hex_to_text(c: Column) -> Column:
    return word_to_text(hex_word(c))


def block_number(c: Column) -> Column:
    """Height from ``0x`` hex or decimal text; null beyond a signed 64-bit number."""
    digits = F.nullif(F.regexp_extract(F.lower(c), "^0x0*([0-9a-f]{1,16})$", 1), F.lit(""))
    as_hex = F.conv(digits, 16, 10).try_cast("bigint")
    as_dec = F.when(c.rlike("^[0-9]+$"), c).try_cast("bigint")
    return F.when(c.startswith("0x"), as_hex).otherwise(as_dec)


def to_hex(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(n)))


def is_address(c: Column) -> Column:
    """``0x`` and forty hex digits; texts of another prefix need two characters."""
    return F.coalesce(F.when(c.startswith("0x"), c.rlike("^0x[0-9a-fA-F]{40}$")).otherwise(F.length(c) >= 2), F.lit(False))


def is_zero_address(c: Column) -> Column:
    return F.coalesce(c.isin(ZERO_ADDRESS, ""), F.lit(False))


def display(amount: Column, decimals: Column) -> Column:
    """``amount`` (decimal text or number) over 10^decimals as text, without trailing zeros; null is ``0``."""
    t = amount.cast("string")
    sign, t = F.when(t.startswith("-"), "-").otherwise(""), F.regexp_replace(t, "^-", "")
    # Padded so that at least one digit stands before the point; a length below that of the text would cut it.
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(decimals + 1 - F.length(t), F.lit(0))), t)
    whole = F.substring(padded, F.lit(1), F.length(padded) - decimals)
    part = F.rtrim(F.substring(padded, F.length(padded) - decimals + 1, decimals), F.lit("0"))
    return F.when(t.isNull(), "0").otherwise(F.concat(sign, whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part))))


def wei_to_ether(wei: Column) -> Column:
    """decimal(38,18); null where it doesn't fit."""
    return F.try_divide(wei.try_cast("decimal(38,0)"), F.lit(10**18).cast("decimal(19,0)")).try_cast("decimal(38,18)")


def ether_to_wei(ether: Column) -> Column:
    return F.floor(ether.try_cast("decimal(28,18)") * F.lit(10**18).cast("decimal(19,0)")).try_cast("decimal(38,0)")


def record_id(chain: Column, tx_hash: Column, index: Column) -> Column:
    return F.sha2(F.concat(chain, F.lit("-"), tx_hash, F.lit("-"), index.cast("string")), 256)


def shard(n: Column, count: int) -> Column:
    return F.pmod(n, F.lit(count)).cast("int")


def address_shard(a: Column, count: int) -> Column:
    """First byte of sha256 of the last two characters, modulo ``count``; 0 for shorter texts."""
    byte = F.conv(F.substring(F.sha2(F.right(a, F.lit(2)), 256), 1, 2), 16, 10).cast("int")
    return F.when(F.length(a) >= 2, byte % count).otherwise(0).cast("int")


def abi_string(c: Column) -> Column:
    """Text in an ABI-encoded string result; texts without ``0x`` are returned as they are, damaged ones give ``''``."""
    data = F.substring(c, 3, 1 << 30)
    number = lambda at: F.conv(F.substring(data, at + 48, F.lit(16)), 16, 10).try_cast("int")
    offset = number(F.lit(1)) * 2
    size = number(offset + 1) * 2
    body = F.substring(data, offset + 65, size)
    text = F.when(data.rlike("^[0-9a-fA-F]{128,}$") & (F.length(body) == size), F.try_validate_utf8(F.unhex(body).cast("string")))
    return F.when(c.startswith("0x"), F.coalesce(text, F.lit(""))).otherwise(c)


def topic_address(topic: Column) -> Column:
    return F.concat(F.lit("0x"), F.right(topic, F.lit(40)))


def receipt_status(status: Column) -> Column:
    """``confirmed`` for 1, else ``reverted``."""
    return F.when(F.coalesce(block_number(status), F.lit(0)) == 1, "confirmed").otherwise("reverted")


def flag_status(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "confirmed").otherwise("reverted")


def tx_key(chain: Column, tx_hash: Column) -> Column:
    return F.concat(F.lit("tx:"), chain, F.lit(":"), tx_hash)


def message_key(*parts: Column) -> Column:
    return F.concat_ws("-", *(p.cast("string") for p in parts))


def fee(gas_price: Column, gas_used: Column) -> Column:
    """decimal(38,0) product, null where it doesn't fit."""
    return F.try_multiply(gas_price.try_cast("decimal(38,0)"), gas_used.try_cast("decimal(38,0)")).try_cast("decimal(38,0)")


def clean_text(c: Column) -> Column:
    """Without surrounding space and control characters."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "[\\x00-\\x1f\\x7f]", "")


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def byte_text(n: Column) -> Column:
    """``512 B``, ``1.5 KiB`` and so on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / 1024.0**k), F.lit(" " + unit))).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    """``12ms``, ``1.50s``, ``2.25m``, ``1.00h``."""
    s = seconds.cast("double")
    unit = lambda size, mark: F.concat(F.format_string("%.2f", s / size), F.lit(mark))
    return F.when(s < 1, F.concat(F.floor(s * 1000).cast("string"), F.lit("ms"))).when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).otherwise(F.when(s.isNotNull(), unit(3600, "h")))


def from_seconds(c: Column) -> Column:
    return F.timestamp_seconds(c)


def from_millis(c: Column) -> Column:
    """Timestamp of whole seconds, milliseconds cut off."""
    return F.timestamp_seconds(F.floor(c / 1000))


def clamp(c: Column, low: Column, high: Column | None = None) -> Column:
    c = F.greatest(c, low)
    return c if high is None else F.least(c, high)
