"""Completion tokens as column expressions: CRC-32C, base64url, JSON, and the verdict on a token."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEDGER, AUDITOR = "ledger", "auditor"
SCHEMA = "server_type string, started_at_ms bigint, crc32c string"
#: Verdicts on a token.
OK, BAD_CRC, UNDECODABLE, UNKNOWN_SERVER, NOT_LEDGER, NOT_AUDITOR = "OK", "001", "002", "003", "005", "006"
#: The Castagnoli polynomial, reflected.
POLYNOMIAL = 0x82F63B78


def crc_table(polynomial: int = POLYNOMIAL) -> list[int]:
    return [reduce(lambda c, _: c >> 1 ^ (polynomial if c & 1 else 0), range(8), i) for i in range(256)]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc32c(text: Column, reverse_bytes: bool = True) -> Column:
    """CRC-32C of a string's UTF-8 bytes as eight hex digits, least significant byte first, as the tokens have it, or most significant first."""
    table = F.array(*[F.lit(x).cast("long") for x in crc_table()])
    bytes_ = F.filter(F.split(F.decode(text.cast("binary"), "ISO-8859-1"), ""), lambda c: c != "")  # one character for each byte

    def whole(entries: Column) -> Column:
        def step(crc: Column, c: Column) -> Column:
            return F.shiftright(crc, 8).bitwiseXOR(F.get(entries, crc.bitwiseXOR(F.ascii(c).cast("long")).bitwiseAND(F.lit(255)).cast("int")))

        return F.aggregate(bytes_, F.lit(0xFFFFFFFF).cast("long"), step).bitwiseXOR(F.lit(0xFFFFFFFF).cast("long"))

    value = bound(table, whole)
    out = F.lower(F.lpad(F.hex(value), 8, "0"))
    return F.concat(*[F.substring(out, k, 2) for k in (7, 5, 3, 1)]) if reverse_bytes else out


def checksum(server: Column, started_at_ms: Column, reverse_bytes: bool = True) -> Column:
    return crc32c(F.concat(server, started_at_ms.cast("string")), reverse_bytes)


def base64url(data: Column) -> Column:
    """Without padding and line breaks."""
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def from_base64url(text: Column) -> Column:
    """Bytes of a padded or unpadded token; null if it isn't base64url."""
    bare = F.rtrim(F.translate(text, "-_", "+/"), F.lit("="))
    return F.try_to_binary(F.rpad(bare, ((F.length(bare) + 3) / 4).cast("int") * 4, F.lit("=")), F.lit("base64"))


def encode(server: Column, started_at_ms: Column, reverse_bytes: bool = True) -> Column:
    body = F.struct(server.alias("server_type"), started_at_ms.cast("long").alias("started_at_ms"), checksum(server, started_at_ms, reverse_bytes).alias("crc32c"))
    return base64url(F.encode(F.to_json(body), "UTF-8"))


def decode(token: Column) -> Column:
    """Struct of the token's fields; all null if it can't be decoded."""
    return F.from_json(F.try_validate_utf8(from_base64url(token).cast("string")), SCHEMA)


def verdict(fields: Column, expected: Column | None = None, reverse_bytes: bool = True) -> Column:
    """OK or a code, in this order: undecodable, unknown server type, wrong checksum, type not expected in its place."""
    server, ms, crc = fields["server_type"], fields["started_at_ms"], fields["crc32c"]
    out = (
        F.when(server.isNull() | ms.isNull() | crc.isNull(), UNDECODABLE)
        .when(~server.isin(LEDGER, AUDITOR), UNKNOWN_SERVER)
        .when(checksum(server, ms, reverse_bytes) != crc, BAD_CRC)
    )
    if expected is not None:
        out = out.when((expected == LEDGER) & (server != LEDGER), NOT_LEDGER).when((expected == AUDITOR) & (server != AUDITOR), NOT_AUDITOR)
    return out.otherwise(OK)
