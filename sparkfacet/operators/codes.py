"""Verifiable codes: signed tokens and vehicle identification numbers, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the VIN standard (ISO 3779): what letters count, the weights of the places, letters of model years from
#: 2010 on (digits 1 to 9: from 2001), and regions by the first character.
VIN_VALUES = {
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8, "J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9, "S": 2, "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9,
    "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9,
}
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_YEARS = "ABCDEFGHJKLMNPRSTVWXY"
VIN_REGIONS = (("12345", "Norteamérica"), ("67", "Oceanía"), ("89", "Sudamérica"), ("J", "Japón"), ("K", "Corea del Sur"), ("L", "China"), ("M", "India / Tailandia / Indonesia"), ("STUVWXYZ", "Europa"), ("ABCDEFGH", "África"))


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC as hex, from two SHA-256; the pads are made once on the driver."""
    key = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def base64url(data: Column) -> Column:
    """Base64 for URLs, without line breaks and padding."""
    return F.translate(F.regexp_replace(F.base64(data), r"\s", ""), "+/=", "-_")


def issue(secret: bytes, payload: Column) -> Column:
    """payload.signature, both in base64url; payload: canonical JSON."""
    return F.concat_ws(".", base64url(payload.cast("binary")), base64url(F.unhex(hmac_sha256(secret, payload))))


def verify(secret: bytes, token: Column) -> Column:
    """Whether the token's signature is that of its payload; false if it is malformed."""
    body = F.translate(F.get(F.split(token, "[.]"), F.lit(0)), "-_", "+/")
    payload = F.try_to_binary(F.concat(body, F.repeat(F.lit("="), (F.lit(4) - F.length(body) % 4) % 4)), F.lit("base64")).cast("string")
    return F.coalesce(issue(secret, payload) == token, F.lit(False))


def vin_valid(vin: Column) -> Column:
    """17 characters without I, O, Q, the ninth being the weighted sum modulo 11 (10: X)."""
    values = F.create_map(*(x for k, v in VIN_VALUES.items() for x in (F.lit(k), F.lit(v))))
    shape = vin.rlike("^[A-HJ-NPR-Z0-9]{17}$")
    terms = F.zip_with(F.split(vin, ""), F.array(*map(F.lit, VIN_WEIGHTS)), lambda c, w: F.coalesce(F.try_element_at(values, c), F.lit(0)) * w)
    rest = F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 11
    return F.coalesce(shape & (F.substring(vin, 9, 1) == F.when(rest == 10, "X").otherwise(rest.cast("string"))), F.lit(False))


def vin_clean(text: Column) -> Column:
    """Upper case letters and digits, 17 at most."""
    return F.substring(F.regexp_replace(F.upper(text), "[^A-Z0-9]", ""), 1, 17)


def vin_error(vin: Column) -> Column:
    """Why a cleaned number is none: its length, or the letters I, O and Q; else null."""
    return F.when(F.length(vin) != 17, "length").when(vin.rlike("[IOQ]"), "letters")


def vin_year(vin: Column, current: Column) -> Column:
    """The model year of a cleaned number: letters go round every thirty years, so those beyond next year are of the cycle before."""
    code = F.substring(vin, 10, 1)
    letter = F.instr(F.lit(VIN_YEARS), code)
    year = F.when(code.rlike("[1-9]"), 2000 + code.try_cast("int")).when((code != "") & (letter > 0), 2009 + letter)
    return F.when(year > current + 1, year - 30).otherwise(year)


def vin_region(vin: Column) -> Column:
    out = F.lit(None).cast("string")
    for letters, name in VIN_REGIONS:
        out = F.when(F.substring(vin, 1, 1).isin(*letters), name).otherwise(out)
    return out


def payload_of(token: Column, schema: str) -> Column:
    """The payload of a token as a struct; null if it is malformed. What it says counts only if verify() holds."""
    body = F.translate(F.get(F.split(token, "[.]"), F.lit(0)), "-_", "+/")
    return F.from_json(F.try_to_binary(F.concat(body, F.repeat(F.lit("="), (F.lit(4) - F.length(body) % 4) % 4)), F.lit("base64")).cast("string"), schema)


def short_code(token: Column, letters: int = 8) -> Column:
    """A code for people: the first hexadecimal digits of the token's hash, in two halves."""
    code = F.upper(F.substring(F.sha2(token.cast("binary"), 256), 1, letters))
    return F.concat_ws("-", F.substring(code, 1, letters // 2), F.substring(code, letters // 2 + 1, letters))
