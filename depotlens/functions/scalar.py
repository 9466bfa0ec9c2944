"""Column functions shared by the operators.  All run inside the JVM."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity (-2.5 gives -2)."""
    return F.floor(x + F.lit(0.5))


def mean_rounded(x: Column) -> Column:
    """Mean rounded half up; 0 for an empty group.  An aggregate."""
    return F.coalesce(round_half_up(F.avg(x)), F.lit(0).cast("bigint"))


def _share(n: Column, total: Column) -> Column:
    return n.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))


def percent(n: Column, total: Column) -> Column:
    """Percentage with one decimal as a double; 0 when there is no total."""
    return F.coalesce(round_half_up(_share(n, total) * 1000) / 10, F.lit(0.0))


def percent_whole(n: Column, total: Column) -> Column:
    return F.coalesce(round_half_up(_share(n, total) * 100), F.lit(0).cast("bigint"))


def fixed1(x: Column) -> Column:
    """One-decimal text of a value in [0, 2^20), judged on its exact binary value.

    1.45 is stored slightly below 1.45, so its text is 1.4.  ``round`` works on
    the shortest decimal form and would say 1.5.  The candidate tenth is checked
    against the tie below it with two exact partial products.
    """
    candidate = F.floor(x * 10 + F.lit(0.5))
    high = F.floor(x * 1048576).cast("double") / 1048576
    low = x - high
    below_tie = (high * 20 - (candidate * 2 - 1)) < (low * -20)
    tenths = candidate - F.when(below_tie, 1).otherwise(0)
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string")
    )


def percent_fixed1(n: Column, total: Column) -> Column:
    """Percentage as one-decimal text, ``0.0`` when there is no total."""
    return F.coalesce(fixed1(_share(n, total) * 100), F.lit("0.0"))


def yen(x: Column) -> Column:
    return F.concat(F.lit("¥"), F.format_number(x, 0))


def short_id(x: Column) -> Column:
    return F.concat(F.substring(x, 1, 8), F.lit("…"))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_number(text: Column) -> Column:
    """Number from text; blank, unparsable and NaN become NULL."""
    number = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_text(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits.  CJK runs are not segmented."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    """The same rule for a query typed by a user, duplicates removed."""
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", text.lower()) if t))


def encode_token(values: Column) -> Column:
    """Cursor text of a struct: JSON in URL-safe base64 without padding."""
    coded = F.base64(F.to_json(values).cast("binary"))
    return F.translate(coded, "+/=\r\n", "-_")  # long texts come with line breaks


def decode_token(token: str, fields: list[str]) -> dict:
    """Values of a cursor; a damaged cursor raises ``ValueError('INVALID_TOKEN')``."""
    try:
        raw = base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True)
        values = json.loads(raw.decode("utf-8"))
        return {f: values[f] for f in fields}
    except (ValueError, KeyError, TypeError) as bad:
        raise ValueError("INVALID_TOKEN") from bad
