"""Format-preserving pseudonyms for personal data.

Card numbers, phone numbers, social security numbers, IP addresses, dates, e-mail addresses and access
tokens are found by pattern, validated, and replaced by a keyed permutation of their own format: an
alternating Feistel network over the two halves of the value, with keyed SHA-512 as the round function.
The permutation depends on kind, key and value alone, so equal values stay linked across documents and
different values stay different; without the key nobody can undo it.  Cards keep a right check digit,
addresses stay in range, dates stay dates, separators stay where they are.

Cards are looked for in whole runs of digit groups: from the first group on, the longest stretch of groups
of 13 to 19 digits with a right check digit is a card, and the search goes on behind it.  So an expiry date, a
security code or another number beside a card does not hide it.

Everything is a column expression; no text leaves its row.

Defined cases: a null text stays null; what fails validation (a check digit, an octet above 255, the 31st of
a short month, a date outside 1900-01-01 to 2099-08-04) is left as it is; repeated rows are treated alike; an empty
table gives no rows.  Other columns pass through; columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Kinds in the order in which they are tried, with the pattern of a whole value.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9_-])(?i:api_?key|token|secret|password)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9_-]{16,128}(?![A-Za-z0-9_-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}"
             r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])",
}
#: Groups of digits between spaces in which cards are looked for, up to where another kind begins.
_GROUP = r"[0-9](?:-?[0-9])*+(?![0-9-])"
PATTERNS["card"] = (
    rf"(?<![0-9-])(?=[0-9](?:[ -]?[0-9]){{12}}){_GROUP}(?: (?!{'|'.join(PATTERNS.values())}){_GROUP})*+"
)
KINDS = list(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: Days from the first date of the permuted range to 1970-01-01, and the root of the length of the range.
DATE_BASE, DATE_SIDE = 25567, 270


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, kind: Column, round_: Column, half: Column) -> Column:
    parts = F.concat_ws("|", F.lit(key), kind, round_.cast("string"), half)
    return F.concat(F.sha2(F.concat(parts, F.lit("|0")), 512), F.sha2(F.concat(parts, F.lit("|1")), 512))


def _number(digest: Column, at: Column | int, width: int) -> Column:
    return F.conv(F.substr(digest, F.lit(at) if isinstance(at, int) else at, F.lit(width)), 16, 10).cast("long")


def _shifted(half: Column, digest: Column, letters: int) -> Column:
    """Every digit and letter of ``half`` moved within its own class; all else stays."""

    def moved(code: Column, by: Column) -> Column:
        rotate = lambda first, size: F.char(first + F.pmod(code - first + by, F.lit(size)))
        return (
            F.when((code >= 48) & (code <= 57), rotate(48, 10))
            .when((code >= 97) & (code < 97 + letters), rotate(97, letters))
            .when((code >= 65) & (code < 65 + letters), rotate(65, letters))
            .otherwise(F.char(code))
        )

    def all_moved(stream: Column) -> Column:
        codes = F.transform(F.split(half, ""), lambda c: F.ascii(c))
        return F.array_join(F.transform(codes, lambda code, i: moved(code, _number(stream, 3 * i + 1, 3))), "")

    return F.when(F.length(half) > 0, _let(digest, all_moved)).otherwise(half)


def permuted_text(value: Column, kind: Column, key: str, letters: int = 26) -> Column:
    """Feistel permutation of the strings with the same character classes as ``value``."""
    middle = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), middle).alias("a"), F.substr(value, middle + 1).alias("b"))

    def round_(pair: Column, r: Column) -> Column:
        new_b = _shifted(pair["b"], _digest(key, kind, r, pair["a"]), letters)
        new_a = _shifted(pair["a"], _digest(key, kind, r, pair["b"]), letters)
        return F.when(
            r % 2 == 0, F.struct(pair["a"].alias("a"), new_b.alias("b"))
        ).otherwise(F.struct(new_a.alias("a"), pair["b"].alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda p: F.concat(p["a"], p["b"]))


def permuted_number(value: Column, side: int, kind: Column, key: str) -> Column:
    """Feistel permutation of the numbers from 0 to ``side`` squared, less one."""
    start = F.struct(
        F.floor(value / side).cast("long").alias("a"), F.pmod(value.cast("long"), F.lit(side)).cast("long").alias("b")
    )

    def round_(pair: Column, r: Column) -> Column:
        added = lambda half, other: F.pmod(
            half + _number(_digest(key, kind, r, other.cast("string")), 1, 8), F.lit(side)).cast("long")
        return F.when(
            r % 2 == 0, F.struct(pair["a"].alias("a"), added(pair["b"], pair["a"]).alias("b"))
        ).otherwise(F.struct(added(pair["a"], pair["b"]).alias("a"), pair["b"].alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda p: p["a"] * side + p["b"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits from the right, every second one doubled, starting with the last undoubled."""
    def weight(i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, weight), F.lit(0), lambda a, x: a + x)


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn by ``digits``."""
    chars = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, i, F.lit(1)))
    step = lambda acc, c: F.when(
        c.rlike("[0-9]"),
        F.struct(F.concat(acc["out"], F.substr(digits, acc["k"], F.lit(1))).alias("out"), (acc["k"] + 1).alias("k")),
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k")))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def _filled(value: Column, digits: Column) -> Column:
    return _let(digits, lambda known: _refilled(value, known))


def _card(value: Column, key: str) -> Column:
    def renumbered(digits: Column) -> Column:
        body = permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("card"), key)
        return _let(body, lambda b: _let(F.concat(b, F.lit("0")), lambda open_: F.concat(
            b, F.pmod(10 - F.pmod(_luhn_sum(open_), F.lit(10)), F.lit(10)).cast("string"))))

    return _let(_digits(value), lambda digits: F.when(
        _luhn_sum(digits) % 10 == 0, _filled(value, renumbered(digits))))


def _card_places(groups: Column) -> Column:
    """First group and group after the last of every card in a run."""
    place = "array<struct<start:int,end:int>>"

    def ends(start: Column, near: Column) -> Column:
        """Ends of the stretches of 13 to 19 digits, the longest first."""
        fitting = F.filter(F.sequence(F.size(near), F.lit(1), F.lit(-1)), lambda k: F.length(_digits(
            F.array_join(F.slice(near, F.lit(1), k), ""))).between(13, 19))
        right = F.filter(fitting, lambda k: _let(
            _digits(F.array_join(F.slice(near, F.lit(1), k), "")), lambda digits: _luhn_sum(digits) % 10 == 0))
        return start + F.get(right, F.lit(0))

    def step(found: Column, start: Column) -> Column:
        behind = F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(0))
        longest = _let(F.slice(groups, start + 1, F.lit(19)), lambda near: ends(start, near))
        return F.when(start < behind, found).otherwise(_let(longest, lambda end: F.when(end.isNull(), found).otherwise(
            F.concat(found, F.array(F.struct(start.alias("start"), end.alias("end"))).cast(place)))))

    return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), F.array().cast(place), step)


def _cards_apart(run: Column) -> Column:
    """``gap, value`` of every card in a run, and what follows the last one with a null value."""
    def joined(groups: Column, start: Column, end: Column) -> Column:
        return F.array_join(F.slice(groups, start + 1, end - start), " ")

    def cut(groups: Column, places: Column) -> Column:
        def before(start: Column, i: Column) -> Column:
            last = F.coalesce(F.get(places, i - 1)["end"], F.lit(0))
            return F.when(start > last, F.concat(F.when(last > 0, F.lit(" ")).otherwise(F.lit("")),
                                                 joined(groups, last, start), F.lit(" "))).otherwise(
                F.when(last > 0, F.lit(" ")).otherwise(F.lit("")))

        cards = F.transform(places, lambda p, i: F.struct(
            before(p["start"], i).alias("gap"), joined(groups, p["start"], p["end"]).alias("value")))
        last = F.coalesce(F.get(places, F.size(places) - 1)["end"], F.lit(0))
        rest = F.when(last < F.size(groups), F.concat(
            F.when(last > 0, F.lit(" ")).otherwise(F.lit("")), joined(groups, last, F.size(groups)))).otherwise(F.lit(""))
        return F.concat(cards, F.array(F.struct(rest.alias("gap"), F.lit(None).cast("string").alias("value"))))

    return _let(F.split(run, " "), lambda groups: _let(_card_places(groups), lambda places: cut(groups, places)))


def _phone(value: Column, key: str) -> Column:
    """The country code stays."""
    prefix = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(value, F.length(prefix) + 1)
    return F.concat(prefix, _let(rest, lambda r: _filled(r, permuted_text(_digits(r), F.lit("phone"), key))))


def _ssn(value: Column, key: str) -> Column:
    issued = value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.when(issued, _filled(value, permuted_text(_digits(value), F.lit("ssn"), key)))


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    new = permuted_number(number, 65536, F.lit("ip"), key)
    steps = F.lit([16777216, 65536, 256, 1])
    text = _let(new, lambda n: F.array_join(
        F.transform(steps, lambda s: F.pmod(F.floor(n / s), F.lit(256)).cast("string")), "."))
    return F.when(~F.exists(octets, lambda o: o > 255), text)


def _date(value: Column, key: str) -> Column:
    def form(pattern: str) -> Column:
        def renamed(days: Column) -> Column:
            new = permuted_number(days, DATE_SIDE, F.lit("date"), key).cast("int") - DATE_BASE
            return F.when((days >= 0) & (days < DATE_SIDE**2), F.date_format(F.date_from_unix_date(new), pattern))

        return _let(F.unix_date(F.try_to_timestamp(value, F.lit(pattern)).cast("date")) + DATE_BASE, renamed)

    return (
        F.when(F.contains(value, F.lit("-")), form("yyyy-MM-dd"))
        .when(F.contains(value, F.lit(".")), form("dd.MM.yyyy"))
        .otherwise(form("MM/dd/yyyy"))
    )


def _email(value: Column, key: str) -> Column:
    """The domain stays."""
    at = F.instr(value, "@")
    local = permuted_text(F.substr(value, F.lit(1), at - 1), F.lit("email"), key)
    return F.concat(local, F.substr(value, at))


def _token(value: Column, key: str) -> Column:
    """The name before the value stays; hexadecimal values stay hexadecimal."""
    def renamed(secret: Column) -> Column:
        plain = permuted_text(secret, F.lit("token"), key)
        hexadecimal = permuted_text(secret, F.lit("token"), key, letters=6)
        name = F.substr(value, F.lit(1), F.length(value) - F.length(secret))
        return F.concat(name, F.when(secret.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), hexadecimal).otherwise(plain))

    return _let(F.regexp_extract(value, "[A-Za-z0-9_-]{16,128}$", 0), renamed)


MAKERS = {"email": _email, "token": _token, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(value: Column) -> Column:
    whole = [(kind, value.rlike(f"^(?:{pattern})$")) for kind, pattern in PATTERNS.items()]
    return reduce(lambda rest, k: F.when(k[1], F.lit(k[0])).otherwise(rest), reversed(whole), F.lit(None).cast("string"))


def _pseudonym(kind: Column, value: Column, key: str) -> Column:
    """The pseudonym, or null where the value fails its validation."""
    made = [(k, MAKERS[k](value, key)) for k in KINDS]
    return reduce(lambda rest, k: F.when(kind == k[0], k[1]).otherwise(rest), reversed(made), F.lit(None).cast("string"))


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its ``text`` rewritten and ``found``: kind, value and pseudonym of every replacement.

    ``found`` is in text order and is meant for checks; drop it before the result leaves a safe place.
    """
    names = [c for c in docs.columns if c not in ("text", "found")]
    rows = docs.select(F.struct(*names).alias("record"), F.col("text").cast("string").alias("text"))
    likely = F.col("text").rlike("[0-9@=:]")
    rows = rows.withColumn("values", F.when(likely, F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(0))))
    rows = rows.withColumn("kinds", F.transform("values", kind_of))
    whole = lambda v: F.array(F.struct(F.lit("").alias("gap"), v["values"].alias("value")))
    parts = F.transform(
        F.arrays_zip("values", "kinds"),
        lambda v: F.transform(
            F.when(v["kinds"] == "card", _cards_apart(v["values"])).otherwise(whole(v)),
            lambda p: F.struct(p["gap"].alias("gap"), p["value"].alias("value"),
                               F.when(p["value"].isNotNull(), v["kinds"]).alias("kind")),
        ),
    )
    rows = rows.withColumn("parts", F.when(F.size("values") > 0, parts))
    new = F.transform("parts", lambda found: F.transform(found, lambda p: F.struct(
        p["kind"].alias("kind"), p["value"].alias("value"), p["gap"].alias("gap"),
        _let(p["value"], lambda value: _pseudonym(p["kind"], value, key)).alias("pseudonym"))))
    rows = rows.withColumn("runs", new)
    put = F.transform("runs", lambda run: F.array_join(F.transform(run, lambda t: F.concat(
        t["gap"], F.coalesce(t["pseudonym"], t["value"], F.lit("")))), ""))
    rows = rows.withColumn("tried", F.transform(F.flatten("runs"), lambda t: F.struct(
        t["kind"].alias("kind"), t["value"].alias("value"), t["pseudonym"].alias("pseudonym"))))
    gaps = F.split("text", ANY, -1)
    pieces = F.transform(
        F.arrays_zip(gaps.alias("gap"), put.alias("put")),
        lambda p: F.concat(p["gap"], F.coalesce(p["put"], F.lit(""))),
    )
    changed = F.exists("tried", lambda t: t["pseudonym"].isNotNull())
    text = F.when(changed, F.array_join(pieces, "")).otherwise(F.col("text"))
    nothing = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    found = F.coalesce(F.filter("tried", lambda t: t["pseudonym"].isNotNull()), nothing)
    return rows.select("record.*", text.alias("text"), found.alias("found"))


def found_counts(found: Column) -> list[Column]:
    """Number of replacements by kind."""
    def of(kind: str) -> Column:
        return F.size(F.filter(found, lambda f: f["kind"] == kind)).alias(f"n_{kind}")

    return [of(kind) for kind in KINDS]
