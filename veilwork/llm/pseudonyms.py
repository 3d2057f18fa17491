"""Format-preserving pseudonyms for personal data, without user functions.

Validated values are replaced by values of the same format: a keyed Feistel network
permutes each format's own domain, so a pseudonym is again a valid value, different
values get different pseudonyms, and equal values stay linked across documents, in
whatever way their separators are written.  A domain is a pair of numbers below
``a`` and ``b``; rounds add a keyed hash of one number to the other, by turns.

| kind  | validated by                                  | permuted                                  |
|-------|-----------------------------------------------|-------------------------------------------|
| email | local part, ``@``, two or more labels         | letters and digits of the local part      |
| ip    | four numbers up to 255                        | both halves of the address                |
| date  | a calendar day of 1900-2099 (``2024-02-28``,  | the day among these days                  |
|       | ``28.02.2024``, ``02/28/2024``, ``28/02/2024``)|                                          |
| ssn   | area, group and serial that can be assigned   | (area, group) and serial                  |
| phone | ten digits, ``+`` and country code in front   | the ten digits                            |
|       | or area and exchange from 200 on, grouped 3-3-4| area, exchange and line                  |
| iban  | country, check digits that are right (mod 97) | the digits of the account; check digits   |
| card  | 13 to 19 digits with a right Luhn digit       | all but the last; that is computed anew   |

Other numbers that stand beside a card number, as its check value or date, stay as they are: of the
whole groups of digits, those are the card that have a right Luhn digit; groups written in
the usual way win, then longer ones.

A date with slashes is month first if that is a day, and else day first; those that can only be day
first are permuted among themselves, so no two dates get one text.  A phone number without
a country code is linked with others without, not with the international form.

What does not validate stays as it is.  The key is a secret of the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.text import held, whole

ROUNDS = 10

# Kind and shape, tried in this order at each place.  Starts are possible at the
# beginning of a run only, so that long runs of letters or digits stay linear.
SHAPES = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("date", r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])"
             r"|(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])|(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9]|/[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}[ -]?(?:\([0-9]{3}\)|[0-9]{3})[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9])"
              r"|(?<![0-9+.(-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-. ])[2-9][0-9]{2}[-. ][0-9]{4}(?![0-9]|[-.][0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
)
# Cards as they are printed, with spaces for separators.
_USUAL = r"^(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{4,5})$"
KINDS = tuple(kind for kind, _ in SHAPES)
PATTERN = "|".join(shape for _, shape in SHAPES)

# The days from 1900-01-01 to 2099-12-31 are 319 * 229.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 319, 229
# So many steps a day-first date walks at most; that none of them fits is less likely than 1e-25.
STEPS = 64
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(key: str, tweak: str, *parts: Column) -> Column:
    """60 keyed bits of the parts as a number."""
    told = F.concat_ws("|", F.lit(key), F.lit(tweak), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("long")


def permuted(key: str, tweak: str, left: Column, a, right: Column, b) -> Column:
    """The pair (left below ``a``, right below ``b``) permuted; a struct of x and y."""
    a, b = (v if isinstance(v, Column) else F.lit(v).cast("long") for v in (a, b))

    def turn(state: Column, step: Column) -> Column:
        x, y = state.getField("x"), state.getField("y")
        even = step % 2 == 0
        return F.struct(
            F.when(even, (x + _hash(key, tweak, step, a, b, y) % a) % a).otherwise(x).alias("x"),
            F.when(even, y).otherwise((y + _hash(key, tweak, step, a, b, x) % b) % b).alias("y"),
        )

    start = F.struct(left.cast("long").alias("x"), right.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _padded(number: Column, width) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _put_back(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, one after the other, by ``digits``."""

    def place(state: Column, char: Column) -> Column:
        used, text = state.getField("used"), state.getField("text")
        digit = char.rlike("[0-9]")
        return F.struct(
            (used + digit.cast("int")).alias("used"),
            F.concat(text, F.when(digit, F.substring(state.getField("digits"), used + 1, F.lit(1))).otherwise(char)).alias("text"),
            state.getField("digits").alias("digits"),
        )

    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("text"), digits.alias("digits"))
    return F.aggregate(F.split(value, ""), start, place, lambda state: state.getField("text"))


def _number(digits: Column, start, width) -> Column:
    return F.substring(digits, F.lit(start) if isinstance(start, int) else start, F.lit(width) if isinstance(width, int) else width).cast("long")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of all digits, the last one counting once."""
    size = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), size), F.lit(0),
        lambda total, i: total + _let(
            F.substring(digits, i, F.lit(1)).cast("int") * F.when((size - i) % 2 == 1, F.lit(2)).otherwise(F.lit(1)),
            lambda v: v - F.when(v > 9, F.lit(9)).otherwise(F.lit(0)),
        ),
    )


def _one_card(key: str, value: Column) -> Column:
    def changed(digits: Column) -> Column:
        body = F.length(digits) - 1
        half = (body / F.lit(2)).cast("int")
        pair = permuted(
            key, "card", _number(digits, 1, half), F.pow(F.lit(10), half).cast("long"),
            _number(digits, half + 1, body - half), F.pow(F.lit(10), body - half).cast("long"),
        )
        moved = _let(pair, lambda p: F.concat(_padded(p.getField("x"), half), _padded(p.getField("y"), body - half)))
        checked = _let(moved, lambda m: F.concat(
            m, ((F.lit(10) - luhn_sum(F.concat(m, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(digits) % 10 == 0, _put_back(value, checked))

    return _let(_digits(value), changed)


def _card(key: str, value: Column) -> Column:
    """``value`` with the card among its groups of digits changed, or null."""

    def spans(group: Column) -> Column:
        last = F.size(group) - 1
        part = lambda i, j: F.slice(group, i + 1, j - i + 1)
        every = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(
            F.sequence(i, last), lambda j: F.struct(
                F.array_join(part(i, j), " ").rlike(_USUAL).alias("usual"),
                F.length(F.array_join(part(i, j), "")).alias("digits"),
                (-F.length(F.array_join(F.slice(group, 1, i), " ")) - F.when(i > 0, F.lit(1)).otherwise(F.lit(0))).alias("before"),
                F.array_join(part(i, j), "").alias("number"),
                F.length(F.array_join(part(i, j), " ")).alias("width"),
            ))))
        fitting = F.filter(every, lambda x: x.getField("digits").between(13, 19))
        return F.array_max(F.filter(fitting, lambda x: luhn_sum(x.getField("number")) % 10 == 0))

    def put(best: Column) -> Column:
        start, width = -best.getField("before"), best.getField("width")
        made = _one_card(key, F.substring(value, start + 1, width))
        return F.when(best.isNotNull(), F.concat(
            F.substring(value, F.lit(1), start), made, F.substring(value, start + width + 1, F.length(value))))

    return _let(_let(F.split(value, "[ -]"), spans), put)


def _phone(key: str, value: Column) -> Column:
    def international(digits: Column) -> Column:
        code = F.length(digits) - 10
        pair = permuted(key, "phone", _number(digits, code + 1, 5), 100_000, _number(digits, code + 6, 5), 100_000)
        moved = _let(pair, lambda p: F.concat(_padded(p.getField("x"), 5), _padded(p.getField("y"), 5)))
        return _put_back(value, F.concat(F.substring(digits, F.lit(1), code), moved))

    def national(digits: Column) -> Column:
        area, exchange = _number(digits, 1, 3) - 200, _number(digits, 4, 3) - 200
        pair = permuted(key, "national", area * 800 + exchange, 800 * 800, _number(digits, 7, 4), 10_000)
        return _put_back(value, _let(pair, lambda p: F.concat(
            (F.floor(p.getField("x") / 800) + 200).cast("string"), (p.getField("x") % 800 + 200).cast("string"),
            _padded(p.getField("y"), 4))))

    return _let(_digits(value), lambda d: F.when(F.startswith(value, F.lit("+")), international(d)).otherwise(national(d)))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of the number a text of digits and letters (A is 10) stands for."""
    def add(rest: Column, char: Column) -> Column:
        letter = F.instr(F.lit(LETTERS.upper()), char)
        return F.when(letter > 0, (rest * 100 + letter + 9) % 97).otherwise((rest * 10 + char.cast("long")) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), add)


def _iban(key: str, value: Column) -> Column:
    """Country and letters stay; the digits of the account are permuted and the check digits computed anew."""
    def changed(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

        def told(digits: Column) -> Column:
            half = (F.length(digits) / F.lit(2)).cast("int")
            rest = F.length(digits) - half
            pair = permuted(
                key, "iban", _number(digits, 1, half), F.pow(F.lit(10), half).cast("long"),
                _number(digits, half + 1, rest), F.pow(F.lit(10), rest).cast("long"),
            )
            moved = _let(pair, lambda p: F.concat(_padded(p.getField("x"), half), _padded(p.getField("y"), rest)))
            made = _put_back(account, moved)
            checked = _let(made, lambda m: F.concat(
                _padded(F.lit(98) - _mod97(F.concat(m, country, F.lit("00"))), 2), _digits(m)))
            return _put_back(value, checked)

        right = _mod97(F.concat(account, F.substring(plain, 1, 4))) == 1
        return F.when(right & plain.rlike("^.{15,34}$") & (F.length(_digits(account)) >= 6), _let(_digits(account), told))

    return _let(F.replace(value, F.lit(" "), F.lit("")), changed)


def _ssn(key: str, value: Column) -> Column:
    def changed(digits: Column) -> Column:
        area, group, serial = _number(digits, 1, 3), _number(digits, 4, 2), _number(digits, 6, 4)
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        place = area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))  # 898 areas
        pair = permuted(key, "ssn", place * 99 + group - 1, 898 * 99, serial - 1, 9999)

        def told(p: Column) -> Column:
            at = F.floor(p.getField("x") / 99)
            return F.concat(
                _padded(at + F.when(at >= 665, F.lit(2)).otherwise(F.lit(1)), 3),
                _padded(p.getField("x") % 99 + 1, 2), _padded(p.getField("y") + 1, 4),
            )

        return F.when(valid, _put_back(value, _let(pair, told)))

    return _let(_digits(value), changed)


def _ip(key: str, value: Column) -> Column:
    def changed(part: Column) -> Column:
        valid = F.forall(part, lambda p: p <= 255)
        pair = permuted(
            key, "ip", F.get(part, F.lit(0)) * 256 + F.get(part, F.lit(1)), 65536,
            F.get(part, F.lit(2)) * 256 + F.get(part, F.lit(3)), 65536,
        )
        told = _let(pair, lambda p: F.concat_ws(".", *[
            c.cast("string") for h in ("x", "y") for c in (F.floor(p.getField(h) / 256), p.getField(h) % 256)]))
        return F.when(valid, told)

    return _let(F.transform(F.split(value, r"\."), lambda p: p.cast("long")), changed)


def _moved_day(key: str, day: Column) -> Column:
    """A day of 1900 to 2099 permuted among these days; null for others."""
    place = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    pair = permuted(key, "date", F.floor(place / DAYS_B), DAYS_A, place % DAYS_B, DAYS_B)
    moved = _let(pair, lambda p: (p.getField("x") * DAYS_B + p.getField("y")).cast("int"))
    return F.when(place.between(0, DAYS_A * DAYS_B - 1), F.date_add(F.lit(FIRST_DAY).cast("date"), moved))


def _date(key: str, value: Column) -> Column:
    part = lambda *bounds: F.concat_ws("-", *[F.substring(value, a, n) for a, n in bounds]).try_cast("date")
    year, first, second = (7, 4), (1, 2), (4, 2)

    def day_first(day: Column) -> Column:
        # On until the day is over 12 again: a permutation of those days, of which three in five are such.
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(STEPS)), _moved_day(key, day),
            lambda at, _: F.when(F.dayofmonth(at) > 12, at).otherwise(_moved_day(key, at)),
        )
        return _let(walked, lambda d: F.when(F.dayofmonth(d) > 12, F.date_format(d, "dd/MM/yyyy")))

    def slashes(month_first: Column) -> Column:
        return F.when(month_first.isNotNull(), F.date_format(_moved_day(key, month_first), "MM/dd/yyyy")).otherwise(
            _let(part(year, second, first), day_first))

    return (
        F.when(F.contains(value, F.lit(".")), F.date_format(_moved_day(key, part(year, second, first)), "dd.MM.yyyy"))
        .when(F.contains(value, F.lit("/")), _let(part(year, first, second), slashes))
        .otherwise(_let(value.try_cast("date"), lambda day: _moved_day(key, day).cast("string")))
    )


def _added(half: Column, stream: Column) -> Column:
    """Every letter and digit moved within its alphabet by the numbers of the stream."""

    def moved(alphabet: str, char: Column, by: Column) -> Column:
        at = (F.instr(F.lit(alphabet), char) - 1 + by) % len(alphabet)
        return F.substring(F.lit(alphabet), at + 1, F.lit(1))

    def change(char: Column, i: Column) -> Column:
        # Two hex digits of the stream for each character; it repeats after 32.
        by = F.conv(F.substring(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return (
            F.when(char.rlike("[a-z]"), moved(LETTERS, char, by))
            .when(char.rlike("[A-Z]"), moved(LETTERS.upper(), char, by))
            .when(char.rlike("[0-9]"), moved("0123456789", char, by))
            .otherwise(char)
        )

    return F.array_join(F.transform(F.split(half, ""), change), "")


def _email(key: str, value: Column) -> Column:
    """The halves of the local part change each other by turns, letter by letter."""

    def turn(state: Column, step: Column) -> Column:
        x, y = state.getField("x"), state.getField("y")
        even = step % 2 == 0
        stream = F.sha2(F.concat_ws(
            "|", F.lit(key), F.lit("email"), step.cast("string"),
            F.length(x).cast("string"), F.length(y).cast("string"), F.lower(F.when(even, y).otherwise(x))), 256)
        return F.struct(
            F.when(even, _added(x, stream)).otherwise(x).alias("x"),
            F.when(even, y).otherwise(_added(y, stream)).alias("y"),
        )

    def changed(local: Column) -> Column:
        half = F.floor(F.length(local) / 2).cast("int")
        start = F.struct(
            F.substring(local, F.lit(1), half).alias("x"), F.substring(local, half + 1, F.length(local)).alias("y"))
        moved = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn,
                            lambda s: F.concat(s.getField("x"), s.getField("y")))
        return F.concat(moved, F.substring(value, F.length(local) + 1, F.length(value)))

    return _let(F.substring_index(value, "@", 1), changed)


_MAKE = {"email": _email, "ip": _ip, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _replaced(key: str, value: Column) -> Column:
    """(kind, text): the first kind whose shape and checks hold, else no kind and the value itself."""
    none = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"))
    result = none
    for kind, shape in reversed(SHAPES):
        made = _let(_MAKE[kind](key, value), lambda m: F.when(  # noqa: B023
            m.isNotNull(), F.struct(F.lit(kind).alias("kind"), m.alias("text"))))  # noqa: B023
        result = F.when(value.rlike(f"^(?:{shape})$"), F.coalesce(made, none)).otherwise(result)
    return result


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``row`` (the input row as a struct), ``text`` with pseudonyms, ``n_<kind>`` for each kind (long).

    A null text stays null with counts of 0, and an empty one empty.  Rows are changed one
    by one with the same key: repeated rows get equal results, and an empty table an
    empty result.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    given = F.col("row").getField(text)
    step = held(packed, ["row"], body=whole(given), missing=given.isNull())
    # Every value has a digit or an at sign; other texts are not searched.
    found = F.when(F.col("body").rlike("[0-9@]"), F.regexp_extract_all("body", F.lit(PATTERN), F.lit(0)))
    step = held(step, ["row", "body", "missing"], value=F.coalesce(found, F.expr("cast(array() as array<string>)")))
    step = held(step, ["row", "body", "missing"], made=F.transform("value", lambda v: _replaced(key, v)))
    pieces = F.when(F.size("made") > 0, F.split("body", PATTERN, -1)).otherwise(F.array("body"))
    step = held(step, ["row", "made", "missing"], piece=pieces)
    joined = F.array_join(
        F.zip_with("piece", "made", lambda p, m: F.concat(p, F.coalesce(m.getField("text"), F.lit("")))), ""
    )
    counts = [
        F.size(F.array_compact(F.transform("made", _is(kind)))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    told = F.when(~F.col("missing"), joined)
    return step.select("row", told.alias("text"), *counts)


def _is(kind: str):
    return lambda made: F.when(made.getField("kind") == kind, F.lit(1))
