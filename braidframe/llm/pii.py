"""Personal data as format-preserving pseudonyms, in DataFrame expressions only.

Numbers and dates that pass validation are permuted, under a key, within their own format by a Feistel network whose two halves
have exact moduli, so the permutation is a bijection of the valid values: equal values stay equal (and linked across documents),
different ones stay different, and a valid value stays valid. Kinds:

* ``card``: 13 to 19 digits that pass the Luhn check, plain or in groups; all digits but the last are permuted, the last is the new check digit;
* ``phone``: ten digits in North American grouping, with or without a leading 1; the first digits of area and exchange stay 2 to 9
  where they are (and 0 or 1 where they are that), so a valid number stays valid;
* ``abroad``: 8 to 15 digits in groups after a plus sign and another country's code, whose digits stay;
* ``ip``: dotted quads of octets up to 255;
* ``ssn``: three-two-four digits with a valid area, group and serial;
* ``date``: YYYY-MM-DD and DD/MM/YYYY from the year 400 on that exist in the calendar, permuted within the 400-year cycle they lie in,
  the same in both forms; MM/DD/YYYY whose day is above 12, permuted among such dates;
* ``email``: letters among letters and digits among digits, but for the top-level domain; dots, signs, length and capitals stay;
* ``secret`` (hexadecimal after token, key, secret or password): hexadecimal digits among hexadecimal digits, of any length.

Addresses that differ in capitals alone are one value. Anything else is left as it is. Separators, brackets, capitals and length are
kept. As in any permutation, a value may chance to map to itself.

Defined results: null text stays null with no findings in :func:`pseudonymised`; empty text stays empty; a text of any length is
searched whole; ties and repeated rows get equal results; an empty table gives an empty result; further columns pass through
:func:`pseudonymised` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

DEFAULT_KEY = "braidframe-pseudonym-key"
ROUNDS = 8
KINDS = ("email", "secret", "ip", "phone", "abroad", "card", "ssn", "date")

#: Every candidate holds a digit or an at sign, or is a long run of hexadecimal letters; other texts are left unsearched.
MAYBE = r"[0-9@]|[A-Fa-f]{16}"

#: The usual groups of 19, 16, 14 or 15 and 13 digits.
GROUPED_CARD = r"(?:\d{4}[ \-]){4}\d{3}|(?:\d{4}[ \-]){3}\d{4}|\d{4}[ \-]\d{6}[ \-]\d{4,5}|\d{4}(?:[ \-]\d{3}){3}"

#: The candidates, in the order in which they are tried at a place.
PATTERN = (
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
    r"|(?=[0-9A-Fa-f]{16})(?<=(?i:token|secret|password|passwd|key)[ ]{0,3}[=:][ ]{0,3}[\"']?)[0-9A-Fa-f]{16,64}(?![0-9A-Za-z])"
    r"|(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
    r"|(?<![\w.+])\+(?!1[ .\-(\d])(?=(?:[ .\-]?\d){8,15}(?!\d))\d{1,3}(?:[ .\-]\d{2,5}){2,4}(?!\w)"
    r"|(?<![\w.+])(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\w)"
    r"|(?<![\w])\d{4}-\d{2}-\d{2}(?!\w)|(?<![\w])\d{2}/\d{2}/\d{4}(?!\w)"
    r"|(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
    r"|(?<!\d)(?:" + GROUPED_CARD + r")(?!\d)|(?<!\d)\d{13,19}(?!\d)"
)

_DIGITS = "0123456789"
#: 146097 days are a Gregorian cycle of 400 years, and 189 times 773.
_CYCLE, _CYCLE_A, _CYCLE_B = 146_097, 189, 773


def _long(x: Column) -> Column:
    return x.cast("bigint")


def _power10(n: Column) -> Column:
    return F.get(F.array(*[F.lit(10**i).cast("bigint") for i in range(19)]), n)


def feistel(left: Column, right: Column, left_mod: Column, right_mod: Column, key: str, kind: str) -> Column:
    """struct(l, r): the keyed permutation of (left, right) in Z_left_mod x Z_right_mod."""

    def noise(i: Column, half: Column, mod: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), left_mod.cast("string"), right_mod.cast("string"), i.cast("string"), half.cast("string")), 256)
        return F.pmod(_long(F.conv(F.substring(digest, 1, 15), 16, 10)), mod)

    start = F.struct(_long(left).alias("l"), _long(right).alias("r"))
    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(
        rounds,
        start,
        lambda a, i: F.when(
            i % 2 == 0, F.struct(F.pmod(a["l"] + noise(i, a["r"], left_mod), left_mod).alias("l"), a["r"].alias("r"))
        ).otherwise(F.struct(a["l"].alias("l"), F.pmod(a["r"] + noise(i, a["l"], right_mod), right_mod).alias("r"))),
    )


def unfeistel(left: int, right: int, left_mod: int, right_mod: int, key: str, kind: str) -> tuple[int, int]:
    """The inverse of :func:`feistel`, for those who hold the key; plain Python, not part of any query."""
    import hashlib

    for i in reversed(range(ROUNDS)):
        half, mod = (right, left_mod) if i % 2 == 0 else (left, right_mod)
        f = int(hashlib.sha256("|".join(map(str, (key, kind, left_mod, right_mod, i, half))).encode()).hexdigest()[:15], 16) % mod
        if i % 2 == 0:
            left = (left - f) % left_mod
        else:
            right = (right - f) % right_mod
    return left, right


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""

    def whole(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        b = n - a
        moved = feistel(_long(F.substring(d, F.lit(1), a)), _long(F.substring(d, a + 1, b)), _power10(a), _power10(b), key, kind)
        return let(moved, lambda m: F.concat(F.lpad(m["l"].cast("string"), a, "0"), F.lpad(m["r"].cast("string"), b, "0")))

    return let(digits, whole)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counting once."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(_long(c) * F.when(i % 2 == 0, 1).otherwise(2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    step = lambda a, c: F.when(
        c.rlike(r"\d"), F.struct(F.concat(a["out"], F.substring(digits, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda a: a["out"])


def _card(m: Column, key: str) -> Column:
    def moved(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return let(_only_digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, _refill(m, moved(d))))


def _phone(m: Column, key: str) -> Column:
    def moved(d: Column) -> Column:
        """Ten digits, permuted among those whose area and exchange begin with a digit of the same class."""
        area, exchange, line = (_long(F.substring(d, F.lit(i), F.lit(n))) for i, n in ((1, 3), (4, 3), (7, 4)))
        valid = lambda x: x >= 200
        base = lambda x: F.when(valid(x), 200).otherwise(0)
        span = lambda x: F.when(valid(x), 800).otherwise(200).cast("bigint")
        left = (area - base(area)) * (span(exchange) / 10).cast("bigint") + F.floor((exchange - base(exchange)) / 10)
        right = (exchange - base(exchange)) % 10 * 10_000 + line
        out = feistel(left, right, span(area) * (span(exchange) / 10).cast("bigint"), F.lit(100_000).cast("bigint"), key, "phone")

        def shown(x: Column) -> Column:
            tens = (span(exchange) / 10).cast("bigint")
            a = F.floor(x["l"] / tens) + base(area)
            e = x["l"] % tens * 10 + F.floor(x["r"] / 10_000) + base(exchange)
            return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lpad(e.cast("string"), 3, "0"), F.lpad((x["r"] % 10_000).cast("string"), 4, "0"))

        return let(out, shown)

    return let(_only_digits(m), lambda x: _refill(m, F.concat(F.substring(x, F.lit(1), F.length(x) - 10), let(F.substring(x, F.length(x) - 9, F.lit(10)), moved))))


def _abroad(m: Column, key: str) -> Column:
    def whole(x: Column) -> Column:
        # the country's code is the first group, and a key of its own for the rest
        code = F.regexp_extract(m, r"^\+(\d{1,3})", 1)
        rest = F.substring(x, F.length(code) + 1, F.length(x))
        n = F.length(rest)
        a = F.floor(n / 2).cast("int")
        out = feistel(_long(F.substring(rest, F.lit(1), a)), _long(F.substring(rest, a + 1, n - a)), _power10(a), _power10(n - a), key, "abroad")
        return _refill(m, F.concat(code, let(out, lambda y: F.concat(F.lpad(y["l"].cast("string"), a, "0"), F.lpad(y["r"].cast("string"), n - a, "0")))))

    return let(_only_digits(m), whole)


def _ip(m: Column, key: str) -> Column:
    def whole(o: Column) -> Column:
        n = [_long(F.get(o, F.lit(i))) for i in range(4)]
        moved = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), key, "ip")
        part = lambda v: F.concat(F.shiftright(v, 8).cast("string"), F.lit("."), (v % 256).cast("string"))
        out = let(moved, lambda x: F.concat(part(x["l"]), F.lit("."), part(x["r"])))
        return F.when(F.forall(o, lambda v: _long(v) < 256), out)

    return let(F.split(m, r"\."), whole)


def _ssn(m: Column, key: str) -> Column:
    def whole(p: Column) -> Column:
        area, group, serial = (_long(F.get(p, F.lit(i))) for i in range(3))
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        rank = area - F.when(area > 666, 2).otherwise(1)
        moved = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), key, "ssn")

        def shown(x: Column) -> Column:
            r = F.floor(x["l"] / 99)
            a = r + F.when(r >= 665, 2).otherwise(1)
            return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

        return F.when(valid, let(moved, shown))

    return let(F.split(m, "-"), whole)


#: Steps after which a walk through dates gives up; two in five of them end it at each.
_WALK = 60


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^\\d{4}-")
    start = F.to_date(F.lit("2000-01-01"))

    def parsed(y: Column, mo: Column, d: Column) -> Column:
        return F.to_date(F.try_to_timestamp(F.concat_ws("-", y, mo, d), F.lit("yyyy-MM-dd")))

    first, second, last = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
    day_first = F.when(iso, parsed(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))).otherwise(parsed(last, second, first))

    def step(day: Column, kind: str) -> Column:
        n = F.datediff(day, start).cast("bigint")
        era = F.floor(n / _CYCLE).cast("bigint")
        at = F.pmod(n, F.lit(_CYCLE))
        moved = feistel(F.floor(at / _CYCLE_B), at % _CYCLE_B, F.lit(_CYCLE_A).cast("bigint"), F.lit(_CYCLE_B).cast("bigint"), key, kind)
        return let(moved, lambda x: F.date_add(start, (era * _CYCLE + x["l"] * _CYCLE_B + x["r"]).cast("int")))

    def whole(day: Column) -> Column:
        out = let(step(day, "date"), lambda x: F.when(iso, F.date_format(x, "yyyy-MM-dd")).otherwise(F.date_format(x, "dd/MM/yyyy")))
        return F.when(F.year(day) >= 400, out)

    def month_first(day: Column) -> Column:
        # the permutation is walked on until the day is above 12 again, which permutes such dates
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), step(day, "us"), lambda x, _: F.when(F.dayofmonth(x) > 12, x).otherwise(let(x, lambda v: step(v, "us"))))
        return F.when((F.year(day) >= 400) & (F.dayofmonth(day) > 12), let(walk, lambda x: F.when(F.dayofmonth(x) > 12, F.date_format(x, "MM/dd/yyyy"))))

    return F.coalesce(let(day_first, whole), F.when(~iso, let(parsed(last, first, second), month_first)))


def permute_characters(text: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """Lower-case ``text`` with its letters permuted among letters and its digits among digits (or all as hexadecimal digits), the
    rest in place: a Feistel network over the two halves of those characters, each added to by place, so different texts stay different."""
    digits = "0123456789abcdef" if hexadecimal else "0123456789"

    def whole(chars: Column) -> Column:
        slots = F.filter(chars, lambda c: c.rlike("^[0-9a-f]$" if hexadecimal else "^[0-9a-z]$"))
        shape = F.concat_ws("", F.transform(chars, lambda c: F.when(c.rlike("^[0-9]$"), "0").when(c.rlike("^[a-z]$"), "a").otherwise(c))) if not hexadecimal else F.lit("")

        def added(half: Column, by: Column, i: Column) -> Column:
            def one(c: Column, j: Column) -> Column:
                noise = _long(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), shape, i.cast("string"), j.cast("string"), F.concat_ws("", by)), 256), 1, 12), 16, 10))
                is_digit = F.lit(True) if hexadecimal else c.rlike("^[0-9]$")
                letters = "abcdefghijklmnopqrstuvwxyz"
                turn = lambda alphabet: F.substring(F.lit(alphabet), (F.pmod(_long(F.instr(F.lit(alphabet), c)) - 1 + noise, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
                return F.when(is_digit, turn(digits)).otherwise(turn(letters))

            return F.transform(half, one)

        def rounds(s: Column) -> Column:
            a = F.floor(F.size(s) / 2).cast("int")
            begin = F.struct(F.slice(s, F.lit(1), a).alias("l"), F.slice(s, a + 1, F.size(s)).alias("r"))
            step = lambda x, i: F.when(i % 2 == 0, F.struct(added(x["l"], x["r"], i).alias("l"), x["r"].alias("r"))).otherwise(F.struct(x["l"].alias("l"), added(x["r"], x["l"], i).alias("r")))
            return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), begin, step, lambda x: F.concat(x["l"], x["r"]))

        def filled(new: Column) -> Column:
            step = lambda x, c: F.when(
                c.rlike("^[0-9a-f]$" if hexadecimal else "^[0-9a-z]$"), F.struct(F.concat(x["out"], F.get(new, x["at"])).alias("out"), (x["at"] + 1).alias("at"))
            ).otherwise(F.struct(F.concat(x["out"], c).alias("out"), x["at"].alias("at")))
            return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda x: x["out"])

        return let(let(slots, rounds), filled)

    return let(F.split(text, ""), whole)


def _capitals_of(shape: Column, text: Column) -> Column:
    """``text`` with capitals where ``shape``, of the same length, has them."""
    pairs = F.zip_with(F.split(shape, ""), F.split(text, ""), lambda a, b: F.when(a.rlike("^[A-Z]$"), F.upper(b)).otherwise(b))
    return F.array_join(pairs, "")


def _email(m: Column, key: str) -> Column:
    top = F.substring_index(m, ".", -1)

    def whole(t: Column) -> Column:
        body = F.substring(m, F.lit(1), F.length(m) - F.length(t) - 1)
        return let(body, lambda b: F.concat(_capitals_of(b, permute_characters(F.lower(b), key, "email")), F.lit("."), t))

    return let(top, whole)


def _secret(m: Column, key: str) -> Column:
    return _capitals_of_hex(m, permute_characters(F.lower(m), key, "secret", hexadecimal=True))


def _capitals_of_hex(shape: Column, text: Column) -> Column:
    """All capitals if ``shape`` has no small letter."""
    return F.when(shape == F.upper(shape), F.upper(text)).otherwise(text)


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), "date")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(f"^({GROUPED_CARD})$"), "card").when(m.rlike(r"^\+(?!1[ .\-(\d])"), "abroad").when(m.rlike(r"^(\+?1[ .\-]?)?(\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}$"), "phone")
    )


def replacements(text: Column, key: str = DEFAULT_KEY) -> Column:
    """array<struct<old, kind, new>> of the candidates in ``text``, in order; kind and new are null where validation fails."""

    def one(m: Column, before: Column) -> Column:
        # plain runs of digits are cards unless a secret's name stands before them, which the gap's end shows
        named = before.rlike(r"(?i)(token|secret|password|passwd|key)[ ]{0,3}[=:][ ]{0,3}[\"']?$") & m.rlike(r"^[0-9A-Fa-f]{16,64}$")
        kind = F.when(named, "secret").otherwise(F.coalesce(_kind(m), F.when(m.rlike(r"^\d+$"), "card")))
        makers: dict[str, Callable[[Column, str], Column]] = {"email": _email, "secret": _secret, "ip": _ip, "phone": _phone, "abroad": _abroad, "card": _card, "ssn": _ssn, "date": _date}

        def made(k: Column) -> Column:
            new = F.lit(None).cast("string")
            for name, make in makers.items():
                new = F.when(k == name, make(m, key)).otherwise(new)
            return let(new, lambda v: F.struct(m.alias("old"), F.when(v.isNotNull(), k).alias("kind"), v.alias("new")))

        return let(kind, made)

    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    gaps = F.split(text, PATTERN, -1)
    some = lambda f: F.when(F.size(f) > 0, let(gaps, lambda g: F.transform(f, lambda m, i: let(m, lambda x: one(x, F.get(g, i))))))
    return F.when(text.rlike(MAYBE), let(found, some))


def pseudonymised(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text", out: str | None = None) -> DataFrame:
    """``docs`` with the personal data in column ``text`` replaced, and an array column ``out`` of the kinds that were, if it is named."""
    t = docs[text]

    def rebuilt(r: Column) -> Column:
        gaps = F.split(t, PATTERN, -1)
        pieces = let(gaps, lambda g: F.transform(g, lambda x, i: F.concat(x, F.coalesce(F.get(r, i)["new"], F.get(r, i)["old"], F.lit("")))))
        return F.struct(F.array_join(pieces, "").alias("text"), F.array_compact(F.transform(r, lambda x: x["kind"])).alias("kinds"))

    same = F.struct(t.alias("text"), F.array().cast("array<string>").alias("kinds"))
    made = let(replacements(t, key), lambda r: F.when(r.isNull(), same).otherwise(rebuilt(r)))
    # one struct beside the row, so that no name of the input can clash
    pair = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), made.alias("made")) if len(docs.columns) > 1 else docs.select(made.alias("made"))
    columns = [F.col("made.text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return pair.select(*columns, *([F.col("made.kinds").alias(out)] if out else []))


def findings(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """doc_id, the pseudonymised text and the number of replacements, in all and by kind."""
    d = pseudonymised(docs.select("doc_id", "text"), key, out="kinds")

    def count(kind: str) -> Column:
        return F.size(F.filter("kinds", lambda x: x == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), *[count(k) for k in KINDS])
