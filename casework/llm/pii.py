"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

A value that passes the check of its kind (a checksum, a calendar, a range) is mapped to another
value of the same format that passes it as well. The mapping is a permutation that depends on the
key and the kind only, so equal values stay equal across documents, however they are punctuated,
different ones stay different, and who has the key can undo it. Everything is column work.

Kinds: e-mail addresses (all but the last label), IPv4 addresses, payment card numbers (Luhn),
IBANs (mod 97), US social security numbers, dates (1900-01-01 to 2100-05-01), phone numbers and
quoted credentials. Digit runs that pass no check are left alone.
"""

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: First day and number of days of the date domain, as the product of its two halves.
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), (270, 271)

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
SSN = r"(?<![\w.\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
DATE = (
    r"(?<![\w\-/])(?<!\d\.)(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})"
    r"(?!\d|[\-/.]\d)"
)
IP = r"(?<!\w)(?<!\w\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
CARD = r"(?<!\w)(?<!\w[.,])(?:\d{13,19}|\d{4}(?<gap>[ \-])\d{4}\k<gap>\d{4}\k<gap>\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\w|[.,]\d)"
PHONE = (
    r"(?<![\w+])(?<!\w[.\-])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}"
    r"|\d{3}(?<dot>[.\-])\d{3}\k<dot>\d{4})(?!\w|[.\-]\d)"
)
SECRET = r"(?<!\w)(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\s{0,4}[=:]\s{0,4}\x22[^\x22\s]{8,256}\x22"
PATTERN = "|".join((EMAIL, IBAN, SSN, DATE, IP, CARD, PHONE, SECRET))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(text: Column) -> Column:
    return F.try_to_number(text, F.lit("9" * 18)).cast("long")


def _prf(key: str, kind: str, turn: Column, value: Column) -> Column:
    """64 hexadecimal digits that depend on the key and everything else."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)


def _hex(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _turns(undo: bool) -> Column:
    return F.array(*map(F.lit, range(ROUNDS)[::-1] if undo else range(ROUNDS)))


def permuted(value: Column, size: tuple, key: str, kind: str, undo: bool = False) -> Column:
    """A number below ``size[0] * size[1]`` under a keyed permutation of these numbers."""
    u, v = size
    sign = -1 if undo else 1

    def step(s, turn):
        drift = lambda x: _hex(F.substring(_prf(key, kind, turn, x), 1, 12))
        a = F.when(turn % 2 == 0, F.pmod(s["a"] + sign * drift(s["b"]), F.lit(u))).otherwise(s["a"])
        b = F.when(turn % 2 == 1, F.pmod(s["b"] + sign * drift(s["a"]), F.lit(v))).otherwise(s["b"])
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    start = F.struct(F.floor(value / v).cast("long").alias("a"), F.pmod(value, F.lit(v)).cast("long").alias("b"))
    return F.aggregate(_turns(undo), start, step, lambda s: s["a"] * v + s["b"])


#: Classes of characters that a pseudonym keeps, by format: first character and size.
CLASSES = {
    "digits": (("0", 10),),
    "phone": (("0", 2), ("2", 8)),  # an area code never begins with 0 or 1
    "word": (("0", 10), ("a", 26), ("A", 26)),
    "hex": (("0", 10), ("a", 6), ("A", 6)),
}


def _shift(text: Column, stream: Column, classes, sign: int) -> Column:
    """Every character moved within its class by its part of the stream."""
    def moved(stream):
        def one(c, i):
            by = _hex(F.substr(stream, (2 * F.pmod(i, F.lit(31)) + 1).cast("int"), F.lit(2)))
            out = c
            for first, size in classes:
                base = ord(first)
                code = F.pmod(F.ascii(c) - base + sign * by, F.lit(size)) + base
                out = F.when(c.between(first, chr(base + size - 1)), F.char(code.cast("long"))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return _let(stream, moved)


def scrambled(text: Column, form: str, key: str, kind: str, undo: bool = False) -> Column:
    """A text under a keyed permutation of the texts with the same characters' classes."""
    classes, sign = CLASSES[form], -1 if undo else 1

    def step(s, turn):
        if undo:
            a, b = _shift(s["b"], _prf(key, kind, turn, s["a"]), classes, sign), s["a"]
        else:
            a, b = s["b"], _shift(s["a"], _prf(key, kind, turn, s["b"]), classes, sign)
        return F.struct(a.alias("a"), b.alias("b"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))
    return F.aggregate(_turns(undo), start, step, lambda s: F.concat(s["a"], s["b"]))


def _refilled(form: Column, new: Column) -> Column:
    """The letters and digits of ``new`` in the places of those of ``form``, which keeps the rest."""
    def step(s, c):
        own = c.rlike("[A-Za-z0-9]")
        return F.struct(
            F.concat(s["out"], F.when(own, F.substr(new, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(own, 1).otherwise(0)).cast("int").alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(1).cast("int").alias("at"))
    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def _luhn(payload: Column) -> Column:
    """Check digit of a card number without it."""
    def weighed(c, i):
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(payload), ""), weighed), F.lit(0), lambda s, d: s + d)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    def step(r, c):
        code = F.ascii(c)
        return F.when(c.between("0", "9"), (r * 10 + code - 48) % 97).otherwise((r * 100 + code - 55) % 97).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0).cast("int"), step)


def _card(m, key, undo):
    digits = F.regexp_replace(m, "[^0-9]", "")
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = _let(scrambled(payload, "digits", key, "card", undo), lambda p: F.concat(p, _luhn(p)))
    valid = (_luhn(payload) == F.right(digits, F.lit(1))) & F.regexp_replace(digits, "0", "").rlike(".")
    return F.when(valid, _refilled(m, new)).otherwise(m)


def _iban(m, key, undo):
    bare = F.regexp_replace(m, " ", "")
    land, own = F.substring(bare, 1, 2), F.substr(bare, F.lit(5))
    valid = _mod97(F.concat(own, F.substring(bare, 1, 4))) == 1
    new = _let(scrambled(own, "word", key, "iban", undo), lambda x: F.concat(
        land, F.lpad((98 - _mod97(F.concat(x, land, F.lit("00")))).cast("string"), 2, "0"), x
    ))
    return F.when(valid, _refilled(m, new)).otherwise(m)


def _ip(m, key, undo):
    parts = F.transform(F.split(m, r"\."), lambda x: _number(x))
    valid = F.forall(parts, lambda x: x <= 255) & ~m.rlike(r"(?:^|\.)0\d")
    whole = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = _let(permuted(whole, (65536, 65536), key, "ip", undo), lambda x: F.concat_ws(
        ".", *[F.pmod(F.shiftright(x, 8 * i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)]
    ))
    return F.when(valid, new).otherwise(m)


def _ssn(m, key, undo):
    area, group, serial = (_number(F.substring(m, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    whole = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def shown(x):
        area = F.floor(x / (99 * 9999)) + 1
        return F.format_string(
            "%03d-%02d-%04d", F.when(area >= 666, area + 1).otherwise(area),
            F.floor(x / 9999) % 99 + 1, x % 9999 + 1,
        )

    return F.when(valid, _let(permuted(whole, (898 * 99, 9999), key, "ssn", undo), shown)).otherwise(m)


def _date(m, key, undo):
    part = [F.regexp_extract(m, r"^(\d+)(\D)(\d+)\D(\d+)$", i) for i in (1, 2, 3, 4)]
    a, mark, b, c = part
    day = lambda y, m_, d: F.try_to_timestamp(F.concat_ws("-", y, m_, d), F.lit("yyyy-M-d")).cast("date")
    year_first = F.length(a) == 4
    # 1/2/2003 is the second of January; a first number beyond 12 is a day.
    month_first = ~year_first & (mark == "/") & day(c, a, b).isNotNull()
    value = F.when(year_first, day(a, b, c)).when(month_first, day(c, a, b)).otherwise(day(c, b, a))
    place = F.datediff(value, F.lit(FIRST_DAY)).cast("long")
    valid = F.coalesce(place.between(0, DAYS[0] * DAYS[1] - 1), F.lit(False))
    padded = F.length(m) == 10

    def shown(x):
        new = F.date_add(F.lit(FIRST_DAY), x.cast("int"))
        two = lambda n: F.when(padded, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
        y, m_, d = F.year(new).cast("string"), two(F.month(new)), two(F.dayofmonth(new))
        return F.when(year_first, F.concat(y, mark, m_, mark, d)).when(
            month_first, F.concat(m_, mark, d, mark, y)
        ).otherwise(F.concat(d, mark, m_, mark, y))

    return F.when(valid, _let(permuted(place, DAYS, key, "date", undo), shown)).otherwise(m)


def _phone(m, key, undo):
    digits = F.regexp_replace(m, "[^0-9]", "")
    tail = F.least(F.lit(10), F.length(digits) - F.when(m.startswith("+"), 1).otherwise(0))
    new = F.concat(
        F.substr(digits, F.lit(1), F.length(digits) - tail),
        scrambled(F.right(digits, tail), "phone", key, "phone", undo),
    )
    return F.when(F.length(digits).between(8, 15), _refilled(m, new)).otherwise(m)


def _email(m, key, undo):
    last = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    return F.concat(scrambled(F.substr(m, F.lit(1), F.length(m) - F.length(last)), "word", key, "email", undo), last)


def _secret(m, key, undo):
    head, value = F.regexp_extract(m, r"^[^\x22]*\x22", 0), F.regexp_extract(m, r"\x22([^\x22]*)\x22$", 1)
    new = F.when(value.rlike("^[0-9a-fA-F]+$"), scrambled(value, "hex", key, "secret", undo)).otherwise(
        scrambled(value, "word", key, "secret", undo)
    )
    return F.concat(head, new, F.lit('"'))


def pseudonym(found: Column, key: str, undo: bool = False) -> Column:
    """What stands for one match of PATTERN; matches that fail the check of their kind stay."""
    kinds = ((SECRET, _secret), (EMAIL, _email), (IBAN, _iban), (SSN, _ssn), (DATE, _date), (IP, _ip))
    out = F.when(found.rlike(r"^[0-9][0-9 \-]*$") & ~found.rlike(r"^\d{3}-\d{3}-\d{4}$"), _card(found, key, undo)).otherwise(_phone(found, key, undo))
    for pattern, f in reversed(kinds):
        out = F.when(found.rlike("^(?:" + pattern + ")$"), f(found, key, undo)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pseudonyms", undo: bool = False) -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; ``count_col`` counts what was.

    ``undo`` with the same key brings the first texts back; only in dates written without leading
    zeros, or with slashes and the day first (read so where the month can't come first), it may
    bring the same date back in the other style. Null texts stay null (count 0), empty
    ones empty. Texts that hold nothing of the kinds above come back unchanged. Rows do not
    depend on each other; a column named like ``count_col`` is replaced.
    """
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    around = F.split(text, PATTERN, -1)
    docs = docs.select(*[c for c in docs.columns if count_col is None or c.lower() != count_col.lower()])

    def rebuilt(found):
        return _let(F.transform(found, lambda m: pseudonym(m, key, undo)), lambda new: F.struct(
            F.array_join(F.zip_with(around, new, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "").alias("text"),
            F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)).cast("long").alias("n"),
        ))

    some = F.when(text.rlike("[0-9@\x22]"), _let(found, lambda f: F.when(F.size(f) > 0, rebuilt(f))))
    row, done = F.col("_row"), F.col("_done")
    columns = [F.coalesce(done["text"], row[c]).alias(c) if c == text_col else row[c].alias(c) for c in docs.columns]
    if count_col:
        columns.append(F.coalesce(done["n"], F.lit(0)).cast("long").alias(count_col))
    return docs.select(F.struct("*").alias("_row"), some.alias("_done")).select(*columns)
