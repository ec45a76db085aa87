"""PII: format-preserving Feistel pseudonyms.

Native: DataFrame functions only.  One regular expression finds candidates;
each is validated (cards by their check digit, dates by the calendar, addresses
by their octets), and its number is permuted by a keyed Feistel network within its own format.  Equal
values get equal pseudonyms in every document, and different values of one
format get different ones.

========  ======================================  ==================================
kind      found                                   permuted
========  ======================================  ==================================
card      13 to 19 digits, or 4-4-4-4 and 4-6-5   all but the last digit; the last is
          with spaces or hyphens, with a valid    the new check digit
          Luhn check digit
iban      country, check digits, 11 to 30 more,   the digits after the check digits;
          also in fours, valid modulo 97          these are computed anew
phone     +C (AAA) NNN-NNNN, (AAA) NNN-NNNN,      the ten national digits
          AAA-NNN-NNNN, AAA.NNN.NNNN
          + and 8 to 15 digits                    the digits after the country code
ssn       AAA-GG-SSSS, area 001 to 899 but 666,   its number among all such
          group 01 and serial 0001 upwards
ip        four octets of 0 to 255                 the 32 bits
date      YYYY-MM-DD, DD.MM.YYYY, MM/DD/YYYY      the day's number, 1900 to 2099
email     local@domain, up to 64 and 255          the local part's letters and digits
          characters
========  ======================================  ==================================

The expressions repeat single characters or groups of fixed length only, so
their work and their stack don't grow with what they match.
A candidate that doesn't validate stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EMAIL = r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]*[A-Za-z0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
PHONE = r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])|\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])|[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-])|[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9.])|\+[0-9]{8,15}(?![0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])|[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])|[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
CARD = r"(?:[0-9]{4} ){3}[0-9]{4}(?![0-9A-Za-z])|(?:[0-9]{4}-){3}[0-9]{4}(?![0-9A-Za-z])|[0-9]{4} [0-9]{6} [0-9]{5}(?![0-9A-Za-z])|[0-9]{4}-[0-9]{6}-[0-9]{5}(?![0-9A-Za-z])|[0-9]{13,19}(?![0-9A-Za-z])"
ANY = rf"(?<![A-Za-z0-9._%+\-])(?:{EMAIL}|{IBAN}|{PHONE}|{SSN}|{IP}|{DATE}|{CARD})"
#: Country codes of one and two digits; all others have three (fixed values of the numbering plan).
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

KINDS = ("card", "iban", "phone", "ssn", "ip", "date", "email")
DIGITS = "0123456789"
LETTERS = DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FIRST_DAY, DAYS = "1900-01-01", 73_049
CHUNK = 8


def _draw(key: str, tweak: Column, r: Column, other: Column) -> Column:
    """A keyed pseudorandom number below 2**60."""
    told = F.concat_ws("|", F.lit(key), tweak, r.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, left_size: Column, right_size: Column, rounds: int = 8) -> Column:
    """struct(a, b): a keyed permutation of pairs with a < left_size and b < right_size."""

    def step(s, r):
        even = r % 2 == 0
        size = F.when(even, left_size).otherwise(right_size)
        drawn = F.pmod(F.when(even, s["a"]).otherwise(s["b"]) + F.pmod(_draw(key, tweak, r, F.when(even, s["b"]).otherwise(s["a"])), size), size)
        return F.struct(F.when(even, drawn).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(drawn).alias("b"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)


def _power(base: int, n: Column) -> Column:
    return F.round(F.pow(F.lit(float(base)), n.cast("double"))).cast("long")


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def permute_digits(d: Column, key: str, tweak: Column | str) -> Column:
    """Digits (1 to 19 of them) to as many digits."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    v = n - u
    a, b = F.coalesce(F.substring(d, F.lit(1), u).try_cast("long"), F.lit(0)), F.substring(d, u + 1, v).cast("long")
    left = lambda s: F.when(u > 0, F.lpad(s["a"].cast("string"), u, F.lit("0"))).otherwise("")
    return _let(
        feistel(key, F.concat(F.lit(tweak) if isinstance(tweak, str) else tweak, n.cast("string")), a, b, _power(10, u), _power(10, v)),
        lambda s: F.concat(left(s), F.lpad(s["b"].cast("string"), v, F.lit("0"))),
    )


def dealt(shape: Column, cells: Column, what: str) -> Column:
    """``shape`` with the characters that match ``what`` replaced by those of ``cells``, in order."""
    out = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike(what), F.struct(F.concat(s["s"], F.substring(cells, s["at"], F.lit(1))).alias("s"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["at"].alias("at"))),
    )
    return out["s"]


def luhn_digit(prefix: Column) -> Column:
    """The check digit that makes prefix and digit valid."""

    def step(s, c):
        doubled = c.cast("int") * 2
        return F.struct((s["total"] + F.when(s["twice"], F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(c.cast("int"))).alias("total"), (~s["twice"]).alias("twice"))

    start = F.struct(F.lit(0).alias("total"), F.lit(True).alias("twice"))
    digits = F.split(F.reverse(prefix), "")
    return F.aggregate(digits, start, step, lambda s: F.pmod(-s["total"], F.lit(10)))


def _card(m: Column, key: str) -> Column:
    def of(digits):
        front = F.substring(digits, F.lit(1), F.length(digits) - 1)
        valid = F.substring(digits, F.length(digits), F.lit(1)).cast("int") == luhn_digit(front)
        new = _let(permute_digits(front, key, "card"), lambda p: F.concat(p, luhn_digit(p).cast("string")))
        return F.when(valid, _let(new, lambda p: dealt(m, p, "[0-9]"))).otherwise(m)

    return _let(F.translate(m, " -", ""), of)


def modulo_97(s: Column) -> Column:
    """A text of digits and capitals (A is 10, B is 11, ...) modulo 97."""

    def step(r, c):
        letter = F.ascii(c) >= 65
        return F.when(letter, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    def of(x):
        country, rest = F.substring(x, F.lit(1), F.lit(2)), F.substring(x, F.lit(5), F.length(x))
        digits = F.regexp_replace(rest, "[^0-9]", "")
        chunks = F.regexp_extract_all(digits, F.lit(".{1,15}"), F.lit(0))
        tweak = lambda i: F.concat(F.lit("iban"), country, F.length(x).cast("string"), F.lit("/"), i.cast("string"), F.lit("/"))
        mapped = F.array_join(F.transform(chunks, lambda c, i: permute_digits(c, key, tweak(i))), "")
        new = _let(mapped, lambda p: dealt(rest, p, "[0-9]"))
        checked = _let(new, lambda r: F.concat(country, F.lpad((98 - modulo_97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))
        valid = (modulo_97(F.concat(rest, F.substring(x, F.lit(1), F.lit(4)))) == 1) & F.length(x).between(15, 34)
        return F.when(valid, _let(checked, lambda r: dealt(m, r, "[^ ]"))).otherwise(m)

    return _let(F.translate(m, " ", ""), of)


def _phone(m: Column, key: str) -> Column:
    """All forms of ten national digits share one permutation, with +1 before them too."""
    ten = F.regexp_replace(F.regexp_replace(m, r"^\+[0-9]+ |^\+1(?=[0-9]{10}$)", ""), "[^0-9]", "")
    country = F.regexp_extract(m, COUNTRY, 0)
    other = F.substring(m, F.length(country) + 1, F.length(m))
    plain = ~m.rlike(r"^\+[0-9]+$")
    national = _let(permute_digits(ten, key, "phone"), lambda p: F.when(plain, _after(m, r"^\+[0-9]+ ", p)).otherwise(F.concat(F.lit("+1"), p)))
    return F.when(plain | m.rlike(r"^\+1[0-9]{10}$"), national).otherwise(F.concat(country, permute_digits(other, key, F.concat(F.lit("phone"), country, F.lit("/")))))


def _after(m: Column, prefix: str, digits: Column) -> Column:
    """``m`` with its digits beyond a prefix replaced."""
    head = F.regexp_extract(m, prefix, 0)
    return F.concat(head, dealt(F.substring(m, F.length(head) + 1, F.length(m)), digits, "[0-9]"))


AREAS, REST = 898, 99 * 9999


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    two = lambda x, n: F.lpad(x.cast("string"), n, "0")
    told = lambda s: F.concat_ws("-", two(s["a"] + F.when(s["a"] >= 665, 2).otherwise(1), 3), two(F.floor(s["b"] / 9999) + 1, 2), two(s["b"] % 9999 + 1, 4))
    a, b = area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1
    return F.when(valid, _let(feistel(key, F.lit("ssn"), a, b, F.lit(AREAS).cast("long"), F.lit(REST).cast("long")), told)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    def of(o):
        n = [F.element_at(o, i + 1).cast("long") for i in range(4)]
        half = F.lit(1 << 16).cast("long")
        whole = _let(feistel(key, F.lit("ip"), n[0] * 256 + n[1], n[2] * 256 + n[3], half, half), lambda s: F.concat_ws(".", *[F.floor(x / 256).cast("string") if hi else (x % 256).cast("string") for x in (s["a"], s["b"]) for hi in (True, False)]))
        return F.when(n[0].between(0, 255) & n[1].between(0, 255) & n[2].between(0, 255) & n[3].between(0, 255), whole).otherwise(m)

    return _let(F.split(m, r"\."), of)


def _date(m: Column, key: str) -> Column:
    kinds = ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"\.", "dd.MM.yyyy"), ("/", "MM/dd/yyyy"))
    day = F.coalesce(*[F.when(m.rlike(shape), F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(fmt))), F.lit(FIRST_DAY).cast("date"))) for shape, fmt in kinds])
    left, right = F.lit(267).cast("long"), F.lit(274).cast("long")

    def turn(x):
        return _let(feistel(key, F.lit("date"), F.floor(x / 274), x % 274, left, right), lambda s: s["a"] * 274 + s["b"])

    # cycle-walking: 109 numbers of the domain are no days, so no walk is longer
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(267 * 274 - DAYS)), turn(day.cast("long")), lambda x, _: F.when(x >= DAYS, turn(x)).otherwise(x))

    def shown(n):
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
        return F.coalesce(*[F.when(m.rlike(shape), F.date_format(new, fmt)) for shape, fmt in kinds])

    return F.when(day.between(0, DAYS - 1), _let(walked, shown)).otherwise(m)


def _number(s: Column) -> Column:
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda acc, c: acc * len(LETTERS) + F.position(c, F.lit(LETTERS)) - 1)


def _text(n: Column, width: Column) -> Column:
    base = len(LETTERS)
    out = F.aggregate(
        F.sequence(F.lit(1), width),
        F.struct(n.alias("n"), F.lit("").alias("s")),
        lambda s, _: F.struct(F.floor(s["n"] / base).alias("n"), F.concat(F.substring(F.lit(LETTERS), (s["n"] % base + 1).cast("int"), F.lit(1)), s["s"]).alias("s")),
    )
    return out["s"]


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    plain = F.regexp_replace(local, "[^A-Za-z0-9]", "")

    def chunk(s, i):
        w = F.length(s)
        u = F.floor(w / 2).cast("int")
        v = w - u
        a, b = F.when(u > 0, _number(F.substring(s, F.lit(1), u))).otherwise(F.lit(0).cast("long")), _number(F.substring(s, u + 1, v))
        tweak = F.concat(F.lit("email"), i.cast("string"), F.lit("/"), F.length(plain).cast("string"))
        return _let(feistel(key, tweak, a, b, _power(len(LETTERS), u), _power(len(LETTERS), v)), lambda r: F.concat(F.when(u > 0, _text(r["a"], F.greatest(u, F.lit(1)))).otherwise(""), _text(r["b"], v)))

    chunks = F.regexp_extract_all(plain, F.lit(f".{{1,{CHUNK}}}"), F.lit(0))
    mapped = F.array_join(F.transform(chunks, chunk), "")

    # marks stay where they are, letters and digits are dealt in order
    new = _let(mapped, lambda p: F.concat(dealt(local, p, "[A-Za-z0-9]"), F.lit("@"), domain))
    fits = (F.length(local) <= 64) & (F.length(domain) <= 255) & F.contains(domain, F.lit(".")) & ~domain.rlike(r"^[.\-]|\.\.")
    return F.when(fits & (F.length(plain) > 0), new).otherwise(m)


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{IBAN})$"), "iban")
        .when(m.rlike(rf"^(?:{CARD})$"), "card")
        .when(m.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(m.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(m.rlike(rf"^(?:{IP})$"), "ip")
        .otherwise("date")
    )


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate."""
    return _let(
        kind_of(m),
        lambda k: F.when(k == "email", _email(m, key))
        .when(k == "card", _card(m, key))
        .when(k == "iban", _iban(m, key))
        .when(k == "phone", _phone(m, key))
        .when(k == "ssn", _ssn(m, key))
        .when(k == "ip", _ip(m, key))
        .otherwise(_date(m, key)),
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and the columns _n_found and _n_replaced.

    _n_found counts the candidates, _n_replaced those that got another value.
    A null text stays null with 0, an empty one stays empty.  Equal rows give
    equal rows.  Columns that are named like the two new ones are replaced;
    all others are kept as they are.
    """
    own = [c for c in docs.columns if c not in ("_n_found", "_n_replaced")]
    text = F.col(f"row.{text_col}")
    found = F.coalesce(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    base = docs.select(F.struct(*own).alias("row")).withColumn("found", found)
    base = base.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))))
    gaps = F.split(text, ANY, -1)
    woven = F.array_join(F.zip_with(gaps, "new", lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    changed = F.when(F.size("found") > 0, F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))).otherwise(0)
    cols = [F.when(F.size("found") > 0, woven).otherwise(text).alias(c) if c == text_col else F.col(f"row.{c}") for c in own]
    return base.select(*cols, F.size("found").cast("long").alias("_n_found"), changed.cast("long").alias("_n_replaced"))
