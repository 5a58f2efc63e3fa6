"""Format-preserving pseudonyms for personal data, in SQL functions only.

Numbers and dates that pass their check are permuted within their own format by a keyed
Feistel network, so the result is again a valid value of that kind, equal values get equal
pseudonyms in every document, and the holder of the key can undo it:

* card numbers of 13 to 19 digits with a right check digit (digits before it permuted, the
  check digit recomputed, separators kept),
* bank account numbers (IBAN) whose remainder by 97 is right (country, letters and spaces
  kept, digits permuted, both check digits recomputed),
* IPv4 addresses, US social security numbers in their valid range,
* telephone numbers (the last ten digits, punctuation and country code kept; other
  international numbers of 8 to 15 digits: all but the first three),
* dates from 1900 to 2099 that exist (permuted over the 73,049 days, notation kept).

Mail addresses, hexadecimal secrets (32 to 64 digits) and cloud access key ids have no such
format and get a keyed digest of the same kind: 128 bits for each part of an address, so
different people do not share one.  Everything else stays as it is, byte for byte; dates
with month names and IPv6 addresses are not looked for.

Each row is handled where it lies: one pattern finds the values, a higher-order function
rewrites them, and the pieces are joined again; no Python, no shuffle.

Defined cases: NULL text stays NULL, empty text stays empty; numbers that fail their check
stay; texts of any length are read whole; repeated rows give repeated results; all other
columns come back unchanged, whatever their names (one named like ``count_col`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLE_KEY = "an example key; a job takes its own from a secret store"
ROUNDS = 12
FIRST_DAY = "1900-01-01"
DAYS = (17, 4297)  # their product is the number of days from 1900 to 2099

HEX = r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]{0,63}[0-9])(?=[0-9a-fA-F]{0,63}[a-fA-F])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9][A-Za-z0-9.-]{0,253}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}(?![0-9]|\.[0-9])"
MONTH, DAY, YEAR = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])", r"(?:19|20)[0-9]{2}"
ISO = rf"(?<![0-9.-]){YEAR}(?:-{MONTH}-|/{MONTH}/){DAY}(?![0-9]|-[0-9])"
LOCAL = rf"(?<![0-9.-])(?:{DAY}\.{MONTH}\.|{MONTH}/{DAY}/){YEAR}(?![0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
)
INTL = r"(?<![0-9A-Za-z+])\+[1-9](?:[ ./()-]{0,2}[0-9]){7,14}(?![0-9])"
IBAN = (
    r"(?<![0-9A-Za-z])(?=(?: ?[A-Z0-9]){15,34}(?![0-9A-Za-z]))[A-Z]{2}[0-9]{2}"
    r"(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
)
ACCESS = r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9A-Za-z])"
KINDS = {
    "mail": MAIL, "secret": HEX, "access": ACCESS, "iban": IBAN, "ip": IP, "iso": ISO, "local": LOCAL, "ssn": SSN,
    "phone": PHONE, "intl": INTL, "card": CARD,
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _whole(pattern: str) -> str:
    """The pattern for a found value on its own."""
    return f"^(?:{pattern})$"


def _digest(key: str, kind: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), value), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Keyed permutation of the pairs (left < a, right < b): struct(l, r).  Every round
    adds a keyed function of one side to the other, modulo its radix."""

    def mix(i: Column, x: Column) -> Column:
        text = F.concat_ws("|", i.cast("string"), x.cast("string"))
        return F.conv(F.substring(_digest(key, kind, text), 1, 15), 16, 10).cast("bigint")

    def step(s: Column, i: Column) -> Column:
        sign = -1 if undo else 1
        return F.struct(
            F.when(i % 2 == 0, F.pmod(s["l"] + sign * mix(i, s["r"]), a)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, F.pmod(s["r"] + sign * mix(i, s["l"]), b)).otherwise(s["r"]).alias("r"),
        )

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(rounds, start, step)


def _padded(x: Column, width: Column) -> Column:
    return F.lpad(x.cast("string"), width, F.lit("0"))


def permute_digits(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Permutation of the digit strings of one length (2 to 36 digits)."""
    n = F.char_length(digits)
    u = F.floor(n / 2).cast("int")
    radix = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("bigint")
    s = feistel(
        F.substring(digits, F.lit(1), u).cast("bigint"),
        F.substring(digits, u + 1, n - u).cast("bigint"),
        radix(u), radix(n - u), key, kind, undo,
    )
    return F.transform(F.array(s), lambda x: F.concat(_padded(x["l"], u), _padded(x["r"], n - u)))[0]


def luhn_sum(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add)


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order, other characters kept."""

    def step(s: Column, i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        digit = c.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + digit.cast("int")).alias("k"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), start, step)["out"]


def _then(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _card(value: Column, key: str, undo: bool) -> Column:
    def made(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.char_length(d) - 1), key, "card", undo)
        new = _then(body, lambda x: F.concat(x, ((F.lit(10) - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _refill(value, new)).otherwise(value)

    return _then(F.regexp_replace(value, "[^0-9]", ""), made)


def _mod97(chars: Column) -> Column:
    """Remainder of letters and digits read as one number, A = 10 to Z = 35."""

    def add(total: Column, i: Column) -> Column:
        code = F.ascii(F.substring(chars, i, F.lit(1)))
        return F.when(code < 65, total * 10 + code - 48).otherwise(total * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.char_length(chars)), F.lit(0), add)


def _iban(value: Column, key: str, undo: bool) -> Column:
    """A number whose check fails may still be four characters before a card number."""

    def checked(s: Column) -> Column:
        body, country = F.substring(s, F.lit(5), F.char_length(s) - 4), F.substring(s, 1, 2)
        digits = F.regexp_replace(body, "[^0-9]", "")

        def made(new: Column) -> Column:
            remainder = _mod97(F.concat(_refill(body, new), country, F.lit("00")))
            return _refill(value, F.concat(_padded(F.lit(98) - remainder, F.lit(2)), new))

        right = (_mod97(F.concat(body, F.substring(s, 1, 4))) == 1) & (F.char_length(digits) >= 2)
        return F.when(right, _then(permute_digits(digits, key, "iban", undo), made))

    rest = F.substring(value, F.lit(6), F.char_length(value))
    card = F.when(rest.rlike(_whole(CARD)), F.concat(F.substring(value, 1, 5), _card(rest, key, undo)))
    return F.coalesce(_then(F.replace(value, F.lit(" "), F.lit("")), checked), card, value)


def _phone(value: Column, key: str, undo: bool, kind: str = "phone") -> Column:
    def made(d: Column) -> Column:
        kept = F.lit(3) if kind == "intl" else F.char_length(d) - 10
        new = permute_digits(F.substring(d, kept + 1, F.char_length(d) - kept), key, kind, undo)
        return _refill(value, F.concat(F.substring(d, F.lit(1), kept), new))

    return _then(F.regexp_replace(value, "[^0-9]", ""), made)


def _ip(value: Column, key: str, undo: bool) -> Column:
    def made(o: Column) -> Column:
        n = [o[i].cast("bigint") for i in range(4)]
        s = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "ip", undo)
        return _then(s, lambda x: F.concat_ws(".", *[
            F.floor(x[side] / 256).cast("string") if high else (x[side] % 256).cast("string")
            for side in ("l", "r") for high in (True, False)
        ]))

    return _then(F.split(value, r"\."), made)


def _ssn(value: Column, key: str, undo: bool) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999, counted from zero."""
    area, group, serial = (F.substring(value, p, n).cast("bigint") for p, n in ((1, 3), (5, 2), (8, 4)))
    rank = area - 1 - (area > 666).cast("int")
    s = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", undo)

    def made(x: Column) -> Column:
        rank = F.floor(x["l"] / 99)
        return F.concat_ws(
            "-",
            _padded(rank + 1 + (rank >= 665).cast("int"), F.lit(3)),
            _padded(x["l"] % 99 + 1, F.lit(2)),
            _padded(x["r"] + 1, F.lit(4)),
        )

    return _then(s, made)


def _date(value: Column, key: str, undo: bool) -> Column:
    """A date in any of the four notations; one that does not exist stays."""

    def moved(day: Column) -> Column:
        index = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")
        s = feistel(F.floor(index / DAYS[1]), index % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date", undo)
        return _then(s, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x["l"] * DAYS[1] + x["r"]).cast("int")))

    out = F.lit(None).cast("string")
    for shape, notation in (
        (r"^....-", "yyyy-MM-dd"), (r"^..../", "yyyy/MM/dd"), (r"^..\.", "dd.MM.yyyy"), (r"^../", "MM/dd/yyyy"),
    ):
        day = F.to_date(F.try_to_timestamp(value, F.lit(notation)))
        out = F.when(value.rlike(shape), F.date_format(_then(day, moved), notation)).otherwise(out)
    return F.coalesce(out, value)


def _mail(value: Column, key: str) -> Column:
    at = F.split(F.lower(value), "@")
    return _then(at, lambda p: F.concat(
        F.substring(_digest(key, "user", F.concat_ws("@", p)), 1, 32), F.lit("@"),
        F.substring(_digest(key, "host", p[1]), 1, 32), F.lit(".invalid"),
    ))


def _secret(value: Column, key: str) -> Column:
    new = F.substring(_digest(key, "secret", F.lower(value)), F.lit(1), F.char_length(value))
    return F.when(value == F.upper(value), F.upper(new)).otherwise(new)


def _access(value: Column, key: str) -> Column:
    return F.concat(F.substring(value, 1, 4), F.upper(F.substring(_digest(key, "access", value), 1, 16)))


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one found value.  ``undo`` takes back permuted values; digests of
    mail addresses and secrets cannot be taken back and stay."""
    kind = lambda k: value.rlike(_whole(KINDS[k]))
    return (
        F.when(F.contains(value, F.lit("@")), value if undo else _mail(value, key))
        .when(kind("secret"), value if undo else _secret(value, key))
        .when(kind("access"), value if undo else _access(value, key))
        .when(kind("iban"), _iban(value, key, undo))
        .when(kind("ip"), _ip(value, key, undo))
        .when(kind("iso") | kind("local"), _date(value, key, undo))
        .when(kind("ssn"), _ssn(value, key, undo))
        .when(kind("phone"), _phone(value, key, undo))
        .when(kind("intl"), _phone(value, key, undo, "intl"))
        .when(kind("card"), _card(value, key, undo))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, undo: bool = False) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; ``count_col``, if named, is
    added with the number of values replaced.  ``key`` decides the pseudonyms: keep it as
    secret as the data."""
    if not key:
        raise ValueError("a key is needed")
    text = F.col("row")[text_col]
    candidate = text.rlike("[0-9@]|A[KS]IA")
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row",
        F.when(candidate, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("old"),
    )
    new = found.select(
        "row", "old", F.when(F.size("old") > 0, F.transform("old", lambda v: pseudonym(v, key, undo))).alias("new")
    )
    between = F.split(text, ANY, -1)
    rebuilt = F.concat_ws("", F.zip_with(between, F.concat(F.col("new"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)))
    changed = F.when(F.col("new").isNotNull(), rebuilt).otherwise(text)
    columns = [changed.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != count_col]
    if count_col:
        differ = F.filter(F.zip_with("old", "new", lambda a, b: a != b), lambda x: x)
        columns.append(F.coalesce(F.when(F.col("new").isNotNull(), F.size(differ)), F.lit(0)).cast("bigint").alias(count_col))
    return new.select(*columns)
