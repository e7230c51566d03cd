"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates are validated (Luhn, octet and area ranges, calendar), mapped to an index pair of their format's own
domain, and permuted there by a keyed Feistel network: a value always gets the same pseudonym of the same format, in
every document, and two values never get the same one. The letters and digits of an e-mail's local part are permuted
the same way, each within its class.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

ROUNDS = 6
KEY_SETTING = "lumenlog.pii.secret"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![0-9])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9+])\+[0-9]{8,15}(?![0-9])"
#: Tried in this order where several begin at one place.
KINDS = {"email": EMAIL, "ip": IP, "date": DATE, "ssn": SSN, "card": CARD, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
FIRST_YEAR, YEARS, DAYS = 1800, 400, 146_097  # a whole Gregorian cycle: 189 * 773 days


def _mix(key: str, kind: Column | str, r: Column, x: Column) -> Column:
    """Keyed round function: 15 hexadecimal digits of a SHA-256, as a number."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, r.cast("string"), x.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(key: str, kind: str, a: Column, b: Column, m: Column, n: Column) -> Column:
    """Permute pairs 0 <= a < m, 0 <= b < n: struct(a, b). m and n, and so the format, are part of the round keys."""
    label = F.concat_ws("/", F.lit(kind), m.cast("string"), n.cast("string"))
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + F.pmod(_mix(key, label, r, s["b"]), m), m)).otherwise(s["a"]).cast("bigint").alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(_mix(key, label, r, s["a"]), n), n)).cast("bigint").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(11)]), n.cast("int") + 1)


def _permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A digit string of 2 to 20 characters, permuted among those of its length."""
    left = F.floor(F.length(digits) / 2).cast("int")
    right = F.length(digits) - left
    whole = feistel(key, kind, F.substring(digits, F.lit(1), left).cast("bigint"), F.substring(digits, left + 1, right).cast("bigint"), _power(left), _power(right))
    return _let(whole, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, F.lit("0")), F.lpad(p["b"].cast("string"), right, F.lit("0"))))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced, from the left, by `digits`."""
    chars = F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.substring(shape, i, F.lit(1)))
    filled = F.transform(
        chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    )
    return F.array_join(filled, "")


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of Luhn's digits; `doubled_last`: the last digit of the string is one that is doubled."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(digits, i, F.lit(1)).cast("int").alias("d"), (F.pmod(n - i, F.lit(2)) == (0 if doubled_last else 1)).alias("x")))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v["x"], v["d"] * 2 - F.when(v["d"] > 4, 9).otherwise(0)).otherwise(v["d"]))


def _card(key: str, m: Column) -> Column:
    digits = _digits(m)
    body = F.concat(F.substring(digits, 1, 1), _permuted_digits(key, "card", F.substring(digits, F.lit(2), F.length(digits) - 2)))
    checked = _let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - F.pmod(_luhn_sum(b, True), F.lit(10)), F.lit(10)).cast("string")))
    return F.when(F.pmod(_luhn_sum(digits, False), F.lit(10)) == 0, _refill(m, checked)).otherwise(m)


def _phone(key: str, m: Column) -> Column:
    """The country code stays; the rest of the digits are permuted."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])|^\+[0-9]", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _refill(rest, _permuted_digits(key, "phone", _digits(rest))))


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)
    made = feistel(key, "ssn", index, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))

    def written(p: Column) -> Column:
        a = p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(p["b"], F.lit(9999)) + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(made, written)).otherwise(m)


def _ip(key: str, m: Column) -> Column:
    octet = [F.split(m, r"\.")[i].cast("int") for i in range(4)]
    plain = [(F.length(F.split(m, r"\.")[i]) == F.length(o.cast("string"))) & (o < 256) for i, o in enumerate(octet)]
    made = feistel(key, "ip", octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536))
    parts = lambda p: [F.floor(p[k] / 256).cast("string") if high else F.pmod(p[k], F.lit(256)).cast("string") for k in "ab" for high in (True, False)]
    return F.when(plain[0] & plain[1] & plain[2] & plain[3], _let(made, lambda p: F.concat_ws(".", *parts(p)))).otherwise(m)


def _date(key: str, m: Column) -> Column:
    """Year-first and dotted or dashed day-first dates over all days of the cycle; slashed ones are month first where
    that is a date, else day first, each permuted among those that are read the same way."""
    first = F.lit(f"{FIRST_YEAR}-01-01").cast("date")

    def moved(kind: str, day: Column, write) -> Column:
        index = F.datediff(day, first)
        made = feistel(key, kind, F.floor(index / 773), F.pmod(index, F.lit(773)), F.lit(DAYS // 773), F.lit(773))
        inside = (index >= 0) & (index < DAYS)
        return F.when(inside, _let(F.date_add(first, _let(made, lambda p: p["a"] * 773 + p["b"]).cast("int")), write))

    def parsed(pattern: str) -> Column:
        y, mo, d = (F.substring(m, pattern.index(c) + 1, pattern.count(c)).cast("string") for c in "yMd")
        return F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")

    def each(pattern: str) -> Column:
        return moved("date", parsed(pattern), lambda x: F.date_format(x, pattern))

    d, mo, y = (F.substring(m, a, n).cast("bigint") for a, n in ((1, 2), (4, 2), (7, 4)))
    late = F.when((y >= FIRST_YEAR) & (y < FIRST_YEAR + YEARS), F.when(d <= 28, _let(
        feistel(key, "day", (d - 13) * 12 + mo - 1, y - FIRST_YEAR, F.lit(16 * 12), F.lit(YEARS)),
        lambda p: F.concat_ws("/", (F.floor(p["a"] / 12) + 13).cast("string"), F.lpad((F.pmod(p["a"], F.lit(12)) + 1).cast("string"), 2, "0"), (p["b"] + FIRST_YEAR).cast("string")),
    )).when(mo != 2, _let(
        feistel(key, "year", F.floor((y - FIRST_YEAR) / 20), F.pmod(y - FIRST_YEAR, F.lit(20)), F.lit(20), F.lit(20)),
        lambda p: F.concat(F.substring(m, 1, 6), (p["a"] * 20 + p["b"] + FIRST_YEAR).cast("string")),
    )))
    slashed = F.when(parsed("MM/dd/yyyy").isNotNull(), each("MM/dd/yyyy")).when(parsed("dd/MM/yyyy").isNotNull(), late)
    made = (
        F.when(m.rlike("^[0-9]{4}-"), each("yyyy-MM-dd")).when(m.rlike("^[0-9]{4}/"), each("yyyy/MM/dd"))
        .when(m.rlike("^[0-9]{2}/"), slashed).when(m.rlike(r"^[0-9]{2}\."), each("dd.MM.yyyy")).otherwise(each("dd-MM-yyyy"))
    )
    return F.coalesce(made, m)


def _email(key: str, m: Column) -> Column:
    """Letters and digits of the local part are moved within their class, half by half, keyed by the other half."""
    local = F.substring_index(m, "@", 1)
    half = F.ceil(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))

    def shifted(part: Column, r: Column, other: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), r.cast("string"), F.length(part).cast("string"), other).cast("binary"), 256)

        def move(i: Column) -> Column:
            c = F.substring(part, i, F.lit(1))
            k = F.conv(F.substring(stream, 2 * (i - 1) + 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda base, size: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + k, F.lit(size)))
            return F.when(c.rlike("[0-9]"), turn(48, 10)).when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).otherwise(c)

        return F.when(F.length(part) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), move), "")).otherwise("")

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, shifted(s["a"], r, s["b"])).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(shifted(s["b"], r, s["a"])).alias("b"))

    made = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return _let(made, lambda p: F.concat(p["a"], p["b"], F.substring(m, F.length(local) + 1, F.length(m))))


PERMUTED = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonymised(docs: DataFrame, key: str, column: str = "text", added: tuple[str, str] = ("n_pii", "pii")) -> DataFrame:
    """All columns of `docs` with `column` pseudonymised, and `added`: values changed, and their kinds in order, joined by
    commas. Columns of `docs` that are named as `added` are replaced.

    A null text stays null and has no values. Values that look like a kind but fail its validation stay as they are.
    Texts are taken whole, every row on its own, so repeated rows get equal results. An empty table gives an empty result.
    """
    text = F.col(column)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    kind = lambda m: F.coalesce(*[F.when(m.rlike(f"^(?:{KINDS[k]})$"), k) for k in KINDS])

    def replaced(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for k in reversed(KINDS):
            out = F.when(m["kind"] == k, PERMUTED[k](key, m["m"])).otherwise(out)
        return F.struct(m["kind"].alias("kind"), m["m"].alias("m"), out.alias("to"))

    values = F.when(F.size(found) > 0, F.transform(F.transform(found, lambda m: F.struct(kind(m).alias("kind"), m.alias("m"))), replaced))
    marked = docs.withColumn("__pii", values)
    between = F.split(text, ANY, -1)
    changed = F.filter(F.col("__pii"), lambda m: m["m"] != m["to"])
    joined = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("__pii"), i)["to"], F.lit("")))), "")
    return (
        marked.withColumn(column, F.when(F.col("__pii").isNotNull(), joined).otherwise(text))
        .withColumn(added[0], F.when(F.col("__pii").isNotNull(), F.size(changed)).otherwise(0))
        .withColumn(added[1], F.when(F.col("__pii").isNotNull(), F.array_join(F.transform(changed, lambda m: m["kind"]), ",")).otherwise(""))
        .drop("__pii")
    )


def session_key(spark: SparkSession) -> str:
    """The key of pseudonyms: the setting KEY_SETTING; where it is unset, a random one that is kept for the session.

    Pseudonyms can be undone by whoever has the key, so it is never part of the code. To link values across sessions, set
    it.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return pseudonymised(docs, session_key(spark)).select("doc_id", "n_pii", "pii", "text")
