"""Pseudonyms for personal data that keep its format. DataFrame operations only.

One pattern finds candidates; each is validated by its kind (check digit, octet range, calendar, ...)
and only valid ones change. Digits and dates are permuted within their format by a Feistel network
over mixed radices a*b: with L < a and R < b, rounds add a keyed hash of one half to the other, so the
network is a bijection on a*b values without cycle walking, and equal values have equal pseudonyms in
every document. A card's check digit is recomputed; a date maps to a date, whatever its notation; an
address keeps four octets. Names of mailboxes and secrets are no numbers: they are replaced by
keyed digests of the same length in their own alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.scratch import fresh

#: What stands before a secret: a name in any case, = or a colon, and a quote if there is one. After a colon and a space,
#: where a sentence may go on, only a value with a digit is a secret.
NAMES = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)"
SECRETS = NAMES + r"[\"']?(?: ?= ?[\"']?|: ?[\"']|:(?! )|: (?=[^\s\"']*[0-9]))"
#: Lengths of account numbers by country.
IBAN = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Country codes of E.164, by their ranges.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9]"
#: A number with +1; any country's with its code, 8 to 15 digits in all; pairs after a 0; North America's without code.
PHONES = [
    r"\+1 ?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
    r"(?:\+|00)[ .-]?(?:" + COUNTRY + r")(?:[ .()/-]{0,3}[0-9]){6,12}(?![./-]?[0-9])",
    r"0[1-9](?:\.[0-9]{2}){4}",
    r"(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![./-]?[0-9])",
]
#: Patterns by kind, in order of precedence; a match belongs to the first kind whose pattern fits it whole.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "key": r"AKIA[A-Z0-9]{16}",
    "secret": f"(?:{SECRETS})(?=[^\\s\"']{{8}})[^\\s\"']*[^\\s\"'.,;:!?)\\]}}]",
    "phone": "|".join(PHONES),
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?",
    "ip6": r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
    "trunk": r"(?:\(0[1-9][0-9]{0,3}\)[ /-]?|0[1-9][0-9]{0,3}[ /-])(?:[ -]?[0-9]){5,9}(?![./-]?[0-9])",
}
#: Texts without any of this hold no match: every kind but keys and secrets has a digit or @.
HOT = f"[0-9@]|AKIA|{SECRETS}"
#: No candidate begins or ends within a longer word or number, but a day may be followed by its time.
ANY = r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + r")(?:(?![A-Za-z0-9])|(?<=[0-9]{4}-[0-9]{2}-[0-9]{2})(?=T[0-9]{2}:[0-9]{2}))"
ROUNDS = 8
#: Days from FIRST_DAY on, 1900-01-01 to 2099-12-31: 73049 = 229 * 319.
FIRST_DAY, DAYS = "1900-01-01", (229, 319)


def number(key: str, *parts: Column) -> Column:
    """A keyed 60-bit number of the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def network(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the pairs 0 <= left < a, 0 <= right < b, as left * b + right."""

    def turn(s: Column, r: Column) -> Column:
        even = (r % 2) == 0
        moved, fixed = F.when(even, s["l"]).otherwise(s["r"]), F.when(even, s["r"]).otherwise(s["l"])
        grown = (moved + number(key, tweak, r, fixed)) % F.when(even, a).otherwise(b)
        return F.struct(F.when(even, grown).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(grown).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(left.alias("l"), right.alias("r")), turn, lambda s: s["l"] * b + s["r"])


def feistel(x: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of 0 <= x < a*b."""
    return network(F.floor(x / b).cast("bigint"), F.pmod(x, b).cast("bigint"), a, b, key, tweak)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of at most 18 digits, permuted among those of its length."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), half).cast("bigint"), F.substring(digits, half + 1, n - half).cast("bigint")
    power10 = lambda k: F.pow(F.lit(10), k).cast("bigint")
    value = network(left, right, power10(half), power10(n - half), key, F.concat(F.lit(kind), n.cast("string")))
    return F.lpad(value.cast("string"), n, "0")


def luhn(digits: Column) -> Column:
    """The sum that a valid number makes a multiple of ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced in turn."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def digest(text: Column, length: Column, key: str, kind: str, upper: bool = False) -> Column:
    """Hex digits of keyed digests, as many as asked for."""
    hexes = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"{kind}{i}"), text), 256) for i in range(2)])
    out = F.substring(F.repeat(hexes, F.ceil(length / 128).cast("int")), F.lit(1), length)
    return F.upper(out) if upper else out


def day(m: Column) -> Column:
    """The date that a match writes, null if the calendar has no such day; day first before month first."""
    return F.coalesce(
        F.try_to_date(F.regexp_replace(m, "^([0-9]{4})/([0-9]{2})/", "$1-$2-"), "yyyy-MM-dd"),
        F.try_to_date(F.regexp_replace(m, r"\.", "/"), "dd/MM/yyyy"),
        F.when(m.contains("/"), F.try_to_date(m, "MM/dd/yyyy")),
    )


def written(d: Column, like: Column) -> Column:
    """A date in the notation of ``like``."""
    month_first = F.try_to_date(F.regexp_replace(like, r"\.", "/"), "dd/MM/yyyy").isNull() & like.contains("/")
    return (
        F.when(like.contains("-"), F.date_format(d, "yyyy-MM-dd"))
        .when(like.rlike("^[0-9]{4}/"), F.date_format(d, "yyyy/MM/dd"))
        .when(like.contains("."), F.date_format(d, "dd.MM.yyyy"))
        .when(month_first, F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "dd/MM/yyyy"))
    )


def permuted_date(m: Column, key: str) -> Column:
    at = F.datediff(day(m), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    new = feistel(at, F.lit(DAYS[0]).cast("bigint"), F.lit(DAYS[1]).cast("bigint"), key, F.lit("date"))
    return written(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), m)


def permuted_ip(m: Column, key: str) -> Column:
    octet = lambda i: F.get(F.split(m, r"\."), F.lit(i)).cast("bigint")
    new = feistel(((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3), F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), key, F.lit("ip"))
    parts = F.transform(F.array(new), lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)]))
    return F.get(parts, F.lit(0))


def permuted_hex(group: Column, key: str) -> Column:
    """A group of hexadecimal digits permuted among those of its length."""
    n = F.length(group)
    half = F.pow(F.lit(4), n).cast("bigint")
    value = F.conv(F.lower(group), 16, 10).cast("bigint")
    new = feistel(value, half, half, key, F.concat(F.lit("ip6"), n.cast("string")))
    return F.lpad(F.lower(F.conv(new.cast("string"), 10, 16)), n, "0")


def permuted_phone(m: Column, digits: Column, key: str) -> Column:
    """A phone number with the digits after its country code or trunk 0 permuted; national ones of North America as with +1."""
    n = F.length(digits)
    abroad = F.length(F.regexp_extract(digits, f"^((?:00)?(?:{COUNTRY}))", 1))
    lead = F.when(m.rlike(r"^(?:\+|00)"), abroad).when(m.rlike(r"^\(?0"), 1).otherwise(0)
    return F.get(F.transform(F.array(lead), lambda k: refill(m, F.concat(F.substring(digits, F.lit(1), k), permuted_digits(F.substring(digits, k + 1, n - k), key, "phone")))), F.lit(0))


def iban_rest(m: Column) -> Column:
    """The remainder by 97 of an account number, 1 if it is valid: its country and check digits moved to the end, letters as 10 to 35."""
    plain = F.upper(F.regexp_replace(m, " ", ""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def permuted_iban(m: Column, key: str) -> Column:
    """An account number with the digits after its check digits permuted, 16 at a time, and its check digits computed anew."""
    digits = F.regexp_replace(F.substr(m, F.lit(5)), "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 16).cast("int") - 1, F.lit(0))), lambda i: F.when(n > 0, permuted_digits(F.substr(digits, i * 16 + 1, F.least(n - i * 16, F.lit(16))), key, "iban")).otherwise(""))
    blank = F.transform(F.array(F.concat(F.substring(m, 1, 2), F.lit("00"), refill(F.substr(m, F.lit(5)), F.array_join(parts, "")))), lambda t: F.concat(F.substring(t, 1, 2), F.lpad((98 - iban_rest(t)).cast("string"), 2, "0"), F.substr(t, F.lit(5))))
    return F.get(blank, F.lit(0))


def kind_of(m: Column) -> Column:
    """The kind of a valid match, else null."""
    digits, plain = F.regexp_replace(m, "[^0-9]", ""), F.regexp_replace(m, " ", "")
    days = F.datediff(day(m), F.lit(FIRST_DAY).cast("date"))
    valid = {
        # what is written in small letters may be any word with digits, so its country must have numbers of its length
        "iban": F.length(plain).between(15, 34) & (iban_rest(m) == 1) & (~m.rlike("^[a-z]") | (F.create_map(*[F.lit(x) for kv in IBAN.items() for x in kv])[F.upper(F.substring(m, 1, 2))] == F.length(plain))),
        "ip6": F.size(F.split(m, ":")).between(3, 8) & (F.size(F.split(m, "::")) <= 2) & m.rlike("[0-9]"),
        "ip": F.forall(F.split(m, r"\."), lambda o: o.try_cast("int") <= 255),
        "date": F.coalesce((days >= 0) & (days < DAYS[0] * DAYS[1]), F.lit(False)),
        "ssn": ~m.rlike("^(000|666|9)|-00-|-0000$"),
        # short codes may leave a number too short
        "phone": ~m.rlike(r"^(?:\+|00)") | F.length(F.regexp_replace(digits, "^00", "")).between(8, 15),
        "trunk": F.length(digits).between(8, 12),
        "card": (luhn(digits) % 10 == 0) & ~digits.rlike("^0+$"),
    }
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        fits = m.rlike(f"^(?:{pattern})$")
        out = F.when(fits, F.when(F.coalesce(valid[kind], F.lit(False)), kind) if kind in valid else F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    local = F.substring_index(m, "@", 1)
    lead = F.regexp_extract(m, f"^(?:{SECRETS})", 0)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    moved = F.transform(F.array(permuted_digits(body, key, "card")), lambda d: F.concat(d, ((10 - luhn(F.concat(d, F.lit("0"))) % 10) % 10).cast("string")))
    return (
        F.when(kind == "email", F.concat(digest(F.lower(m), F.greatest(F.length(local), F.lit(12)), key, "email"), F.lit("@"), F.substring_index(m, "@", -1)))
        .when(kind == "key", F.concat(F.lit("AKIA"), digest(m, F.lit(16), key, "key", upper=True)))
        .when(kind == "secret", F.concat(lead, digest(m, F.length(m) - F.length(lead), key, "secret")))
        .when(kind.isin("phone", "trunk"), permuted_phone(m, digits, key))
        .when(kind == "iban", permuted_iban(m, key))
        .when(kind == "ip6", F.array_join(F.transform(F.split(m, ":"), lambda g: F.when(g == "", g).otherwise(permuted_hex(g, key))), ":"))
        .when(kind == "ip", permuted_ip(m, key))
        .when(kind == "date", permuted_date(m, key))
        .when(kind == "ssn", refill(m, permuted_digits(digits, key, "ssn")))
        .when(kind == "card", refill(m, F.get(moved, F.lit(0))))
        .otherwise(m)
    )


def pseudonymised(docs: DataFrame, key: str, count: str = "_n_pii") -> DataFrame:
    """``docs`` with text replaced and a column ``count`` added, the number of values replaced.

    Whoever has ``key`` can undo the permutations. Null and empty texts stay as they are, a text of any
    length is one row, every row is its own, so repeated ones, null ids and an empty table are no cases.
    Other columns stay, whatever their names but ``count``. Texts that hold nothing a match must hold are
    not searched.
    """
    (name,) = fresh(docs, "_found")
    changed = lambda m: F.transform(F.array(kind_of(m)), lambda k: F.struct(k.alias("kind"), pseudonym(m, k, key).alias("new")))[0]
    hot = F.col("text").rlike(HOT)
    found = F.when(hot, F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), changed))
    parts = F.split("text", ANY, -1)
    news = F.transform(F.col(name), lambda f: f["new"])
    text = F.when(F.size(name) > 0, F.array_join(F.zip_with(parts, F.concat(news, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")).otherwise(F.col("text"))
    n = F.coalesce(F.size(F.filter(name, lambda f: f["kind"].isNotNull())), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return docs.withColumn(name, found).withColumn("text", text).withColumn(count, n).drop(name)


def pii(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_pii) of every row; see ``pseudonymised``. Extra columns are ignored."""
    return pseudonymised(docs.select("doc_id", "text"), key, "n_pii")
