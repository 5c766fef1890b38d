"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

Validated numbers and dates found in a text are permuted within their format by a keyed
Feistel network, so equal values get equal pseudonyms in every document and different
values stay different. Card numbers keep their length, separators and Luhn digit, IP
addresses stay IP addresses, dates stay dates of the same notation, social security
numbers keep to the areas, groups and serials that are given out, and phone numbers of the
North American plan stay numbers of that plan. E-mail addresses and secrets have no
numeric format; they become keyed digests.

No pattern repeats a group without a bound (Java's regular expressions recurse for each
turn of one): a mail domain has 126 labels at most, which is what 253 characters hold.

Defined results: a null text stays null, an empty one empty; numbers that fail their
validation stay as they are; repeated rows are changed alike; an empty table gives no
rows; other columns are untouched, whatever their names (helpers start with `_pii_`).

The key has no default and needs 16 characters. Spark writes expressions to its event
log, so on a shared cluster the log has to be as private as the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import common

#: Where a session names the key of the query and the pipeline; without it they take a key that anyone can read, good for tests only.
KEY_SETTING, PUBLIC_KEY = "spark.quakeframe.pseudonyms.key", "a public key, for tests only"
ROUNDS = 8
#: The patterns of the kinds, tried in this order at every place.
PATTERNS = {
    "secret": "AKIA[A-Z0-9]{16}(?![A-Z0-9])|(?i:password|passwd|pwd|token|secret|api[_-]?key)[ \\t]{0,3}[=:][ \\t]{0,3}[\"']?[^\\s\"'#*$%&|<>]{6,}",
    "email": "[A-Za-z0-9._%+\\-]{1,64}+@(?:[A-Za-z0-9\\-]{1,63}+\\.){1,126}[A-Za-z]{2,24}",
    "date": "(?<!\\d)(?:\\d{4}([-/.])\\d{2}\\1\\d{2}|\\d{2}([-/.])\\d{2}\\2\\d{4})(?!\\d)",
    "ip": "(?<![\\d.])\\d{1,3}(?:\\.\\d{1,3}){3}(?!\\d|\\.\\d)",
    "phone": "(?<!\\d)(?:\\+?\\d{1,3}[ .\\-]?)?(?:\\(\\d{3}\\)[ .\\-]?|\\d{3}[ .\\-])\\d{3}[ .\\-]\\d{4}(?!\\d)",
    "ssn": "(?<!\\d)\\d{3}-\\d{2}-\\d{4}(?!\\d)",
    "card": "(?<!\\d)(?:\\d{13,19}|\\d{4}(?<four>[ \\-])\\d{4}\\k<four>\\d{4}\\k<four>\\d{4}|\\d{4}(?<six>[ \\-])\\d{6}\\k<six>\\d{5})(?!\\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without one of these characters can hold none of the kinds but an AWS key.
GATE = "[0-9@=:]|AKIA"
#: Dates are permuted within the 400 years from here: 146097 days are 189 * 773.
EPOCH, DAYS_A, DAYS_B = "1700-01-01", 189, 773


def _round(key: str, kind: str, r: Column, half: Column) -> Column:
    """The round function: 60 bits of a keyed SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), r.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Permutes the pairs of 0 <= a < size_a, 0 <= b < size_b; a struct of the new a and b."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def step(x: Column, r: Column) -> Column:
        left = F.when(r % 2 == 0, F.pmod(x["a"] + F.pmod(_round(key, kind, r, x["b"]), size_a), size_a)).otherwise(x["a"])
        right = F.when(r % 2 == 1, F.pmod(x["b"] + F.pmod(_round(key, kind, r, x["a"]), size_b), size_b)).otherwise(x["b"])
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), n)).cast("bigint")


def permuted(key: str, kind: str, digits: Column) -> Column:
    """Two or more digits as as many other digits."""

    def of(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        a, b = F.substring(d, F.lit(1), u).cast("bigint"), F.substring(d, u + 1, n - u).cast("bigint")
        pair = feistel(key, kind, a, b, _power(u), _power(n - u))
        return _let(pair, lambda x: F.concat(F.lpad(x["a"].cast("string"), u, "0"), F.lpad(x["b"].cast("string"), n - u, "0")))

    return _let(digits, of)


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum; from the right, the places 0, 2, ... count doubled if odd is 0, else 1, 3, ..."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == odd, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), value), F.lit(0), lambda a, x: a + x)


def refilled(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced, in order, by `digits`."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))

    def step(a: Column, c: Column) -> Column:
        d = c.rlike("[0-9]")
        return F.struct((a["k"] + d.cast("int")).alias("k"), F.concat(a["s"], F.when(d, F.substring(digits, a["k"] + 1, F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(_chars(form), start, step, lambda a: a["s"])


def _card(key: str, m: Column) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d)
        body = permuted(key, "card", F.substring(d, F.lit(1), n - 1))
        new = _let(body, lambda x: F.concat(x, ((10 - _luhn_sum(x, 0) % 10) % 10).cast("string")))
        return F.when(_luhn_sum(d, 1) % 10 == 0, refilled(m, new)).otherwise(m)

    return _let(digits_of(m), of)


def _phone(key: str, m: Column) -> Column:
    """Numbers of the North American plan (no country code, or 1) have areas and exchanges from 200 up; those of other countries are permuted whole."""

    def of(d: Column) -> Column:
        head, own = F.substring(d, F.lit(1), F.length(d) - 10), F.substring(d, F.length(d) - 9, F.lit(10))
        area, exchange, line = (F.substring(own, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (4, 3), (7, 4)))
        pair = feistel(key, "phone", area - 200, (exchange - 200) * 10000 + line, F.lit(800), F.lit(8_000_000))
        dialled = _let(pair, lambda x: F.concat((x["a"] + 200).cast("string"), F.lpad((x["b"] + 2_000_000).cast("string"), 7, "0")))
        american, valid = head.isin("", "1"), (area >= 200) & (exchange >= 200)
        return F.when(american & ~valid, m).when(american, refilled(m, F.concat(head, dialled))).otherwise(refilled(m, F.concat(head, permuted(key, "phone", own))))

    return _let(digits_of(m), of)


def _ssn(key: str, m: Column) -> Column:
    """Areas are 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""

    def of(d: Column) -> Column:
        area, group, serial = (F.substring(d, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (4, 2), (6, 4)))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        pair = feistel(key, "ssn", area - 1 - (area > 666).cast("bigint"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
        areas = lambda a: a + 1 + (a >= 665).cast("bigint")
        shown = lambda v, n: F.lpad(v.cast("bigint").cast("string"), n, "0")
        new = _let(pair, lambda x: F.concat(shown(areas(x["a"]), 3), shown(F.floor(x["b"] / 9999) + 1, 2), shown(x["b"] % 9999 + 1, 4)))
        return F.when(valid, refilled(m, new)).otherwise(m)

    return _let(digits_of(m), of)


def _ip(key: str, m: Column) -> Column:
    def of(o: Column) -> Column:
        pair = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
        dotted = lambda x: F.concat_ws(".", *[v.cast("bigint").cast("string") for v in (F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)])
        return F.when(F.forall(o, lambda v: v < 256), _let(pair, dotted)).otherwise(m)

    return _let(F.transform(F.split(m, "[.]"), lambda v: v.cast("bigint")), of)


def _date(key: str, m: Column) -> Column:
    def of(d: Column) -> Column:
        kinds = [F.when(m.rlike("^[0-9]{4}[^0-9]"), F.lit("yyyyMMdd")), F.when(F.try_to_date(d, "MMddyyyy").isNotNull(), F.lit("MMddyyyy")), F.lit("ddMMyyyy")]
        out = m
        for form in ("ddMMyyyy", "MMddyyyy", "yyyyMMdd"):
            day = F.datediff(F.try_to_date(d, form), F.lit(EPOCH).cast("date"))
            inside = day.between(0, DAYS_A * DAYS_B - 1)
            pair = feistel(key, "date", F.floor(day / DAYS_B), day % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B))
            new = F.date_format(_let(pair, lambda x: F.date_add(F.lit(EPOCH).cast("date"), (x["a"] * DAYS_B + x["b"]).cast("int"))), form)
            out = F.when((F.coalesce(*kinds) == form) & F.coalesce(inside, F.lit(False)), refilled(m, new)).otherwise(out)
        return out

    return _let(digits_of(m), of)


def _digest(key: str, kind: str, value: Column, n: int) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), value), 256), 1, n)


def _secret(key: str, m: Column) -> Column:
    head = F.regexp_extract(m, "^((?i:password|passwd|pwd|token|secret|api[_-]?key)[ \\t]{0,3}[=:][ \\t]{0,3}[\"']?)", 1)
    return F.concat(head, F.lit("secret-"), _digest(key, "secret", F.substring(m, F.length(head) + 1, F.length(m)), 16))


def kind_of(m: Column) -> Column:
    """The first kind whose pattern takes all of a match."""
    out = F.lit("card")
    for name, p in reversed(list(PATTERNS.items())[:-1]):
        whole = p.replace("(?<!\\d)", "").replace("(?<![\\d.])", "").replace("(?!\\d|\\.\\d)", "").replace("(?!\\d)", "").replace("(?![A-Z0-9])", "")
        out = F.when(m.rlike(f"^(?:{whole})$"), F.lit(name)).otherwise(out)
    return out


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    """What stands in a text in place of the match `m` of a kind."""
    lower = F.lower(m)
    made = {
        "secret": _secret(key, m),
        "email": F.concat(F.lit("user-"), _digest(key, "email", lower, 16), F.lit("@mail.invalid")),
        "date": _date(key, m),
        "ip": _ip(key, m),
        "phone": _phone(key, m),
        "ssn": _ssn(key, m),
        "card": _card(key, m),
    }
    out = m
    for name, value in made.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def key_of(spark: SparkSession) -> str:
    """The key that the session's KEY_SETTING names, or the public one."""
    return spark.conf.get(KEY_SETTING, PUBLIC_KEY)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: bool = False) -> DataFrame:
    """The documents with their texts changed; with `count`, also n_<kind> columns of replaced values."""
    if len(key) < 16:
        raise ValueError("a key needs 16 characters")
    plain = common.Plain(docs)
    t, text = F.col("_pii_text"), plain.at(text)
    df = plain.df.withColumn("_pii_text", F.col(text).cast("string"))
    none = F.array().cast("array<string>")
    df = df.withColumn("_pii_found", F.when(t.rlike(GATE), F.regexp_extract_all(t, F.lit(ANY), 0)).otherwise(none))
    found = F.col("_pii_found")
    df = df.withColumn("_pii_parts", F.when(F.size(found) > 0, F.split(t, ANY, -1)))
    entry = lambda m: _let(kind_of(m), lambda k: F.struct(k.alias("kind"), m.alias("old"), pseudonym(key, k, m).alias("new")))
    df = df.withColumn("_pii_new", F.when(F.size(found) > 0, F.transform(found, entry)))
    new = F.col("_pii_new")
    pieces = F.zip_with("_pii_parts", F.transform(new, lambda x: x["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    out = {text: F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(t)}
    if count:
        of_kind = lambda k: F.coalesce(F.size(F.filter(new, lambda x: (x["kind"] == k) & (x["old"] != x["new"]))), F.lit(0)).cast("long")
        out |= {f"n_{k}": F.when(F.size(found) > 0, of_kind(k)).otherwise(F.lit(0)).cast("long") for k in PATTERNS}
    return plain.back(df.withColumns(out), *[c for c in out if c != text])


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents with its pseudonyms, and how many values of each kind were replaced."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key_of(spark), count=True)


SQL = None
