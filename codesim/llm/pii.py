"""Format-preserving pseudonyms by a keyed Feistel network.  DataFrame functions only.

Found: card numbers (Luhn), phone numbers (North American form, whatever their codes), IPv4 addresses, social security numbers
and calendar dates, each only where it is valid, and e-mail addresses.  A value is read as a number
of its kind's domain Z_a x Z_b, permuted by ``ROUNDS`` alternating rounds x += PRF(key, kind, round, y) and written in
the format it was found in, so the result is valid again: cards keep length, first digit, separators and get their check
digit; dates stay in the 400-year cycle from 1800 on (189 * 773 days); e-mails keep their domain and the kinds of characters.
Cards are looked for in every stretch of digit groups a blank or hyphen apart, at every group and length, so that numbers beside a
card don't hide it.  The permutation depends on key and value alone: equal values get equal pseudonyms in
every document, whatever the separators, without any join; different values stay different.

Defined results: null and empty texts stay as they are; repeated rows get equal results; invalid look-alikes
(a failed check digit, the 31st of June) stay; an empty table gives an empty result; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)*"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9])(?:(?:1[89]|2[01])[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([/.])(?:0[1-9]|1[0-2])\2(?:1[89]|2[01])[0-9]{2})(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
DATE_IN = DATE.replace(r"\1", r"\3").replace(r"\2", r"\4")
#: Groups of digits, a blank or hyphen apart, up to the first that begins a value of another kind.  In ``ANY`` its dates' groups are 3 and 4.
STRETCH = rf"(?<![0-9])(?=(?:[0-9][ -]?){{12}}[0-9])[0-9]++(?:[ -](?!{'|'.join((MAIL, IP, SSN, DATE_IN, PHONE))})[0-9]++)*+"
ANY = "|".join((MAIL, IP, SSN, DATE, PHONE, STRETCH))
#: Digits in the groups of cards as they are printed; one unbroken group is the other usual form.
PRINTED = ("4,4,4,4", "4,6,5")
KINDS = ("mail", "ip", "ssn", "date", "phone", "card")


def _prf(key: str, kind: str, i: Column, x: Column) -> Column:
    """60 keyed bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(x: Column, a, b, key: str, kind: str, tweak: Column | None = None) -> Column:
    """The keyed permutation of 0 .. a * b - 1 at ``x``; a and b up to 10^9.  ``tweak`` chooses among permutations."""
    tweak = F.lit("") if tweak is None else tweak
    a, b = (v if isinstance(v, Column) else F.lit(v) for v in (a, b))
    a, b = a.cast("long"), b.cast("long")

    def step(s, i):
        left = F.pmod(s["l"] + F.pmod(_prf(key, kind, i, F.concat_ws(":", tweak, s["r"].cast("string"))), a), a)
        right = F.pmod(s["r"] + F.pmod(_prf(key, kind, i, F.concat_ws(":", tweak, s["l"].cast("string"))), b), b)
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _number(c: Column) -> Column:
    return c.cast("long")


def _in_format(found: Column, digits: Column) -> Column:
    """``digits`` written where ``found`` has digits, all else as it is."""
    seats = F.split(found, "")
    fill = F.aggregate(seats, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])
    return fill


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0") if isinstance(n, Column) else "0")


def _weighted(digits: Column) -> Column:
    """Luhn sum of digits that a check digit is to follow."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _check_digit(payload: Column) -> Column:
    return F.pmod(10 - F.pmod(_weighted(payload), F.lit(10)), F.lit(10)).cast("string")


def _tail(c: Column, at) -> Column:
    return F.substr(c, F.lit(at) if isinstance(at, int) else at, F.length(c))


def _card(x: Column, key: str) -> Column:
    d = _digits(x)
    first, middle = F.substr(d, F.lit(1), F.lit(1)), F.substr(d, F.lit(2), F.length(d) - 2)
    n = F.length(middle)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    mixed = _pad(feistel(_number(middle), power(n - half), power(half), key, "card", F.concat(first, n.cast("string"))), n)
    payload = F.concat(first, mixed)
    valid = F.substr(d, F.length(d), F.lit(1)) == _check_digit(F.substr(d, F.lit(1), F.length(d) - 1))
    return F.when(valid, _in_format(x, F.concat(payload, _check_digit(payload))))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cards_apart(x: Column) -> Column:
    """A stretch cut into (value, kind): its cards and what stands between them, in order.  Every run of whole groups with a
    valid check digit counts; from the left, those as printed come first, then the longest of the others that hold none of these."""
    entry = lambda v, k: F.struct(v.alias("value"), F.lit(k).cast("string").alias("kind"))

    def valid(d: Column) -> Column:
        return F.when(~F.length(d).between(13, 19), False).otherwise(F.substr(d, F.length(d), F.lit(1)) == _check_digit(F.substr(d, F.lit(1), F.length(d) - 1)))

    def of_groups(g: Column) -> Column:
        n = F.size(g)
        joined = lambda i, k: F.array_join(F.slice(g, i, k), "")
        printed = lambda i, k: (k == 1) | F.array_join(F.transform(F.slice(g, i, k), lambda w: F.length(w).cast("string")), ",").isin(*PRINTED)
        runs = lambda i: F.filter(F.sequence(F.lit(1), F.least(F.lit(19), n - i + 1)), lambda k: valid(joined(i, k)))
        starts = F.transform(F.sequence(F.lit(1), n), lambda i: _let(runs(i), lambda ks: F.struct(i.alias("i"), ks.alias("all"), F.filter(ks, lambda k: printed(i, k)).alias("printed"))))

        def of_starts(s: Column) -> Column:
            def longest(a: Column) -> Column:
                return F.coalesce(F.array_max(F.filter(a["all"], lambda k: ~F.exists(F.slice(s, a["i"] + 1, k - 1), lambda b: F.size(b["printed"]) > 0))), F.lit(0))

            first = F.struct(F.lit(1).alias("free"), F.array().cast("array<struct<i:int,k:int>>").alias("cuts"))
            taken = lambda t, a: _let(F.when(a["i"] < t["free"], 0).when(F.size(a["printed"]) > 0, F.array_max(a["printed"])).when(F.size(a["all"]) > 0, longest(a)).otherwise(0), lambda k: F.when(k > 0, F.struct((a["i"] + k).alias("free"), F.concat(t["cuts"], F.array(F.struct(a["i"].alias("i"), k.alias("k")))).alias("cuts"))).otherwise(t))
            return F.aggregate(s, first, taken, lambda t: t["cuts"])

        # the place of a group's first character
        place = lambda i: F.when(i == 1, 1).otherwise(F.length(F.array_join(F.slice(g, 1, i - 1), " ")) + 2)
        size = lambda c: F.length(F.array_join(F.slice(g, c["i"], c["k"]), " "))
        spots = lambda cuts: F.transform(cuts, lambda c: F.struct(place(c["i"]).alias("at"), size(c).alias("n")))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<value:string,kind:string>>").alias("out"))
        add = lambda t, c: F.struct((c["at"] + c["n"]).alias("at"), F.concat(t["out"], F.array(entry(F.substr(x, t["at"], c["at"] - t["at"]), None), entry(F.substr(x, c["at"], c["n"]), "card"))).alias("out"))
        return _let(_let(starts, of_starts), lambda cuts: F.aggregate(spots(cuts), start, add, lambda t: F.concat(t["out"], F.array(entry(_tail(x, t["at"]), None)))))

    return _let(F.split(x, "[ -]"), of_groups)


def _phone(x: Column, key: str) -> Column:
    d = _digits(x)
    country, local = F.substr(d, F.lit(1), F.length(d) - 10), _tail(d, F.length(d) - 9)
    part = lambda at, n: F.substr(local, F.lit(at), F.lit(n)).cast("long")
    # codes under 200, which the numbering plan lacks, have a domain of their own: a valid number stays valid
    area, exchange = part(1, 3), part(4, 3)
    least = lambda c: F.when(c < 200, 0).otherwise(200).cast("long")
    size = lambda c: F.when(c < 200, 200).otherwise(800).cast("long")
    tweak = F.concat(F.when(area < 200, "a").otherwise(""), F.when(exchange < 200, "e").otherwise(""))
    y = feistel(((area - least(area)) * size(exchange) + exchange - least(exchange)) * 10_000 + part(7, 4), size(area) * 100, size(exchange) * 100, key, "phone", tweak)
    codes = F.floor(y / 10_000)
    out = F.concat(_pad(F.floor(codes / size(exchange)) + least(area), 3), _pad(F.pmod(codes, size(exchange)) + least(exchange), 3), _pad(F.pmod(y, F.lit(10_000)), 4))
    return _in_format(x, F.concat(country, out))


def _ip(x: Column, key: str) -> Column:
    octets = F.split(x, r"\.")
    y = feistel(F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long")), 65_536, 65_536, key, "ip")
    return F.concat_ws(".", *(F.pmod(F.floor(y / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)))


def _ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.element_at(F.split(x, "-"), i).cast("long") for i in (1, 2, 3))
    y = feistel(((F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1) * 9_999 + serial - 1, 898 * 99, 9_999, key, "ssn")
    place = F.floor(y / (99 * 9_999))
    area = F.when(place >= 665, place + 2).otherwise(place + 1)
    return F.concat_ws("-", _pad(area, 3), _pad(F.pmod(F.floor(y / 9_999), F.lit(99)) + 1, 2), _pad(F.pmod(y, F.lit(9_999)) + 1, 4))


def _date(x: Column, key: str) -> Column:
    year_first = x.rlike("^[0-9]{4}")
    d = _digits(x)
    iso = F.when(year_first, F.concat_ws("-", F.substr(d, F.lit(1), F.lit(4)), F.substr(d, F.lit(5), F.lit(2)), F.substr(d, F.lit(7), F.lit(2)))).otherwise(F.concat_ws("-", F.substr(d, F.lit(5), F.lit(4)), F.substr(d, F.lit(3), F.lit(2)), F.substr(d, F.lit(1), F.lit(2))))
    day = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    out = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(day, *DAYS, key, "date").cast("int")).cast("string")
    out = _digits(out)
    out = F.when(year_first, out).otherwise(F.concat(F.substr(out, F.lit(7), F.lit(2)), F.substr(out, F.lit(5), F.lit(2)), F.substr(out, F.lit(1), F.lit(4))))
    return F.when(day.isNotNull(), _in_format(x, out))


def _mail(x: Column, key: str) -> Column:
    """Feistel on the halves of the local part: every letter or digit of one half is shifted, within its
    kind, by the digest of the other."""
    name, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    half = F.ceil(F.length(name) / 2).cast("int")

    def shifted(part: Column, other: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), i.cast("string"), F.lower(domain), other).cast("binary"), 256)
        by = lambda at: F.conv(F.substr(digest, 2 * at + 1, F.lit(2)), 16, 10).cast("int")  # noqa: E731  a half has at most 32 characters
        turn = lambda c, at, first, n: F.char(F.pmod(F.ascii(c) - first + by(at), F.lit(n)) + first)
        each = F.transform(F.split(part, ""), lambda c, at: F.when(c.rlike("^[a-z]"), turn(c, at, 97, 26)).when(c.rlike("^[A-Z]"), turn(c, at, 65, 26)).when(c.rlike("^[0-9]"), turn(c, at, 48, 10)).otherwise(c))
        return F.when(part == "", part).otherwise(F.array_join(each, ""))

    def step(s, i):
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(shifted(s["r"], s["l"], i)).alias("r"))

    start = F.struct(F.substr(name, F.lit(1), half).alias("l"), _tail(name, half + 1).alias("r"))
    mixed = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))
    return F.concat(mixed, F.lit("@"), domain)


def kind(x: Column) -> Column:
    out = F.when(F.contains(x, F.lit("@")), "mail")
    for name, pattern in zip(KINDS[1:], (IP, SSN, DATE, PHONE, CARD)):
        out = out.when(x.rlike(rf"^(?:{pattern})$"), name)
    return out


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of a value of any kind; null where it isn't valid."""
    return _pseudonym(x, kind(x), key)


def _pseudonym(x: Column, k: Column, key: str) -> Column:
    return F.when(k == "mail", _mail(x, key)).when(k == "ip", _ip(x, key)).when(k == "ssn", _ssn(x, key)).when(k == "date", _date(x, key)).when(k == "phone", _phone(x, key)).when(k == "card", _card(x, key))


def found(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with _found: for each match of ``ANY``, in the text's order, an array of (value, kind, pseudonym or null).  A stretch is
    cut into its cards and what stands between them, which has no kind; any other match is one value."""
    rows = docs.withColumn("__pii_match", F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0)))
    parts = lambda x: _let(kind(x), lambda k: F.when(k.isNull() | (k == "card"), _cards_apart(x)).otherwise(F.array(F.struct(x.alias("value"), k.alias("kind")))))
    entry = lambda v: F.struct(v["value"].alias("value"), v["kind"].alias("kind"), _pseudonym(v["value"], v["kind"], key).alias("pseudonym"))
    return rows.withColumn("__pii_found", F.when(F.size("__pii_match") > 0, F.transform("__pii_match", lambda x: F.transform(parts(x), entry)))).drop("__pii_match")


def _rewritten() -> Column:
    between = F.split(F.col("text"), ANY, -1)
    new = F.transform(F.col("__pii_found"), lambda m: F.array_join(F.transform(m, lambda f: F.coalesce(f["pseudonym"], f["value"])), ""))
    text = F.concat_ws("", F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    return F.when(F.size("__pii_found") > 0, text).otherwise(F.col("text")).alias("text")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` rewritten; columns and their order stay."""
    return found(docs, key).withColumn("text", _rewritten()).select(*docs.columns)


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (rewritten) and the number of replaced values of each kind."""
    rows = found(docs.select("doc_id", "text"), key)
    n = lambda k: F.coalesce(F.size(F.filter(F.flatten("__pii_found"), lambda f: (f["kind"] == k) & f["pseudonym"].isNotNull())), F.lit(0)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", _rewritten(), *(n(k) for k in KINDS))
