"""Format-preserving pseudonyms for personal data, by a keyed Feistel network. DataFrame functions only.

Card numbers (Luhn), social security numbers, phone numbers, IPv4 addresses and dates are found and validated; each
valid value is permuted among the values of its format, so that equal values get equal pseudonyms in every document and
different values different ones; a date has one pseudonym in all its forms. Separators and spelling stay. The name in an
e-mail address, which has no such format, becomes a keyed digest; its domain stays. The secret has to be given.

Defined results: a null text stays null with counts of 0; values that fail validation stay as they are; ids may be null
or repeated; an empty table gives an empty table; only id and text are read, so that clashing extra columns don't
matter. Texts are read whole, in linear time.
"""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROUNDS = 8

# The forms in which the data are written.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
PHONE = (
    r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{8,15}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9])(?<![0-9][.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![.-]?[0-9])"
)
SSN = r"(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]*[0-9])"
DATE = (
    r"(?<![0-9])(?<![0-9]-)[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-]*[0-9])|(?<![0-9])(?<![0-9]/)(?:[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2})(?![0-9/]*[0-9])"
    r"|(?<![0-9])(?<![0-9]\.)[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?!\.?[0-9])"
)
IP = r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
# Groups of digits with one separator are taken as a whole run; the cards (and phone numbers) in it are found by _run().
# A group that begins a value of another form ends the run. Possessive: a long run needs no stack.
_OTHER = r"(?![0-9]{3,4}[./-][0-9]{1,6}[./-][0-9]|[A-Za-z0-9._%+-]{1,64}@)"
CARD = (
    r"(?<![0-9])(?<![0-9][.-])(?:[0-9]{13,19}(?![0-9])"
    rf"|{_OTHER}[0-9]{{3,6}}(?: {_OTHER}[0-9]{{3,6}}(?![0-9])){{2,}}+|[0-9]{{4}}(?:-[0-9]{{4,6}}(?![0-9])){{2,}}+)"
)
KINDS = ("email", "phone", "ssn", "date", "ip", "card")
_ANY = EMAIL + "|(?=[0-9+(])(?:" + "|".join((PHONE, SSN, DATE, IP, CARD)) + ")"  # one look ahead settles most places
# 400 years of days: 4,800 months of 12 days, and 88,497 later days, as rectangles.
_FIRST_DAY, _YEARS, _EARLY, _LATE = "1800-01-01", 400, (240, 240), (9, 9833)


def _prf(key: str, kind: str, i: Column, value: Column) -> Column:
    """60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, rows: Column, columns: Column, kind: str, key: str) -> Column:
    """A struct (l, r): the keyed permutation of the pairs with 0 <= l < rows, 0 <= r < columns."""

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        new_left = F.when(even, F.pmod(acc["l"] + F.pmod(_prf(key, kind, i, acc["r"]), rows), rows)).otherwise(acc["l"])
        new_right = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(_prf(key, kind, i, acc["l"]), columns), columns))
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _padded(x: Column, n: Column) -> Column:
    """x in n digits."""
    return F.substring(F.concat(F.lit("0" * 19), x.cast("string")), -19, 19).substr(F.lit(20) - n, n)


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    out = feistel(digits.substr(F.lit(1), half), digits.substr(half + 1, n - half), _power(half), _power(n - half), kind, key)
    return F.concat(_padded(out["l"], half), _padded(out["r"], n - half))


def relaid(form: Column, digits: Column) -> Column:
    """form, with its digits replaced by the given ones."""
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("p"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(acc["t"], F.when(digit, digits.substr(acc["p"], F.lit(1))).otherwise(c)).alias("t"), (acc["p"] + digit.cast("int")).alias("p"))

    return F.aggregate(F.split(form, ""), start, step, lambda acc: acc["t"])


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Sum from the right; doubled_from: 1 to double the second digit (a whole number), 0 the first (without check digit)."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int") * F.when(i % 2 == doubled_from, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def _card_ok(digits: Column) -> Column:
    return (luhn_sum(digits, 1) % 10 == 0) & ~digits.rlike("^0+$")


def _card(x: Column, key: str) -> Column:
    d = _digits(x)
    front = permuted_digits(d.substr(F.lit(1), F.length(d) - 1), "card", key)
    # the front is computed once and closed by its check digit
    new = F.transform(F.array(front), lambda f: F.concat(f, ((F.lit(10) - luhn_sum(f, 0) % 10) % 10).cast("string")))[0]
    return relaid(x, new)


def _run(x: Column, key: str) -> Column:
    """A struct (kinds, text) of a run of groups of digits: each valid card in it, whatever groups stand before and after.

    A group that begins no card is given back and the next one is tried. Each group is marked with what begins there (a:
    a card of four groups, b: of three, c: of one, p: a phone number, d: nothing); an expression takes the marked groups
    from the left.
    """
    size = lambda g, i: F.coalesce(F.length(F.get(g, i)), F.lit(0))
    whole = lambda g, i, n: F.array_join(F.slice(g, i + 1, n), "")

    def card(g: Column, i: Column) -> Column:
        four = (size(g, i) == 4) & (size(g, i + 1) == 4) & (size(g, i + 2) == 4) & (size(g, i + 3) == 4)
        three = (size(g, i) == 4) & (size(g, i + 1) == 6) & size(g, i + 2).isin(4, 5)
        one = size(g, i) >= 13
        return F.when(four, F.when(_card_ok(whole(g, i, 4)), "a")).when(three, F.when(_card_ok(whole(g, i, 3)), "b")).when(one, F.when(_card_ok(F.get(g, i)), "c"))

    def mark(g: Column, cards: Column, i: Column) -> Column:
        phone = (size(g, i) == 3) & (size(g, i + 1) == 3) & (size(g, i + 2) == 4) & F.get(cards, i + 2).isNull() & ~x.contains("-")
        return F.coalesce(F.get(cards, i), F.when(phone, "p"), F.lit("d"))

    places = lambda g: F.sequence(F.lit(0), F.size(g) - 1)
    groups = F.split(x, "[ -]")
    held = F.transform(F.array(groups), lambda g: F.struct(g.alias("g"), F.transform(places(g), lambda i: card(g, i)).alias("cards")))
    marked = F.transform(held, lambda h: F.array_join(F.transform(places(h["g"]), lambda i: F.concat(mark(h["g"], h["cards"], i), F.get(h["g"], i))), " "))[0]
    tokens = F.regexp_extract_all(marked, F.lit("a[0-9]+(?: [a-dp][0-9]+){3}|[bp][0-9]+(?: [a-dp][0-9]+){2}|[cd][0-9]+"), F.lit(0))

    def made(token: Column) -> Column:
        plain = F.regexp_replace(token, "[a-dp]", "")
        kind = F.when(token.startswith("p"), F.when(_phone(plain, key)[0], "phone")).when(~token.startswith("d"), "card")
        return F.struct(kind.alias("kind"), F.when(kind == "phone", _phone(plain, key)[1]).when(kind == "card", _card(plain, key)).otherwise(plain).alias("text"))

    parts = F.transform(F.array(F.transform(tokens, made)), lambda t: F.struct(F.filter(t["kind"], lambda k: k.isNotNull()).alias("kinds"), F.array_join(t["text"], " ").alias("text")))[0]
    return F.transform(F.array(parts), lambda p: F.struct(p["kinds"].alias("kinds"), F.when(x.contains("-"), F.translate(p["text"], " ", "-")).otherwise(p["text"]).alias("text")))[0]


def _ssn(x: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = x.substr(1, 3).cast("int"), x.substr(5, 2).cast("int"), x.substr(8, 4).cast("int")
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn", key)
    text = F.transform(F.array(out), lambda o: F.concat_ws("-", _padded(o["l"] + 1 + (o["l"] >= 665).cast("int"), F.lit(3)), _padded(F.floor(o["r"] / 9999) + 1, F.lit(2)), _padded(o["r"] % 9999 + 1, F.lit(4))))[0]
    return ok, text


def _phone(x: Column, key: str) -> tuple[Column, Column]:
    d = _digits(x)
    n = F.length(d)
    kept = F.when(n > 10, n - 10).when(x.startswith("+"), 2).otherwise(0)  # the country's digits
    # 8 to 15 digits, a country that doesn't begin with 0, a number that isn't one digit repeated
    ok = n.between(8, 15) & ~x.rlike(r"^\+0") & ~d.substr(kept + 1, n - kept).rlike(r"^(\d)\1*$")
    return ok, relaid(x, F.concat(d.substr(F.lit(1), kept), permuted_digits(d.substr(kept + 1, n - kept), "phone", key)))


def _ip(x: Column, key: str) -> tuple[Column, Column]:
    o = F.transform(F.split(x, r"\."), lambda p: p.cast("int"))
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "ip", key)
    byte = lambda v: v.cast("string")
    text = F.transform(F.array(out), lambda p: F.concat_ws(".", byte(F.floor(p["l"] / 256)), byte(p["l"] % 256), byte(F.floor(p["r"] / 256)), byte(p["r"] % 256)))[0]
    return F.forall(o, lambda p: p < 256), text


def _early_day(n: Column, base: Column) -> Column:
    return F.date_add(F.add_months(base, F.floor(n / 12).cast("int")), (n % 12).cast("int"))


def _late_day(n: Column, base: Column) -> Column:
    """The n-th of the days after the 12th of their months: first the last month with no more than n before it."""
    before = lambda m: F.datediff(F.add_months(base, m), base) - 12 * m
    near = F.floor(n * (_YEARS * 12) / (_LATE[0] * _LATE[1])).cast("int")  # the months' sizes differ by less than one month in sum
    month = F.element_at(F.filter(F.sequence(near - 2, near + 2), lambda m: before(m) <= n), -1)
    return F.transform(F.array(month), lambda m: F.date_add(F.add_months(base, m), (12 + n - before(m)).cast("int")))[0]


def _date(x: Column, key: str) -> tuple[Column, Column]:
    """Days up to the 12th and later ones are permuted apart, so that a text that can only be month first stays one: no
    pseudonym of such a text is also that of a text with the day first, and a day has one pseudonym in every form."""
    day_first = x.substr(4, 2).cast("int") <= 12
    forms = [(x.contains("-"), "yyyy-MM-dd"), (x.contains(".") & day_first, "dd.MM.yyyy"), (x.contains("."), "MM.dd.yyyy"), (x.rlike("^[0-9]{4}/"), "yyyy/MM/dd"), (day_first, "dd/MM/yyyy"), (F.lit(True), "MM/dd/yyyy")]

    def by_form(made):
        return F.coalesce(*(F.when(is_, made(form)) for is_, form in forms))

    base = F.lit(_FIRST_DAY).cast("date")
    found = F.try_to_timestamp(x, by_form(F.lit)).cast("date")

    def made(day: Column) -> Column:
        month = (F.year(day) - F.year(base)) * 12 + F.month(day) - 1
        # early days are numbered by month and day, late ones by how many late days come before
        early, late = month * 12 + F.day(day) - 1, F.datediff(day, base) - 12 * (month + 1)
        first = F.day(day) <= 12
        new_early = feistel(F.floor(early / _EARLY[1]), early % _EARLY[1], F.lit(_EARLY[0]), F.lit(_EARLY[1]), "early", key)
        new_late = feistel(F.floor(late / _LATE[1]), late % _LATE[1], F.lit(_LATE[0]), F.lit(_LATE[1]), "late", key)
        number = F.when(first, new_early["l"] * _EARLY[1] + new_early["r"]).otherwise(new_late["l"] * _LATE[1] + new_late["r"])
        return F.transform(F.array(number), lambda n: F.when(first, _early_day(n, base)).otherwise(_late_day(n, base)))[0]

    ok = found.isNotNull() & (F.year(found) >= F.year(base)) & (F.year(found) < F.year(base) + _YEARS)
    new = F.transform(F.array(found), made)[0]
    return ok, F.transform(F.array(new), lambda d: by_form(lambda form: F.date_format(d, form)))[0]


def _email(x: Column, key: str) -> tuple[Column, Column]:
    return F.lit(True), F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key), F.lit(":email:"), F.lower(x)), 256), 1, 12), F.lit("@"), F.substring_index(x, "@", -1))


def _pseudonym(x: Column, key: str) -> Column:
    """A struct (kinds, text): the kinds of the values replaced in x; none where it is not valid, and the text as it was."""
    is_ = {"email": x.contains("@"), "phone": x.rlike(r"[(+]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), "ssn": x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "date": x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|/|^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), "ip": x.contains(".")}
    made = {"email": _email, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip}
    kept = F.struct(F.array().cast("array<string>").alias("kinds"), x.alias("text"))
    out = None
    for k in made:
        ok, text = made[k](x, key)
        one = F.when(F.coalesce(ok, F.lit(False)), F.struct(F.array(F.lit(k)).alias("kinds"), text.alias("text"))).otherwise(kept)
        out = F.when(is_[k], one) if out is None else out.when(is_[k], one)
    return out.otherwise(_run(x, key))


def configured_secret(spark: SparkSession) -> str:
    """The session's spark.loam.secret, or the environment's LOAM_SECRET; without either, one that is drawn for this
    session and kept in it, so that pseudonyms can't be inverted by whoever reads this file."""
    found = spark.conf.get("spark.loam.secret", None) or os.environ.get("LOAM_SECRET")
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set("spark.loam.secret", found)
    return found


def pseudonymised(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, text with pseudonyms, and n_<kind> values replaced, of each kind.

    Equal secrets give equal pseudonyms; whoever has the secret can invert them. An empty secret is an error.
    """
    if not secret:
        raise ValueError("pseudonyms need a secret")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    parts = rows.select("doc_id", "text", F.split("text", _ANY, -1).alias("gaps"), F.transform(F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)), lambda x: _pseudonym(x, secret)).alias("found"))
    joined = F.array_join(F.zip_with("gaps", "found", lambda g, f: F.concat(g, F.coalesce(f["text"], F.lit("")))), "")
    count = lambda kind: F.coalesce(F.size(F.filter(F.flatten("found.kinds"), lambda k: k == kind)), F.lit(0))
    counts = [count(k) for k in KINDS]
    return parts.select("doc_id", F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"), *(F.greatest(c, F.lit(0)).cast("long").alias(f"n_{k}") for c, k in zip(counts, KINDS)))
