"""Format-preserving pseudonyms: personal values are permuted within their format by a keyed Feistel network.

A value is a list of digits, each with a radix of its own: decimal digits of card and phone numbers, the four octets of
an address, letters and digits of an e-mail address, a day in two mixed digits. A network over the two halves of the list
adds keyed digests of one half to the other, digit by digit, so it is a permutation of all values of that format: equal
values get equal pseudonyms in every document, and different values different ones. Only Spark's own functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, as mixed digits of these two radices (17 * 4297 = 73,049 days).
FIRST_DAY, DAY_RADICES = "1900-01-01", (17, 4297)

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = (r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}"
        r"|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![/.-]?[0-9])")
PHONE = (r"(?<![0-9A-Za-z+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
         r"|(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[ .-][0-9]{4}"
         r"|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4})(?![0-9])")
CARD = (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}"
        r"|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{4} [0-9]{6} [0-9]{5})(?![0-9])")
SECURITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Every number starts with one of few characters, which is looked for first.
NUMBERS = "(?=[0-9+(])(?:" + "|".join([ADDRESS, DATE, PHONE, CARD, SECURITY]) + ")"
ANY = f"{EMAIL}|{NUMBERS}"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once: what stands inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permute(values: Column, radices: Column, key: str, tweak: Column) -> Column:
    """The Feistel network over the halves of a list of digits. tweak: values of one tweak form one permutation."""
    def add(side: Column, radix: Column, other: Column, name: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", name, F.array_join(F.transform(other, lambda v: v.cast("string")), ",")), 512)
        shifts = let(digest, lambda d: F.transform(side, lambda _, i: F.conv(
            F.substring(d, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")))
        return F.zip_with(F.zip_with(side, shifts, lambda v, x: v + x), radix, lambda v, r: F.pmod(v, r))

    def network(x: Column) -> Column:
        half = F.floor(F.size(x["v"]) / 2).cast("int")
        rest = F.size(x["v"]) - half

        def turn(state: Column, step: Column) -> Column:
            name = F.concat_ws("|", F.lit(key), x["t"], step.cast("string"))
            return F.when(step % 2 == 0, F.struct(
                add(state["l"], state["rl"], state["r"], name).alias("l"), state["r"].alias("r"), state["rl"].alias("rl"), state["rr"].alias("rr"),
            )).otherwise(F.struct(
                state["l"].alias("l"), add(state["r"], state["rr"], state["l"], name).alias("r"), state["rl"].alias("rl"), state["rr"].alias("rr")))

        start = F.struct(F.slice(x["v"], F.lit(1), half).alias("l"), F.slice(x["v"], half + 1, rest).alias("r"),
                         F.slice(x["r"], F.lit(1), half).alias("rl"), F.slice(x["r"], half + 1, rest).alias("rr"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))

    return let(F.struct(values.alias("v"), radices.alias("r"), tweak.alias("t")), network)


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def digits(text: Column) -> Column:
    return F.transform(letters(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def fill(text: Column, what: str, new: Column) -> Column:
    """The text with its characters of the class `what` replaced by those of the list, in order."""
    def filled(n: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.length(F.regexp_replace(F.substring(text, F.lit(1), i), f"[^{what}]", ""))
            return F.when(c.rlike(f"^[{what}]$"), F.get(n, before)).otherwise(c)

        return F.array_join(F.transform(letters(text), one), "")

    return let(new, filled)


def luhn(values: Column) -> Column:
    """Weighted digit sum; a number is valid if it is a multiple of ten."""
    weighed = F.transform(F.reverse(values), lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(weighed, F.lit(0), lambda a, v: a + v)


def strings(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("string"))


def tens(values: Column) -> Column:
    return F.transform(values, lambda v: F.lit(10))


def card(m: Column, key: str) -> Column:
    """The first digit, which names the kind of card, stays; the check digit is computed anew."""
    def number(d: Column) -> Column:
        inner = F.slice(d, F.lit(2), F.size(d) - 2)
        head = F.concat(F.slice(d, 1, 1), permute(inner, tens(inner), key, F.concat(F.lit("card"), F.get(d, F.lit(0)))))
        return let(head, lambda h: F.concat(h, F.array(F.pmod(10 - luhn(F.concat(h, F.array(F.lit(0)))) % 10, F.lit(10)))))

    return fill(m, "0-9", strings(let(digits(m), number)))


def phone(m: Column, key: str) -> Column:
    """Ten national digits, the first of area and exchange within 2 to 9; abroad all but the country's first two."""
    home = ~m.rlike(r"^\+[2-9]")

    def number(d: Column) -> Column:
        kept = F.when(home, F.size(d) - 10).otherwise(2)

        def own(x: Column) -> Column:
            lead = lambda v, i: home & i.isin(0, 3) & (v >= 2)
            # a leading 0 or 1 is no valid start: it has radix 1 and stays
            radix = F.transform(x, lambda v, i: F.when(lead(v, i), 8).when(home & i.isin(0, 3), 1).otherwise(10))
            base = F.transform(x, lambda v, i: F.when(lead(v, i), 2).when(home & i.isin(0, 3), v).otherwise(0))
            value = F.zip_with(x, base, lambda v, b: v - b)
            return F.zip_with(permute(value, radix, key, F.lit("phone")), base, lambda v, b: v + b)

        return F.concat(F.slice(d, F.lit(1), kept), let(F.slice(d, kept + 1, F.size(d) - kept), own))

    return fill(m, "0-9", strings(let(digits(m), number)))


def address(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    return F.array_join(strings(permute(octets, F.transform(octets, lambda o: F.lit(256)), key, F.lit("address"))), ".")


def security(m: Column, key: str) -> Column:
    """The first digit stays."""
    def number(d: Column) -> Column:
        rest = F.slice(d, F.lit(2), F.size(d) - 1)
        return F.concat(F.slice(d, 1, 1), permute(rest, tens(rest), key, F.lit("security")))

    return fill(m, "0-9", strings(let(digits(m), number)))


def email(m: Column, key: str) -> Column:
    """Letters and digits before the last label, each within its class."""
    body = F.regexp_extract(m, r"^(.*)\.", 1)
    code = F.transform(letters(F.regexp_replace(body, "[^A-Za-z0-9]", "")), F.ascii)

    def chars(c: Column) -> Column:
        base = F.transform(c, lambda x: F.when(x < 58, 48).when(x < 91, 65).otherwise(97))
        value = F.zip_with(c, base, lambda x, b: x - b)
        new = permute(value, F.transform(base, lambda b: F.when(b == 48, 10).otherwise(26)), key, F.lit("email"))
        return F.transform(F.zip_with(new, base, lambda v, b: v + b), F.chr)

    return F.concat(fill(body, "A-Za-z0-9", let(code, chars)), F.substring(m, F.length(body) + 1, F.length(m)))


def date_fields(m: Column) -> tuple[Column, Column, Column, Column]:
    """Year, month, day and whether the month stands first. A slashed date is read day first if that is possible."""
    number = lambda p: F.regexp_extract(m, p, 1).cast("int")
    year_first = m.rlike("^[0-9]{4}")
    year = F.when(year_first, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4)).cast("int")
    one = F.when(year_first, F.substring(m, 6, 2)).otherwise(F.substring(m, 1, 2)).cast("int")
    two = F.when(year_first, F.substring(m, 9, 2)).otherwise(F.substring(m, 4, 2)).cast("int")
    month_first = ~year_first & (two > 12) & m.contains("/")
    ahead = year_first | month_first
    return year, F.when(ahead, one).otherwise(two), F.when(ahead, two).otherwise(one), month_first


def is_date(m: Column) -> Column:
    year, month, day, _ = date_fields(m)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return m.rlike(f"^(?:{DATE})$") & year.between(1900, 2099) & month.between(1, 12) & day.between(1, last)


def date(m: Column, key: str) -> Column:
    year, month, day, month_first = date_fields(m)
    n = F.date_diff(F.make_date(year, month, day), F.lit(FIRST_DAY).cast("date"))
    a, b = DAY_RADICES
    new = permute(F.array(F.floor(n / b).cast("int"), (n % b).cast("int")), F.array(F.lit(a), F.lit(b)), key, F.lit("date"))
    day = let(new, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(x, F.lit(0)) * b + F.get(x, F.lit(1))))
    return let(day, lambda to: F.when(m.contains("-"), F.date_format(to, "yyyy-MM-dd"))
               .when(m.rlike("^[0-9]{4}/"), F.date_format(to, "yyyy/MM/dd")).when(m.contains("."), F.date_format(to, "dd.MM.yyyy"))
               .when(month_first, F.date_format(to, "MM/dd/yyyy")).otherwise(F.date_format(to, "dd/MM/yyyy")))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a matched string, or null if it is no valid value of any kind."""
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    octets = F.forall(F.split(m, r"\."), lambda o: o.rlike("^(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    area = F.substring(m, 1, 3)
    return (F.when(m.contains("@"), email(m, key))
            .when(m.rlike(f"^(?:{ADDRESS})$"), F.when(octets, address(m, key)))
            .when(is_date(m), date(m, key))
            .when(m.rlike(f"^(?:{PHONE})$") & n.between(8, 15), phone(m, key))
            .when(m.rlike(f"^(?:{CARD})$"), F.when(luhn(digits(m)) % 10 == 0, card(m, key)))
            .when(m.rlike(f"^(?:{SECURITY})$") & ~area.isin("000", "666") & (area < "900")
                  & ~m.rlike("-00-|-0000$"), security(m, key)))


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", count: str | None = None) -> DataFrame:
    """The same rows and columns, with personal values in the whole text replaced by pseudonyms under the key.

    Kinds: e-mail addresses, IPv4 addresses with octets up to 255, dates from 1900 to 2099, telephone numbers, card
    numbers that pass the Luhn test, US social security numbers. Texts without a valid value stay byte for byte; a null
    text stays null. Rows are independent, so nulls, repeated rows, other columns and empty tables need no case of
    their own. count: the name of an added column with the number of replaced values (0 for null).
    """
    taken = set(docs.columns)
    found, parts, new = (next(n for n in (f"_{x}" + "_" * i for i in range(99)) if n not in taken)
                         for x in ("found", "parts", "new"))
    mail, has = F.contains(F.col(text), F.lit("@")), F.col(text).rlike("[0-9]")  # a text with neither has no value
    none = F.array().cast("array<string>")
    out = (docs.withColumn(found, F.when(mail, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
                           .when(has, F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0))).otherwise(none))
           .withColumn(new, F.transform(found, lambda m: pseudonym(m, key)))
           .withColumn(parts, F.when(F.size(found) == 0, none).when(mail, F.split(text, ANY, -1)).otherwise(F.split(text, NUMBERS, -1))))
    whole = let(F.struct(F.col(found).alias("f"), F.col(new).alias("n")), lambda x: F.array_join(F.transform(
        parts, lambda p, i: F.concat(p, F.coalesce(F.get(x["n"], i), F.get(x["f"], i), F.lit("")))), ""))
    out = out.withColumn(text, F.when(F.size(found) > 0, whole).otherwise(F.col(text)))
    if count:
        out = out.withColumn(count, F.size(F.filter(new, lambda x: x.isNotNull())).cast("long"))
    return out.drop(found, parts, new)
