"""Format-preserving pseudonyms for personal data, in DataFrame functions throughout.

One pattern finds candidates of all kinds in a text. Card numbers (Luhn), calendar dates, IPv4 addresses, social security and telephone
numbers that pass their validation are numbers of a finite range, on which a keyed Feistel network permutes: equal values become equal
pseudonyms in all documents, different ones stay different, and the result is a valid value of the same form with the same separators. The
check digit of a card follows from the permuted digits. An e-mail address is no number: its local part becomes a keyed hash of the whole
address, which links documents in the same way, and its domain example.com.

Defined cases: null texts stay null, empty ones empty; candidates that fail their validation stay as they are (no Luhn digit, no such day,
an octet over 255); a date between slashes is day-first where that is a date, else month-first; documents with neither a digit nor an @ are not searched. Rows are independent, so copies get the same text. An empty table
gives an empty result. ``pseudonymise`` keeps all columns of its input, whatever their names, and replaces only ``text``; the kinds found
come as an array of the name the caller gives.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkraster.llm.common import let, table, unused

KEY, ROUNDS, WALK = "change-me", 8, 128  # 2 in 5 days are before the 13th: a walk is longer once in 10^28 times
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 73,049 days, up to 2099-12-31

PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d/-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{2}\.\d{2}\.\d{4}|(?<!\.)\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-. ]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
}
#: Groups of digits over single blanks or hyphens with 13 digits or more, up to where something of another kind begins; card_parts looks for cards in them.
PATTERNS["card"] = r"(?<![\d.-])(?=\d(?:[ -]?\d){12})\d++(?!-(?!\d))(?:[ -](?!" + "|".join(PATTERNS.values()) + r")\d++(?!-(?!\d)))*+"
#: Groupings of cards: unbroken, 4-6-5 and 4-6-4, 4-4-4-4 with or without a last group.
SHAPES = r"^(?:\d{13,19}|\d{4}([ -])\d{6}\1\d{4,5}|\d{4}([ -])\d{4}\2\d{4}\2\d{4}(?:\2\d{1,3})?)$"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
WHOLE = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}


def draw(key: str, kind: str, step: Column, half: Column, below: Column) -> Column:
    """The round function: a keyed hash of the other half as a number under ``below``."""
    h = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string"), below.cast("string")), 256), 1, 15)
    return F.pmod(F.conv(h, 16, 10).cast("long"), below)


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, kind: str, key: str) -> Column:
    """A struct (l, r): the pair permuted among all pairs under (n_left, n_right). Each round adds to one half what the other draws."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(a: Column, i: Column) -> Column:
        odd = F.struct(a["l"].alias("l"), F.pmod(a["r"] + draw(key, kind, i, a["l"], n_right), n_right).alias("r"))
        even = F.struct(F.pmod(a["l"] + draw(key, kind, i, a["r"], n_left), n_left).alias("l"), a["r"].alias("r"))
        return F.when(i % 2 == 1, odd).otherwise(even)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """A string of up to 36 digits as another of the same length."""
    def run(d: Column) -> Column:
        n = F.length(d)
        k = F.floor(n / 2).cast("int")
        f = feistel(F.substring(d, F.lit(1), k), F.substring(d, k + 1, n - k), power(k), power(n - k), kind, key)
        return let(f, lambda x: F.concat(F.lpad(x["l"].cast("string"), k, "0"), F.lpad(x["r"].cast("string"), n - k, "0")))
    return let(digits, run)


def luhn_sum(digits: Column) -> Column:
    """Of digits before the check digit: every second from the right is doubled."""
    return F.aggregate(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
                       lambda a, c: F.struct((a["i"] + 1).alias("i"), (a["s"] + let(c.cast("int") * F.when(a["i"] % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))).alias("s")),
                       lambda a: a["s"])


def refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits`` in order."""
    return let(digits, lambda d: F.aggregate(F.split(form, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("o")), lambda a, c: F.when(
        c.rlike("^[0-9]$"), F.struct((a["i"] + 1).alias("i"), F.concat(a["o"], F.substring(d, a["i"], F.lit(1))).alias("o"))).otherwise(
        F.struct(a["i"].alias("i"), F.concat(a["o"], c).alias("o"))), lambda a: a["o"]))


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def day_of(x: Column) -> Column:
    """Days since FIRST_DAY: year first, else day first, else, between slashes, month first; null if there is no such day."""
    def day(y: Column, m: Column, d: Column) -> Column:
        return F.datediff(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    return let(F.split(x, "[-/.]"), lambda p: F.when(x.rlike(r"^\d{4}-"), day(p[0], p[1], p[2])).otherwise(
        F.coalesce(day(p[2], p[1], p[0]), F.when(x.contains("/"), day(p[2], p[0], p[1])))))


def permuted_day(day: Column, key: str) -> Column:
    """Another date for a day number. Days after the 12th stay among themselves, or a month-first date could become one that reads as
    day-first: the permutation of all days is repeated until the result is on the right side."""
    a, b = (F.lit(n).cast("long") for n in DAYS)

    def date(d: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), d.cast("int"))

    def next_(d: Column) -> Column:
        return let(feistel(F.floor(d / b), F.pmod(d, b), a, b, "date", key), lambda f: f["l"] * b + f["r"])
    late = F.dayofmonth(date(day)) > 12
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(day.cast("long").alias("d"), F.lit(False).alias("there")), lambda s, i: F.when(s["there"], s).otherwise(
        let(next_(s["d"]), lambda d: F.struct(d.alias("d"), ((F.dayofmonth(date(d)) > 12) == late).alias("there")))))
    return date(walk["d"])


def date_like(x: Column, day: Column) -> Column:
    """``day`` in the order, separators and padding of ``x``."""
    def part(old: Column, new: Column) -> Column:
        return F.when(F.length(old) == 2, F.lpad(new.cast("string"), 2, "0")).otherwise(new.cast("string"))

    def write(p: Column, d: Column) -> Column:
        y, m, n = F.year(d).cast("string"), F.month(d), F.dayofmonth(d)
        return (F.when(x.rlike(r"^\d{4}-"), F.concat_ws("-", y, part(p[1], m), part(p[2], n)))
                .when(x.rlike(r"^\d+/(?:1[3-9]|[23]\d)/"), F.concat_ws("/", part(p[0], m), part(p[1], n), y))
                .when(x.contains("/"), F.concat_ws("/", part(p[0], n), part(p[1], m), y)).otherwise(F.concat_ws(".", part(p[0], n), part(p[1], m), y)))
    return let(F.split(x, "[-/.]"), lambda p: let(day, lambda d: write(p, d)))


def octets(x: Column) -> Column:
    return F.transform(F.split(x, r"\."), lambda o: o.cast("int"))


def kind_of(x: Column) -> Column:
    """The kind of a candidate that passes its validation, else null."""
    digits = only_digits(x)
    return (F.when(x.rlike(WHOLE["email"]), "email")
            .when(x.rlike(WHOLE["ip"]), F.when(F.forall(octets(x), lambda o: o <= 255), "ip"))
            .when(x.rlike(WHOLE["date"]), F.when(day_of(x).between(0, DAYS[0] * DAYS[1] - 1), "date"))
            .when(x.rlike(WHOLE["ssn"]), F.when(~x.rlike("^(000|666|9..)|-00-|-0000$"), "ssn"))
            .when(x.rlike(WHOLE["phone"]), F.when(F.length(digits).between(7, 15), "phone")))


def is_luhn(x: Column) -> Column:
    return F.pmod(let(only_digits(x), lambda d: luhn_sum(F.substring(d, F.lit(1), F.length(d) - 1)) + F.substring(d, -1, 1).cast("int")), F.lit(10)) == 0


def card_parts(x: Column) -> Column:
    """The pieces (k, x) of groups of digits, in order; k is card for cards. Every group may begin a card of a usual grouping. Of what is left,
    as many groups as hold 13 to 19 digits, none of them 13 by itself, are held to be one number, which is a card if it is valid."""
    def joined(t: Column, i: Column, m: Column) -> Column:
        return F.concat(t[i - 1]["d"], F.array_join(F.transform(F.slice(t, i + 1, m - 1), lambda e: F.concat(e["p"], e["d"])), ""))

    def usual(t: Column, i: Column) -> Column:
        fits = F.filter(F.array(*map(F.lit, (1, 3, 4, 5))), lambda m: let(joined(t, i, m), lambda y: y.rlike(SHAPES) & is_luhn(y)))
        return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))

    def other(t: Column, u: Column, i: Column) -> Column:
        def fits(m: Column) -> Column:
            n = F.aggregate(F.slice(t, i, m), F.lit(0), lambda a, e: a + F.length(e["d"]))
            return (i + m - 1 <= F.size(t)) & n.between(13, 19) & F.forall(F.slice(t, i, m), lambda e: F.length(e["d"]) < 13) & F.forall(F.slice(u, i, m), lambda k: k == 0)
        return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(2), F.lit(19)), fits)), F.lit(0))

    def cards(t: Column, u: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            def state(m: Column, card: Column) -> Column:
                return F.struct((i + F.greatest(m, F.lit(1))).alias("next"), F.when(card, F.concat(s["c"], F.array(F.struct(i.alias("i"), m.alias("m"))))).otherwise(s["c"]).alias("c"))
            return F.when(i < s["next"], s).when(u[i - 1] > 0, state(u[i - 1], F.lit(True))).otherwise(
                let(other(t, u, i), lambda m: state(m, F.when(m > 0, is_luhn(joined(t, i, m))).otherwise(F.lit(False)))))
        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<i:int,m:int>>").alias("c"))
        return F.aggregate(F.sequence(F.lit(1), F.size(t)), start, step, lambda s: s["c"])

    def pieces(t: Column, c: Column) -> Column:
        def piece(i: Column) -> Column:
            gap = F.struct(F.lit(None).cast("string").alias("k"), t[i - 1]["p"].alias("x"))
            mine = F.filter(c, lambda e: (e["i"] <= i) & (i < e["i"] + e["m"]))
            return let(F.get(mine, F.lit(0)), lambda e: F.when(e.isNull(), F.array(gap, F.struct(F.lit(None).cast("string").alias("k"), t[i - 1]["d"].alias("x"))))
                       .when(e["i"] == i, F.array(gap, F.struct(F.lit("card").alias("k"), joined(t, i, e["m"]).alias("x")))).otherwise(F.array().cast("array<struct<k:string,x:string>>")))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(t)), piece))
    gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all(x, F.lit("[ -]"), F.lit(0)))
    groups = F.zip_with(gaps, F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), lambda p, d: F.struct(p.alias("p"), d.alias("d")))
    return let(groups, lambda t: let(F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: usual(t, i)), lambda u: let(cards(t, u), lambda c: pieces(t, c))))


def parts_of(x: Column) -> Column:
    """The pieces (k, x) of a candidate: the whole of it, or cards and what is between them."""
    other = F.lit(False)
    for k, p in WHOLE.items():
        other = other | x.rlike(p) if k != "card" else other
    return F.when(other | ~x.rlike(r"^\d[\d -]*$"), F.array(F.struct(kind_of(x).alias("k"), x.alias("x")))).otherwise(card_parts(x))


def permuted_ssn(d: Column, key: str) -> Column:
    """Nine digits of a valid number of the same kind: the permutation is applied again while its result is no valid one, so valid
    numbers are permuted among themselves. One in nine results is invalid; after 32 in a row, which no run will see, the last one stays.
    """
    def again(x: Column) -> Column:
        return permuted_digits(x, "ssn", key)
    bad = r"^(000|666|9\d\d)|^\d{3}00|0000$"
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), again(d), lambda x, _: F.when(x.rlike(bad), again(x)).otherwise(x))


def pseudonym(kind: Column, x: Column, key: str) -> Column:
    big = F.lit(1 << 16).cast("long")
    ip = let(octets(x), lambda o: let(feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], big, big, "ip", key), lambda f: F.concat_ws(
        ".", F.floor(f["l"] / 256).cast("string"), (f["l"] % 256).cast("string"), F.floor(f["r"] / 256).cast("string"), (f["r"] % 256).cast("string"))))
    date = date_like(x, permuted_day(day_of(x), key))
    card = let(permuted_digits(let(only_digits(x), lambda d: F.substring(d, F.lit(1), F.length(d) - 1)), "card", key),
               lambda d: F.concat(d, F.pmod(10 - luhn_sum(d) % 10, F.lit(10)).cast("string")))
    # the country code of a telephone number stays
    prefix = F.regexp_extract(x, r"^(\+\d{1,3}(?=[ .(-]))", 1)
    phone = let(prefix, lambda p: F.concat(p, let(F.substring(x, F.length(p) + 1, F.length(x)), lambda rest: refill(rest, permuted_digits(only_digits(rest), "phone", key)))))
    return (F.when(kind == "email", F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(x)), 256), 1, 16), F.lit("@example.com")))
            .when(kind == "ip", ip).when(kind == "date", date).when(kind == "ssn", refill(x, permuted_ssn(only_digits(x), key)))
            .when(kind == "phone", phone).when(kind == "card", refill(x, card)).otherwise(x))


def pseudonymise(docs: DataFrame, found: str = "pii_found", key: str = KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and ``found``, the kinds of what was replaced, in text order."""
    matches, parsed, new = unused(docs, "pii_matches", "pii_parts", "pii_new")
    any_ = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    d = docs.withColumn(matches, F.when(any_, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    d = d.withColumn(parsed, F.transform(matches, parts_of))
    d = d.withColumn(new, F.transform(parsed, lambda a: F.array_join(F.transform(a, lambda s: pseudonym(s["k"], s["x"], key)), "")))
    parts = F.split("text", ANY, -1)
    hit = F.size(matches) > 0  # null for texts that were not searched
    joined = F.array_join(F.flatten(F.zip_with(parts, F.col(new), lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")
    kinds = F.filter(F.transform(F.flatten(parsed), lambda s: s["k"]), lambda k: k.isNotNull())
    return (d.withColumn("text", F.when(hit, joined).otherwise(F.col("text")))
            .withColumn(found, F.coalesce(kinds, F.array().cast("array<string>"))).select(*[F.col(f"`{c}`") for c in docs.columns if c != found], found))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def times(kind: str) -> Column:
        return F.size(F.filter("pii_found", lambda x: x == F.lit(kind))).alias(f"n_{kind}")
    return d.select("doc_id", "text", *map(times, PATTERNS))
