"""Format-preserving pseudonyms by keyed Feistel permutations, in SQL functions only.

Texts are cut at candidate values; each candidate that validates is replaced and all others stay as they are:

- card numbers (13 to 19 digits, single spaces or dashes allowed, Luhn checksum holds): all digits but the last are permuted and
  the check digit is made anew, so the result validates too; in a run of digit groups, which may hold other numbers beside a card,
  the longest valid number from each group on counts, from left to right, after the other formats' values are cut out; the checksums of
  all numbers from a group on are one running sum, and runs are worked on in blocks of groups, so work is linear in a run's length;
- phone numbers (10 digits in the groups 3-3-4 that punctuation or a country code marks) and 3-2-4 digit identity numbers: the digits
  are permuted, the country code stays, and a number has one pseudonym with and without it;
- account numbers (IBAN, checksum holds): the digits behind the check digits are permuted and those made anew; letters stay;
- IPv4 addresses (four octets of 0 to 255): the 32 bits are permuted; IPv6 addresses (eight groups, or with ::): each half is;
- dates (YYYY-MM-DD, DD/MM/YYYY, DD.MM.YYYY of the years 1800 to 2199 that exist; with slashes also MM/DD/YYYY where the day comes first
  in no reading): the day's number among the 146,097 = 189 x 773 days of four centuries is permuted, and written in the same order;
- mail addresses and access keys (AKIA..., password=, token = "..."), which are no numbers, get a keyed digest in their shape.

A permutation is a Feistel network of ROUNDS rounds over two mixed-radix halves with keyed SHA-256 as the round function, so distinct
values of a format keep distinct pseudonyms, and equal values (in any punctuation) the same one in every document.

No pattern repeats a group without a bound, as the JVM's matcher takes a stack frame for each repeat: a mail address's domain is one run of
its characters, and its labels are looked at afterwards.

Defined results: null text stays null and empty text empty; repeated rows are treated alike; invalid candidates (failed checksum,
octet over 255, 31 February) stay; counts of replaced values are returned; other columns are carried along, but for one named
n_replaced, whose place the count takes; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused, without

ROUNDS = 8
DAY_RADIX = (189, 773)
FIRST_DAY = "1800-01-01"
TEST_KEY = "tidemark test key"
KEY_SETTING = "spark.tidemark.pii.key"

_DOMAIN = r"@[A-Za-z0-9-][A-Za-z0-9.-]*(?<=\.[A-Za-z]{2,63})(?![A-Za-z])"
_MAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_DOMAIN}"
_SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z])(?:password|passwd|secret|token|api_key)\s?[=:]\s?\"?[0-9A-Za-z+/_-]{12,}\"?"
_DATE = r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])\d{2}([/.])\d{2}\1\d{4}(?!\d)"
_IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
_IDENTITY = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_NATIONAL = r"(?<![\w+.-])(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\.?[\w-])"
_ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:.])"
_RUN = r"(?<![\d.])\d[\d -]{11,}\d"
CANDIDATE = "|".join([_MAIL, _SECRET, _ACCOUNT, _IP6, _DATE, _IP, _PHONE, _NATIONAL, _IDENTITY])
_MAYBE = r"[0-9]|@|=|:|AKIA"  # every candidate and run has one of these


def _word(key: Column, *parts) -> Column:
    """A keyed digest of the parts as a number below 2^52."""
    said = F.concat_ws("|", key, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: Column, tweak: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs l < left_size, r < right_size."""

    def step(s: Column, i: Column) -> Column:
        new_left = F.pmod(s["l"] + _word(key, tweak, i, s["r"]), left_size)
        new_right = F.pmod(s["r"] + _word(key, tweak, i, s["l"]), right_size)
        return F.when(i % 2 == 0, F.struct(new_left.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), new_right.alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, key: Column, tweak: Column) -> Column:
    """Digit strings of one length, permuted among each other."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    halves = feistel(F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, n), ten(a), ten(n - a), key, F.concat(tweak, n.cast("string")))
    return F.aggregate(F.array(halves), F.lit(""), lambda _, s: F.concat(F.lpad(s["l"].cast("string"), a, "0"), F.lpad(s["r"].cast("string"), n - a, "0")))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, whose last digit counts once."""
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    return F.aggregate(places, F.lit(0), lambda t, i: t + F.when(i % 2 == 1, value(i)).otherwise(2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)))


def refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in turn."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.split(shape, ""), state, step, lambda s: s["out"])


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _card(x: Column, key: Column) -> Column:
    def of(digits: Column) -> Column:
        payload = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card"))
        with_check = _let(payload, lambda p: F.concat(p, F.pmod(F.lit(10) - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(digits) % 10 == 0, _let(with_check, lambda d: refill(x, d))).otherwise(x)

    return _let(F.regexp_replace(x, "[^0-9]", ""), of)


def _card_ends(groups: Column, i: Column) -> Column:
    """How many of the groups from the i-th on make the longest valid card number; null if none does.

    groups: struct(digits, gap, odd, even), the digits' Luhn sums with those in odd and in even places doubled. Over a number so far, the sums for an even
    and an odd count of digits are kept; a group behind an even count adds its own sums as they are, one behind an odd count crosswise."""
    zero = F.lit(0)
    start = F.struct(zero.alias("count"), zero.alias("odd"), zero.alias("even"), zero.alias("seen"), F.lit(None).cast("int").alias("best"), F.lit(True).alias("open"))

    def step(s: Column, g: Column) -> Column:
        n = F.length(g["digits"])
        fits = s["open"] & (s["count"] + n <= 19)
        straight = s["count"] % 2 == 0
        odd, even = (s["odd"] + F.when(straight, g["odd"]).otherwise(g["even"])), (s["even"] + F.when(straight, g["even"]).otherwise(g["odd"]))
        count, seen = s["count"] + n, s["seen"] + 1
        valid = (count >= 13) & (F.when(count % 2 == 0, odd).otherwise(even) % 10 == 0)
        more = F.struct(count.alias("count"), odd.alias("odd"), even.alias("even"), seen.alias("seen"), F.when(valid, seen).otherwise(s["best"]).alias("best"), (F.length(g["gap"]) == 1).alias("open"))
        over = F.struct(s["count"].alias("count"), s["odd"].alias("odd"), s["even"].alias("even"), s["seen"].alias("seen"), s["best"].alias("best"), F.lit(False).alias("open"))
        return F.when(fits, more).otherwise(over)

    return F.aggregate(F.slice(groups, i, F.lit(19)), start, step, lambda s: s["best"])


def _group(said: Column) -> Column:
    """struct(digits, gap, odd, even) of digits and the spaces and dashes behind them."""

    def of(digits: Column) -> Column:
        def total(doubled: int) -> Column:
            worth = lambda i: F.when(i % 2 == doubled, F.translate(F.substring(digits, i, F.lit(1)), "123456789", "246813579")).otherwise(F.substring(digits, i, F.lit(1))).cast("int")
            return F.when(F.length(digits) <= 19, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda t, i: t + worth(i))).otherwise(0)

        return F.struct(digits.alias("digits"), F.substring(said, F.length(digits) + 1, F.length(said)).alias("gap"), total(1).alias("odd"), total(0).alias("even"))

    return _let(F.regexp_extract(said, "^[0-9]++", 0), of)


GROUPS = 512


def _cards(t: Column, key: Column) -> Column:
    """struct(out, n): the text with the card numbers in its runs of digit groups replaced, and their count."""

    def run(x: Column) -> Column:
        def of(groups: Column) -> Column:
            n = F.size(groups)

            def step(s: Column, i: Column) -> Column:
                group = F.element_at(groups, i)
                whole = lambda g: F.concat(g["digits"], g["gap"])
                same = F.struct(F.concat(s["out"], whole(group)).alias("out"), s["next"].alias("next"), s["n"].alias("n"))

                def take(k: Column) -> Column:
                    last = F.element_at(groups, i + k - 1)
                    old = F.concat(F.array_join(F.transform(F.slice(groups, i, k - 1), whole), ""), last["digits"])
                    new = _let(_card(old, key), lambda c: F.struct(F.concat(s["out"], c, last["gap"]).alias("out"), (i + k).alias("next"), (s["n"] + (c != old).cast("int")).alias("n")))
                    return F.when(k.isNull(), same).otherwise(new)

                return F.when(i < s["next"], s).otherwise(_let(_card_ends(groups, i), take))

            def block(s: Column, b: Column) -> Column:
                """GROUPS groups into one string, so that no string grows with the run."""
                start = F.struct(F.lit("").alias("out"), s["next"].alias("next"), s["n"].alias("n"))
                done = F.aggregate(F.sequence(b, F.least(b + (GROUPS - 1), n)), start, step)
                return _let(done, lambda d: F.struct(F.concat(s["out"], F.array(d["out"])).alias("out"), d["next"].alias("next"), d["n"].alias("n")))

            start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("next"), F.lit(0).alias("n"))
            return F.aggregate(F.sequence(F.lit(1), n, F.lit(GROUPS)), start, block, lambda s: F.struct(F.array_join(s["out"], "").alias("out"), s["n"].alias("n")))

        return _let(F.transform(F.regexp_extract_all(x, F.lit("[0-9]+[ -]*"), F.lit(0)), _group), of)

    runs = F.transform(F.regexp_extract_all(t, F.lit(_RUN), F.lit(0)), run)
    pieces = F.split(t, _RUN, -1)
    said = lambda new: F.struct(F.array_join(F.flatten(F.zip_with(pieces, new, lambda p, r: F.array(p, F.coalesce(r["out"], F.lit(""))))), "").alias("out"), F.aggregate(new, F.lit(0), lambda a, r: a + r["n"]).alias("n"))
    return F.when(t.rlike(_RUN), _let(runs, said)).otherwise(F.struct(t.alias("out"), F.lit(0).alias("n")))


def _phone(x: Column, key: Column) -> Column:
    code = F.regexp_extract(x, r"^(\+\d{1,3}?)[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$", 1)
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    return F.concat(code, _let(permute_digits(F.regexp_replace(rest, "[^0-9]", ""), key, F.lit("phone")), lambda d: refill(rest, d)))


def _national(x: Column, key: Column) -> Column:
    return _let(permute_digits(F.regexp_replace(x, "[^0-9]", ""), key, F.lit("phone")), lambda d: refill(x, d))


def _mod97(text: Column) -> Column:
    """The text's remainder by 97, with letters as two digits (A is 10)."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda m, c: (m * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _account(x: Column, key: Column) -> Column:
    """x is two letters, two check digits and the rest, with spaces between groups."""

    def of(plain: Column) -> Column:
        land, rest = F.substring(plain, 1, 2), F.substring(x, F.lit(5), F.length(x))
        digits = F.regexp_replace(rest, "[^0-9]", "")
        valid = (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1) & (F.length(digits) >= 2)

        def anew(new: Column) -> Column:
            check = 98 - _mod97(F.concat(F.regexp_replace(new, " ", ""), land, F.lit("00")))
            return F.concat(land, F.lpad(check.cast("string"), 2, "0"), new)

        return F.when(valid, _let(_let(permute_digits(digits, key, F.lit("account")), lambda d: refill(rest, d)), anew)).otherwise(x)

    return _let(F.regexp_replace(x, " ", ""), of)


def _ip6(x: Column, key: Column) -> Column:
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    head, tail = groups(F.substring_index(x, "::", 1)), F.when(F.contains(x, F.lit("::")), groups(F.substring_index(x, "::", -1))).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(head) - F.size(tail)
    full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)

    def of(g: Column) -> Column:
        word = lambda i: g[i] * 65536 + g[i + 1]
        size = F.lit(1 << 32)
        first = feistel(word(0), word(2), size, size, key, F.lit("ip6"))
        last = feistel(word(4), word(6), size, size, key, F.concat_ws("|", F.lit("ip6"), word(0), word(2)))
        said = lambda s: F.array(*[F.lower(F.hex(v)) for c in ("l", "r") for v in (F.floor(s[c] / 65536).cast("long"), s[c] % 65536)])
        return F.concat_ws(":", _let(first, said), _let(last, said))

    whole = x.rlike("[0-9]") & (F.size(head) + F.size(tail) >= 2) & F.when(F.contains(x, F.lit("::")), missing >= 1).otherwise(missing == 0)
    return F.when(whole, _let(F.transform(full, lambda g: F.conv(g, 16, 10).cast("long")), of)).otherwise(x)


def _identity(x: Column, key: Column) -> Column:
    return _let(permute_digits(F.regexp_replace(x, "-", ""), key, F.lit("identity")), lambda d: refill(x, d))


def _ip(x: Column, key: Column) -> Column:
    def of(o: Column) -> Column:
        half = F.lit(65536)
        new = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], half, half, key, F.lit("ip"))
        octet = lambda v, d: F.floor(v / d).cast("long").cast("string")
        said = _let(new, lambda s: F.concat_ws(".", octet(s["l"], 256), (s["l"] % 256).cast("string"), octet(s["r"], 256), (s["r"] % 256).cast("string")))
        return F.when(F.forall(o, lambda v: v <= 255), said).otherwise(x)

    return _let(F.transform(F.split(x, r"\."), lambda v: v.cast("long")), of)


def _date(x: Column, key: Column) -> Column:
    iso = x.substr(5, 1) == "-"
    year, one, two = F.substring(x, 7, 4), F.substring(x, 1, 2), F.substring(x, 4, 2)
    made = lambda month, day: F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    slashed, day_first = x.substr(3, 1) == "/", made(two, one)
    day = F.when(iso, F.try_to_date(x, "yyyy-MM-dd")).when(slashed, F.coalesce(day_first, made(one, two))).otherwise(day_first)
    first, (a, b) = F.lit(FIRST_DAY).cast("date"), DAY_RADIX

    def of(n: Column) -> Column:
        new = feistel(F.floor(n / b), n % b, F.lit(a), F.lit(b), key, F.lit("date"))
        back = _let(new, lambda s: F.date_add(first, (s["l"] * b + s["r"]).cast("int")))

        def said(d: Column) -> Column:
            slashes = F.when(day_first.isNull(), F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
            return F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(slashed, slashes).otherwise(F.date_format(d, "dd.MM.yyyy"))

        return F.when((n >= 0) & (n < a * b), _let(back, said)).otherwise(x)

    return _let(F.datediff(day, first), of)


def _mail(x: Column, key: Column) -> Column:
    """An address ends before an empty label; what follows stays."""

    def of(address: Column) -> Column:
        new = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("mail"), F.lower(address)), 256), 1, 12), F.lit("@mail.invalid"))
        return F.when(address == "", x).otherwise(F.concat(new, F.substring(x, F.length(address) + 1, F.length(x))))

    local = F.substring_index(x, "@", 1)
    domain = F.substring_index(F.substring_index(x, "@", -1), "..", 1)
    return _let(F.when(F.contains(x, F.lit("..")) & ~F.contains(local, F.lit("..")), F.regexp_extract(F.concat_ws("@", local, domain), rf"^[^@]++{_DOMAIN}", 0)).otherwise(x), of)


def _secret(x: Column, key: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, F.lit("secret"), x), 256)
    name = F.regexp_extract(x, r"^([A-Za-z_]+\s?[=:]\s?\"?)", 1)
    tail = F.when(F.endswith(x, F.lit('"')), F.lit('"')).otherwise(F.lit(""))
    return F.when(x.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16)))).otherwise(F.concat(name, F.substring(digest, F.lit(1), F.length(x) - F.length(name) - F.length(tail)), tail))


def pseudonym(x: Column, key: Column) -> Column:
    """The candidate's pseudonym, or itself where it does not validate."""
    whole = lambda p: x.rlike(f"^(?:{p})$")
    new = (
        F.when(whole(_MAIL), _mail(x, key)).when(whole(_SECRET), _secret(x, key)).when(whole(_ACCOUNT), _account(x, key)).when(whole(_IP6), _ip6(x, key)).when(whole(_DATE), _date(x, key))
        .when(whole(_IP), _ip(x, key)).when(whole(_PHONE), _phone(x, key)).when(whole(_NATIONAL), _national(x, key)).when(whole(_IDENTITY), _identity(x, key))
    )
    return F.coalesce(new, x)


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """The documents with values replaced in `text`, and n_replaced. Whoever knows the key can undo the permutations."""
    own = without(docs, "n_replaced")
    hits, new, parts = unused(own, "hits", "new", "parts")
    k, t = F.lit(key), F.col(text)
    maybe = t.rlike(_MAYBE)
    found = own.withColumn(hits, F.when(maybe, F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    named = found.withColumn(new, F.transform(hits, lambda x: pseudonym(x, k)))
    between = F.when(F.size(hits) > 0, F.split(t, CANDIDATE, -1)).otherwise(F.array(t))
    cut = named.withColumn(parts, F.when(maybe, F.transform(between, lambda p: _cards(p, k))))
    joined = F.array_join(F.flatten(F.zip_with(parts, new, lambda p, n: F.array(p["out"], F.coalesce(n, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with(hits, new, lambda a, b: a != b), lambda c: c)) + F.aggregate(parts, F.lit(0), lambda n, p: n + p["n"])
    out = F.when(maybe, joined).otherwise(t)
    return cut.select(*[out.alias(c) if c == text else F.col(f"`{c}`") for c in own.columns], F.coalesce(changed, F.lit(0)).cast("long").alias("n_replaced"))


def session_key(spark: SparkSession) -> str:
    """The key that the session sets. Unset, as in tests, it is a public one that hides nothing from who knows it."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text"), session_key(spark))
