"""Keyed pseudonyms: valid, the same for the same value everywhere, injective for identifiers.

The key is used in one place, an Arrow function that returns HMAC-SHA256 digests; it is in no plan.  Everything
else is built from the digests' digits.  Collisions are settled in rounds over distinct values: a candidate that
is its own original, any original, taken, or wanted by a value that sorts earlier is drawn again next round.
"""

from __future__ import annotations

import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import BANK_CODES, EMAIL, IBAN, KINDS, MAIL_HOSTS, MOBILE, MOBILE_DIGITS, PERSON_NAME, SAUDI_ID, canonical, complete_iban, complete_saudi_id
from ..functions.names import GAZETTEER, Gazetteer
from ..functions.spans import exploded, windows
from ..functions.text import BLANKS, DIGIT, ascii_digits, flatten, let, normalize_name, offsets
from .tables import dealt, written

MAX_ROUNDS = 1000
WIDEN_AFTER = 50
DRAWS = 64
#: So many draws may be broadcast.
FEW_DRAWS = 50_000
#: Digits of a key that the first of two digests holds: those from its place 41 on.
DIGITS_IN_FIRST = 24
FIRST_NAME, FAMILY_NAME = NAME_PARTS = ("FIRST_NAME", "FAMILY_NAME")


class PseudonymSpaceExhausted(RuntimeError):
    """No free pseudonym after MAX_ROUNDS draws; the message holds no value."""


def digest_function(key: bytes):
    """A Column function: message, how many (2) -> one or two HMAC-SHA256 digests in hexadecimal."""
    if not key:
        raise ValueError("empty key")

    @F.pandas_udf("string")
    def digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        one = lambda m, k: hmac.digest(key, f"{m}#{k}".encode(), "sha256").hex()
        for messages, many in batches:
            yield pd.Series([None if m is None else one(m, 0) if n < 2 else one(m, 0) + one(m, 1) for m, n in zip(messages.tolist(), many.tolist(), strict=True)], dtype=object)

    return lambda message, many=None: digests(message, F.lit(2) if many is None else many)


def digests_needed(canon: Column, attempt: Column) -> Column:
    """How many digests candidate() reads: one, but for long keys and for those that have been widened."""
    return F.when((F.length(canon) > DIGITS_IN_FIRST) | (attempt >= WIDEN_AFTER), 2).otherwise(1)


def _index(hexes: Column, at: int, n: int) -> Column:
    return (F.conv(F.substring(hexes, at, 8), 16, 10).cast("long") % n).cast("int")


def _one(values, hexes: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _index(hexes, at, len(values)) + 1)


def candidate(kind: Column, canon: Column, hexes: Column, attempt: Column, keep_first_digit: bool = True, names: Gazetteer = GAZETTEER) -> Column:
    """The pseudonym that a digest stands for: canonical for identifiers, as displayed for names, same shape for keys."""
    digits = lambda n: F.translate(F.substring(hexes, F.lit(41), F.lit(n) if isinstance(n, int) else n), "abcdef", "012345")
    first = F.when(F.lit(keep_first_digit) & canon.rlike("^[12]"), F.substring(canon, 1, 1)).otherwise(_one("12", hexes, 1))
    identity = let(F.concat(first, digits(8)), complete_saudi_id)
    mobile = F.concat(F.lit("5"), _one(MOBILE_DIGITS, hexes, 1), digits(7))
    iban = let(F.concat(_one(BANK_CODES, hexes, 1), digits(18)), complete_iban)
    mail = F.concat(F.translate(digits(8), "0123456789", "kqwzhvbxjf"), (_index(hexes, 9, 999) + 1).cast("string"), F.lit("@"), _one(MAIL_HOSTS, hexes, 1))
    of = lambda gender: F.when(gender == "M", _one(names.male, hexes, 1)).when(gender == "F", _one(names.female, hexes, 1)).otherwise(_one(names.male + names.female, hexes, 1))
    given = let(names.gender(canon), of)
    shape = lambda own: F.transform(
        F.split(canon, ""),
        lambda c, i: F.when(c.between("0", "9"), F.when((i == 0) & (c != "0") & (F.substring(own, 1, 1) == "0"), F.lit("7")).otherwise(F.substring(own, (i % 88) + 1, F.lit(1)))).otherwise(c),
    )
    wider = F.when(attempt < WIDEN_AFTER, "").otherwise(F.substring(F.reverse(digits(88)), F.lit(1), F.floor(attempt / WIDEN_AFTER).cast("int")))
    # a key of digits alone, as most are, needs no look at each of them
    of_digits = lambda own: F.when((F.substring(canon, 1, 1) != "0") & own.startswith("0"), F.concat(F.lit("7"), F.substring(own, 2, 88))).otherwise(own)
    key = F.when(canon.rlike("^[0-9]{1,88}$"), of_digits(digits(F.length(canon)))).otherwise(F.array_join(let(digits(F.least(F.length(canon), F.lit(88))), shape), ""))
    key = F.concat(key, wider)
    return (
        F.when(kind == SAUDI_ID, identity).when(kind == MOBILE, mobile).when(kind == IBAN, iban).when(kind == EMAIL, mail)
        .when(kind == FIRST_NAME, given).when(kind == FAMILY_NAME, _one(names.family, hexes, 1)).otherwise(key)
    )


def assign(values: DataFrame, key: bytes, keep_first_digit: bool = True, names: Gazetteer = GAZETTEER, max_rounds: int = MAX_ROUNDS, draw=candidate) -> DataFrame:
    """(kind, canon, fake, attempt) for distinct (kind, canon).

    Name parts may share pseudonyms and are only never themselves.  Key groups may meet originals of the group but
    no two of them share one.  The result depends on the key and the set of values alone.
    """
    digests = digest_function(key)
    values = written(dealt(values.select("kind", "canon").filter("canon IS NOT NULL").distinct()), "values")
    of_names = F.col("kind").isin(*NAME_PARTS)

    def drawn(todo: DataFrame, least: int, end: int) -> DataFrame:
        """(kind, canon, attempt, fake, norm): the draws from `least` on of each value, of those before `end`, that are not itself."""
        tries = todo.withColumn("attempt", F.explode(F.sequence(F.lit(least), F.lit(end - 1))))
        message = F.concat("kind", F.lit(":"), "canon", F.when(F.col("attempt") == 0, "").otherwise(F.concat(F.lit(":"), F.col("attempt").cast("string"))))
        some = tries.withColumn("hexes", digests(message, digests_needed(F.col("canon"), F.col("attempt"))))
        some = some.withColumn("fake", draw(F.col("kind"), F.col("canon"), F.col("hexes"), F.col("attempt"), keep_first_digit, names)).drop("hexes")
        some = written(some, "drawn")  # read back, a pseudonym is a value and not an expression that every use repeats
        norm = F.when(of_names, normalize_name(F.col("fake"))).otherwise(F.col("fake"))
        return some.withColumn("norm", norm).filter(F.col("norm") != F.col("canon"))

    def earliest(some: DataFrame) -> DataFrame:
        return some.groupBy("canon", "kind").agg(F.min(F.struct("attempt", "fake", "norm")).alias("x")).select("kind", "canon", "x.*")

    def left(todo: DataFrame, found: DataFrame, name: str) -> DataFrame:
        return written(dealt(todo.join(found.select("canon", "kind"), ["canon", "kind"], "left_anti").select("kind", "canon")), name)

    out = _free_names(values.filter(of_names), drawn, earliest, left, max_rounds)
    more = _free_identifiers(values.filter(~of_names), drawn, earliest, left, max_rounds)
    return out.unionByName(more).select("kind", "canon", "fake", "attempt")


def _free_names(todo: DataFrame, drawn, earliest, left, max_rounds: int) -> DataFrame:
    """Of each part of a name the first draw that is not itself."""
    done, attempt, draws = None, 0, 2
    while attempt < max_rounds:
        end = min(attempt + draws, max_rounds)
        good = written(earliest(drawn(todo, attempt, end)).drop("norm"), "round")
        done = good if done is None else done.unionByName(good)
        todo = left(todo, good, "todo")
        if todo.isEmpty():
            return done
        attempt, draws = end, DRAWS
    raise PseudonymSpaceExhausted(f"no free pseudonym for some value after {max_rounds} draws")


def _free_identifiers(values: DataFrame, drawn, earliest, left, max_rounds: int) -> DataFrame:
    """Of each value a draw that no other has."""
    originals = values.filter(~F.col("kind").startswith("PK:")).select(F.col("kind").alias("k"), F.col("canon").alias("c"))

    def usable(todo: DataFrame, least: int, end: int, taken: DataFrame, few: bool) -> DataFrame:
        """Of each value the first draw from `least` on that is not taken, of those before `end`.  few: there are so few draws that
        they are sent to what is taken."""
        some = drawn(todo, least, end)
        # a long number must not hold an original of another kind: the leak scan looks into every window of digits
        is_long = ((F.col("kind") == IBAN) | F.col("kind").startswith("PK:")) & F.col("norm").rlike("[0-9]{10}")
        long = some.filter(is_long)
        inside = exploded(long.withColumn("windows", windows(F.col("norm"))), "windows", "w").select("kind", "canon", "attempt", F.col("w.kind").alias("k"), F.col("w.canon").alias("c"))
        long = long.join(inside.join(originals, ["c", "k"], "left_semi").select("canon", "kind", "attempt").distinct(), ["canon", "kind", "attempt"], "left_anti")
        some = some.filter(~is_long).unionByName(long.select(some.columns))
        if few:
            wanted = some.select(F.col("norm").alias("_norm"), F.col("kind").alias("_kind"))
            taken = taken.join(F.broadcast(wanted), (F.col("c") == F.col("_norm")) & (F.col("k") == F.col("_kind")), "left_semi")
        # values stand before kinds in keys: rows are sorted by the first bytes of the first key, and those of a kind are all alike
        free = some.join(taken, (F.col("norm") == F.col("c")) & (F.col("kind") == F.col("k")), "left_anti")
        return earliest(free) if end - least > 1 else free

    done, todo, size, attempt, draws = None, values, values.count(), 0, 1
    while attempt < max_rounds:
        # values that collide get more draws at a time, so that short keys don't take a job for each; not all at once, as where keys fill
        # the space of their shape a third of them collides
        end, at, rest, n, first = min(attempt + draws, max_rounds), attempt, todo, size, None
        taken = originals if done is None else originals.union(done.select("kind", "fake"))
        # most have a free one among the first draws, so that only the rest is drawn on
        for to in sorted({min(attempt + max(draws // 8, 2), end), end}):
            if first is not None:
                rest = left(rest, first, "rest")
                n = rest.count()
            if n or first is None:
                found = usable(rest, at, to, taken, n * (to - at) <= FEW_DRAWS)
                first, at = found if first is None else first.unionByName(found), to
            if to < end:
                first = written(first, "found")
        place = F.row_number().over(Window.partitionBy("norm", "kind").orderBy("attempt", "canon"))
        good = written(first.withColumn("place", place).filter("place = 1").select("kind", "canon", "fake", "attempt"), "round")
        done = good if done is None else done.unionByName(good)
        todo = left(todo, good, "todo")
        size = todo.count()
        if not size:
            return done
        attempt, draws = end, min(8 * draws, DRAWS)
    raise PseudonymSpaceExhausted(f"no free pseudonym for some value after {max_rounds} draws")


def name_parts(raw: Column, names: Gazetteer = GAZETTEER) -> Column:
    """array<struct<kind, canon>> of a name's words: the last is a family name if it is known as one or starts with the article."""
    words = F.filter(F.split(raw, f"[{BLANKS}]+"), lambda w: w != "")

    def part(w: Column, i: Column) -> Column:
        plain_word = normalize_name(w)
        last = (F.size(words) >= 2) & (i == F.size(words) - 1)
        return F.struct(F.when(last & (names.is_family(plain_word) | plain_word.startswith("ال")), FAMILY_NAME).otherwise(FIRST_NAME).alias("kind"), plain_word.alias("canon"))

    return F.transform(words, part)


def render_like(raw: Column, kind: Column, fake: Column) -> Column:
    """The fake in the original's layout: prefix style, letter case, separators, and each digit's script."""
    flat = flatten(raw)
    prefix = F.regexp_extract(flat, r"^(\+966|00966|966|0)", 1)
    iban = F.concat(F.when(F.substring(flat, 1, 2).rlike("^[a-z]{2}$"), F.lower(F.substring(fake, 1, 2))).otherwise(F.substring(fake, 1, 2)), F.substring(fake, 3, 100))
    target = F.when(kind == MOBILE, F.concat(prefix, fake)).when(kind == IBAN, iban).otherwise(fake)

    def in_script(digit: Column, like: Column) -> Column:
        eastern = F.when(like.rlike(r"^[\x{0660}-\x{0669}]$"), F.translate(digit, "0123456789", "٠١٢٣٤٥٦٧٨٩")).when(
            like.rlike(r"^[\x{06F0}-\x{06F9}]$"), F.translate(digit, "0123456789", "۰۱۲۳۴۵۶۷۸۹")
        )
        return F.coalesce(eastern, digit)

    def with_chars(chars: Column) -> Column:
        slots = F.filter(offsets(raw), lambda i: ~F.get(chars, i).rlike(f"^[{BLANKS}()]$"))
        return let(F.struct(chars.alias("chars"), slots.alias("slots"), target.alias("target")), laid_out)

    def laid_out(x: Column) -> Column:
        def put(c: Column, i: Column) -> Column:
            placed = lambda place: F.when(place > 0, in_script(F.substring(x["target"], place, F.lit(1)), c)).otherwise(c)
            return let(F.array_position(x["slots"], i).cast("int"), placed)

        some_digit = F.regexp_extract(raw, f"([{DIGIT}])", 1)
        laid = F.array_join(F.transform(x["chars"], put), "")
        return F.when(F.size(x["slots"]) == F.length(x["target"]), laid).otherwise(in_script(x["target"], some_digit))

    return F.when(kind == EMAIL, fake).otherwise(let(F.split(raw, ""), with_chars))


def collect_values(columns: list[tuple[DataFrame, str, str]], spans: DataFrame | None) -> DataFrame:
    """Distinct (kind, canon) of columns (df, column, kind or key group) and of spans (kind, piece)."""
    parts = []
    for df, column, kind in columns:
        raw = df.select(F.col(f"`{column}`").alias("raw")).filter("raw IS NOT NULL").distinct().withColumn("kind", F.lit(kind))
        parts.append(raw)
    if spans is not None:
        parts.append(spans.select(F.col("piece").alias("raw"), "kind").distinct())
    out = None
    for p in parts:
        names = p.filter(F.col("kind") == PERSON_NAME).select(F.explode(name_parts(F.col("raw"))).alias("x")).select("x.kind", "x.canon")
        rest = p.filter(F.col("kind") != PERSON_NAME).select("kind", canonical_of(F.col("kind"), F.col("raw")).alias("canon"))
        both = names.unionByName(rest)
        out = both if out is None else out.unionByName(both)
    return out.distinct()


def canonical_of(kind: Column, raw: Column) -> Column:
    """canonical() for a kind in a column; a key group's canonical form is the stripped text."""
    out = F.trim(raw)
    for k in KINDS:
        out = F.when(kind == k, canonical(k, raw)).otherwise(out)
    return out


def faked(raws: DataFrame, mapping: DataFrame) -> DataFrame:
    """(kind, raw, value) for distinct (kind, raw): what stands for each raw value, in its own layout."""
    plain = raws.filter(F.col("kind") != PERSON_NAME).withColumn("canon", canonical_of(F.col("kind"), F.col("raw")))
    plain = plain.join(mapping.select("kind", "canon", "fake"), ["canon", "kind"], "left")
    is_key = F.col("kind").startswith("PK:")
    value = F.when(F.col("fake").isNull(), F.col("raw")).when(is_key, F.col("fake")).otherwise(render_like(F.col("raw"), F.col("kind"), F.col("fake")))
    plain = plain.select("kind", "raw", value.alias("value"))

    words = raws.filter(F.col("kind") == PERSON_NAME).select("raw", F.posexplode(name_parts(F.col("raw"))).alias("i", "x")).select("raw", "i", "x.kind", "x.canon")
    words = words.join(mapping.select("kind", "canon", "fake"), ["canon", "kind"], "left").groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("i", "fake"))).alias("fakes"))
    blanks = F.split(F.col("raw"), f"[^{BLANKS}]+", -1)
    pieces = F.zip_with(F.transform("fakes", lambda x: x["fake"]), F.slice(blanks, F.lit(2), F.size("fakes")), lambda w, b: F.concat(w, F.coalesce(b, F.lit(""))))
    names = words.select(F.lit(PERSON_NAME).alias("kind"), "raw", F.concat(blanks[0], F.array_join(pieces, "")).alias("value"))
    return plain.unionByName(names)
