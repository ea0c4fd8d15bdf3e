"""Identifiers inside free text, as arrays of spans; every step is a Column expression.

A span is a struct (start, end, kind, conf, source) of half-open offsets into the original text.  Matches of a
pattern are found with what stands between them, so their places are sums of lengths.  Kinds claim text in turn:
valid IBANs, IBAN shapes, mail addresses, digit runs, names; a later span that touches a claimed one is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identifiers import EMAIL, EMAIL_SHAPE, IBAN, MOBILE, PERSON_NAME, SAUDI_ID, is_iban, is_mobile, is_saudi_id
from .names import GAZETTEER, WORD_MARKS, Gazetteer, NamePatterns
from .text import DROPPED, let, normalize

SPAN = "struct<start:int,end:int,kind:string,conf:double,source:string>"
# Words beside account numbers and beside numbers that only look like an identity number.
ACCOUNT_WORDS = "(?i)(آيبان|ايبان|الآيبان|الايبان|iban|حساب|الحساب|تحويل|حوالة|استرداد)"
DOCUMENT_WORDS = "(?i)(فاتور|طلب|مرجع|وثيق|عملي|إيصال|ايصال|invoice|order|ref)"
IBAN_IN_TEXT = r"(?i)(?<![A-Za-z0-9])SA\s?\d{22}(?!\d)"
#: Runs of ten characters or more, a plus sign included.
LONG_RUN = r"\+[0-9]{9,}|(?<![0-9+])[0-9]{10,}"
REVIEW_BELOW = 0.7
MAIL_IN_LOWER = r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}"
#: Marks around matches, and what stands for them where a text holds them.
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of a pattern's matches, in order; the pattern tells no control characters apart.

    One pass of the pattern puts marks around matches; a split at a mark needs none (at a pattern it would compile it for each text).
    """
    plain_text = F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, OTHER * 2)).otherwise(text)

    def placed(start: Column, match: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("text"))

    def found(marked: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,text:string>>")

        def listed(pieces: Column) -> Column:
            start = F.struct(none.alias("out"), F.length(pieces[0]).alias("at"))

            def add(state: Column, piece: Column) -> Column:
                match = F.substring_index(piece, CLOSE, 1)
                return F.struct(F.array_append(state["out"], placed(state["at"], match)).alias("out"), (state["at"] + F.length(piece) - 1).alias("at"))

            one = F.array(placed(F.length(pieces[0]), F.substring_index(F.get(pieces, F.lit(1)), CLOSE, 1)))
            return F.when(F.size(pieces) == 2, one).otherwise(F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, add, lambda state: state["out"]))

        # most texts hold no match, or one
        return F.when(marked.contains(OPEN), let(F.split(marked, OPEN, -1), listed)).when(marked.isNotNull(), none)

    return let(F.regexp_replace(plain_text, pattern, f"{OPEN}$0{CLOSE}"), found)


def span(start: Column, end: Column, kind: Column | str, conf: Column | float, source: str = "regex+validator") -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    conf = F.lit(conf) if isinstance(conf, float) else conf
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("kind"), conf.cast("double").alias("conf"), F.lit(source).alias("source"))


def touching(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def claim(held: Column, more: Column) -> Column:
    """held, and of `more` what touches nothing held."""
    free = F.filter(more, lambda m: ~F.exists(held, lambda h: touching(m, h)))
    return F.when(F.size(more) == 0, held).when(F.size(held) == 0, more).otherwise(F.concat(held, free))


def _kind(piece: Column) -> Column:
    return F.when(is_saudi_id(piece), SAUDI_ID).when(is_mobile(piece), MOBILE)


def _number_span(run: Column, norm: Column, start: Column, end: Column, kind: Column) -> Column:
    begin = run["start"] + start
    before = F.substring(norm, F.greatest(begin - 25, F.lit(0)) + 1, F.least(begin, F.lit(25)))
    return span(begin, run["start"] + end, kind, F.when((kind == SAUDI_ID) & before.rlike(DOCUMENT_WORDS), 0.6).otherwise(0.95))


def _digit_spans(run: Column, norm: Column, dropped: Column) -> Column:
    """Of one run of digits the validated windows between borders of its groups, the longest first, none touching."""
    size = F.length(run["text"])
    inner = F.transform(F.filter(dropped, lambda d: (d["at"] > run["start"]) & (d["at"] < run["end"])), lambda d: d["at"] - run["start"])
    whole = let(F.when(size.between(10, 14), _kind(run["text"])), lambda kind: F.when(kind.isNull(), _none()).otherwise(F.array(_number_span(run, norm, F.lit(0), size, kind))))
    return F.when(F.size(dropped) == 0, whole).otherwise(let(F.concat(F.array(F.lit(0)), inner, F.array(size)), lambda border: _windows_of(run, norm, border)))


def _windows_of(run: Column, norm: Column, border: Column) -> Column:

    def windows(a: Column) -> Column:
        def kind_of(b: Column) -> Column:
            kind = let(F.substring(run["text"], a + 1, b - a), lambda piece: F.when((a > 0) & piece.startswith("+"), F.lit(None)).otherwise(_kind(piece)))
            return F.struct((a - b).alias("rank"), a.alias("start"), b.alias("end"), kind.alias("kind"))

        return F.transform(F.filter(border, lambda b: (b > a) & (b - a).between(10, 14)), kind_of)

    def best(valid: Column) -> Column:
        empty = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")
        chosen = F.aggregate(F.sort_array(valid), empty, lambda out, w: F.when(F.exists(out, lambda o: touching(o, w)), out).otherwise(F.array_append(out, w)))
        return F.transform(F.when(F.size(valid) < 2, valid).otherwise(chosen), lambda w: _number_span(run, norm, w["start"], w["end"], w["kind"]))

    return let(F.filter(F.flatten(F.transform(border, windows)), lambda w: w["kind"].isNotNull()), best)


def with_number_spans(df: DataFrame, norm: str, dropped: str, out: str) -> DataFrame:
    """IBANs, mail addresses, identity and mobile numbers, with offsets into the normalized text; dropped: see dropped()."""
    text = F.col(norm)
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    empty = F.size("_ibans") == 0
    df = df.withColumn("_ibans", F.when(~text.rlike("[Ss][Aa]"), none).otherwise(matches(text, IBAN_IN_TEXT)))

    def shape(m: Column) -> Column:
        before = F.substring(text, F.greatest(m["start"] - 30, F.lit(0)) + 1, F.least(m["start"], F.lit(30)))
        return span(m["start"], m["end"], IBAN, F.when(before.rlike(ACCOUNT_WORDS), 0.9).otherwise(0.6))

    valid = F.filter("_ibans", lambda m: is_iban(F.upper(F.replace(m["text"], F.lit(" "), F.lit("")))))
    df = df.withColumn("_valid", F.when(empty, _none()).otherwise(F.transform(valid, lambda m: span(m["start"], m["end"], IBAN, 0.99))))
    sure = F.size("_valid") == F.size("_ibans")  # no other is left
    df = df.withColumn("_held", F.when(sure, F.col("_valid")).otherwise(claim(F.col("_valid"), F.transform("_ibans", shape)))).drop("_ibans", "_valid")
    df = df.withColumn("_mails", F.when(~text.contains("@"), _none()).otherwise(F.transform(matches(text, EMAIL_SHAPE), lambda m: span(m["start"], m["end"], EMAIL, 0.99))))
    df = df.withColumn("_held", claim(F.col("_held"), F.col("_mails"))).drop("_mails")
    df = df.withColumn("_runs", matches(text, LONG_RUN))
    free = F.filter("_runs", lambda m: ~F.exists("_held", lambda h: touching(m, h)))
    df = df.withColumn("_runs", F.when((F.size("_runs") == 0) | (F.size("_held") == 0), F.col("_runs")).otherwise(free))
    more = F.flatten(F.transform("_runs", lambda m: _digit_spans(m, text, F.col(dropped))))
    return df.withColumn(out, F.when(F.size("_runs") == 0, F.col("_held")).otherwise(F.concat("_held", more))).drop("_held", "_runs")


def with_name_spans(df: DataFrame, text_col: str, out: str, names: Gazetteer = GAZETTEER) -> DataFrame:
    """Person names by gazetteer: known given names, with a family name or a cue where the word is ambiguous.

    Confidence .9 with a family name, .8 after a cue, .7 alone; .75 for an unknown word before a known family name
    unless it names an organisation or kinship.  One pattern finds all of these words, so that only they are looked at.
    """
    text = F.col(text_col)

    def found(patterns: NamePatterns) -> Column:
        def judge(m: Column) -> Column:
            near = m["start"] if patterns.reach is None else F.least(m["start"], F.lit(patterns.reach))
            cue = F.substring(text, m["start"] - near + 1, near).rlike(patterns.after_cue)
            alone = F.when(cue, 0.8).when(~m["text"].rlike(patterns.ambiguous), 0.7)
            conf = F.when(~m["text"].rlike(patterns.two_words), alone).when(m["text"].rlike(patterns.known), 0.9).otherwise(0.75)
            return let(conf, lambda conf: F.when(conf.isNotNull(), span(m["start"], m["end"], PERSON_NAME, conf, "gazetteer")))

        return F.filter(F.transform(matches(text, patterns.found), judge), lambda s: s.isNotNull())

    marked, bare = names.patterns(True), names.patterns(False)
    some_marks = reduce(lambda a, b: a | b, (text.contains(x) for x in WORD_MARKS))
    # rlike keeps its pattern, while a replacement compares a long one for each text
    return df.withColumn(out, F.when(some_marks, found(marked)).when(text.rlike(bare.found), found(bare)).otherwise(_none()))


def dropped(text: Column, norm: Column) -> Column:
    """array<struct<at, n>> of the separators that norm, the normalized text, is without: before its character at place `at`
    n characters of text are missing in all."""
    none = F.array().cast("array<struct<at:int,n:int>>")

    def counted(groups: Column) -> Column:
        def add(out: Column, m: Column) -> Column:
            before = F.coalesce(F.get(out, F.size(out) - 1)["n"], F.lit(0))
            return F.array_append(out, F.struct((m["start"] - before).alias("at"), (before + m["end"] - m["start"]).alias("n")))

        return F.aggregate(groups, none, add)

    return F.when(F.length(norm) == F.length(text), none).when(norm.isNotNull(), let(matches(text, DROPPED), counted))


def place(dropped: Column, at: Column) -> Column:
    """Where in the text the character at a place of its normalized text stands."""
    missing = F.array_max(F.transform(F.filter(dropped, lambda d: d["at"] <= at), lambda d: d["n"]))
    return at + F.when(F.size(dropped) == 0, 0).otherwise(F.coalesce(missing, F.lit(0)))


def with_spans(df: DataFrame, text_col: str, out: str = "spans", names: bool = True, gazetteer: Gazetteer = GAZETTEER) -> DataFrame:
    """df with all spans of a text column, sorted by place; null or empty text: none.

    Each step is a column of its own, so that none is worked out again for every element of the next.
    """
    text = F.col(text_col)
    df = df.withColumn("_norm", normalize(F.when(text.rlike(r"@|\p{Nd}"), text)))
    df = df.withColumn("_dropped", dropped(text, F.col("_norm")))
    df = with_number_spans(df, "_norm", "_dropped", "_numbers")
    moved = F.transform("_numbers", lambda s: span_at(s, place(F.col("_dropped"), s["start"]), place(F.col("_dropped"), s["end"] - 1) + 1))
    df = df.withColumn(out, F.when(F.col("_numbers").isNull(), _none()).when(F.size("_dropped") == 0, F.col("_numbers")).otherwise(moved)).drop("_norm", "_dropped", "_numbers")
    if names:
        df = with_name_spans(df, text_col, "_names", gazetteer)
        df = df.withColumn(out, claim(F.col(out), F.col("_names"))).drop("_names")
    return df.withColumn(out, F.when(F.size(out) > 1, F.sort_array(out)).otherwise(F.col(out)))


def exploded(df: DataFrame, spans: str, name: str = "s") -> DataFrame:
    """df with a row for each span.

    The outer form, filtered afterwards: for the inner one the optimizer infers a filter on the array's size, pushes it
    down through every step of the detection and so works all of them out again.
    """
    return df.withColumn(name, F.explode_outer(spans)).filter(F.col(name).isNotNull())


def span_at(s: Column, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), s["kind"].alias("kind"), s["conf"].alias("conf"), s["source"].alias("source"))


def windows(norm: Column) -> Column:
    """array<struct<kind, canon>>: whatever in a normalized text could be a known identifier, at every place."""
    runs = F.regexp_extract_all(norm, F.lit("[0-9]{10,}"), F.lit(0))

    def pieces(run: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(run) - 9)

        def at(i: Column) -> Column:
            rest = lambda n: F.length(run) - i + 1 >= n
            cut = lambda skip, n: F.substring(run, i + skip, F.lit(n))
            pair = lambda kind, canon: F.struct(F.lit(kind).alias("kind"), canon.alias("canon"))
            return F.array(
                F.when(cut(0, 1).isin("1", "2"), pair(SAUDI_ID, cut(0, 10))), F.when(cut(0, 2) == "05", pair(MOBILE, cut(1, 9))),
                F.when((cut(0, 4) == "9665") & rest(12), pair(MOBILE, cut(3, 9))), F.when(rest(22), pair(IBAN, F.concat(F.lit("SA"), cut(0, 22)))),
            )

        return F.filter(F.flatten(F.transform(starts, at)), lambda x: x.isNotNull())

    mails = F.transform(F.regexp_extract_all(F.lower(norm), F.lit(MAIL_IN_LOWER), F.lit(0)), lambda m: F.struct(F.lit(EMAIL).alias("kind"), m.alias("canon")))
    numbers = F.flatten(F.transform(runs, pieces))
    return F.array_distinct(F.when(norm.contains("@"), F.concat(numbers, mails)).otherwise(numbers))


def baseline_spans(text: Column) -> Column:
    """What a naive tool would find: ASCII patterns, no validation, no normalization, no names."""
    patterns = {SAUDI_ID: "(?<![0-9])[12][0-9]{9}(?![0-9])", MOBILE: "(?<![0-9])05[0-9]{8}(?![0-9])", IBAN: "SA[0-9]{22}", EMAIL: EMAIL_SHAPE}

    def of(kind: str):
        return lambda m: span(m["start"], m["end"], kind, 1.0, "baseline")

    every = [F.when(text.rlike(p), F.transform(matches(text, p), of(kind))).otherwise(_none()) for kind, p in patterns.items()]
    return F.when(text.isNotNull(), F.sort_array(F.concat(*every))).otherwise(_none())


def replace_spans(text: Column, replacements: Column) -> Column:
    """text with each (start, end, value) of a sorted array put in; one that touches an earlier one is skipped."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(state: Column, r: Column) -> Column:
        ok = r["start"] >= state["at"]
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, r["start"] - state["at"]), r["value"])
        return F.when(ok, F.struct(out.alias("out"), r["end"].alias("at"))).otherwise(state)

    done = F.aggregate(replacements, start, put)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
