"""Secret scans: candidates by pattern, false positives removed by a random forest (DataFrame operations only).

A candidate is a run of 16 or more characters of A-Z a-z 0-9 _ + / = . - that holds a digit, or any value of 6 or more
characters that is assigned to a secret word, quoted after one, or the password of a URL.  The forest sees its
length, its character transitions and shares, how much of it the dictionary covers (the words that enough texts
of the corpus hold), the path it is found under and the words beside it.  It learns from labelled findings: lines
of text, each with a candidate and whether that was a secret.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

_CHARS = r"A-Za-z0-9_+/=.\-"
#: Words of so many letters that at least so many texts hold are in the dictionary.
MIN_LETTERS, MIN_TEXTS = 4, 5
TREES, DEPTH, SEED = 40, 7, 11
N_LABELLED = 6000
#: Words so many characters before a candidate stand beside it.
LOOK = 48

# What stands beside secrets and beside look-alikes, starts of issued keys, placeholders, test paths.
SECRET_WORDS = "key|token|secret|passw|pwd|passphrase|auth|bearer|credential|private|signature"
_NAME = rf"(?i:{SECRET_WORDS})[A-Za-z0-9_.\-]{{0,16}}"
#: Before a value: a name and a sign of assignment or a quote, or the scheme of a header; the first look is the cheap one.
_NAMED = rf"(?<=[\"'`=:>\s])(?<=[=:>]\s{{0,4}}[\"'`]?|[\s][\"'`]|(?i:bearer|basic)\s)(?<={_NAME}[\"'`]?\s{{0,4}}(?:[=:>]{{1,2}}\s{{0,4}}[\"'`]?|[\"'`])|\b(?i:bearer|basic)\s{{1,4}})"
_VALUE = r"(?!(?i:bearer|basic)\s)(?:(?<=\")[^\"\r\n]{6,}+(?=\")|(?<=')[^'\r\n]{6,}+(?=')|(?<=`)[^`\r\n]{6,}+(?=`)|[^\s\"'`=:>,;][^\s\"'`,;]{5,}+)"
_PASSWORD = r"(?<=:)(?<=://[^\s:/@]{0,64}:)[^\s/]{6,}(?=@)"
_RUN = rf"(?<![{_CHARS}])(?=[A-Za-z_+/=.\-]*+[0-9])(?![A-Za-z0-9_.\-]*?{_NAME}=[^\s\"'`,;]{{6}})[{_CHARS}]{{16,}}+"
CANDIDATE = rf"{_NAMED}{_VALUE}|{_PASSWORD}|{_RUN}"
HARMLESS_WORDS = "sha|hash|digest|commit|checksum|md5|uuid|guid|revision|version|href|src|url|mail|phone|card|iban|order|invoice|isbn"
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|eyJ)"
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your|x{4,}|0{6,}|1234567|abcdef|deadbeef"
TEST_PATH = r"(?i)(^|[/._-])(tests?|examples?|samples?|fixtures?|docs?|dist|vendor|lock)([/._-]|$)"

FEATURES = (
    "length", "digits", "uppers", "symbols", "transitions", "hex_only", "letters_only_runs", "distinct", "dictionary", "slashes", "dots", "issued",
    "placeholder", "assigned", "quoted", "secret_words", "harmless_words", "mail", "in_url", "test_path",
)


def candidates(lines: DataFrame, line: Column, *keep: str) -> DataFrame:
    """keep, place, left, candidate, right: a row for each candidate of a line, with what stands on the line before it
    (LOOK characters of it, and what is between it and the one before) and up to the next one."""
    rows = lines.filter(line.rlike(CANDIDATE)).select(*keep, F.regexp_extract_all(line, F.lit(CANDIDATE), F.lit(0)).alias("_found"), F.split(line, CANDIDATE, -1).alias("_between"))
    most = LOOK // 6

    def placed(candidate: Column, i: Column) -> Column:
        """A candidate with what is beside it, before lines are exploded: a row carries no other candidate of its line."""
        some = lambda x: F.slice(x, F.greatest(i + 1 - most, F.lit(1)), F.least(i, F.lit(most)))
        earlier = F.zip_with(some("_between"), some("_found"), lambda x, y: F.concat(F.substring(x, -LOOK, LOOK), F.substring(y, -LOOK, LOOK)))
        left = F.concat(F.substring(F.array_join(earlier, ""), -LOOK, LOOK), F.element_at("_between", i + 1))
        return F.struct(i.alias("place"), left.alias("left"), candidate.alias("candidate"), F.element_at("_between", i + 2).alias("right"))

    return rows.select(*keep, F.explode(F.transform("_found", placed)).alias("_x")).select(*keep, "_x.*")


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def features(found: DataFrame) -> DataFrame:
    """The column `features` from left, candidate, right, path and covered (letters that the dictionary covers)."""
    c, left, right = F.col("candidate"), F.col("left"), F.col("right")
    near = F.lower(F.substring(left, -LOOK, LOOK))
    borders = F.regexp_replace(c, "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])", "\u0001")
    is_true = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    columns = {
        "length": F.log(F.length(c).cast("double")),
        "digits": _share(c, "[^0-9]"), "uppers": _share(c, "[^A-Z]"), "symbols": _share(c, "[A-Za-z0-9]"),
        "transitions": (F.length(borders) - F.length(c)) / F.length(c),
        "hex_only": is_true(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "letters_only_runs": _share(c, "[^A-Za-z]|(?<![A-Za-z])[A-Za-z]{1,3}(?![A-Za-z])"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "dictionary": F.coalesce("covered", F.lit(0)) / F.length(c),
        "slashes": F.length(F.regexp_replace(c, "[^/]", "")).cast("double"), "dots": F.length(F.regexp_replace(c, r"[^.]", "")).cast("double"),
        "issued": is_true(c.rlike(ISSUED)), "placeholder": is_true(c.rlike(PLACEHOLDER)),
        "assigned": is_true(left.rlike(r"[=:]\s*[\"'`]?$")), "quoted": is_true(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        "secret_words": is_true(near.rlike(SECRET_WORDS)), "harmless_words": is_true(near.rlike(HARMLESS_WORDS)),
        "mail": is_true(left.endswith("@") | right.startswith("@")), "in_url": is_true(left.rlike(r"(://|www\.)[^\s]*$") | c.rlike("^//")),
        "test_path": is_true(F.col("path").rlike(TEST_PATH)),
    }
    return found.withColumn("features", F.array(*(columns[x].cast("double") for x in FEATURES)))


def labelled_findings(spark: SparkSession, n: int = N_LABELLED) -> DataFrame:
    """(line, path, label): lines with a candidate, made by rule; 1 where it is a secret.

    Values are digests of the row number, so they have the character statistics of random keys; look-alikes are
    digests, identifiers, addresses and placeholders in their own contexts.
    """
    k = F.col("id").cast("string")
    hex_ = F.sha2(k, 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), k), 256))), "[=]", "")
    digits = F.substring(F.regexp_replace(F.concat(hex_, F.sha2(hex_, 256)), "[^0-9]", ""), 1, 16)
    words = F.array(*map(F.lit, "release index module service report archive picture summary chapter invoice network gallery".split()))
    word = lambda salt: F.element_at(words, (F.pmod(F.hash(F.col("id"), F.lit(salt)), F.lit(12)) + 1).cast("int"))
    names = F.array(*map(F.lit, ("token", "api_key", "secret", "password", "auth_token", "client_secret", "private_key", "access_key")))
    name = F.element_at(names, (F.pmod(F.hash(F.col("id"), F.lit(1)), F.lit(8)) + 1).cast("int"))
    name = F.when(F.pmod(F.col("id"), F.lit(5)) == 0, F.upper(name)).otherwise(name)
    cut = lambda x, low, high: F.substring(x, F.lit(1), (F.pmod(F.hash(F.col("id"), F.lit(2)), F.lit(high - low + 1)) + low).cast("int"))
    join = lambda *x: F.concat(*(y if isinstance(y, Column) else F.lit(y) for y in x))
    symbol = F.substring(F.lit("!@#$%&*^"), F.pmod(F.hash(F.col("id"), F.lit(7)), F.lit(8)) + 1, F.lit(1))
    kinds = [
        (join(name, ' = "', F.substring(hex_, 1, 40), '"'), 1), (join(name, "=", cut(mixed, 24, 40)), 1), (join("export ", F.upper(name), "='", cut(hex_, 32, 64), "'"), 1),
        (join(name, ": ", cut(mixed, 20, 43)), 1), (join("Authorization: Bearer ", mixed), 1), (join("use AKIA", F.upper(F.substring(hex_, 1, 16)), " to sign in"), 1),
        (join("ghp_", F.substring(mixed, 1, 36), " still works"), 1), (join("the ", name, " is ", cut(mixed, 28, 43), " for now"), 1),
        (join("commit ", F.substring(hex_, 1, 40)), 0), (join("sha256: ", hex_, " ", word(3), ".tar.gz"), 0), (join("see https://", word(3), ".example.com/", word(4), "/", F.substring(hex_, 1, 12), "/", word(5)), 0),
        (join("write to ", word(3), ".", word(4), "@mail", F.substring(digits, 1, 1), ".example.com today"), 0), (join("card ", digits), 0), (join(word(3), "-", word(4), "-", word(5), "-", F.substring(digits, 1, 4)), 0),
        (join("id ", F.substring(hex_, 1, 8), "-", F.substring(hex_, 9, 4), "-4", F.substring(hex_, 13, 3), "-a", F.substring(hex_, 16, 3), "-", F.substring(hex_, 19, 12)), 0),
        (join(name, ' = "your-', word(3), "-", word(4), '-key-1234567"'), 0), (join(name, ' = "xxxxxxxxxxxxxxxx', F.substring(digits, 1, 4), '"'), 0),
        (join("/usr/lib/", word(3), "/", word(4), F.substring(digits, 1, 1), "/", word(5), ".so"), 0), (join(word(3), "_", word(4), "_", word(5), "_v", F.substring(digits, 1, 2), ".", F.substring(digits, 3, 1), " is out"), 0),
        (join("etag: ", F.md5(k)), 0), (join(digits, F.substring(digits, 1, 4), " ", word(3)), 0), (join(F.upper(F.substring(hex_, 1, 2)), digits, F.substring(digits, 3, 8), " ", word(4)), 0),
        (join(name, ' = "', word(3), symbol, F.substring(mixed, 1, 3), F.substring(digits, 1, 2), '"'), 1), (join(name, "=", cut(mixed, 6, 12), symbol, F.substring(mixed, 20, 3)), 1),
        (join(name, ': "', cut(mixed, 8, 15), '"'), 1), (join("postgres://", word(3), ":", cut(mixed, 7, 14), "@db.example.com/", word(4)), 1),
        (join(name, "=", F.translate(cut(mixed, 16, 30), "0123456789+/", "abQwZkLmRtyX")), 1), (join(name, ' = "', word(3), " ", word(4), " ", word(5), " ", word(6), '"'), 1),
        (join(name, ": ", word(3), " ", word(4), " of the ", word(5)), 0), (join(name, " = load_", word(3), "(", word(4), ")"), 0), (join("author: ", word(3), " ", word(4)), 0),
        (join(name, ' = "<', word(3), '>"'), 0), (join(name, ": required, see the ", word(3)), 0), (join(name, " = ${", F.upper(word(3)), "_", F.upper(word(4)), "}"), 0),
    ]
    line, label = F.array(*(x for x, _ in kinds)), F.array(*(F.lit(y) for _, y in kinds))
    which = (F.pmod(F.col("id"), F.lit(len(kinds))) + 1).cast("int")
    paths = F.array(*map(F.lit, ("src/main.py", "tests/test_keys.py", "config/settings.env", "README.md", "docs/guide.md", "page")))
    path = F.element_at(paths, (F.pmod(F.hash(F.col("id"), F.lit(9)), F.lit(6)) + 1).cast("int"))
    before = F.element_at(F.array(F.lit(""), F.lit("and then "), F.lit("  ")), (F.pmod(F.hash(F.col("id"), F.lit(8)), F.lit(3)) + 1).cast("int"))
    return spark.range(n).select(F.concat(before, F.element_at(line, which)).alias("line"), path.alias("path"), F.element_at(label, which).alias("label"))


def dictionary(texts: DataFrame, min_letters: int = MIN_LETTERS, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(word): lower-case ASCII words that stand in the text column at least min_texts times."""
    words = texts.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter(F.length("word").between(min_letters, 64))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_texts).select("word")


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """(id, line_no, place, n_chars, digest, score, is_secret): a row for each candidate of each text.

    line_no and place count from 0 (the place among the line's candidates); digest is the candidate's SHA-256, so
    that a report holds no secret; score is the forest's share of trees' votes; is_secret is score >= threshold.
    labelled: (line, path, label) to learn from, labelled_findings() where none is given.  A text that is null,
    empty or without candidates gives no row, and so does an empty table; null ids pass through; repeated rows give
    repeated findings.  Long texts and lines count whole, in time that grows with their length.  Ties don't arise.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).cast("string").alias("text"))
    lines = texts.filter(F.col("text").rlike(CANDIDATE)).select("id", "path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = saved(candidates(lines, F.col("line"), "id", "path", "line_no"), "candidates")
    labelled = labelled_findings(spark) if labelled is None else labelled
    known = candidates(labelled, F.col("line"), "path", "label")

    runs = found.select("candidate").union(known.select("candidate")).distinct()
    runs = runs.select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(rf"[a-z]{{{MIN_LETTERS},64}}"), F.lit(0))).alias("run"))
    covered = runs.join(dictionary(texts), F.col("run") == F.col("word")).groupBy(F.col("candidate").alias("of")).agg(F.sum(F.length("run")).alias("covered"))
    covered = saved(covered, "covered")

    def described(rows: DataFrame) -> DataFrame:
        rows = features(rows.join(covered, F.col("candidate") == F.col("of"), "left"))
        return rows.withColumn("vector", array_to_vector("features"))

    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.8, seed=SEED)
    learned = described(known).select("vector", F.col("label").cast("double").alias("label")).coalesce(2).cache()
    model = forest.fit(learned)
    learned.unpersist()
    scored = model.transform(described(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        F.col("id").alias(id_col), F.col("line_no").cast("long").alias("line_no"), F.col("place").cast("long").alias("place"), F.length("candidate").cast("long").alias("n_chars"),
        F.sha2("candidate", 256).alias("digest"), "score", (F.col("score") >= threshold).alias("is_secret"),
    )
