"""The library's operators over whole test tables: each query applies one operator to tables or to people and claims
derived from them (see fixtures)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import IBAN, KINDS, MOBILE, SAUDI_ID, canonical, complete_iban, complete_saudi_id, is_valid
from ..functions.spans import EMAIL_SHAPE, baseline_spans, exploded, matches, with_spans
from ..functions.text import ascii_digits, flatten, normalize, normalize_name
from ..operators import cleaning, fidelity, hierarchy, profiling, returns, review, scans, tokens, twin, viewer
from ..operators.detection import text_spans, valid_shares
from ..operators.policy import DEFAULT, policy_from_dict
from ..operators.report import summary_counts
from ..operators.tables import ROW, ForeignKey, as_text, cells, dealt, numbered, numbered_in_group, shared_dir, written
from ..sources import files, sinks
from . import fixtures, golden, masking, synthesizing

#: Public: it seals nothing but test tables.
TEST_KEY = b"a public key for the test tables only"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.people(spark, sf_dir)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.claims(spark, sf_dir)


def dataset(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """people and claims as text tables; a row's number is its key's order."""
    out = {}
    for name, df, key in (("people", people(spark, sf_dir).drop("balance"), "person_id"), ("claims", claims(spark, sf_dir).drop("amount"), "claim_id")):
        out[name] = written(as_text(df.withColumn(ROW, F.col(key).cast("long"))), name)
    return out


# ---------------------------------------------------------------- functions


def text_forms(spark, sf_dir):
    p = people(spark, sf_dir)
    return p.select("person_id", ascii_digits(F.col("national_id")).alias("ascii_id"), normalize(F.col("national_id")).alias("joined_id"), flatten(F.col("mobile")).alias("flat_mobile"), normalize_name(F.col("full_name")).alias("plain_name"))


def identifier_validity(spark, sf_dir):
    columns = dict(zip(KINDS, ("national_id", "mobile", "iban", "email", "full_name"), strict=True))
    flags = [is_valid(k, F.col(c)).alias(f"valid_{c}") for k, c in columns.items()]
    return people(spark, sf_dir).select("person_id", *flags, *(canonical(k, F.col(c)).alias(f"canonical_{c}") for k, c in columns.items()))


def completed_identifiers(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return _table(spark, sf_dir, "customer").select("c_custkey", complete_saudi_id(F.concat(F.lit("1"), F.lpad(key, 8, "0"))).alias("identity"), complete_iban(F.concat(F.lit("80"), F.lpad(key, 18, "0"))).alias("iban"))


# ---------------------------------------------------------------- profiling and detection


def column_profiles(spark, sf_dir):
    c = as_text(claims(spark, sf_dir).drop("amount").withColumn(ROW, F.col("claim_id").cast("long")))
    stats = profiling.with_dtype(profiling.column_stats(c))
    return stats.select("column", *(F.col(x).cast("long") for x in ("n_rows", "n_null", "n_unique")), "mean_len", "dtype", (F.col("n_unique") == F.col("n_rows")).alias("is_unique"))


def key_containment(spark, sf_dir):
    out = None
    for child, column, parent, key in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "supplier", "s_suppkey")):
        part = profiling.containment(_table(spark, sf_dir, child), column, _table(spark, sf_dir, parent), key).select(F.lit(f"{child}.{column}").alias("child"), F.lit(f"{parent}.{key}").alias("parent"), "n", "inside")
        out = part if out is None else out.unionByName(part)
    return out


def identifier_shares(spark, sf_dir):
    p = people(spark, sf_dir).select(F.col("person_id").cast("long").alias(ROW), "full_name", "national_id", "mobile", "iban", "email", "segment")
    return valid_shares(p)


def note_spans(spark, sf_dir):
    notes = with_spans(claims(spark, sf_dir).select("claim_id", "notes"), "notes")
    s = exploded(notes, "spans")
    return s.select("claim_id", F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"), F.col("s.kind").alias("kind"), F.col("s.conf").alias("conf"))


def naive_note_spans(spark, sf_dir):
    s = claims(spark, sf_dir).select("claim_id", F.explode(baseline_spans(F.col("notes"))).alias("s"))
    return s.select("claim_id", F.col("s.kind").alias("kind")).groupBy("claim_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def document_mails(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").filter(F.col("text").contains("@"))
    return d.select("doc_id", F.explode(matches(F.col("text"), EMAIL_SHAPE)).alias("m")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("m.text")).alias("letters"))


def golden_scores(spark, sf_dir):
    """How the detector and a naive one fare on golden notes, by kind and over all."""
    return golden.scores(*golden.golden(spark, sf_dir)).select("detector", "kind", "golden", "predicted", "found", "exact", "right", "hard_negatives_hit", "recall", "precision")


# ---------------------------------------------------------------- cleaning


def messy(spark, sf_dir) -> DataFrame:
    return spark.sql(fixtures.MESSY.replace("FROM customer", "FROM {customer}"), customer=_table(spark, sf_dir, "customer"))


def cleaned_values(spark, sf_dir):
    m = messy(spark, sf_dir)
    v = F.col
    return m.select(
        "id", cleaning.trim_value(v("padded")).alias("trimmed"), cleaning.null_value(v("maybe")).alias("nulled"), cleaning.number_value(v("grouped")).alias("number"),
        cleaning.date_value(v("day"), "dmy").alias("iso_day"), cleaning.phone_value(v("phone")).alias("phone"),
    )


def deduplicated_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias(ROW), F.col("o_custkey").cast("string").alias("custkey"), F.col("o_orderpriority").alias("priority"))
    return cleaning.dedupe_rows(rows).withColumnRenamed(ROW, "place")


def spelling_suggestions(spark, sf_dir):
    rows = messy(spark, sf_dir).select(F.col("id").cast("long").alias(ROW), "segment")
    return cleaning.category_suggestions(rows, ["segment"]).select("column", "group_key", "target", "variant", "n")


def worth_a_look(spark, sf_dir):
    rows = messy(spark, sf_dir).select(F.col("id").cast("long").alias(ROW), "maybe", "amount", "mixed")
    return cleaning.report_only(rows).select("column", "missing", "extreme_outliers", "mixed_types")


# ---------------------------------------------------------------- review


def review_population(spark, sf_dir):
    c = claims(spark, sf_dir).select(F.col("claim_id").cast("long").alias(ROW), "notes")
    return review.population({"claims": c}, [("claims", "notes")]).select("phrase", "population", "passed")


def review_groups(spark, sf_dir):
    tables = dataset(spark, sf_dir)
    spans = written(text_spans(tables, [("claims", "notes")]), "spans")
    low = review.uncertain(tables, spans, [("claims", "notes")])
    return review.groups(tables, low, [("claims", "notes")])


# ---------------------------------------------------------------- scans


def _originals(spark, sf_dir) -> DataFrame:
    p = people(spark, sf_dir)
    out = None
    for kind, column in ((SAUDI_ID, "national_id"), (MOBILE, "mobile"), (IBAN, "iban"), ("EMAIL", "email")):
        part = p.filter(is_valid(kind, F.col(column))).select(F.lit(kind).alias("kind"), canonical(kind, F.col(column)).alias("canon"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leaked_originals(spark, sf_dir):
    c = claims(spark, sf_dir).select(F.col("claim_id").cast("long").alias(ROW), "notes")
    hits = scans.exhaustive(scans.all_cells({"claims": c})).join(_originals(spark, sf_dir), ["kind", "canon"], "left_semi")
    return hits.select(F.col(ROW).alias("claim_id"), "kind", "canon")


def copied_rows(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    even, odd = o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1")
    return scans.exact_copies(even, odd, ["o_custkey", "o_orderpriority", "o_orderstatus"])


def orphan_rows(spark, sf_dir):
    parents = _table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0")
    return scans.orphans(_table(spark, sf_dir, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


def overlap_scores(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 7).cast("int")
    spans = line.select(F.lit("t").alias("table"), F.lit("c").alias("column"), F.col("l_orderkey").cast("long").alias(ROW), start.alias("start"), (start + F.lit(4) + F.col("l_suppkey") % 9).cast("int").alias("end"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 7).alias("mode"))
    predicted, golden, other = (spans.filter(F.col("mode").isin(*x)).drop("mode") for x in ((0, 1, 2), (0, 3, 4), (5,)))
    return scans.score_detection(predicted, golden, other).select("kind", "golden", "predicted", "found", "exact", "right", "hard_negatives_hit")


# ---------------------------------------------------------------- likeness


def flat_view_places(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return numbered_in_group(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "prior_orders").select("o_orderkey", "o_custkey", F.col("prior_orders").cast("long").alias("prior_orders"))


def distribution_distances(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    a, b = line.filter("l_returnflag = 'A'"), line.filter("l_returnflag = 'R'")
    ks = [fidelity.ks_statistic(a, b, c).withColumnRenamed("ks", "distance") for c in ("l_extendedprice", "l_quantity")]
    rows = ks[0].unionByName(ks[1]).unionByName(fidelity.tvd(a, b, "l_linestatus").withColumnRenamed("tvd", "distance"))
    return rows.select("column", F.round("distance", 9).alias("distance"))


def quality_scores(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    kinds = {"o_totalprice": "numerical", "o_custkey": "numerical", "o_orderdate": "datetime", "o_orderstatus": "categorical", "o_orderpriority": "categorical"}
    return fidelity.quality_scores(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 = 0"), kinds).withColumn("score", F.round("score", 7))


def variance_shares(spark, sf_dir):
    return fidelity.eta_squared(_table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], ["o_totalprice"]).select("category", "number", F.round("eta2", 8).alias("eta2"))


def rows_over_quantile(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    frames, label, _ = fidelity.with_target({"train": o}, "costly = o_totalprice > p90")
    return frames["train"].groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("target").cast("long").alias(label))


def nearest_records(spark, sf_dir):
    ends = _table(spark, sf_dir, "customer").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high")).first()
    scale = float(ends["high"] - ends["low"])
    vector = lambda df, balance, nation: df.select(F.array(F.col(balance).cast("double") / scale, F.col(nation).cast("double") / 25).alias("vector"))
    near = fidelity.nearest_distances(vector(_table(spark, sf_dir, "supplier"), "s_acctbal", "s_nationkey"), vector(_table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey"))
    return near.select(F.round(F.col("vector")[0] * scale, 2).alias("balance"), F.round(F.col("vector")[1] * 25).cast("long").alias("nation"), "n", F.round("nearest", 7).alias("nearest"))


# ---------------------------------------------------------------- views and files


def page_of_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias(ROW), "c_name", F.col("c_custkey").cast("string").alias("number"), "c_mktsegment")
    return viewer.page(rows, 2, 25, "build", "number", True)[0].withColumnRenamed(ROW, "place")


def guarded_cells(spark, sf_dir):
    return messy(spark, sf_dir).select("id", sinks.safe_cell(F.col("formula")).alias("safe"))


def csv_round_trip(spark, sf_dir):
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = messy(spark, sf_dir).select(F.col("id").cast("long").alias(ROW), F.col("id").cast("string").alias("id"), "padded", "maybe", "formula")
    sinks.write_csv_folder({"messy": rows}, folder)
    return files.csv_folder(spark, folder, ["messy"])["messy"].withColumnRenamed(ROW, "place")


def parquet_rows(spark, sf_dir):
    out = None
    for name, df in files.parquet_tables(spark, sf_dir, ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events"]).items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def numbered_rows(spark, sf_dir):
    rows = numbered(_table(spark, sf_dir, "nation").orderBy("n_nationkey"))
    return rows.select(F.col(ROW).alias("place"), "n_nationkey", "n_name")


# ---------------------------------------------------------------- twins


_runs: dict[tuple[str, str], tuple] = {}


def _masked(spark, sf_dir):
    """The tables and their masked twin, which is stored and read again by the queries of one session."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _runs:
        tables = dataset(spark, sf_dir)
        _runs[at] = tables, masking.run_masked(masking.analyze(tables), policy_from_dict(DEFAULT), TEST_KEY)
    return _runs[at]


def masked_twin(spark, sf_dir):
    """The masked claims with their people."""
    _, result = _masked(spark, sf_dir)
    p, c = result.twin["people"], result.twin["claims"]
    return c.select("claim_id", "person_id", "notes").join(p.select("person_id", "full_name", "national_id", "mobile", "iban", "email"), "person_id")


def masked_twin_facts(spark, sf_dir):
    """What must hold of the masked twin, as counts."""
    tables, result = _masked(spark, sf_dir)
    p, c = result.twin["people"], result.twin["claims"]
    new = p.select(F.col(ROW), *(F.col(x).alias(f"new_{x}") for x in ("person_id", "national_id", "mobile", "iban", "email", "full_name")))
    both = tables["people"].join(new, ROW)
    same = [F.count_if(F.col(x) == F.col(f"new_{x}")).alias(f"same_{x}") for x in ("national_id", "full_name")]
    valid = [F.count_if(is_valid(k, F.col(f"new_{x}"))).alias(f"valid_{x}") for k, x in ((SAUDI_ID, "national_id"), (MOBILE, "mobile"), (IBAN, "iban"))]
    facts = both.agg(F.count(F.lit(1)).alias("people"), *same, *valid, F.countDistinct("new_national_id").alias("distinct_ids"), F.countDistinct("new_person_id").alias("distinct_keys"))
    lost = scans.orphans(c, "person_id", p, "person_id").agg(F.count(F.lit(1)).alias("orphans"))
    hits = scans.leaks(result.twin, _originals(spark, sf_dir), result.seen).agg(F.count(F.lit(1)).alias("leaks"))
    n = c.agg(F.count(F.lit(1)).alias("claims"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(facts).join(one(lost), "k").join(one(hits), "k").join(one(n), "k").drop("k")


def masked_note_frames(spark, sf_dir):
    """The masked notes, row by row, with the masked values of their own person taken out: what is left must be what is left of
    the original notes, or a value has another pseudonym in its column than in a note, another layout, or another owner."""
    _, result = _masked(spark, sf_dir)
    p, frame = result.twin["people"].drop(ROW), F.col("notes")
    for tag in ("iban", "email", "mobile", "national_id", "full_name"):
        frame = F.replace(frame, F.trim(tag), F.lit(f"<{tag}>"))
    return result.twin["claims"].drop("claim_id").join(p, "person_id").select(F.col(ROW).alias("claim_id"), frame.alias("frame"))


def masked_report(spark, sf_dir):
    """The report's counts and checks, a row each."""
    _, result = _masked(spark, sf_dir)
    rows = [(k, str(v)) for k, v in summary_counts(result.report).items()] + [(f"check:{c['name']}", c["status"]) for c in result.report["checks"]]
    return spark.createDataFrame(rows, "what string, value string")


def synthetic_twin(spark, sf_dir):
    tables = dataset(spark, sf_dir)
    tables["claims"] = written(tables["claims"].join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias(ROW), F.col("o_totalprice").cast("string").alias("amount")), ROW), "claims")
    result = synthesizing.run_synthetic(masking.analyze(tables), policy_from_dict(DEFAULT), TEST_KEY)
    return next(iter(result.twin.values()))


ORDER_KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": None}
ORDER_LINKS = [ForeignKey("orders", "o_custkey", "customer", "c_custkey"), ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey")]


def child_summaries(spark, sf_dir):
    """What the lines of each order add up to on it."""
    sums = hierarchy.summaries(_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity", "l_discount"])
    return sums.select(F.col("parent").alias("o_orderkey"), "n", F.round("mean_0", 6).alias("mean_quantity"), F.round("mean_1", 6).alias("mean_discount"))


def _multi_table_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, value): of three levels, how many rows there are, how many on a parent, and how columns go together across levels."""
    c, o, x = (tables[t] for t in ("customer", "orders", "lineitem"))
    lines = x.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("q"))
    orders = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"))
    customers = c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").withColumns({"k": F.coalesce("k", F.lit(0)), "all": F.coalesce("all", F.lit(0))})
    of_orders = orders.agg(F.avg("n").alias("lines_per_order"), F.corr("o_totalprice", "n").alias("price_with_lines"), F.corr("o_totalprice", "q").alias("price_with_quantity"))
    of_customers = customers.agg(F.avg("k").alias("orders_per_customer"), F.stddev_pop("k").alias("spread_of_orders"), F.corr("k", "all").alias("orders_with_lines"), F.corr("c_acctbal", "k").alias("balance_with_orders"))
    of_lines = x.agg(F.corr("l_quantity", "l_extendedprice").alias("quantity_with_price"), F.corr("l_quantity", "l_discount").alias("quantity_with_discount"))
    out = None
    for df in (of_orders, of_customers, of_lines):
        part = df.unpivot([], df.columns, "what", "value")
        out = part if out is None else out.unionByName(part)
    return out


def multi_table_facts(spark, sf_dir):
    """Facts of customers, orders and lines, and whether a synthetic twin of all three has them too: correlations within 0.05,
    numbers within 5%."""
    used = {"customer": {"c_acctbal": "numerical", "c_mktsegment": "categorical"}, "orders": {"o_totalprice": "numerical", "o_orderstatus": "categorical"}, "lineitem": {"l_quantity": "numerical", "l_extendedprice": "numerical", "l_discount": "numerical", "l_returnflag": "categorical"}}
    links = {"customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey"]}
    tables = {}
    for t, kinds in used.items():
        columns = [*links[t], *kinds]
        own = F.xxhash64("l_orderkey", "l_linenumber") if t == "lineitem" else F.col(links[t][0]).cast("long")
        tables[t] = written(_table(spark, sf_dir, t).withColumn(ROW, own).select(ROW, *columns), t)
    model = hierarchy.HierarchicalCopula(ORDER_KEYS, ORDER_LINKS)
    model.fit(tables, used)
    real, made = _multi_table_facts(tables), _multi_table_facts(model.sample()).select(F.col("what").alias("w"), F.col("value").alias("made"))
    gap = F.abs(F.col("value") - F.col("made"))
    near = F.when(F.col("what").contains("with"), gap <= 0.05).otherwise(gap <= 0.05 * F.col("value"))
    return real.join(made, F.col("what") == F.col("w")).select("what", F.round("value", 4).alias("value"), near.alias("near"))


# ---------------------------------------------------------------- tokens and returns


def _shared(spark, sf_dir):
    """(customers as shared with tokens, the same with references, sealer)."""
    rows = dealt(_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias(ROW), F.col("c_custkey").cast("string").alias("customer_id"), "c_name", "c_mktsegment"))
    twins = {"customer": tokens.add_references(rows, "customer_id").drop("customer_id")}
    sealer = tokens.Sealer("share-1", "dataset-1", 1, TEST_KEY)
    return rows, twins, tokens.for_share(twins, sealer), sealer


def _returned(spark, sf_dir):
    """What comes back: every 7th token altered, every 11th blank, every 13th of another share, every 5th row twice."""
    rows, twins, shared, sealer = _shared(spark, sf_dir)
    other = tokens.seal_column(tokens.Sealer("share-2", "dataset-1", 1, TEST_KEY), 0)
    own = F.col(tokens.TOKEN_COLUMN)
    k = F.col(ROW)
    last = F.substring(own, -4, 1)
    altered = F.concat(F.expr(f"left({tokens.TOKEN_COLUMN}, length({tokens.TOKEN_COLUMN}) - 4)"), F.when(last == "A", "B").otherwise("A"), F.substring(own, -3, 3))
    token = F.when(k % 7 == 0, altered).when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, other(k.cast("string"))).otherwise(own)
    back = written(shared["customer"], "shared").withColumn(tokens.TOKEN_COLUMN, token).withColumn("score", (k * 3).cast("string")).withColumn("c_name", F.when(k % 17 == 0, F.lit("changed")).otherwise(F.col("c_name")))
    twice = back.filter(k % 5 == 0).withColumn(ROW, k + 1_000_000_000)
    return rows, twins, {"returned": back.unionByName(twice)}, sealer


def token_references(spark, sf_dir):
    """Every token opened again."""
    rows, _, shared, sealer = _shared(spark, sf_dir)
    opened = shared["customer"].withColumn("o", tokens.open_column(sealer)(F.col(tokens.TOKEN_COLUMN)))
    return opened.select("c_name", F.col("o.status").alias("status"), F.col("o.row_key").alias("customer_id"))


def return_statuses(spark, sf_dir):
    _, _, sheets, sealer = _returned(spark, sf_dir)
    rows = tokens.classified(returns.combined(sheets), F.col("token"), sealer, 1)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def relinked_rows(spark, sf_dir):
    rows, twins, sheets, sealer = _returned(spark, sf_dir)
    verified, report = returns.verify(sheets, twins, sealer)
    out, _ = returns.relink(verified, report, {"customer": rows.withColumnRenamed("c_name", "original_name")}, {"customer": "customer_id"})
    return out["customer"].select("customer_id", "original_name", "score", "relink_status")


def totals_of_columns(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias(ROW), F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderkey").cast("string").alias("order"))
    return cells(o).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(viewer.number_of(F.col("value"))).cast("long").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        text_forms, identifier_validity, completed_identifiers, column_profiles, key_containment, identifier_shares, note_spans, naive_note_spans, golden_scores, document_mails,
        cleaned_values, deduplicated_rows, spelling_suggestions, worth_a_look, review_population, review_groups, leaked_originals, copied_rows, orphan_rows, overlap_scores,
        flat_view_places, distribution_distances, quality_scores, variance_shares, rows_over_quantile, nearest_records, page_of_rows, guarded_cells, csv_round_trip, parquet_rows, numbered_rows,
        masked_twin, masked_twin_facts, masked_note_frames, masked_report, synthetic_twin, child_summaries, multi_table_facts, token_references, return_statuses, relinked_rows, totals_of_columns,
    )
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_twin(spark, sf_dir)


def preview(spark: SparkSession, texts: list[str], key: bytes) -> DataFrame:
    """Texts of a person at the screen, masked."""
    df = spark.createDataFrame(list(enumerate(texts)), f"{ROW} long, value string")
    return twin.mask_texts(df, text_spans({"preview": df}, [("preview", "value")]), key)
