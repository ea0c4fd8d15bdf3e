"""generate_twin: clean tables in, a stored twin out, replaced as a whole or not at all.

A twin is a folder: versions of its tables, and manifest.json, which names the version that counts.  A version is written in
full before the manifest is renamed into place; who reads follows the manifest, so that a run that dies leaves the old twin.
The tables of a run lie in a session that ends with it: no original outlives it but those that the caller holds.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..operators import sessions, tokens, viewer
from ..operators.policy import Policy
from ..operators.report import shareable
from ..sources import sinks
from . import masking, synthesizing

MODES = ("masked", "synthetic", "multi_table")


class TwinError(RuntimeError):
    """code: unknown_mode, too_large, unsupported, shared or no_twin."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Twin:
    """What the manifest tells: names, options and counts, no value."""

    name: str
    dataset: str
    mode: str
    verdict: str
    report: dict
    version: str | None
    shared: bool = False


@dataclass(frozen=True)
class Options:
    mode: str = "masked"
    overrides: dict | None = None
    decisions: dict | None = None
    target: str | None = None
    cleaning: dict | None = None
    #: More rows than that are refused for synthetic twins.
    most_synthetic: int | None = None


def _manifest(folder: str, name: str) -> str:
    return f"{folder}/{name}/manifest.json"


def commit(spark: SparkSession, folder: str, twin: Twin) -> Twin:
    """Put the manifest in place of the old one by a rename."""
    path, new = _manifest(folder, twin.name), f"{folder}/{twin.name}/manifest-{uuid.uuid4().hex}.new"
    sessions.write_text(spark, new, json.dumps(vars(twin), ensure_ascii=False, default=str))
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where = fs.Path(path)
    fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.Path(new), where, over)
    return twin


def find(spark: SparkSession, folder: str, name: str) -> Twin:
    text = sessions.read_text(spark, _manifest(folder, name))
    if text is None:
        raise TwinError("no_twin")
    return Twin(**json.loads(text))


def load(spark: SparkSession, folder: str, name: str) -> tuple[Twin, dict[str, DataFrame], DataFrame | None]:
    """(twin, tables, marks) of the version that counts; a withheld twin has no tables."""
    twin = find(spark, folder, name)
    if twin.version is None:
        return twin, {}, None
    tables, marks, _ = sinks.read_table_set(spark, f"{folder}/{name}/{twin.version}")
    return twin, tables, marks


def share(spark: SparkSession, folder: str, name: str, pending: int = 0) -> Twin:
    """Mark a twin as shared: from then on it is never replaced."""
    twin = find(spark, folder, name)
    why = shareable(twin.report, twin.version is not None, pending)
    if why:
        raise TwinError(why)
    return commit(spark, folder, replace(twin, shared=True))


def generate_twin(tables: dict[str, DataFrame], folder: str, dataset: str, policy: Policy, key: bytes, options: Options = Options(), key_version: int = 1, replaces: str | None = None) -> Twin:
    """Analyze, run, add row references, and store with marks and the options that would make it again.

    replaces: a twin of the same dataset that has not been shared is replaced in place and keeps its name; one that was
    shared stays, and a new twin is made beside it.  A twin with a leak is withheld: its manifest has no version.
    """
    if options.mode not in MODES:
        raise TwinError("unknown_mode")
    spark = next(iter(tables.values())).sparkSession
    if options.mode != "masked" and options.most_synthetic is not None and sum(df.count() for df in tables.values()) > options.most_synthetic:
        raise TwinError("too_large")
    old = None
    if replaces is not None:
        old = find(spark, folder, replaces)
        old = None if old.shared or old.dataset != dataset else old
    name, version = old.name if old else uuid.uuid4().hex, f"v-{uuid.uuid4().hex}"
    session = sessions.begin(spark)
    try:
        with sessions.using(session):
            analysis = masking.analyze(tables)
            if options.mode == "masked":
                result = masking.run_masked(analysis, policy, key, options.overrides, options.decisions)
            else:
                try:
                    result = synthesizing.run_multi_table(analysis, policy, key) if options.mode == "multi_table" else synthesizing.run_synthetic(analysis, policy, key, target=options.target)
                except (ValueError, KeyError, ZeroDivisionError) as e:
                    raise TwinError("unsupported") from e
            made, links = dict(result.twin), {}
            if options.mode == "masked" and not result.report["withheld"]:
                for t, df in made.items():
                    links[t] = tokens.usable_key(df, analysis.profile.primary_keys.get(t))
                    made[t] = tokens.add_references(df, links[t])
            entity = viewer.entity_key(analysis.profile) if options.mode == "masked" else None
            report = result.report | {"generation": {
                "dataset": dataset, "mode": options.mode, "overrides": options.overrides or {}, "decisions": options.decisions or {}, "cleaning": options.cleaning or {}, "target": options.target,
                "link": {"table": entity[0], "column": entity[1]} if entity else None, "source": [{"table": t["table"], "rows": t["rows"]} for t in result.report["input"]["tables"]],
                "references": links, "key_version": key_version, "made_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
            }}
            kept = None
            if not result.report["withheld"]:
                sinks.write_table_set(made, f"{folder}/{name}/{version}", result.marks, {"mode": options.mode})
                kept = version
            twin = commit(spark, folder, Twin(name, dataset, options.mode, result.report["verdict"], report, kept))
    except BaseException:
        sessions.delete(spark, f"{folder}/{name}/{version}")
        raise
    finally:
        session.end()
    if old and old.version:
        sessions.delete(spark, f"{folder}/{name}/{old.version}")
    return twin


def purge(spark: SparkSession, folder: str, name: str) -> Twin:
    """Delete a twin's tables; its report stays."""
    twin = find(spark, folder, name)
    gone = commit(spark, folder, replace(twin, version=None))
    if twin.version:
        sessions.delete(spark, f"{folder}/{name}/{twin.version}")
    return gone
