"""python -m duneveil.plans.cli: twins of a folder of CSV tables, from end to end."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators import guards
from ..operators.policy import DEFAULT, load_policy, policy_from_dict
from ..sources import files
from . import masking, synthesizing


def main(args: list[str] | None = None) -> int:
    """0 if the twin passes, 2 if it fails."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--csv", required=True, help="folder of NAME.csv")
    parser.add_argument("--tables", nargs="+", required=True)
    parser.add_argument("--mode", choices=("masked", "synthetic"), default="masked")
    parser.add_argument("--policy", help="YAML; the default policy where none is given")
    parser.add_argument("--target", help="label = column > p90, or a column of 0 and 1")
    parser.add_argument("--out", required=True)
    given = parser.parse_args(args)
    guards.install()
    key = guards.load_key()
    spark = SparkSession.builder.getOrCreate()
    analysis = masking.analyze(files.csv_folder(spark, given.csv, given.tables))
    policy = load_policy(given.policy) if given.policy else policy_from_dict(DEFAULT)
    run = masking.run_masked(analysis, policy, key) if given.mode == "masked" else synthesizing.run_synthetic(analysis, policy, key, target=given.target)
    masking.write_outputs(run, given.out)
    print(run.report["run_id"], run.report["verdict"])
    return 0 if run.report["verdict"] == "PASS" else 2


if __name__ == "__main__":
    raise SystemExit(main())
