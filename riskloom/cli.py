"""Command line: python -m riskloom.cli COMMAND --out DIR [--data DIR | --clinical-root DIR --recordings-root DIR].

The tables come from the clinical roots, or with --data from the driver's tables. Each stage writes its tables under --out and
a Markdown report beside them; `pipeline` runs all and stops at the first that fails. Exit status: 0 done, 1 a stage
failed or an input is missing.

Scores are real (from recordings, with a model named by --model) or drawn at random with --simulate; nothing falls back from
one to the other. `probe` writes them to OUT/predictions.parquet with a manifest; later stages read that or --predictions, and
refuse a table that doesn't match its manifest, or one of another mode, unless allowed.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import bootstrap, metrics
from riskloom.operators import adapters, battery, cohort, figures, incremental, outcomes, reports, scoring, sensitivity, splits, strata, synthesis
from riskloom.operators.probe import Probe, fit_probe
from riskloom.session import local_session, materialize
from riskloom.sources import bindings as bind
from riskloom.sources import files, paths, provenance, synthetic
from riskloom.sources.recordings import waveforms_available
from riskloom.sources.tables import save_table

OUTCOMES = ("mortality_30d", "mortality_90d", "mortality_1yr")
A, B = "model_a_score", "model_b_score"
VERSION = "riskloom 0.2"
SIMULATED_REPLICATES = 50


@dataclass
class Context:
    """What a run was asked for, and the tables it works on, read once."""

    spark: SparkSession
    args: argparse.Namespace
    mode: str | None = None

    def say(self, text: str) -> None:
        if self.args.verbose:
            print(text)

    @property
    def replicates(self) -> int:
        return self.args.bootstraps or (SIMULATED_REPLICATES if self.args.simulate else metrics.REPLICATES)

    @cached_property
    def roots(self) -> paths.DataPaths:
        return paths.resolve(self.args.clinical_root, self.args.recordings_root)

    @cached_property
    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(records, patients, admissions)"""
        if self.args.data:
            return tuple(f(self.spark, self.args.data) for f in (bind.records, bind.patients, bind.admissions))
        return paths.load_tables(self.spark, self.roots)

    def outcomes_of(self, records: DataFrame) -> DataFrame:
        _, patients, admissions = self.tables
        return outcomes.mortality_outcomes(cohort.adults(cohort.age_at_recording(records, patients)), patients, admissions)

    @cached_property
    def index(self) -> DataFrame:
        """The index recordings with outcomes and split, as a table of the run; of the first --max-records subjects, if asked."""
        chosen = cohort.index_recordings(self.outcomes_of(self.tables[0]).where("is_valid"))
        if self.args.max_records:
            chosen = chosen.join(chosen.select("subject_id").orderBy("subject_id").limit(self.args.max_records), "subject_id", "left_semi")
        save_table(splits.hashed_split(chosen, seed=self.args.seed), f"{self.args.out}/cohort")
        held = self.spark.read.parquet(f"{self.args.out}/cohort")
        splits.verify_disjoint(held)
        return held

    def derived(self) -> tuple[DataFrame, DataFrame | None, Probe]:
        """(predictions, embeddings where they were made up, probe)"""
        if self.args.simulate:
            made, embedded = synthetic.simulate(self.index, self.args.seed)
            self.mode = "simulation"
            return made, embedded, fit_probe(embedded, "embedding", OUTCOMES[0])
        if "path" not in self.index.columns or not waveforms_available(self.index, self.roots.recordings):
            raise FileNotFoundError(f"no recordings under {self.roots.recordings}; real scores need them (--simulate draws scores)")
        if not self.args.model:
            raise ValueError("real scores need --model MODULE:NAME")
        module, _, name = self.args.model.partition(":")
        make = getattr(importlib.import_module(module), name)
        spec = adapters.Spec(self.args.model, "1", dim=make().dim)
        made, probe = scoring.build(self.index, self.roots.recordings, make, spec, checkpoint=self.args.checkpoint_path, batch_size=self.args.batch_size)
        self.mode = "real"
        return made, None, probe

    @property
    def held_predictions(self) -> str | None:
        """--predictions, or what `probe` wrote into the same folder."""
        own = f"{self.args.out}/predictions.parquet"
        return self.args.predictions or (own if paths.exists(self.spark, own) else None)

    @cached_property
    def predictions(self) -> DataFrame:
        if path := self.held_predictions:
            allowed = self.args.allow_unverified_artifact or self.args.allow_simulated_artifact
            df, self.mode = provenance.load_verified(self.spark, path, real=not self.args.simulate, allow_unverified=allowed)
            return df
        return self.derived()[0]

    @cached_property
    def nested(self) -> tuple[DataFrame, DataFrame, float, float, DataFrame]:
        """(models, gains, likelihood ratio, p, rated test rows) of nested models, fitted once a run."""
        dev, test = self.scored.where("split = 'dev'"), self.scored.where("split = 'test'")
        table, scored, _ = incremental.nested_models(dev, test, OUTCOMES[0], A, B)
        gains = materialize(incremental.gains(scored, OUTCOMES[0], replicates=self.replicates, seed=self.args.seed), "gains")
        return table, gains, *incremental.likelihood_ratio(table), scored

    @property
    def scored(self) -> DataFrame:
        return self.predictions.where("model_a_valid AND model_b_valid")


def inventory(c: Context) -> dict[str, DataFrame]:
    records, patients, admissions = c.tables
    if c.args.data:
        records, admissions = bind.views(c.spark, c.args.data), bind.stays(c.spark, c.args.data)
    return {"linkage": cohort.linkage_statistics(records, patients, admissions)}


def derive(c: Context) -> dict[str, DataFrame]:
    records, patients, admissions = c.tables
    found = c.outcomes_of(records)
    return {"flow": cohort.attrition(records, patients, admissions).orderBy("step"), "outcomes": outcomes.outcome_statistics(found), "splits": splits.split_summary(c.index, OUTCOMES)}


def probe(c: Context) -> dict[str, DataFrame]:
    if c.args.predictions and paths.exists(c.spark, c.args.predictions):
        return {"validity": scoring.validity(c.predictions), "predictions": scoring.prediction_summary(c.predictions)}
    made, embedded, fitted = c.derived()
    mode, target = c.mode, c.args.predictions or f"{c.args.out}/predictions.parquet"
    provenance.save_predictions(made, target)
    if embedded is not None:
        save_table(embedded, f"{c.args.out}/embeddings")
    held = provenance.load_predictions(c.spark, target)
    provenance.write_manifest(c.spark, target, mode, **{k: v for k, v in provenance.run_manifest(held, mode, c.args.seed, fitted, c.args.model).items() if k != "mode"})
    c.predictions, c.mode = held, mode
    history = c.spark.createDataFrame([(float(k), float(v), float(k) == fitted.best_c) for k, v in fitted.history.items()], "c double, log_loss double, chosen boolean")
    return {"probe": history, "validity": scoring.validity(held), "predictions": scoring.prediction_summary(held)}


def analyze(c: Context) -> dict[str, DataFrame]:
    dev, test, y, own = c.scored.where("split = 'dev'"), c.scored.where("split = 'test'"), OUTCOMES[0], {"replicates": c.replicates, "seed": c.args.seed}
    if test.isEmpty():
        raise ValueError("no rows of the test split that both models scored")
    quadrants = strata.discordance(test, y, A, B)
    table, gains, _, _, nested = c.nested
    rated = test.withColumn("p_a", incremental.calibrated(dev, test, A, y))
    return {
        "discrimination": metrics.discrimination(test, [], y, B), "proper_scores": metrics.proper_scores(test, [], y, B), "correlations": metrics.correlations(test, [], A, B),
        "comparison": bootstrap.compare_models(rated, [], y, A, B, "p_a", B, **own), "stratified_risk": strata.stratified_risk(test, "model_a_category", y, B), "tertiles": strata.tertiles_within(test, "model_a_category", y, B),
        "discordance": quadrants, "discordance_intervals": strata.discordance_intervals(test, y, A, B, **own), "risk_contrasts": strata.risk_contrasts(quadrants), "nested": table, "gains": gains,
        "decision_curves": strata.decision_curves(nested, y, {"a": "p_a", "b": B, "ab": "p_ab"}), "smoother": strata.smoother(test, A, B), "risk_surface": strata.risk_surface(test, y, A, B),
        "calibration": c.spark.createDataFrame([metrics.calibration(test, y, B)], "slope double, intercept double"), "deciles": strata.decile_calibration(test, y, B).orderBy("bin"),
    }


def battery_of(c: Context) -> dict[str, DataFrame]:
    more = {}
    try:
        records, patients, admissions = c.tables
        more = {"records": records, "admissions": admissions, "patients": patients}
    except FileNotFoundError as e:
        c.say(f"without cohorts and subgroups: {e}")
    if paths.exists(c.spark, f"{c.args.out}/embeddings"):
        more["embeddings"] = c.spark.read.parquet(f"{c.args.out}/embeddings")
    return battery.run(c.scored, OUTCOMES, replicates=c.replicates, seed=c.args.seed, **more)


def interpret(c: Context) -> dict[str, DataFrame]:
    _, gains, lrt, p, _ = c.nested
    return {
        "failures": synthesis.failure_summary(c.predictions), "utility": synthesis.utility_distinction(gains, lrt, p),
        "findings": synthesis.findings(c.predictions.where("split = 'dev'"), c.predictions.where("split = 'test'"), replicates=c.replicates, seed=c.args.seed, gains=gains),
    }


STAGES = {"inventory": inventory, "cohort": derive, "probe": probe, "analyze": analyze, "sensitivity": battery_of, "interpret": interpret}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="riskloom", description="Cohort derivation and risk-score evaluation.")
    parser.add_argument("--version", action="version", version=VERSION)
    commands = parser.add_subparsers(dest="command")
    for name in (*STAGES, "pipeline"):
        p = commands.add_parser(name)
        p.add_argument("--data", help="folder of the driver's tables, in place of the clinical roots")
        p.add_argument("--clinical-root", help="folder of patients and admissions")
        p.add_argument("--recordings-root", help="folder of the record list and the recordings")
        p.add_argument("--out", default="./reports", help="folder of tables and reports")
        p.add_argument("--predictions", help="a table of predictions to use in place of the derived one")
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--bootstraps", type=int, help=f"replicates of an interval: {metrics.REPLICATES}, with --simulate {SIMULATED_REPLICATES}")
        p.add_argument("--simulate", action="store_true", help="draw scores instead of computing them from recordings")
        p.add_argument("--allow-simulated-artifact", action="store_true", help="take simulated predictions as unverified ones")
        p.add_argument("--allow-unverified-artifact", action="store_true", help="take predictions without a matching manifest")
        p.add_argument("--model", help="MODULE:NAME of what makes the model of B")
        p.add_argument("--batch-size", type=int, default=adapters.BATCH)
        p.add_argument("--checkpoint-path", help="folder in which scoring goes on where it stopped")
        p.add_argument("--max-records", type=int, help="keep the first subjects only")
        p.add_argument("--report-out", help="the report's path")
        p.add_argument("--generate-figures", action=argparse.BooleanOptionalAction, default=True, help="write the charts of the primary results")
        p.add_argument("--skip-figures", action="store_true", help="write no charts")
        p.add_argument("--verbose", action="store_true")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    if not args.command:
        parser.print_help()
        return 0
    c = Context(spark or SparkSession.getActiveSession() or local_session(), args)
    for name in STAGES if args.command == "pipeline" else [args.command]:
        c.say(f"{name} ...")
        try:
            found = STAGES[name](c)
            for table, df in found.items():
                save_table(df, f"{args.out}/{name}/{table}")
            held = {table: c.spark.read.parquet(f"{args.out}/{name}/{table}") for table in found}
            if name == "analyze" and args.generate_figures and not args.skip_figures:
                for chart, content in figures.draw(held).items():
                    files.write_bytes(c.spark, f"{args.out}/figures/{chart}.png", content)
            mode = c.mode if name not in ("inventory", "cohort") else None
            files.write_text(c.spark, args.report_out if args.report_out and args.command == name else f"{args.out}/{name}/report.md", reports.render(name, mode, held))
        except (AnalysisException, FileNotFoundError, ValueError) as e:
            print(f"{name}: {e}", file=sys.stderr)
            return 1
        print(f"{name}: {args.out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
