"""Experiments as plans of examples: set-at-a-time runs with resume, and a suite over them."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_EXAMPLES, SEED = 50, 20260801


class PlanError(RuntimeError):
    """A plan that can't be run as it is."""


class Experiment(ABC):
    """plan() gives examples with a unique example_id; run_examples() turns the pending ones into records, all at once; summarize() reports."""

    key = ""
    number = 0

    @abstractmethod
    def plan(self, spark: SparkSession) -> DataFrame: ...

    @abstractmethod
    def run_examples(self, pending: DataFrame) -> DataFrame: ...

    @abstractmethod
    def summarize(self, records: DataFrame) -> dict: ...

    def fingerprint(self, plan: DataFrame, seed: int) -> str:
        """A hash of the ids, in any order, and the seed."""
        got = plan.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("example_id").cast("decimal(38,0)")).alias("h")).first()
        return f"{got['n']}-{got['h']}-{seed}"

    def run(self, spark: SparkSession, folder: str, seed: int = SEED, force: bool = False, small: bool = False) -> dict:
        """Run what isn't recorded yet and summarise all records; a folder written under another plan is refused unless `force`."""
        base = f"{folder}/{self.key}"
        plan = self.plan(spark)
        n, ids = plan.agg(F.count(F.lit(1)), F.countDistinct("example_id")).first()
        if not n:
            raise PlanError(f"{self.key}: no examples")
        if ids != n:
            raise PlanError(f"{self.key}: {n - ids} example ids repeat")
        if n < LEAST_EXAMPLES and not small:
            raise PlanError(f"{self.key}: {n} examples are under the floor of {LEAST_EXAMPLES}")
        mark, state = self.fingerprint(plan, seed), None if force else self.state(spark, base)
        if state and state["fingerprint"] != mark:
            raise PlanError(f"{self.key}: the plan differs from the recorded one; force a new run")
        records = None if state is None else spark.read.parquet(f"{base}/records")
        pending = plan if records is None else plan.join(records.select("example_id"), "example_id", "left_anti")
        if records is None or not pending.isEmpty():
            self.run_examples(pending).write.mode("overwrite" if records is None else "append").parquet(f"{base}/records")
        self._save(spark, base, "state", {"fingerprint": mark, "status": "complete", "n_planned": n})
        summary = {"experiment": self.key, "number": self.number, "n_examples": n, **self.summarize(spark.read.parquet(f"{base}/records"))}
        self._save(spark, base, "summary", summary)
        return summary

    @staticmethod
    def _save(spark: SparkSession, base: str, name: str, value: dict) -> None:
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/{name}")

    @staticmethod
    def state(spark: SparkSession, base: str) -> dict | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/state")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return json.loads(spark.read.text(f"{base}/state").first()[0])


class Suite:
    """Experiments in order; one that fails doesn't stop the others."""

    def __init__(self, experiments: list[Experiment]):
        self.experiments = sorted(experiments, key=lambda e: e.number)

    def run(self, spark: SparkSession, folder: str, only: list[str] | None = None, start: int = 0, force: bool = False, small: bool = False) -> list[dict]:
        out = []
        for e in self.experiments:
            if e.number < start or only and e.key not in only:
                continue
            try:
                out.append({"key": e.key, "status": "complete", "summary": e.run(spark, folder, force=force, small=small)})
            except Exception as error:  # noqa: BLE001  isolated, and reported
                out.append({"key": e.key, "status": "failed", "error": str(error)[:500]})
        return out

    def status(self, spark: SparkSession, folder: str) -> list[dict]:
        return [{"key": e.key, "state": e.state(spark, f"{folder}/{e.key}")} for e in self.experiments]


class FaultRecovery(Experiment):
    """Single faults, healthy controls and pairs, diagnosed; how often the injected cause is found."""

    key, number = "fault_recovery", 1

    def plan(self, spark):
        from plumbline.operators import faults as X

        return X.cases(spark.range(160).withColumnRenamed("id", "case_id"), (0, 1, 2)).withColumn("example_id", F.concat(F.lit("case_"), F.col("case_id").cast("string")))

    def run_examples(self, pending):
        from plumbline.operators import diagnosis as D
        from plumbline.operators import faults as X

        traces, refs, verified = X.injected(pending)
        causes = D.root_causes(D.stage_matrix(D.trace_facts(traces, refs, verified)))
        rows = traces.join(causes, "trace_id")
        return rows.select(F.concat(F.lit("case_"), F.col("trace_id").cast("string")).alias("example_id"), "n_faults", "expected_cause", "primary_cause")

    def summarize(self, records):
        rows = records.groupBy("n_faults").agg(F.round(F.avg((F.col("expected_cause") == F.col("primary_cause")).cast("int")), 4).alias("a")).collect()
        return {"accuracy_by_faults": {str(r.n_faults): r.a for r in sorted(rows, key=lambda r: r.n_faults)}}
