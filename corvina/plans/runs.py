"""The log of runs: a row when one starts, completed when it ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.store import Store

RUN = "run_id string, started_at timestamp, ended_at timestamp, status string, counts map<string,long>, error string"


def begin(store: Store, run_id: str) -> None:
    """Adds the run; a run of that id that is there already starts anew."""
    old = store.read("runs", RUN).where(F.col("run_id") != run_id)
    row = store.spark.sql(f"select '{run_id}' as run_id, current_timestamp() as started_at, cast(null as timestamp) as ended_at, 'running' as status, cast(null as map<string,bigint>) as counts, cast(null as string) as error")
    store.write({"runs": old.unionByName(row)})


def end(store: Store, run_id: str, counts: dict[str, int] | None = None, error: str | None = None) -> None:
    """Completes the run: done, or failed with what went wrong. A run that was never begun is an error."""
    runs = store.read("runs", RUN)
    if runs.where(F.col("run_id") == run_id).isEmpty():
        raise KeyError(run_id)
    this = F.col("run_id") == run_id
    kept = F.create_map(*[F.lit(x) for kv in (counts or {}).items() for x in kv]).cast("map<string,bigint>") if counts else F.lit(None).cast("map<string,bigint>")
    store.write({"runs": runs.select("run_id", "started_at", F.when(this, F.current_timestamp()).otherwise(F.col("ended_at")).alias("ended_at"), F.when(this, "failed" if error else "done").otherwise(F.col("status")).alias("status"), F.when(this, kept).otherwise(F.col("counts")).alias("counts"), F.when(this, F.lit(error).cast("string")).otherwise(F.col("error")).alias("error"))})


def latest(store: Store) -> DataFrame:
    """The run begun last."""
    return store.read("runs", RUN).orderBy(F.desc("started_at"), "run_id").limit(1)
