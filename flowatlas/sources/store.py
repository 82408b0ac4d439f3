"""Keyed document stores as DataFrames and Parquet: upsert, lookup, clone, refresh, drop, backlog."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, as the session names it.

    Only a local session that names none (tests) gets one here; on a cluster a local folder would be lost, so it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="flowatlas-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; unlike a checkpoint, its size is what was written.

    Rounds that join their own results need that: sizes that are estimated from estimates grow with every round.
    """
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with ``new`` merged by key: its fields overwrite, others stay, unknown keys are added."""
    fields = [c for c in new.columns if c != key]
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_there"))
    joined = store.join(fresh, key, "full")
    for c in fields:
        old = F.col(c) if c in store.columns else F.lit(None)
        joined = joined.withColumn(c, F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(old))
    return joined.drop("_there", *[f"_new_{c}" for c in fields])


def replace(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with whole documents replaced or added by key."""
    return store.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with those documents added whose key it lacks."""
    return store.unionByName(new.join(store, key, "left_anti"), allowMissingColumns=True)


def search(store: DataFrame, field: str, ids: DataFrame, fields: list[str]) -> DataFrame:
    """The listed fields of documents whose ``field`` is among ``ids`` (a column of that name)."""
    return store.join(ids.select(field).distinct(), field, "left_semi").select(fields)


def flatten_year(docs: DataFrame, year: str, prefixes: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """A year's struct unnested to flat columns, its ``prefixes`` sub-structs to prefix_name columns."""
    inner = docs.select(*[c for c in docs.columns if c != year], f"`{year}`.*")
    for p in prefixes:
        inner = inner.select(*[c for c in inner.columns if c != p], *[F.col(f"{p}.{f.name}").alias(f"{p}_{f.name}") for f in inner.schema[p].dataType.fields])
    return inner.withColumnsRenamed(renames or {})


def nest_year(rows: DataFrame, key: str, year: str, prefixes: list[str]) -> DataFrame:
    """The reverse: (key, year struct of prefix sub-structs, with the prefix stripped from their fields)."""
    subs = [F.struct(*[F.col(c).alias(c.removeprefix(p + "_")) for c in rows.columns if c.startswith(p + "_")]).alias(p) for p in prefixes]
    return rows.select(key, F.struct(*subs).alias(year))


def clone_simulation(rows: DataFrame, sim_id: str, new_id: str, *, new_date: str | None = None) -> DataFrame:
    """A simulation's rows (simulations or commuters) under a new id, with where they came from."""
    out = rows.where(F.col("sim_id") == sim_id).withColumn("created_from_sim_id", F.col("sim_id")).withColumn("sim_id", F.lit(new_id)).withColumn("created_by", F.lit("clone"))
    if "vc_id" in rows.columns:
        out = out.withColumn("created_from_vc_id", F.col("vc_id"))
    return out.withColumn("sim_date", F.lit(new_date)) if new_date is not None and "sim_date" in rows.columns else out


def refresh_travellers(results: DataFrame, commuters: DataFrame) -> DataFrame:
    """Route results with the traveller struct of the commuter of the same simulation, where there is one."""
    new = commuters.select("sim_id", "vc_id", F.col("traveller").alias("_new"))
    return results.join(new, ["sim_id", "vc_id"], "left").withColumn("traveller", F.coalesce("_new", "traveller")).drop("_new")


def drop_results(rows: DataFrame, sim_id: str) -> DataFrame:
    """All rows but those of one simulation."""
    return rows.where(~F.col("sim_id").eqNullSafe(F.lit(sim_id)))


def without_job(rows: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have no job yet."""
    return rows.join(jobs.select(*keys), keys, "left_anti")


def write_simulation(rows: DataFrame, path: str) -> None:
    """Parquet by simulation; simulations that ``rows`` has are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sim_id").parquet(path)


def read_simulation(spark, path: str, sim_id: str) -> DataFrame:
    """The rows of one simulation; only its folder is read."""
    return spark.read.parquet(path).where(F.col("sim_id") == sim_id)


def write_stats(stats: DataFrame, path: str, *, sim_id: str, meta: dict[str, str] | None = None) -> None:
    """A statistics document as JSON: measures, shares and meta."""
    pairs = [F.lit(x) for kv in (meta or {}).items() for x in kv]
    stats.withColumn("sim_id", F.lit(sim_id)).withColumn("meta", F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).write.mode("append").json(path)


def write_heatmap(heatmap: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One row per cell with its four shares."""
    heatmap.select("cell", "car_share", "rail_share", "bus_share", "walk_share").write.mode("overwrite").format(fmt).save(path)
