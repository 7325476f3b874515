"""Layered discovery: breadth-first from many roots at once, one job a layer.

``facts(customer, vendor)`` are the edges that observations give. A layer joins the frontier with
the facts, leaves out what its root has visited, and is written to the shared folder, so that
neither the plan nor a lost executor makes earlier layers run again.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierweave.functions.domains import base_domain, is_common_infrastructure, is_non_registrable

DEEPEST = 10
CHECKPOINT_VERSION = 1


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. On one machine alone, a temporary one where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tierweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting that deletes a query's shuffle files when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def committed(df: DataFrame, label: str, freed: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder. ``freed``: what was shuffled to make it is deleted once it is written, not when the driver happens to collect it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    if freed:
        spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if freed:
            spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table of settings or curated names that are sent to every task.
FEW = 20_000
#: Bytes of the names of steps that are sent to every task, so that a layer's rows stay where they are.
LIGHT = 10_000_000


def told(rows: DataFrame, otherwise: str = "merge") -> DataFrame:
    """A small table for a join: sent to every task where it has ``FEW`` rows at most, shuffled (for a join of the kind ``otherwise``) if it has more."""
    return F.broadcast(rows) if rows.count() <= FEW else rows.hint(otherwise)


def layers(
    roots: DataFrame, facts: DataFrame, max_depth: int | None = None, stop_at_infrastructure: bool = False, skip_unregistrable: bool = False, limits: list[int] | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """``root, domain, layer`` for every domain reached, with its smallest layer; roots are layer 0.

    ``limits[d]`` bounds the vendors of one customer that are followed from depth d (0: no bound); ``stop_at_infrastructure`` lists
    common infrastructure but does not go on from it. The depth is ``DEEPEST`` at most.

    With ``checkpoint`` (a folder of its own in shared storage) each layer is marked there once it is whole, under the check sum of the settings and
    roots. A later run with the same ones reads the marked layers back and goes on after the last; ``resumable`` says which that is.
    """
    spark = roots.sparkSession
    seen = committed(roots.select(F.col("root"), F.col("root").alias("domain"), F.lit(0).alias("layer")).where("root is not null").distinct(), "layer")
    folder, done = None, 0
    if checkpoint:
        folder = checkpoint_folder(checkpoint, seen, max_depth=max_depth, stop_at_infrastructure=stop_at_infrastructure, skip_unregistrable=skip_unregistrable, limits=limits)
        done = resumable(spark, folder)
    frontier = seen
    for depth in range(1, done + 1):
        frontier = spark.read.schema(seen.schema).parquet(f"{folder}/layer-{depth}")
        seen = seen.unionByName(frontier)
    if done and frontier.isEmpty():
        return seen
    steps = facts.select(F.col("customer").alias("domain"), "vendor").where("customer is not null and vendor is not null").distinct()
    if skip_unregistrable:
        steps = steps.where(~is_non_registrable(F.col("vendor")))
    steps = committed(steps, "facts")  # each layer joins the table, not what made it
    later = None
    for depth in range(done + 1, min(DEEPEST, DEEPEST if max_depth is None else max_depth) + 1):
        start = frontier.where(~is_common_infrastructure(F.col("domain"))) if stop_at_infrastructure else frontier
        own = steps
        if depth > 1:
            if later is None:
                later = _second_steps(steps, frontier if done else None)
                sent = (later.agg(F.sum(F.octet_length("domain") + F.octet_length("vendor"))).first()[0] or 0) <= LIGHT
            own = later
        if limits and depth - 1 < len(limits) and limits[depth - 1]:
            from pyspark.sql import Window

            own = own.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("vendor"))).where(F.col("_n") <= limits[depth - 1]).drop("_n")
        found = start.join(F.broadcast(own) if depth > 1 and sent else own, "domain").select("root", F.col("vendor").alias("domain"))
        if depth == 1:  # a root stands at itself alone, so that no pair is found twice and only the root itself was seen
            found = found.where("root <> domain")
        else:
            found = found.distinct().join(seen.select("root", "domain"), ["root", "domain"], "left_anti")
        found = found.withColumn("layer", F.lit(depth))
        frontier = marked(found, folder, depth) if folder else committed(found, "layer")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _second_steps(steps: DataFrame, frontier: DataFrame | None) -> DataFrame:
    """Of ``steps(domain, vendor)`` those that a walk can take from its second step on: their domain is some step's vendor, or stands in a resumed ``frontier``.

    Roots that nobody has as a vendor are most of the customers, and their steps are left out of all joins but the first.
    """
    reachable = steps.select(F.col("vendor").alias("domain")).distinct()
    if frontier is not None:
        reachable = reachable.unionByName(frontier.select("domain").distinct())
    return committed(steps.join(reachable, "domain", "left_semi"), "second-steps")


def checkpoint_folder(checkpoint: str, roots: DataFrame, **settings) -> str:
    """Where a run with these settings and ``roots(root)`` keeps its layers; another run's layers are never met."""
    n, h = roots.agg(F.count("*"), F.sum(F.xxhash64("root").cast("decimal(38,0)"))).first()
    return f"{checkpoint.rstrip('/')}/{settings_hash({**settings, 'roots': [n, str(h)], 'version': CHECKPOINT_VERSION})}"


def marked(layer: DataFrame, folder: str, depth: int) -> DataFrame:
    """A layer, written; then its mark, which says how many rows make it whole. What an interrupted run left is overwritten."""
    spark = layer.sparkSession
    layer.write.mode("overwrite").parquet(f"{folder}/layer-{depth}")
    own = spark.read.schema(layer.schema).parquet(f"{folder}/layer-{depth}")
    own.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/mark-{depth}")
    return own


def resumable(spark: SparkSession, folder: str) -> int:
    """The last layer that stands whole in a folder, all before it whole too; 0 without any."""
    depth = 0
    while depth < DEEPEST:
        try:
            n = spark.read.schema("n long").parquet(f"{folder}/mark-{depth + 1}").agg(F.max("n")).first()[0]
            if n is None or n != spark.read.parquet(f"{folder}/layer-{depth + 1}").count():
                break
        except AnalysisException:  # no such folder
            break
        depth += 1
    return depth


def relationships(reached: DataFrame, facts: DataFrame) -> DataFrame:
    """A row per fact whose customer was reached: the vendor stands one layer below it. Self-references are left out."""
    own = reached.select(F.col("root").alias("root_customer_domain"), F.col("domain").alias("customer"), (F.col("layer") + 1).alias("nth_party_layer"))
    rows = own.join(facts, "customer").where(base_domain(F.col("vendor")) != base_domain(F.col("customer")))
    return rows.withColumnsRenamed({"customer": "nth_party_customer_domain", "vendor": "nth_party_domain"})


def resume(completed: DataFrame, pending: DataFrame) -> DataFrame:
    """What is still to do after an interruption."""
    return pending.join(completed, ["root", "domain"], "left_anti")


def settings_hash(settings: dict) -> str:
    """A check sum of the settings that decide what a scan finds, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def is_compatible(stored: DataFrame, root: str, settings: dict) -> bool:
    """A checkpoint (``stored(root, settings)``, a row a scan) can be resumed: same root, same settings."""
    return not stored.where((F.col("root") == root) & (F.col("settings") == settings_hash(settings))).isEmpty()
