"""Cluster telemetry: documents, node and pod series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_health(clusters: DataFrame) -> DataFrame:
    """A row for each node pool of a cluster document (name, location, status, nodePools, conditions)."""
    status = F.col("status")
    health = F.when(status == "RUNNING", "HEALTHY").when(status.isin("RECONCILING", "PROVISIONING"), "UPDATING").when(status.isin("DEGRADED", "ERROR"), "DEGRADED").otherwise(status)
    bad = F.filter("conditions", lambda c: ~F.coalesce(c["status"] == "True", F.lit(False)))
    df = clusters.select("name", "location", health.alias("health"), F.size(F.coalesce(bad, F.array())).alias("bad_conditions"), F.explode_outer("nodePools").alias("pool"))
    scaling = F.col("pool.autoscaling")
    return df.select("name", "location", "health", "bad_conditions", F.col("pool.name").alias("pool"), F.col("pool.status").alias("pool_status"), F.col("pool.initialNodeCount").alias("node_count"), F.coalesce(scaling["enabled"], F.lit(False)).alias("autoscaling"), scaling["minNodeCount"].alias("min_nodes"), scaling["maxNodeCount"].alias("max_nodes"), (F.col("pool.status") == "RECONCILING").alias("is_upgrading"))


def _latest(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


#: (warning over, critical from) of each node metric; disk is used by total.
NODE_LIMITS = {"cpu": (0.85, 0.95), "memory": (0.85, 0.95), "disk": (0.85, 0.95), "pid": (0.80, 0.90)}


def _with_disk_share(latest: DataFrame) -> DataFrame:
    """Latest values of nodes, with the metric disk where disk_used and disk_total tell it."""
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    disk = latest.filter(F.col("metric").isin("disk_used", "disk_total")).groupBy("node").agg(F.try_divide(of("disk_used"), of("disk_total")).alias("value")).filter("value is not null")
    return latest.unionByName(disk.select("node", F.lit("disk").alias("metric"), "value")).filter(F.col("metric").isin(*NODE_LIMITS))


def node_conditions(points: DataFrame) -> DataFrame:
    """Nodes whose latest utilisation is too high. points: node, metric, ts, value; metrics are the shares cpu, memory, pid and
    disk, the last of them ready-made or as disk_used and disk_total."""
    last = _with_disk_share(_latest(points.filter(F.col("metric").isin(*NODE_LIMITS, "disk_used", "disk_total")), ["node", "metric"]))
    warn, crit = F.lit(None).cast("double"), F.lit(None).cast("double")
    for m, (w, c) in NODE_LIMITS.items():
        warn, crit = F.when(F.col("metric") == m, w).otherwise(warn), F.when(F.col("metric") == m, c).otherwise(crit)
    return last.filter(F.col("value") > warn).select("node", "metric", "value", F.concat(F.upper("metric"), F.lit("_PRESSURE")).alias("condition"), F.when(F.col("value") >= crit, "CRITICAL").otherwise("WARNING").alias("severity"))


def node_summary(points: DataFrame) -> DataFrame:
    """One row: nodes, nodes with a condition, and CRITICAL if those are over half."""
    bad = node_conditions(points).agg(F.countDistinct("node").alias("affected"))
    n = points.agg(F.countDistinct("node").alias("nodes"))
    share = F.try_divide(F.col("affected"), F.col("nodes"))
    return n.crossJoin(F.broadcast(bad)).withColumn("status", F.when(share > 0.5, "CRITICAL").when(share > 0, "WARNING").otherwise("HEALTHY"))


def pod_restarts(points: DataFrame, limit: int = 20) -> DataFrame:
    """Restarts of each pod over the points' period: newest less oldest counter of each container, summed."""
    per = points.groupBy("namespace", "pod", "container").agg((F.max_by("value", "ts") - F.min_by("value", "ts")).alias("restarts"))
    g = per.groupBy("namespace", "pod").agg(F.sum("restarts").alias("restarts")).filter("restarts > 0")
    return g.withColumn("severity", F.when(F.col("restarts") > 50, "CRITICAL").when(F.col("restarts") > 10, "WARNING").otherwise("INFO")).orderBy(F.desc("restarts"), "namespace", "pod").limit(limit)


def hpa_events(points: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Scalings of each workload: ups, downs, range, last value; over 20 is thrashing."""
    old = F.lag("value").over(Window.partitionBy(*keys).orderBy(*order))
    g = points.withColumn("step", F.col("value") - old).groupBy(*keys).agg(F.count_if(F.col("step") > 0).alias("scale_ups"), F.count_if(F.col("step") < 0).alias("scale_downs"), F.min("value").alias("min_replicas"), F.max("value").alias("max_replicas"), F.max_by("value", F.struct(*order)).alias("current_replicas"))
    return g.withColumn("is_thrashing", F.col("scale_ups") + F.col("scale_downs") > 20).withColumn("at_max", F.col("current_replicas") == F.col("max_replicas"))


def oom_events(logs: DataFrame, text: Column, keyword: str = "OOMKilled") -> DataFrame:
    """Logs of out-of-memory kills by pod and container."""
    at = F.col("resource.attributes")
    df = logs.filter(F.contains(F.lower(text), F.lit(keyword.lower())))
    return df.groupBy(at["namespace_name"].alias("namespace"), at["pod_name"].alias("pod"), at["container_name"].alias("container")).agg(F.count("*").alias("events"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def memory_risks(points: DataFrame) -> DataFrame:
    """Containers whose greatest memory utilisation is over 0.85. points: namespace, pod, container, value."""
    g = points.groupBy("namespace", "pod", "container").agg(F.max("value").alias("max_utilization"))
    return g.filter("max_utilization > 0.85").withColumn("severity", F.when(F.col("max_utilization") > 0.95, "HIGH").otherwise("MEDIUM"))


def oom_report(logs: DataFrame, text: Column, points: DataFrame, keyword: str = "OOMKilled") -> DataFrame:
    """One row: kills, the containers they hit, containers with little memory left, and how bad that is together: CRITICAL with
    a kill, else WARNING with a container at risk, else NORMAL."""
    kills = oom_events(logs, text, keyword).agg(F.coalesce(F.sum("events"), F.lit(0)).alias("oom_events"), F.count("*").alias("killed_containers"))
    risks = memory_risks(points).agg(F.count("*").alias("containers_at_risk"), F.count_if(F.col("severity") == "HIGH").alias("high_risk_containers"))
    severity = F.when(F.col("oom_events") > 0, "CRITICAL").when(F.col("containers_at_risk") > 0, "WARNING").otherwise("NORMAL")
    return kills.crossJoin(F.broadcast(risks)).withColumn("severity", severity)


def workload_health(points: DataFrame) -> DataFrame:
    """Workloads (pods without their last two name parts) by their worst pod. points: namespace, pod, metric (cpu, memory,
    restarts), value."""
    workload = F.coalesce(F.nullif(F.regexp_extract("pod", r"^(.+)-[^-]+-[^-]+$", 1), F.lit("")), F.col("pod"))
    of = lambda m: F.when(F.col("metric") == m, F.col("value"))
    per = points.groupBy("namespace", workload.alias("workload"), "pod").agg(F.max(of("cpu")).alias("cpu"), F.max(of("memory")).alias("memory"), F.coalesce(F.max(of("restarts")), F.lit(0.0)).alias("restarts"))
    g = per.groupBy("namespace", "workload").agg(F.count("*").alias("pods"), F.max("cpu").alias("max_cpu"), F.max("memory").alias("max_memory"), F.sum("restarts").alias("restarts"))
    status = F.when((F.col("restarts") > 5) | (F.coalesce("max_memory", F.lit(0.0)) > 0.95), "CRITICAL").when((F.col("restarts") > 0) | (F.coalesce("max_memory", F.lit(0.0)) > 0.85) | (F.coalesce("max_cpu", F.lit(0.0)) > 0.9), "WARNING").otherwise("HEALTHY")
    return g.withColumn("status", status)
