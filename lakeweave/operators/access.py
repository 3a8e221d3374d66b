"""Who may do what: access lists, memberships with roles, public entries, derivative rights, space guards.

A decision is asked for in rows (request, user, space, kind, resource, permission); each way to be allowed is one join,
and a request is allowed by the first way that holds: explicit entry, role in the space, public entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Permissions of each role by kind of resource.
_MANAGED = "read write delete share"
ROLE_RIGHTS = {
    "owner": {"space": "read write delete share admin", "file": _MANAGED, "asset": "read write delete share execute", "knowledge": _MANAGED, "markdown": _MANAGED, "negotiation": "read write execute"},
    "admin": {"space": "read write share", "file": _MANAGED, "asset": _MANAGED, "knowledge": _MANAGED, "markdown": _MANAGED, "negotiation": "read write"},
    "editor": {"space": "read", "file": "read write", "asset": "read write", "knowledge": "read write", "markdown": "read write", "negotiation": "read"},
    "viewer": {"space": "read", "file": "read", "asset": "read", "knowledge": "read", "markdown": "read"},
}


def role_rights(spark: SparkSession) -> DataFrame:
    """(role, kind, permission): the roles' rights as a small table."""
    rows = [(role, kind, p) for role, kinds in ROLE_RIGHTS.items() for kind, held in kinds.items() for p in held.split()]
    return spark.createDataFrame(rows, "role string, kind string, permission string")


def unexpired(expires_at: Column, as_of: str) -> Column:
    return expires_at.isNull() | (expires_at > F.lit(as_of).cast("timestamp_ntz"))


def by_entry(requests: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    """Requests that an unexpired entry of the user itself allows. ``entries``: user, kind, resource, permissions, expires_at, is_public."""
    live = entries.where(unexpired(F.col("expires_at"), as_of)).select("user", "kind", "resource", F.explode("permissions").alias("permission"))
    return requests.join(live, ["user", "kind", "resource", "permission"], "left_semi").select("request")


def by_public_entry(requests: DataFrame, entries: DataFrame, as_of: str) -> DataFrame:
    live = entries.where(F.col("is_public") & unexpired(F.col("expires_at"), as_of)).select("kind", "resource", F.explode("permissions").alias("permission"))
    return requests.join(live, ["kind", "resource", "permission"], "left_semi").select("request")


def by_role(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Requests that an active membership allows: by its own list of permissions ("*" is all), else by its role.

    ``members``: space, user, role, status, permissions (may be null).
    """
    active = members.where(F.col("status") == "active").select("space", "user", "role", "permissions")
    asked = requests.join(active, ["space", "user"])
    own = F.array_contains("permissions", F.col("permission")) | F.array_contains("permissions", "*")
    rights = F.broadcast(role_rights(requests.sparkSession).groupBy("role", "kind").agg(F.collect_set("permission").alias("held")))  # at most 24 rows
    held = asked.join(rights, ["role", "kind"], "left")
    by_default = F.array_contains("held", F.col("permission")) | F.array_contains("held", "admin")
    return held.where(F.coalesce(own, F.lit(False)) | F.coalesce(by_default, F.lit(False))).select("request").distinct()


def decide(requests: DataFrame, entries: DataFrame, members: DataFrame, as_of: str) -> DataFrame:
    """``requests`` with ``allowed`` and ``by`` (entry, role, public or null)."""
    ways = None
    for rank, (name, found) in enumerate((("entry", by_entry(requests, entries, as_of)), ("role", by_role(requests, members)), ("public", by_public_entry(requests, entries, as_of)))):
        one = found.select("request", F.lit(rank).alias("_rank"), F.lit(name).alias("by"))
        ways = one if ways is None else ways.unionByName(one)
    first = ways.groupBy("request").agg(F.min_by("by", "_rank").alias("by"))
    return requests.join(first, "request", "left").withColumn("allowed", F.col("by").isNotNull())


def granted(entries: DataFrame, wanted: DataFrame, admins: DataFrame) -> DataFrame:
    """Entries after grants: those of ``wanted`` (with ``granted_by``) whose giver is an admin (user, kind, resource)."""
    ok = wanted.join(admins.withColumnRenamed("user", "granted_by"), ["granted_by", "kind", "resource"], "left_semi")
    return entries.unionByName(ok.drop("granted_by"))


def revoked(entries: DataFrame, gone: DataFrame, admins: DataFrame) -> DataFrame:
    """Entries without those in ``gone`` (entry, kind, resource, revoked_by) whose remover is an admin."""
    ok = gone.join(admins.withColumnRenamed("user", "revoked_by"), ["revoked_by", "kind", "resource"], "left_semi")
    return entries.join(ok.select("entry"), "entry", "left_anti")


def with_members(members: DataFrame, added: DataFrame) -> DataFrame:
    """Members after invitations: a known member's role changes and nothing else does; a new one is inserted as active."""
    new_roles = added.select("space", "user", F.col("role").alias("_role"))
    kept = members.join(new_roles, ["space", "user"], "left").withColumn("role", F.coalesce("_role", "role")).drop("_role")
    fresh = added.join(members, ["space", "user"], "left_anti").select("space", "user", "role", F.lit("active").alias("status"), F.lit(None).cast("array<string>").alias("permissions"))
    return kept.unionByName(fresh)


def without_members(members: DataFrame, removed: DataFrame) -> DataFrame:
    """Members with those in ``removed`` (space, user) deactivated."""
    marked = members.join(removed.select("space", "user", F.lit(True).alias("_gone")), ["space", "user"], "left")
    return marked.withColumn("status", F.when(F.col("_gone"), "inactive").otherwise(F.col("status"))).drop("_gone")


def owned_only(rows: DataFrame, spaces: DataFrame) -> DataFrame:
    """Rows (user, space, ...) whose space belongs to the user (``spaces``: space, owner)."""
    return rows.join(spaces.withColumnRenamed("owner", "user"), ["space", "user"], "left_semi")


def derivative_violations(wanted: DataFrame, assets: DataFrame, grants: DataFrame, as_of: str) -> DataFrame:
    """Of (user, asset) that a derived work would use: those neither owned nor covered by a live derivative right."""
    t = F.lit(as_of).cast("timestamp_ntz")
    own = assets.select("asset", F.col("owner").alias("user"))
    live = grants.where((F.col("status") == "active") & (F.col("valid_from") <= t) & (F.col("valid_until") >= t) & F.array_contains("rights", "derivative_right"))
    return wanted.join(own, ["user", "asset"], "left_anti").join(live.select("user", "asset"), ["user", "asset"], "left_anti")
