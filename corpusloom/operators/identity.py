"""Users of chat platforms: found by (platform, id there), or made once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_user_id(tenant: Column, platform: Column, platform_user_id: Column) -> Column:
    """The id of a user made for this platform user: the same whenever and wherever it is made."""
    return F.md5(F.concat_ws("\x1f", tenant, platform, platform_user_id))


def get_or_create(requests: DataFrame, mappings: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users and mappings that have to be added so that every request has one; the requests of a run answered by mappings plus these.

    requests: (request_id, platform, platform_user_id, display_name, tenant_id or null); mappings: (platform, platform_user_id,
    user_id, ...); tenants: (tenant_id, created_at). A platform user without a mapping gets one from its first request, by request
    id; a null tenant is the oldest one. Names and addresses follow the platform; an id that is only spaces is replaced by one made
    from the request. Running it again over the enlarged tables adds nothing.
    """
    key = ["platform", "platform_user_id"]
    known = mappings.select(*key).distinct()
    new = requests.where("platform is not null and platform_user_id is not null").join(known, key, "left_anti")
    first = new.groupBy(*key).agg(F.min_by(F.struct("request_id", "display_name", "tenant_id"), "request_id").alias("r")).select(*key, "r.*")
    oldest = tenants.agg(F.min_by("tenant_id", F.struct("created_at", "tenant_id")).alias("oldest"))  # one row
    rows = first.crossJoin(F.broadcast(oldest)).withColumn("tenant_id", F.coalesce("tenant_id", "oldest"))
    named = F.nullif("display_name", F.lit(""))
    part = F.coalesce(F.nullif(F.trim("platform_user_id"), F.lit("")), F.substring(F.md5(F.col("request_id").cast("string")), 1, 12))
    rows = rows.select(
        new_user_id(F.col("tenant_id").cast("string"), F.col("platform"), F.col("platform_user_id")).alias("user_id"), "tenant_id",
        F.coalesce(named, F.concat_ws(":", "platform", "platform_user_id")).alias("name"), F.concat(F.trim(F.lower("platform")), F.lit("_"), part, F.lit("@platform.local")).alias("email"),
        F.lit("user").alias("role"), *key, named.alias("display_name"),
    )
    return rows.select("user_id", "tenant_id", "name", "email", "role"), rows.select("user_id", "tenant_id", *key, "display_name")
