"""Price watches, their alerts, favourites and recent queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium.functions.pricing import delta_arrow  # noqa: F401  shown with alerts

DUE_AT_ONCE = 5


def due(watches: DataFrame, now: Column, most: int | None = DUE_AT_ONCE) -> DataFrame:
    """Active watches never checked, or checked their interval ago or longer; never checked and oldest first."""
    waited = F.timestamp_diff("SECOND", F.col("last_check_at"), now)
    found = watches.where(F.col("active") & (F.col("last_check_at").isNull() | (waited >= F.col("interval_min") * 60)))
    found = found.orderBy(F.asc_nulls_first("last_check_at"), "id")
    return found.limit(most) if most else found


def price_changes(checks: DataFrame) -> DataFrame:
    """Alerts of checks (watch_id, check_ts, best_price, threshold_pct): prev_price, new_price, diff_pct.

    Each check with a price is compared with the one before it that had one; the first, and one after a price of 0 or
    less, only set the baseline.
    """
    order = W.partitionBy("watch_id").orderBy("check_ts", "check_id")
    seen = checks.where("best_price IS NOT NULL").withColumn("prev_price", F.lag("best_price").over(order))
    diff = (F.col("best_price").cast("double") - F.col("prev_price").cast("double")) / F.col("prev_price").cast("double") * 100
    changed = seen.where("prev_price > 0").withColumn("diff_pct", diff)
    return changed.where(F.abs("diff_pct") >= F.col("threshold_pct")).withColumnRenamed("best_price", "new_price")


def after_checks(watches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Watches after one round of outcomes (id, checked_at, price, source, url, name, error).

    A success sets the baseline and clears the error; a failure keeps the baseline and has its error cut to 500
    characters, or ``no offers found`` where there is none.
    """
    joined = watches.join(outcomes.select(F.col("id"), F.col("checked_at"), F.col("price").alias("_price"), F.col("source").alias("_source"), F.col("url").alias("_url"), F.col("name").alias("_name"), F.col("error").alias("_error")), "id", "left")
    done, ok = F.col("checked_at").isNotNull(), F.col("_price").isNotNull()

    def new(name: str, value: Column) -> Column:
        return F.when(ok, value).otherwise(F.col(name)).alias(name)

    failure = F.substring(F.coalesce("_error", F.lit("no offers found")), 1, 500)
    changed = {
        "last_best_price": new("last_best_price", F.col("_price")), "last_best_source": new("last_best_source", F.col("_source")),
        "last_best_url": new("last_best_url", F.col("_url")), "last_best_name": new("last_best_name", F.col("_name")),
        "last_check_at": F.when(done, F.col("checked_at")).otherwise(F.col("last_check_at")).alias("last_check_at"),
        "last_error": F.when(ok, F.lit(None)).when(done, failure).otherwise(F.col("last_error")).alias("last_error"),
    }
    return joined.select(*[changed.get(c, F.col(c)) for c in watches.columns])


def list_alerts(alerts: DataFrame, owner: str, unread: bool = False, limit: int = 50) -> DataFrame:
    """An owner's newest alerts, 1 to 200 of them."""
    own = alerts.where(F.col("owner_key") == owner)
    own = own.where("read_at IS NULL") if unread else own
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(200, limit)))


def unread_counts(alerts: DataFrame) -> DataFrame:
    """Unread alerts of each owner."""
    return alerts.where("read_at IS NULL").groupBy("owner_key").agg(F.count("*").alias("unread"))


def mark_read(alerts: DataFrame, owner: str, now: Column, ids: list[int] | None = None) -> DataFrame:
    """Alerts with an owner's unread ones (all, or those named) read now."""
    mine = (F.col("owner_key") == owner) & F.col("read_at").isNull()
    mine = mine & F.col("id").isin(ids) if ids is not None else mine
    return alerts.withColumn("read_at", F.when(mine, now).otherwise(F.col("read_at")))


def upsert(existing: DataFrame, new: DataFrame, *keys: Column) -> DataFrame:
    """All existing rows, and of the new ones those whose key is not there yet, the first of each key."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = [df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)]) for df in (existing, new)]
    fresh = keyed[1].dropDuplicates(names).join(keyed[0].select(*names).distinct(), names, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert_favorites(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Favourites, unique by (user_id, source, item_id)."""
    return upsert(existing, new, F.col("user_id"), F.col("source"), F.col("item_id"))


def upsert_watches(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Watches, unique by owner, query in lower case and being active."""
    return upsert(existing, new, F.col("owner_key"), F.lower("query"), F.col("active"))


def delete(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not among those gone."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def with_alerts(watches: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each watch with the number of its alerts, of the unread ones, and when the last was made."""
    found = alerts.groupBy(F.col("watch_id").alias("id")).agg(F.count("*").alias("alerts"), F.count_if(F.col("read_at").isNull()).alias("unread"), F.max("created_at").alias("last_alert_at"))
    return watches.join(found, "id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0))).withColumn("unread", F.coalesce("unread", F.lit(0)))


def delete_watches(watches: DataFrame, alerts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Watches without those gone (id), and alerts without those of watches gone."""
    return delete(watches, gone, "id"), delete(alerts, gone.select(F.col("id").alias("watch_id")), "watch_id")


def favorites_of(users: DataFrame, favorites: DataFrame) -> DataFrame:
    """(user_id, favorites) of each user (user_id), newest first; none is an empty list."""
    item = F.struct("created_at", "source", "item_id", "name", "price")
    found = favorites.groupBy("user_id").agg(F.reverse(F.array_sort(F.collect_list(item))).alias("favorites"))
    return users.select("user_id").join(found, "user_id", "left").withColumn("favorites", F.coalesce("favorites", F.array().cast(found.schema["favorites"].dataType)))


def recent_queries(history: DataFrame, most: int = 12) -> DataFrame:
    """Each owner's newest queries, one of each whatever the case."""
    once = history.withColumn("_n", F.row_number().over(W.partitionBy("owner_key", F.lower("query")).orderBy(F.desc("ts"), "query"))).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(W.partitionBy("owner_key").orderBy(F.desc("ts"), "query"))).where(F.col("place") <= most)
