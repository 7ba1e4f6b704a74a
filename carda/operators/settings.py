"""Small keyed tables: settings, site lists, request bodies, toggles, marks, accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settings_map(settings: DataFrame) -> DataFrame:
    """(settings): the whole table as one map; it is small and fixed, its last value of a key counts."""
    last = settings.groupBy("skey").agg(F.max_by("svalue", "updated_at").alias("v"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct("skey", "v"))).alias("settings"))


def setting(m: Column, key: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def setting_int(m: Column, key: str, default: int) -> Column:
    """A whole number; the default where the value is not numeric."""
    v = setting(m, key)
    return F.coalesce(F.when(v.rlike(r"^\s*[+-]?\d+(?:\.\d*)?\s*$"), v.try_cast("double").cast("int")), F.lit(default))


def field_map(overrides: Column, defaults: dict[str, str]) -> Column:
    """Field names: the defaults with the entries of a JSON object laid over them."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    given = F.coalesce(F.from_json(overrides, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k)), given)


def update_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """The settings with changed values; keys not there yet are added."""
    c = changes.select("skey", F.col("svalue").alias("_v"))
    return settings.join(c, "skey", "full_outer").select("skey", F.coalesce("_v", "svalue").alias("svalue"))


def enabled_sites(sites: DataFrame, only: str | None = None) -> DataFrame:
    """Sites in use, or the one of an id stripped of everything but letters, digits, - and _."""
    if only is None:
        return sites.where("enabled")
    return sites.where(F.col("site") == F.regexp_replace(F.lit(only), "[^A-Za-z0-9_-]", ""))


def request_body(raw: Column) -> Column:
    """A request's fields: a JSON object, else a form."""
    form = F.transform_values(F.str_to_map(raw, F.lit("&"), F.lit("=")), lambda _, v: F.url_decode(v))
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.when(~F.coalesce(F.ltrim(raw).startswith("{"), F.lit(False)), form))


def toggle(rows: DataFrame, ids: DataFrame, column: str = "status", values: tuple[int, int] = (0, 1), key: str = "id") -> DataFrame:
    """``rows`` with ``column`` switched between two values for the given ids."""
    a, b = values
    x = rows.join(ids.select(key, F.lit(True).alias("_hit")).distinct(), key, "left")
    flipped = F.when(F.col(column) == a, b).when(F.col(column) == b, a).otherwise(F.col(column))
    return x.withColumn(column, F.when(F.col("_hit"), flipped).otherwise(F.col(column))).select(*rows.columns)


def reset_marks(posts: DataFrame, marks: DataFrame, ids: DataFrame, counter: str = "invalid_count") -> tuple[DataFrame, DataFrame]:
    """Marks without those of the given posts, and posts with their counter at zero."""
    hit = ids.select("id").distinct()
    x = posts.join(hit.withColumn("_hit", F.lit(True)), "id", "left").withColumn(counter, F.when(F.col("_hit"), 0).otherwise(F.col(counter)))
    return marks.join(hit.withColumnRenamed("id", "post_id"), "post_id", "left_anti"), x.select(*posts.columns)


def sign_in(users: DataFrame, logins: DataFrame) -> DataFrame:
    """(subject, display_name, last_login_at, status, known): accounts after the logins; a new subject gets an account, a
    known one its newest name and login, a blocked one is left as it is."""
    last = logins.groupBy("subject").agg(F.max_by("display_name", "at").alias("_name"), F.max("at").alias("_at"))
    x = users.join(last, "subject", "full_outer")
    fresh, open_ = F.col("status").isNull(), F.col("status") == 1
    return x.select(
        "subject",
        F.when(fresh | (open_ & F.col("_at").isNotNull()), F.coalesce("_name", "display_name")).otherwise(F.col("display_name")).alias("display_name"),
        F.when(fresh | (open_ & F.col("_at").isNotNull()), F.col("_at")).otherwise(F.col("last_login_at")).alias("last_login_at"),
        F.coalesce("status", F.lit(1)).alias("status"),
        (~fresh).alias("known"),
    )


def allowed(rows: DataFrame, column: str, whitelist: DataFrame, active: str | None = None) -> DataFrame:
    """Rows whose value is on a list, or among its active entries."""
    w = whitelist.where(F.col(active) == 1) if active else whitelist
    return rows.join(w.select(F.col(w.columns[0]).alias(column)).distinct(), column, "left_semi")
