"""Inventory and capacity questions over lock rows (kind, repo, rev, file, bytes, sha256, profile) and files.

These tables describe one drive: they have tens of rows, so a running sum over all of them is one small task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.text import BANDS, band_of, display_name, is_split_part, model_tag, weight_of

GIB = 1 << 30


def folder(kind: Column) -> Column:
    return F.when(kind == "embed", "embed").when(kind == "binary", "bin").otherwise("models")


def verify(lock: DataFrame, files: DataFrame, check_sha: bool = False) -> DataFrame:
    """file, kind, status, percent for each pinned file. files: dir, file, bytes, sha256."""
    pinned = lock.filter(F.col("kind").isin("model", "embed", "binary"))
    there = files.select(F.col("dir").alias("d"), F.col("file").alias("f"), F.col("bytes").alias("have"), F.col("sha256").alias("got"))
    both = pinned.join(there, (folder(F.col("kind")) == F.col("d")) & (F.col("file") == F.col("f")), "left")
    wrong = F.col("got") != F.col("sha256") if check_sha else F.lit(False)
    status = F.when(F.col("have").isNull(), "MISSING").when(F.col("have") < F.col("bytes"), "INCOMPLETE").when(F.col("have") > F.col("bytes"), "TOO LARGE").when(wrong, "SHA MISMATCH").otherwise("OK")
    return both.select("file", "kind", status.alias("status"), F.when(F.col("have").isNotNull() & (F.col("bytes") > 0), F.floor(F.col("have") * 100 / F.col("bytes"))).alias("percent"))


def unpinned(lock: DataFrame, files: DataFrame, profile: int | None = None) -> DataFrame:
    """Model and encoder files that the lock (up to a profile) doesn't know."""
    pinned = lock.filter(F.col("kind").isin("model", "embed"))
    if profile is not None:
        pinned = pinned.filter(F.coalesce("profile", F.lit(0)) <= profile)
    return files.filter(F.col("dir").isin("models", "embed") & F.col("file").endswith(".gguf")).join(pinned.select("file"), "file", "left_anti").select("dir", "file", "bytes")


def counters(status: DataFrame, strays: DataFrame) -> DataFrame:
    """One row: ok, bad, missing, unpinned."""
    left = status.agg(F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(~F.col("status").isin("OK", "MISSING")).alias("bad"), F.count_if(F.col("status") == "MISSING").alias("missing"))
    return left.crossJoin(strays.agg(F.count("*").alias("unpinned")))


def needed(lock: DataFrame, files: DataFrame, profile: int) -> DataFrame:
    """Lock rows up to a profile without a file of their exact size."""
    pinned = lock.filter(F.col("kind").isin("model", "embed") & (F.coalesce("profile", F.lit(0)) <= profile))
    there = files.select(F.col("dir").alias("d"), F.col("file").alias("f"), F.col("bytes").alias("have"))
    return pinned.join(there, (folder(F.col("kind")) == F.col("d")) & (F.col("file") == F.col("f")) & (F.col("bytes") == F.col("have")), "left_anti").select("kind", "repo", "file", "bytes")


def profile_sizes(lock: DataFrame) -> DataFrame:
    """profile, bytes of all files up to it; rows without a profile belong to every one."""
    pinned = lock.filter(F.col("kind").isin("model", "embed"))
    own = pinned.groupBy(F.coalesce("profile", F.lit(0)).alias("profile")).agg(F.sum("bytes").alias("own"))
    summed = own.withColumn("bytes", F.sum("own").over(Window.orderBy("profile").rowsBetween(Window.unboundedPreceding, 0)))
    return summed.join(pinned.select("profile").distinct(), "profile", "left_semi").select("profile", "bytes")


def usable(total: Column) -> Column:
    """Space without the reserve: 8 GiB or a tenth."""
    return total - F.greatest(F.lit(8 * GIB), F.floor(total * 0.10))


def largest_profile(lock: DataFrame, total: int) -> DataFrame:
    """One row: the largest profile that fits a drive."""
    return profile_sizes(lock).filter(F.col("bytes") <= usable(F.lit(total))).agg(F.max("profile").alias("profile"))


def complete_profile(lock: DataFrame, files: DataFrame) -> DataFrame:
    """One row: the largest profile all of whose files are there."""
    state = verify(lock.filter(F.col("kind").isin("model", "embed")), files).join(lock.select("file", "profile"), "file").groupBy(F.coalesce("profile", F.lit(0)).alias("profile")).agg(F.bool_and(F.col("status") != "MISSING").alias("own"))
    whole = state.withColumn("whole", F.bool_and("own").over(Window.orderBy("profile").rowsBetween(Window.unboundedPreceding, 0)))
    return whole.filter("whole").agg(F.max("profile").alias("profile"))


def budget(ram: Column, encoder: Column) -> Column:
    """Memory for models: 0.7 of it or all but 4 GiB, without the encoder if something is left then."""
    least = F.least(F.floor(ram * 7 / 10), ram - 4 * GIB)
    return F.when(encoder.isNotNull() & (least - encoder > 0), least - encoder).otherwise(least)


def packing(models: DataFrame, budget_bytes: int) -> DataFrame:
    """One row (fitting, models_max) for models (name, bytes): how many fit alone, and how many of the largest fit together, at least 1."""
    fits = models.filter(~is_split_part(F.regexp_replace("name", r"(?i)\.gguf$", "")) & (F.col("bytes") <= budget_bytes))
    run = fits.withColumn("run", F.sum("bytes").over(Window.orderBy(F.desc("bytes"), "name").rowsBetween(Window.unboundedPreceding, 0)))
    return run.agg(F.count("*").alias("fitting"), F.greatest(F.lit(1), F.count_if(F.col("run") <= budget_bytes)).alias("models_max"))


def machine_manifest(models: DataFrame, ram: int, budget_bytes: int) -> DataFrame:
    """One row with the manifest as JSON."""
    entry = F.struct("name", F.struct(F.col("bytes"), (F.col("bytes") <= budget_bytes).alias("fits")).alias("v"))
    usable_ = models.filter(~is_split_part(F.col("name")))
    got = usable_.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("models")).crossJoin(packing(models, budget_bytes))
    return got.select(F.to_json(F.struct(F.lit(ram).alias("ramBytes"), F.lit(budget_bytes).alias("budgetBytes"), F.col("models_max").alias("modelsMax"), "models")).alias("json"))


def picker(ids: DataFrame, sizes: DataFrame) -> DataFrame:
    """Models as a menu shows them: ids (id) with sizes (id, bytes, fits), by band, weight and id; unreadable names last."""
    both = ids.join(sizes, "id", "left")
    part = is_split_part(F.col("id"))
    band = F.when(part, -1).otherwise(band_of(F.col("id"), F.col("bytes")))
    names = F.when(F.col("b") == -1, "")
    for i, (label, _, _) in enumerate(BANDS):
        names = names.when(F.col("b") == i, label)
    out = both.withColumn("b", band).withColumn("w", weight_of(F.col("id"), F.col("bytes")))
    return out.select("id", F.when(part, F.col("id")).otherwise(display_name(F.col("id"))).alias("label"), F.when(part, "").otherwise(model_tag(F.col("id"))).alias("tag"), names.alias("band"), (~part & F.coalesce("fits", F.lit(True))).alias("usable"), F.col("w").alias("weight"), F.when(F.col("b") == -1, 99).otherwise(F.col("b")).alias("place")).orderBy("place", "weight", "id")


def first_encoder(files: DataFrame) -> DataFrame:
    return files.filter((F.col("dir") == "embed") & F.col("file").endswith(".gguf")).agg(F.min("file").alias("file"))


def asset_name(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("-"))
