"""Operators over task catalogs: summaries, lookups, versions, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def summarize(tasks: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """Tasks with ``batch_count, completed_pages, any_completed, all_completed`` of their batches (``status, page_count``).

    Batches are summed by key before they meet the tasks, so a task with very many sends one row a partition.
    """
    done = F.col("status") == "completed"
    sums = batches.groupBy(key).agg(
        F.count("*").alias("batch_count"),
        F.sum(F.when(done, F.coalesce("page_count", F.lit(0))).otherwise(0)).alias("completed_pages"),
        F.bool_or(done).alias("any_completed"),
        F.bool_and(done).alias("all_completed"),
    )
    zero = {"batch_count": F.lit(0), "completed_pages": F.lit(0), "any_completed": F.lit(False), "all_completed": F.lit(True)}
    out = tasks.join(sums, key, "left")
    return out.withColumns({name: F.coalesce(name, value.cast(dict(sums.dtypes)[name])) for name, value in zero.items()})


def status_label(status: Column, any_completed: Column, all_completed: Column, batches: Column) -> Column:
    return (
        F.when(status == "error", "error")
        .when((batches > 0) & all_completed, "completed")
        .when(any_completed, "partial")
        .when(status == "processing", "processing")
        .otherwise("pending")
    )


def hydrate(tasks: DataFrame, results: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Tasks with their results; where there is none, the defaults."""
    out = tasks.join(results.select(key, *defaults), key, "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def preserve(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A metadata write keeps what an earlier version holds in ``columns``."""
    before = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    out = new.join(before, key, "left")
    return out.select(*[F.coalesce(c, f"_old_{c}").alias(c) if c in columns else F.col(c) for c in new.columns])


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of both; a change wins column by column where it isn't null."""
    rest = [c for c in table.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in rest])
    return table.join(renamed, key, "full_outer").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in rest])


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in ``gone``."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def keep_latest(rows: DataFrame, fingerprint: list[Column], updated: Column, order: Column) -> DataFrame:
    """Of rows with one fingerprint the one updated last, the first of ties. Partial aggregation, no window over a group."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in fingerprint])
    best = F.max_by(F.struct("*"), F.struct(F.coalesce(updated, F.lit(0)), -order))
    return rows.groupBy(key.alias("_fingerprint")).agg(best.alias("_row")).select("_row.*")


def search(rows: DataFrame, name: Column, keyword: str, condition: Column) -> DataFrame:
    return rows.filter(condition & F.lower(name).contains(keyword.lower()))


def page_of(rows: DataFrame, order: list[Column], start: int, count: int) -> DataFrame:
    """A stretch of the rows in order; Spark keeps start + count rows a partition."""
    return rows.orderBy(*order).offset(start).limit(count)


def batch_plan(rows: DataFrame, pages: Column, size: Column) -> DataFrame:
    """Rows with ``start_page, end_page, page_count, label`` of their batches of ``size`` pages; none without pages."""
    starts = F.when(pages >= 1, F.sequence(F.lit(1), pages, size)).otherwise(F.array().cast("array<int>"))
    out = rows.withColumns({"_pages": pages, "_size": size}).withColumn("start_page", F.explode(starts))
    out = out.withColumn("end_page", F.least(F.col("start_page") + F.col("_size") - 1, F.col("_pages")))
    out = out.withColumn("page_count", F.col("end_page") - F.col("start_page") + 1)
    return out.withColumn("label", T.page_label(F.col("start_page"), F.col("end_page"))).drop("_pages", "_size")


def page_range(plan: DataFrame, start: int, end: int, total: Column) -> DataFrame:
    """Batches that meet pages start to end; the end stops at the total, a bad range gives none."""
    last = F.least(F.lit(end), total)
    return plan.filter((F.lit(start) >= 1) & (F.lit(end) >= F.lit(start)) & (F.col("start_page") <= last) & (F.col("end_page") >= start))


def page_rows(pages: DataFrame, start: int = 0, limit: int | None = None, number: str = "page") -> DataFrame:
    """Rows of pages ``start`` (from 0) up to ``limit`` of them. The range is of a plain column, so it reaches the scan; what a document lacks it has no rows of."""
    first = max(0, start)
    chosen = pages.filter(F.col(number) >= first)
    return chosen if limit is None else chosen.filter(F.col(number) < start + limit)


def page_counts(pages: DataFrame, key: str, most: int) -> DataFrame:
    """``key, pages``: the number of page rows of each document; one with more than ``most`` fails the query."""
    counts = pages.groupBy(key).agg(F.count("*").alias("pages"))
    told = F.concat(F.lit("document "), F.col(key).cast("string"), F.lit(f" has more than {most} pages"))
    return counts.select(key, F.when(F.col("pages") > most, F.raise_error(told).cast("long")).otherwise(F.col("pages")).alias("pages"))


#: Threshold rows at most: a list that a person keeps.
MOST_LEVELS = 1000


def levels(rows: DataFrame, amount: Column, thresholds: DataFrame) -> DataFrame:
    """Each row with each threshold row (``name, minimum, recommended``) and how it meets it; more than MOST_LEVELS thresholds raise.

    The thresholds are an array in the plan, so nothing is joined or sent apart.
    """
    known = thresholds.select("name", "minimum", "recommended").limit(MOST_LEVELS + 1).collect()
    if len(known) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} thresholds")
    kinds = [(f.name, f.dataType) for f in thresholds.select("name", "minimum", "recommended").schema]
    row = lambda r: F.struct(*[F.lit(r[name]).cast(kind).alias(name) for name, kind in kinds])
    every = rows.select("*", F.inline(F.array(*map(row, known)))) if known else rows.crossJoin(thresholds.limit(0))
    level = F.when(amount >= F.col("recommended"), "recommended").when(amount >= F.col("minimum"), "low").otherwise("unsupported")
    return every.withColumn("level", level)


def unique_stems(rows: DataFrame, stem: Column, path: Column) -> DataFrame:
    """``stem`` made unique in order of path: the first keeps it, others get a hash of the path, then a number."""
    first = Window.partitionBy("_stem").orderBy("_path")
    again = Window.partitionBy("_stem", "_hash").orderBy("_path")
    out = rows.withColumns({"_stem": stem, "_path": path, "_hash": T.digest8(path)})
    out = out.withColumn("_n", F.row_number().over(first))
    later = out.withColumn("_m", F.sum((F.col("_n") > 1).cast("int")).over(again))
    name = F.when(F.col("_n") == 1, F.col("_stem")).otherwise(F.concat_ws("-", "_stem", "_hash", F.when(F.col("_m") > 1, F.col("_m").cast("string"))))
    return later.withColumn("stem", name).drop("_stem", "_path", "_hash", "_n", "_m")


def exclusivity(services: DataFrame) -> DataFrame:
    """One row: running and ready ids in order, and whether more than one runs. ``services``: ``id, running, ready``; a short list."""
    running, ready = F.col("running"), F.col("running") & F.col("ready")
    out = services.agg(F.sort_array(F.collect_set(F.when(running, F.col("id")))).alias("r"), F.sort_array(F.collect_set(F.when(ready, F.col("id")))).alias("d"))
    return out.select(F.array_join("r", ",").alias("running_ids"), F.array_join("d", ",").alias("ready_ids"), (F.size("r") > 1).alias("violation"))


def merge_maps(rows: DataFrame, key: str, order: str, column: str, last_wins: bool) -> DataFrame:
    """One map a key from the maps of its rows in order; of equal names the last or the first wins."""
    flat = rows.select(key, order, F.explode(column).alias("name", "value"))
    chosen = (F.max_by if last_wins else F.min_by)("value", order).alias("value")
    return flat.groupBy(key, "name").agg(chosen).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(column))


def run_metrics(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs by keys: how many, how many failed, characters and seconds. ``runs``: ``error, text, seconds``."""
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"),
        F.bround(F.sum("seconds"), 3).alias("seconds"),
    )


def concat_parts(rows: DataFrame, key: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Non-empty parts of a key in order with a separator."""
    parts = rows.filter(F.coalesce(F.col(text), F.lit("")) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_parts"))
    return parts.select(key, F.array_join(F.transform("_parts", lambda p: p[text]), separator).alias(text))


def join_continuations(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Parts of a key in order: a blank where a sentence goes on over the border, else a blank line."""
    parts = rows.withColumn("_part", T.strip(F.coalesce(F.col(text), F.lit("")))).filter(F.col("_part") != "")
    before = F.lag("_part").over(Window.partitionBy(key).orderBy(order))
    image = before.rlike(r"(?:^|\n)!\[[^\]]*\]\([^)]+\)\s*\z")
    open_end = before.rlike(r"[A-Za-z0-9,)\]%'”’]\z") & ~image
    mark = F.when(before.isNull(), "").when(open_end & F.col("_part").rlike("^[a-z]"), " ").otherwise("\n\n")
    marked = parts.select(key, order, F.concat(mark, F.col("_part")).alias("_part"))
    return marked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_part"))), lambda p: p["_part"]), "").alias(text))


def model_catalog(ids: DataFrame, definitions: DataFrame, runtime: DataFrame) -> DataFrame:
    """Models in the catalog's order that are defined and configured. ``ids``: ``ord, id``; short lists."""
    return ids.join(definitions, "id").join(runtime, "id").orderBy("ord")


def with_labels(rows: DataFrame, label: str, names: list[DataFrame]) -> DataFrame:
    """``shown``: a label's name from the first dictionary (``label, name``; short lists) that has it, else the label."""
    out = rows
    for i, dictionary in enumerate(names):
        out = out.join(dictionary.select(F.col("label").alias(label), F.col("name").alias(f"_n{i}")), label, "left")
    return out.withColumn("shown", F.coalesce(*[f"_n{i}" for i in range(len(names))], label)).drop(*[f"_n{i}" for i in range(len(names))])


def lease_models(leases: DataFrame, pool: str) -> DataFrame:
    """``pool, models, leases, mixed``: how many leases of how many models a pool holds."""
    out = leases.groupBy(pool).agg(F.countDistinct("model").alias("models"), F.count("*").alias("leases"))
    return out.withColumn("mixed", F.col("models") > 1)


def chosen_device(devices: DataFrame, identity: str | None, index: int | None) -> DataFrame:
    """One device: by its id, else by its index, else the only one; an error if that leaves none. A short list."""
    rank = F.when(F.col("device_id") == F.lit(identity), 1).when(F.col("index") == F.lit(index), 2).otherwise(3)
    ranked = devices.select("*", rank.alias("_rank"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("_all"))
    fits = ranked.filter((F.col("_rank") < 3) | ((F.col("_all") == 1) & F.lit(identity is None and index is None)))
    best = fits.orderBy("_rank", "index").limit(1).drop("_rank", "_all")
    found = devices.agg(F.count("*").alias("_n")).crossJoin(best.agg(F.count("*").alias("_m")))
    check = found.select(F.when(F.col("_m") == 0, F.raise_error(F.lit("no device fits"))).otherwise(F.lit(True)).alias("_ok"))
    return best.crossJoin(check).filter("_ok").drop("_ok")


def first_available(preferences: DataFrame, available: DataFrame, key: str, order: str) -> DataFrame:
    """The first preference that is there."""
    return preferences.join(available.select(key).distinct(), key, "left_semi").agg(F.min_by(key, order).alias(key))


def services_of(models: DataFrame, deployments: DataFrame, key: str) -> DataFrame:
    """``key, ord, service``: services of each model in order. ``deployments``: ``key, services array``."""
    return models.join(deployments, key).select(key, F.posexplode("services").alias("ord", "service"))


def combined_images(pages: DataFrame, key: str, batch: str) -> DataFrame:
    """``key, images``: image names of pages under their batches' names, all in one map; later ones win."""
    from ..functions.records import namespaced

    named = pages.select(key, batch, namespaced(F.col("images"), F.col(batch).cast("string")).alias("images"))
    return merge_maps(named, key, batch, "images", True)
