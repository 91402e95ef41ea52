"""Mining access and observation logs."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.durable import as_table
from mnemoframe.functions.scores import DAY, half_decay
from mnemoframe.functions.text import iso_week, jaccard, looks_like_error, word_set
from mnemoframe.operators.lexical import top_ranked

# Constants that results depend on.
CO_RECALL_HALF_LIFE, CO_RECALL_PRUNE = 45.0, 0.05
GAP_SECONDS = 600
RECOVERY_ROWS, RECOVERY_SIMILARITY = 20, 0.3
SIGNIFICANT = {"accesses": 5, "files": 4, "new": 1, "engine": 3}
PAIR_SECONDS = 60
#: Most frequent files whose pairs bound how often the wanted pairs are seen.
BOUND_FILES = 200


def access_stats(access: DataFrame, now: int, file: str = "file", at: str = "ts") -> DataFrame:
    """``file, last, total, d30, d90`` in one pass. Null files or times don't count."""
    rows = access.where(F.col(file).isNotNull() & F.col(at).isNotNull())
    return rows.groupBy(F.col(file).alias("file")).agg(
        F.max(at).alias("last"), F.count("*").alias("total"), F.count_if(F.col(at) >= now - 30 * DAY).alias("d30"), F.count_if(F.col(at) >= now - 90 * DAY).alias("d90")
    )


def item_pairs(baskets: DataFrame, items: str = "items") -> DataFrame:
    """``..., a, b``: the pairs a < b of each row's sorted array of distinct items.

    Pairs are unfolded one item at a time, never as one array of all pairs.
    """
    others = [c for c in baskets.columns if c != items]
    first = baskets.where(F.size(items) > 1).select(*others, items, F.posexplode(items).alias("_i", "a"))
    return first.select(*others, "a", F.explode(F.expr(f"slice({items}, _i + 2, size({items}))")).alias("b"))


def co_recall(access: DataFrame, now: int, batch: list[str], file: str = "file", at: str = "ts", valid: DataFrame | None = None, half_life: float = CO_RECALL_HALF_LIFE, prune: float = CO_RECALL_PRUNE) -> DataFrame:
    """``a, b, weight, decayed, last_fired`` of files accessed in one batch, a < b.

    ``weight`` counts batches, ``decayed`` sums 2^(-age/half life), to six places with halves
    to even. Pairs under ``prune`` are left out, and files that ``valid`` (``file``) doesn't hold.
    """
    rows = access.where(F.col(file).isNotNull() & F.col(at).isNotNull())
    if valid is not None:
        rows = rows.join(valid.select(F.col("file").alias(file)).distinct(), file, "left_semi")
    groups = rows.groupBy(*batch).agg(F.array_sort(F.collect_set(file)).alias("items"), F.max(at).alias("fired"))
    pairs = item_pairs(groups.select("items", "fired"))
    part = half_decay((F.lit(now) - F.col("fired")) / F.lit(float(DAY)), half_life)
    summed = pairs.groupBy("a", "b").agg(F.count("*").alias("weight"), F.sum(part).alias("decayed"), F.max("fired").cast("long").alias("last_fired"))
    return summed.where(F.col("decayed") >= prune).withColumn("decayed", F.bround("decayed", 6))


def strongest_partners(edges: DataFrame, k: int = 8, least: float = 0.0) -> DataFrame:
    """``file, partner, decayed, rank``: the strongest partners of each file."""
    both = edges.select(F.col("a").alias("file"), F.col("b").alias("partner"), "decayed").unionByName(edges.select(F.col("b").alias("file"), F.col("a").alias("partner"), "decayed"))
    return top_ranked(both.where(F.col("decayed") >= least), k, ["file"], [F.desc("decayed"), F.col("partner")])


def gap_windows(rows: DataFrame, at: str, gap: int = GAP_SECONDS, by: list[str] | None = None, slice_seconds: int = DAY) -> DataFrame:
    """Adds ``window``, the time of the first row of its run: a run ends where the next row is more than ``gap`` later.

    Runs are found in two steps, so that a log without ``by`` isn't sorted as one partition: the distinct
    times are cut into slices, a slice's first time is compared with the last one of the slice before,
    and the starts are then carried on over the slices.
    """
    by = by or []
    times = rows.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_t")).distinct().withColumn("_s", F.call_function("div", F.col("_t"), F.lit(slice_seconds)))
    within = Window.partitionBy(*by, "_s").orderBy("_t")
    edges = times.groupBy(*by, "_s").agg(F.max("_t").alias("_last"))
    over = Window.partitionBy(*by).orderBy("_s")
    before = edges.select(*by, "_s", F.lag("_last").over(over).alias("_before"))
    marked = times.join(before, [*by, "_s"]).withColumn("_prev", F.coalesce(F.lag("_t").over(within), "_before"))
    marked = marked.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > gap), F.col("_t")))
    own = F.last("_start", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = marked.groupBy(*by, "_s").agg(F.max("_start").alias("_latest"))
    carried = carried.select(*by, "_s", F.last("_latest", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    starts = marked.withColumn("_own", own).join(carried, [*by, "_s"]).select(*by, F.col("_t").alias(at), F.coalesce("_own", "_carry").alias("window"))
    return rows.join(starts, [*by, at])


def co_access(access: DataFrame, file: str = "file", at: str = "ts", gap: int = GAP_SECONDS, k: int = 20, least: int = 3) -> DataFrame:
    """``a, b, n``: of the k most frequent pairs of one gap window, those seen at least so often.

    A busy log's windows hold nearly all files, so that not all pairs are counted, only what can be among the k:
    a pair is seen at most as often as the rarer of its files, and the k-th best pair of the most frequent files
    is a bound from below. Of files with the same windows the first k + 1 by name are enough, as each
    pair of a later one has k pairs before it that are seen as often.
    """
    rows = access.where(F.col(file).isNotNull()).select(F.col(file).alias("file"), F.col(at).alias("ts"))
    items = gap_windows(rows, "ts", gap).groupBy("file").agg(F.array_sort(F.collect_set("window")).alias("windows")).where(F.size("windows") >= least)
    items = as_table(top_ranked(items, k + 1, ["windows"], [F.col("file")]).select("file", "windows", F.size("windows").alias("often")), "co-access")

    def counted(some: DataFrame) -> DataFrame:
        groups = some.select("file", F.explode("windows").alias("window")).groupBy("window").agg(F.array_sort(F.collect_list("file")).alias("items"))
        return item_pairs(groups.select("items")).groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(k)

    known = counted(items.orderBy(F.desc("often"), "file").limit(BOUND_FILES)).collect()
    bound = max(least, known[-1]["n"] if len(known) == k else 0)
    return counted(items.where(F.col("often") >= bound)).where(F.col("n") >= least)


def session_summary(rows: DataFrame, session: str, at: str, tool: str, file: str, k: int = 3) -> DataFrame:
    """``session, started, ended, seconds, n, top_tools, top_files``; lists hold ``name x count``, ties by name."""
    base = rows.groupBy(F.col(session).alias("session")).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))
    out = base.withColumn("seconds", F.greatest(F.lit(1), F.col("ended") - F.col("started")))
    for name, column in (("top_tools", tool), ("top_files", file)):
        counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(session).alias("session"), F.col(column).alias("v")).agg(F.count("*").alias("c"))
        best = top_ranked(counts, k, ["session"], [F.desc("c"), F.col("v")])
        listed = best.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("v").cast("string"), F.lit("x"), F.col("c").cast("string")).alias("s")))), lambda x: x["s"]), ", ").alias(name))
        out = out.join(listed, "session", "left")
    return out


def significance(access: DataFrame, new: DataFrame, observations: DataFrame, now: int, hours: int = 4) -> DataFrame:
    """One row: counts of the last hours and whether any reaches its limit.

    ``access`` has ``file, ts``, ``new`` has ``mtime``, ``observations`` has ``ts, engine`` (boolean).
    """
    since = now - hours * 3600
    a = access.where(F.col("ts") >= since).agg(F.count("*").alias("accesses"), F.count_distinct("file").alias("files"))
    n = new.where(F.col("mtime") >= since).agg(F.count("*")).scalar()
    o = observations.where((F.col("ts") >= since) & F.col("engine")).agg(F.count("*")).scalar()
    row = a.select("accesses", "files", n.alias("new"), o.alias("engine"))
    yes = F.lit(False)
    for name, least in SIGNIFICANT.items():
        yes = yes | (F.col(name) >= least)
    return row.withColumn("significant", yes)


def error_recoveries(rows: DataFrame, session: str, at: str, id: str, tool: str, text: str, failed: Column | None = None, output: str = "output", ahead: int = RECOVERY_ROWS, least: float = RECOVERY_SIMILARITY) -> DataFrame:
    """``session, tool, error_id, recovery_id, distance``: the first later success like a failed operation.

    Within a session ordered by time and id: of the next ``ahead`` rows the first of the same tool
    that didn't fail and shares at least ``least`` of its words. Rows and their followers meet by
    an equi-join on blocks of the row number, so that a long session isn't squared.
    """
    failed = failed if failed is not None else looks_like_error(output)
    order = Window.partitionBy(session).orderBy(at, id)
    numbered = rows.select(F.col(session).alias("session"), F.col(id).alias("id"), F.col(tool).alias("tool"), word_set(text).alias("words"), failed.alias("failed"), F.row_number().over(order).alias("n"))
    block = lambda n: F.call_function("div", n, F.lit(ahead))
    errors = numbered.where("failed").select("session", "tool", F.col("id").alias("error_id"), F.col("words").alias("error_words"), F.col("n").alias("error_n"))
    errors = errors.withColumn("block", F.explode(F.array(block(F.col("error_n")), block(F.col("error_n")) + 1)))
    later = numbered.where("NOT failed").select("session", "tool", "id", "words", "n", block(F.col("n")).alias("block"))
    met = errors.join(later, ["session", "tool", "block"]).where((F.col("n") > F.col("error_n")) & (F.col("n") <= F.col("error_n") + ahead) & (jaccard("error_words", "words") >= least))
    return met.groupBy("session", "tool", "error_id").agg(F.min_by("id", "n").alias("recovery_id"), F.min(F.col("n") - F.col("error_n")).cast("long").alias("distance"))


def next_event(rows: DataFrame, at: str, name: str, first: Column, second: Column, by: list[str] | None = None, within: int = PAIR_SECONDS, slice_seconds: int | None = None) -> DataFrame:
    """Forward as-of join: each ``first`` row with the next ``second`` row at most ``within`` seconds later.

    Returns ``by..., at, name, next_name, next_at``, both null where there is none. Rows are ordered
    by time and name. Rows are cut into slices of time, by default of ten times ``within``; the ``second`` rows of a slice's first
    seconds are also put into the slice before, so that slices are searched on their own. A slice is
    read once from its end, carrying the last ``second`` row along.
    """
    by = by or []
    slice_seconds = slice_seconds or 10 * max(1, within)
    tagged = rows.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_t"), F.col(name).alias("_name"), F.coalesce(first, F.lit(False)).alias("_first"), F.coalesce(second, F.lit(False)).alias("_second"))
    slice_of = F.call_function("div", F.col("_t"), F.lit(slice_seconds))
    early = F.col("_second") & (F.pmod(F.col("_t"), F.lit(slice_seconds)) <= within)
    spread = tagged.withColumn("_s", F.explode(F.when(early, F.array(slice_of, slice_of - 1)).otherwise(F.array(slice_of))))
    ahead = Window.partitionBy(*by, "_s").orderBy(F.desc("_t"), F.desc("_name"), "_second").rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.last(F.when(F.col("_second"), F.struct(F.col("_name").alias("name"), F.col("_t").alias("at"))), ignorenulls=True).over(ahead)
    found = spread.withColumn("_next", nearest).where(F.col("_first") & (F.col("_s") == slice_of))
    near = F.col("_next.at") - F.col("_t") <= within
    return found.select(*by, F.col("_t").alias("at"), F.col("_name").alias("name"), F.when(near, F.col("_next.name")).alias("next_name"), F.when(near, F.col("_next.at")).alias("next_at"))


def nearest_in_time(left: DataFrame, right: DataFrame, at: str, by: list[str], key: str) -> DataFrame:
    """As-of join to the nearest: adds ``right_key, gap`` of the right row of the same ``by`` closest in time; ties: earlier, then smaller key.

    Both sides are merged by time in two running windows a group, forwards and backwards; no pairs are formed.
    """
    kind = right.schema[key].dataType
    stream = left.select(*by, F.col(at).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_k")).unionByName(
        right.select(*by, F.col(at).alias("_t"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("_row"), F.col(key).alias("_k"))
    )
    place = F.struct(F.col("_t").alias("t"), F.col("_k").alias("k"))
    at_time = right.groupBy(*by, F.col(at).alias("_t")).agg(F.min(key).alias("_first"))
    here = Window.partitionBy(*by).orderBy("_t")
    real = F.when(F.col("_k").isNotNull(), place)
    before = F.last(real, ignorenulls=True).over(here.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.partitionBy(*by).orderBy(F.desc("_t"))
    after = F.last(real, ignorenulls=True).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = stream.withColumn("_b", before).withColumn("_a", after).where(F.col("_row").isNotNull())
    gap_b, gap_a = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
    use_before = F.col("_a").isNull() | (F.col("_b").isNotNull() & (gap_b <= gap_a))
    chosen = both.withColumn("_pick", F.when(use_before, F.col("_b.t")).otherwise(F.col("_a.t")))
    named = chosen.join(at_time.select(*by, F.col("_t").alias("_pick"), F.col("_first").alias("right_key")), [*by, "_pick"], "left")
    return named.select("_row.*", "right_key", F.abs(F.col("_t") - F.col("_pick")).alias("gap"))


def systematic_sample(rows: DataFrame, order: list[str], keep: Column, target: int) -> DataFrame:
    """About ``target`` rows at even steps of the order; rows that ``keep`` marks always stay."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_c"))
    starts = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    total = rows.agg(F.count("*")).scalar()
    step = F.greatest(F.lit(1), F.call_function("div", total, F.lit(target)))
    placed = numbered.join(starts, "_part").withColumn("_at", F.col("_before") + F.col("_n") - 1)
    return placed.where((F.pmod("_at", step) == 0) | keep).drop("_part", "_n", "_before", "_at")


def weight_suggestions(files: DataFrame, access: DataFrame, now: int) -> DataFrame:
    """``file, current, suggested, n7``: high from five accesses in seven days; low where an unweighted file over 30 days old has none."""
    recent = access.where(F.col("ts") >= now - 7 * DAY).groupBy("file").agg(F.count("*").alias("n7"))
    current = F.lower(F.coalesce("weight", F.lit("")))
    rows = files.join(recent, "file", "left").select("file", current.alias("current"), F.coalesce("n7", F.lit(0)).alias("n7"), F.floor((now - F.col("mtime")) / DAY).alias("age"))
    suggested = F.when((F.col("n7") >= 5) & (F.col("current") != "high"), "high").when((F.col("n7") == 0) & (F.col("current") == "") & (F.col("age") > 30), "low")
    return rows.withColumn("suggested", suggested).where("suggested IS NOT NULL").select("file", F.when(F.col("current") == "", "(none)").otherwise(F.col("current")).alias("current"), "suggested", "n7")


def stale_files(files: DataFrame, stats: DataFrame, now: int, days: int = 90) -> DataFrame:
    """``file, last_access``: not of high weight, and either never accessed and older than that or last accessed before it."""
    rows = files.where(F.lower(F.coalesce("weight", F.lit(""))) != "high").join(stats, "file", "left")
    last = F.coalesce("last", F.lit(0))
    age = F.floor((now - F.col("mtime")) / DAY)
    never = (last == 0) & (age > days)
    long_ago = (last > 0) & (last < now - days * DAY) & (F.coalesce("d30", F.lit(0)) == 0)
    day = F.date_format(F.timestamp_seconds(last), "yyyy-MM-dd")
    return rows.where(never | long_ago).select("file", F.when(never, "never").otherwise(day).alias("last_access"))


def hot_and_stale(files: DataFrame, stats: DataFrame, now: int, accesses: int = 20, days: int = 45, k: int | None = None) -> DataFrame:
    """``file, total, age``: often read, but its last substantive date (event date, created, else mtime) is long past."""
    substantive = F.coalesce(F.unix_timestamp(F.try_to_date("event_date", "yyyy-MM-dd").cast("timestamp")), F.unix_timestamp(F.try_to_date("created", "yyyy-MM-dd").cast("timestamp")), F.floor("mtime").cast("long"))
    rows = files.join(stats, "file").select("file", "total", F.floor((now - substantive) / DAY).alias("age"))
    out = rows.where((F.col("total") >= accesses) & (F.col("age") >= days))
    return out if k is None else out.orderBy(F.desc("total"), "file").limit(k)


def weekly_growth(files: DataFrame, at: Column, kind: Column) -> DataFrame:
    """``week, kind, n``: new files by ISO week and kind."""
    return files.where(at.isNotNull()).groupBy(iso_week(at).alias("week"), kind.alias("kind")).agg(F.count("*").alias("n"))


def cost_rollup(calls: DataFrame, prices: DataFrame, now: int, days: int) -> DataFrame:
    """``model, calls, tokens_in, tokens_out, cost`` of the last days; an unusable time counts as now, an unlisted model is free.

    ``calls`` has ``ts string, model, tokens_in, tokens_out``; ``prices`` has ``model, price_in, price_out`` per million tokens.
    """
    at = F.coalesce(F.unix_timestamp(F.try_to_timestamp("ts")), F.lit(now))
    rows = calls.where(at >= now - days * DAY).join(prices, "model", "left")
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))) / 1e6
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(cost).alias("cost"))


def week_triage(drafts: DataFrame, digests: DataFrame, day: Column, now_week: str) -> DataFrame:
    """``week, archive, needs_digest``: drafts of past weeks, to be archived where their week has a digest."""
    weeks = drafts.select(iso_week(day).alias("week")).where((F.col("week") < now_week) & F.col("week").isNotNull()).groupBy("week").agg(F.count("*").alias("n"))
    done = digests.select("week").distinct().withColumn("_d", F.lit(True))
    return weeks.join(done, "week", "left").select("week", F.when(F.col("_d"), F.col("n")).otherwise(0).alias("archive"), F.when(F.col("_d"), 0).otherwise(F.col("n")).alias("needs_digest"))


def keyword_states(rows: DataFrame, text: str, keywords: list[str], key: str, examples: int = 3) -> DataFrame:
    """``keyword, n, examples``: texts that hold each keyword, and the first lines with it by key."""
    low = rows.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(key).alias("k"), F.lower(text).alias("low"))
    hits = low.select("k", "low", F.explode(F.filter(F.array(*[F.lit(w) for w in keywords]), lambda w: F.contains(F.col("low"), w))).alias("keyword"))
    line = F.substring(F.btrim(F.get(F.filter(F.split("low", "\r\n|\n|\r"), lambda x: F.contains(x, F.col("keyword"))), F.lit(0))), 1, 120)
    lines = hits.select("keyword", "k", line.alias("line"))
    best = top_ranked(lines, examples, ["keyword"], [F.col("k")]).groupBy("keyword").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), " | ").alias("examples"))
    return lines.groupBy("keyword").agg(F.count("*").alias("n")).join(best, "keyword")


