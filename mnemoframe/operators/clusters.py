"""Near duplicates, link suggestions, clusterings, novelty, habits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.scores import HABIT_HALF_LIFE, confidence_tier, corroboration_boost, cosine, half_decay
from mnemoframe.operators.lexical import top_ranked
from mnemoframe.operators.vectors import close_pairs, vector_topk

# Constants that results depend on.
NEAR_DUPLICATE, LINK_LEAST, LINK_CAP = 0.92, 0.55, 5
LINK_EXCLUDED = ("digest_", "session_handoff_")
SEED_SIMILARITY, CENTROID_SIMILARITY = 0.65, 0.85
COVERED, CITED, PENDING = 0.88, 0.5, 0.85
HABIT_LEAST, HABIT_MOST = 0.62, 3
UPVOTE, NEW_IMPORTANCE = 0.85, 2
#: The most rows that a sequential clustering takes; beyond it raises, as its result depends on the order of all rows.
SEQUENTIAL_ROWS = 200_000


def near_duplicates(vectors: DataFrame, files: DataFrame, least: float = NEAR_DUPLICATE) -> DataFrame:
    """``a, b, similarity, intended``: pairs of files with close vectors.

    ``vectors`` has ``key, vector``, ``files`` ``key, related``. Intended are pairs one of which
    names the other as related, and two files of one excluded family. Files with equal
    vectors come as pairs with the first of them.
    """
    pairs = close_pairs(vectors, least, copies=True)
    related = files.select("key", F.explode("related").alias("r")).select("key", F.btrim("r").alias("r"))
    said = related.select(F.least("key", "r").alias("a"), F.greatest("key", "r").alias("b")).distinct().withColumn("_said", F.lit(True))
    family = F.lit(False)
    for prefix in LINK_EXCLUDED:
        family = family | (F.startswith("a", F.lit(prefix)) & F.startswith("b", F.lit(prefix)))
    return pairs.join(said, ["a", "b"], "left").select("a", "b", "similarity", (F.coalesce("_said", F.lit(False)) | family).alias("intended"))


def suggested_links(neighbours: DataFrame, existing: DataFrame, least: float = LINK_LEAST, cap: int = LINK_CAP) -> DataFrame:
    """``file, other, similarity``: of the best ``cap - have`` neighbours not linked yet, those that are close enough.

    ``neighbours`` has ``file, other, similarity``, ``existing`` ``file, related``. Excluded families
    neither get nor give links.
    """
    have = existing.select("file", F.coalesce("related", F.array().cast("array<string>")).alias("related")).groupBy("file").agg(F.array_distinct(F.flatten(F.collect_list("related"))).alias("related"))
    open_ = lambda c: ~(F.startswith(c, F.lit(LINK_EXCLUDED[0])) | F.startswith(c, F.lit(LINK_EXCLUDED[1])))
    rows = neighbours.where(open_("file") & open_("other") & (F.col("file") != F.col("other"))).join(have, "file", "left")
    rows = rows.withColumn("related", F.coalesce("related", F.array().cast("array<string>"))).where(~F.array_contains("related", F.col("other")))
    best = Window.partitionBy("file").orderBy(F.desc(F.round("similarity", 10)), "other")
    picked = rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= cap - F.size("related"))
    return picked.where(F.round("similarity", 10) >= least).select("file", "other", "similarity")


def greedy_seeds(vectors: list[np.ndarray], least: float = SEED_SIMILARITY) -> list[int]:
    """The cluster of each vector, in order: it joins the first seed that is close enough, else it is a seed."""
    unit = [v / n if (n := np.linalg.norm(v)) > 0 else v for v in map(np.asarray, vectors)]
    of = [-1] * len(unit)
    for i, v in enumerate(unit):
        if of[i] >= 0:
            continue
        of[i] = i
        for j in range(i + 1, len(unit)):
            if of[j] < 0 and float(v @ unit[j]) >= least:
                of[j] = i
    return of


def greedy_centroids(vectors: list[np.ndarray], least: float = CENTROID_SIMILARITY) -> list[int]:
    """The cluster of each vector, in order: it joins the first cluster whose mean is close enough, else it begins one."""
    sums: list[np.ndarray] = []
    sizes: list[int] = []
    firsts: list[int] = []
    of = []
    for i, v in enumerate(np.asarray(x, float) for x in vectors):
        chosen = None
        for c, s in enumerate(sums):
            mean = s / sizes[c]
            norm = np.linalg.norm(v) * np.linalg.norm(mean)
            if norm > 0 and float(v @ mean) / norm >= least:
                chosen = c
                break
        if chosen is None:
            sums.append(v.copy()), sizes.append(1), firsts.append(i)
            chosen = len(sums) - 1
        else:
            sums[chosen] += v
            sizes[chosen] += 1
        of.append(firsts[chosen])
    return of


def sequential_clusters(rows: DataFrame, key: str, vector: str, order: Column | str, method: str = "seed", least: float | None = None, by: str | None = None) -> DataFrame:
    """``by, key, cluster``: the greedy clusterings, in the rows' order; ``cluster`` is its first row's key.

    Each row depends on all before it, so that a group of ``by`` (or all rows) is one task; more
    than SEQUENTIAL_ROWS rows in a group are refused. For large inputs link close pairs instead,
    which is another operator with another result.
    """
    fold, default = {"seed": (greedy_seeds, SEED_SIMILARITY), "centroid": (greedy_centroids, CENTROID_SIMILARITY)}[method]
    limit = default if least is None else least
    order = F.col(order) if isinstance(order, str) else order
    group = F.col(by).cast("string") if by else F.lit("all")
    picked = rows.where(F.col(vector).isNotNull()).select(group.alias("by"), F.col(key).cast("string").alias("key"), order.alias("_o"), F.col(vector).cast("array<double>").alias("vector"))
    most = picked.groupBy("by").count().agg(F.max("count")).first()[0] or 0
    if most > SEQUENTIAL_ROWS:
        raise ValueError(f"a sequential clustering takes at most {SEQUENTIAL_ROWS} rows a group, not {most}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_o", "key"], kind="stable").reset_index(drop=True)
        of = fold([np.array(v, float) for v in pdf["vector"]], limit)
        return pd.DataFrame({"by": pdf["by"], "key": pdf["key"], "cluster": pdf["key"].to_numpy()[of] if len(pdf) else []})

    return picked.groupBy("by").applyInPandas(one, "by string, key string, cluster string")


def cluster_facts(members: DataFrame, day: str, similarity: str | None = None) -> DataFrame:
    """``cluster, size, first_day, last_day, span_days, tier`` of ``cluster`` rows with a date."""
    sim = F.max(similarity) if similarity else F.lit(None).cast("double")
    rows = members.groupBy("cluster").agg(F.count("*").alias("size"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), sim.alias("_s"))
    rows = rows.withColumn("span_days", F.date_diff("last_day", "first_day"))
    return rows.withColumn("tier", confidence_tier("size", "span_days", "_s")).drop("_s")


def closest_known(vectors: DataFrame, known: DataFrame) -> DataFrame:
    """``key, closest, similarity``: the most similar known vector; null where there is nothing to compare with."""
    best = vector_topk(known.select("key", "vector"), vectors.select(F.col("key").alias("query_id"), "vector"), 1)
    best = best.select(F.col("query_id").alias("key"), F.col("key").alias("closest"), F.col("score").alias("similarity"))
    return vectors.select("key").join(best, "key", "left")


def coverage(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """``key, closest, similarity, covered``: candidates whose centroid an existing vector covers."""
    return closest_known(candidates, known).withColumn("covered", F.coalesce(F.col("similarity") >= COVERED, F.lit(False)))


def citation_overlap(cited: DataFrame, members: DataFrame) -> DataFrame:
    """``draft, candidate, overlap``: the share of a draft's cited rows that a pending candidate has, its best candidate.

    ``cited`` has ``draft, row``, ``members`` ``candidate, row``.
    """
    cited, members = cited.distinct(), members.distinct()
    sizes = cited.groupBy("draft").agg(F.count("*").alias("cited"))
    common = cited.join(members, "row").groupBy("draft", "candidate").agg(F.count("*").alias("n"))
    shares = common.join(sizes, "draft").select("draft", "candidate", (F.col("n") / F.col("cited")).alias("overlap"))
    return top_ranked(shares, 1, ["draft"], [F.desc("overlap"), F.col("candidate")]).drop("rank")


def pending_verdict(overlap: Column, similarity: Column) -> Column:
    """corroborate from an overlap of 0.5, or else a cosine of 0.85; otherwise new."""
    return F.when(F.coalesce(overlap, F.lit(0.0)) >= CITED, "corroborate").when(F.coalesce(similarity, F.lit(0.0)) >= PENDING, "corroborate").otherwise("new")


def habit_scores(cosines: DataFrame, habits: DataFrame, now: int, k: int = HABIT_MOST, least: float = HABIT_LEAST) -> DataFrame:
    """``query_id, id, cosine, score, inject, rank``: active habits by cosine, decay since last validated, and corroboration.

    ``cosines`` has ``query_id, id, cosine``, ``habits`` ``id, status, importance, corroboration, last_validated_ts, created_ts``.
    """
    age = (F.lit(now) - F.coalesce("last_validated_ts", "created_ts", F.lit(now))) / F.lit(86400.0)
    live = habits.where((F.col("status") == "active") & (F.coalesce("importance", F.lit(0)) >= 1))
    rows = cosines.where("cosine > 0").join(live, "id")
    rows = rows.withColumn("score", F.col("cosine") * half_decay(age, HABIT_HALF_LIFE) * corroboration_boost("corroboration"))
    best = top_ranked(rows.select("query_id", "id", "cosine", "score"), k, ["query_id"], [F.desc(F.round("score", 10)), F.col("id")])
    return best.withColumn("inject", F.round("cosine", 10) >= least)


def habit_list(habits: DataFrame, k: int = 5) -> DataFrame:
    """``id, strength``: the strongest active habits, latest validated first on ties."""
    strength = F.coalesce("importance", F.lit(0)) * F.coalesce("corroboration", F.lit(0))
    rows = habits.where("status = 'active'").withColumn("strength", strength)
    return rows.orderBy(F.desc("strength"), F.col("last_validated_ts").desc_nulls_last(), "id").limit(k).select("id", "strength")


def upserted_habits(pool: list[tuple[int, np.ndarray]], arrivals: list[tuple[int, np.ndarray]], least: float = UPVOTE) -> list[tuple[int, int, bool]]:
    """For each arrival in turn (its id, the habit it counts for, whether it is new): the nearest habit of at least that cosine gets the vote, and a new habit joins the pool."""
    ids, unit, out = [i for i, _ in pool], [v / (np.linalg.norm(v) or 1.0) for _, v in pool], []
    for i, v in arrivals:
        u = v / (np.linalg.norm(v) or 1.0)
        scores = np.array([x @ u for x in unit]) if unit else np.zeros(0)
        if len(scores) and scores.max() >= least:
            out.append((i, ids[int(scores.argmax())], False))
        else:
            ids.append(i), unit.append(u)
            out.append((i, i, True))
    return out


def exact_votes(existing: DataFrame, arrivals: DataFrame, trigger: str = "trigger") -> DataFrame:
    """``id, habit, is_new``: without vectors, an arrival counts for the first row, stored or arrived, with its exact trigger."""
    both = existing.select(F.lit(0).alias("_new"), "id", trigger).unionByName(arrivals.select(F.lit(1).alias("_new"), "id", trigger)).where(F.col(trigger).isNotNull())
    first = both.groupBy(trigger).agg(F.min(F.struct("_new", "id")).alias("_f"))
    return arrivals.join(first, trigger).select("id", F.col("_f.id").alias("habit"), (F.col("_f.id") == F.col("id")).alias("is_new"))


def adjacent_drift(rows: DataFrame, key: str, at: str, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., key, similarity``: each row's cosine with the row before it in time; null for the first."""
    order = Window.partitionBy(*by).orderBy(at, key)
    both = rows.withColumn("_p", F.lag(vector).over(order))
    return both.select(*by, key, F.when(F.col("_p").isNotNull(), cosine("_p", vector)).alias("similarity"))
