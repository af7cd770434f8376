"""Learning-to-rank data, model training and scoring, and serving for all users in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.order import global_row_number, hash_key, top_k_list
from basketry.functions.treemodel import SAVED_RANKER, TreeModel, tree_score
from basketry.functions.windows import trailing_window
from basketry.operators.boosting import Params, boost, successive_halving
from basketry.operators.candidates import (
    LIST_ROWS, cf_window, dealt, low_activity_lists, merged_lists, popularity_candidates, user_parts,
)
from basketry.operators.features import frequency_encoded
from basketry.operators.segments import ACTIVE, LOW_ACTIVITY

FEATURES = ["purchase_count", "recency", "purchase_frequency_encoded", "popularity_rank", "sales_count"]
ITEM_FEATURES = ["popularity_rank", "sales_count"]
#: Most boosting rounds of a ranker, and the rounds without a better validation NDCG that end its training.
ROUNDS, PATIENCE = 500, 30


# --------------------------------------------------------------------------- dataset 28-33
def ranking_user_sample(tx: DataFrame, sample_users: int | None = 10000, window_days: int = 28,
                        seed: int | str = 42) -> DataFrame:
    """Key 28: ``sample_users`` users active in the window, in md5(id || seed) order (repeatable); None: all."""
    users = trailing_window(tx.select("customer_id", "t_dat"), window_days).select("customer_id").distinct()
    if sample_users is None:
        return users
    keyed = users.select("customer_id", hash_key("customer_id", seed=seed).alias("_h"))
    return top_k_list(keyed, [F.col("_h").asc(), F.col("customer_id").asc()], sample_users).select("customer_id")


def ranking_positives(tx: DataFrame, sampled: DataFrame, pos_per_user: int = 3, window_days: int = 28) -> DataFrame:
    """Key 29: each sampled user's last P rows (date desc, id asc); only users with exactly P."""
    recent = trailing_window(tx.select("customer_id", "article_id", "t_dat"), window_days)
    mine = recent.join(sampled.select("customer_id"), "customer_id", "left_semi")
    w = Window.partitionBy("customer_id").orderBy(F.col("t_dat").desc(), F.col("article_id").asc())
    last = mine.withColumn("rn", F.row_number().over(w).cast("long")).filter(F.col("rn") <= pos_per_user)
    full = last.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("customer_id")))
    return full.filter(F.col("_n") == pos_per_user).select("customer_id", "rn", "article_id",
                                                           F.lit(1).cast("int").alias("label"))


def ranking_negatives(tx: DataFrame, sampled: DataFrame, itf: DataFrame, pos_per_user: int = 3,
                      negative_per_user: int = 50, popularity_pool: int = 2000, window_days: int = 28,
                      seed: int | str = 42) -> DataFrame:
    """Key 30: per sampled user, ``negative_per_user * pos_per_user`` items from the popularity pool
    that the user did not buy in the window, in md5(user || item || seed) order.

    The pool is a parameter-sized list; it reaches every user as one array (scalar subquery), and only
    the kept items unfold."""
    n = int(negative_per_user) * int(pos_per_user)
    pool = popularity_candidates(itf, popularity_pool).agg(F.sort_array(F.collect_list("article_id"))).scalar()
    # a user's purchases as a set; the pool stays one constant array and never unfolds to users x pool rows. Sets of
    # strings are told apart by hash, and structs of strings are sorted by value: both cost no more than their length
    bought = (trailing_window(tx.select("customer_id", "article_id", "t_dat"), window_days)
              .join(sampled.select("customer_id"), "customer_id", "left_semi")
              .groupBy("customer_id").agg(F.collect_set("article_id").alias("bought")))
    rest = (sampled.select("customer_id").join(bought, "customer_id", "left")
            .select("customer_id", F.array_except(pool, F.coalesce("bought", F.array().cast("array<string>"))).alias("rest")))
    hashed = F.transform("rest", lambda x: F.struct(
        F.md5(F.concat(F.col("customer_id").cast("string"), x, F.lit(str(seed)))).alias("h"), x.alias("article_id")))
    return (rest.select("customer_id", F.inline(F.slice(F.sort_array(hashed), 1, n)))
                .select("customer_id", "article_id", F.lit(0).cast("int").alias("label")))


def ranking_dataset(tx: DataFrame, uf: DataFrame, itf: DataFrame, sample_users: int | None = 10000,
                    pos_per_user: int = 3, negative_per_user: int = 50, window_days: int = 28,
                    popularity_pool: int = 2000, seed: int | str = 42) -> DataFrame:
    """Key 31: positives ∪ negatives, inner-joined to user and item features."""
    sampled = ranking_user_sample(tx, sample_users, window_days, seed)
    pos = ranking_positives(tx, sampled, pos_per_user, window_days).select("customer_id", "article_id", "label")
    neg = ranking_negatives(tx, sampled, itf, pos_per_user, negative_per_user, popularity_pool, window_days, seed)
    s = pos.unionByName(neg)
    u = uf.select("customer_id", "purchase_count", "recency",
                  frequency_encoded(F.col("purchase_frequency")).alias("purchase_frequency_encoded"))
    i = itf.select("article_id", "popularity_rank", "sales_count")
    return s.join(u, "customer_id").join(i, "article_id").select(
        "customer_id", "article_id", "label", "purchase_count", "recency", "purchase_frequency_encoded",
        "popularity_rank", "sales_count")


def ranking_group_sizes(ds: DataFrame) -> DataFrame:
    """Key 32: rows, positives and negatives per user (the groups of the ranking objective)."""
    return ds.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.sum(F.col("label").cast("long")).alias("n_pos"),
                                         F.sum((1 - F.col("label")).cast("long")).alias("n_neg"))


def user_train_val_split(ds: DataFrame, val_ratio: float = 0.2, seed: int | str = 42) -> DataFrame:
    """Key 33: whole users to validation: the first ``int(val_ratio * n_users)`` in md5(id || seed) order."""
    users = ds.select("customer_id").distinct().withColumn("_h", hash_key("customer_id", seed=seed))
    ranked = global_row_number(users, [F.col("_h").asc(), F.col("customer_id").asc()], "_r", total="_n")
    n_val = F.floor(F.col("_n") * F.lit(float(val_ratio)))
    return ranked.select("customer_id", F.when(F.col("_r") <= n_val, "val").otherwise("train").alias("split"))


# --------------------------------------------------------------------------- models 34-37
def score_with_model(df: DataFrame, model: TreeModel = SAVED_RANKER, out: str = "score") -> DataFrame:
    """Key 36 core: add the model score as a Catalyst expression (whole-stage codegen, no UDF)."""
    return df.withColumn(out, tree_score(model, FEATURES))


def tree_model_score(ds: DataFrame, model: TreeModel = SAVED_RANKER) -> DataFrame:
    """Key 36: one score per (user, item) of the ranking dataset."""
    rows = ds.select("customer_id", "article_id", *FEATURES).distinct()
    return score_with_model(rows, model).select("customer_id", "article_id", "score")


def train_ranker(ds: DataFrame, split: DataFrame, max_iter: int = ROUNDS, max_depth: int = 4, k_values: list[int] = [5, 10, 20],
                 objective: str = "pairwise", rate: float = 0.1) -> tuple[TreeModel, DataFrame]:
    """Key 34: boosted trees on the 5 features with a pairwise (or pointwise) loss, stopped when PATIENCE rounds bring no
    better NDCG@10 on the validation users. Returns the model and its metrics on those users (model, metric, value), beside
    those of the popularity order. Without validation users all rounds are trained and the metrics are empty."""
    booster = boost(ds, split, FEATURES, Params(objective=objective, rounds=max_iter, patience=PATIENCE, depth=max_depth, rate=rate))
    model = booster.model()
    return model, ranker_report(model, ds, split, k_values, objective)


def ranker_report(model: TreeModel, ds: DataFrame, split: DataFrame, k_values: list[int] = [5, 10, 20], name: str = "pairwise") -> DataFrame:
    """A ranker's metrics on the validation users beside those of the popularity order: model, metric, value."""
    val = ds.join(split.filter("split = 'val'").select("customer_id"), "customer_id", "left_semi")
    return ranker_metrics(score_with_model(val, model), k_values, name).unionByName(
        ranker_metrics(val.withColumn("score", -F.coalesce(F.col("popularity_rank").cast("double"), F.lit(float("inf")))), k_values, "popularity"))


def ranker_metrics(scored: DataFrame, k_values: list[int], name: str) -> DataFrame:
    from basketry.operators.metrics import evaluate_ranking
    return evaluate_ranking(scored, k_values).select(F.lit(name).alias("model"), F.concat("metric", F.lit("@"), F.col("k").cast("string")).alias("metric"), "value")


def tune_ranker(ds: DataFrame, split: DataFrame, grid: dict | None = None, rounds: int = 10, objective: str = "pairwise") -> DataFrame:
    """Key 35: successive halving over boosting parameters on the same user split, by validation NDCG@10.

    Every point of the grid trains ``rounds`` rounds and the better half goes on; nothing is fitted twice. Columns: params,
    ndcg_10 (at the point's best round), rounds (trained)."""
    grid = grid or {"depth": [3, 5], "rate": [0.05, 0.1]}
    points = successive_halving(ds, split, FEATURES, grid, rounds, Params(objective=objective, patience=PATIENCE))
    rows = [(",".join(f"{k}={v}" for k, v in p.items()), b.best(), len(b.trees)) for p, b in points]
    return ds.sparkSession.createDataFrame(rows, "params string, ndcg_10 double, rounds int")


def feature_importance(nodes: DataFrame, feature_names: list[str] = FEATURES) -> DataFrame:
    """Key 37: total gain and number of splits of each feature, from a model's node table; 0 for one without a split."""
    splits = nodes.filter("tree >= 0 AND feature IS NOT NULL").groupBy("feature").agg(
        F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("n_splits"))
    names = nodes.sparkSession.createDataFrame([(f,) for f in feature_names], "feature string")
    return names.join(F.broadcast(splits), "feature", "left").select(
        "feature", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("n_splits", F.lit(0)).cast("long").alias("n_splits"))


# --------------------------------------------------------------------------- serving 38-40
def rerank_topk(candidates: DataFrame, uf: DataFrame, itf: DataFrame, top_k: int = 10,
                model: TreeModel | None = SAVED_RANKER) -> DataFrame:
    """Key 38: join each user's candidates (customer_id, pos, article_id) to user and item features,
    drop candidates without item features, score with the model, keep top-k by (score desc, candidate
    position). Users whose candidates all lack features (or with no model) fall back to candidate order. Candidates that
    carry their item features are not joined to the items, so nothing is shuffled by item.
    Columns: customer_id, pos, article_id, score, fallback."""
    u = uf.select("customer_id", "purchase_count", "recency",
                  frequency_encoded(F.col("purchase_frequency")).alias("purchase_frequency_encoded"))
    carried = [x for x in ITEM_FEATURES if x in candidates.columns]
    c = candidates.select("customer_id", F.col("pos").alias("cand_pos"), "article_id", *carried)
    j = c.join(u, "customer_id", "left")
    if carried != ITEM_FEATURES:
        j = j.drop(*carried).join(itf.select("article_id", *ITEM_FEATURES), "article_id", "left")
    ok = F.col("popularity_rank").isNotNull() & F.col("sales_count").isNotNull() & F.col("purchase_count").isNotNull()
    j = j.withColumn("_ok", ok).withColumn("_any", F.max(F.col("_ok").cast("int")).over(Window.partitionBy("customer_id")))
    scored = j.withColumn("score", tree_score(model, FEATURES) if model is not None else F.lit(None).cast("double"))
    use_model = (F.col("_any") == 1) & F.lit(model is not None)
    # candidates without features are dropped, unless none has them (then the list is kept as is)
    ranked_rows = scored.filter((F.col("_any") == 0) | F.col("_ok"))
    w = Window.partitionBy("customer_id").orderBy(
        F.when(use_model, F.col("score")).desc_nulls_last(), F.col("cand_pos").asc())
    return (ranked_rows.withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= top_k)
                       .select("customer_id", "pos", "article_id",
                               F.when(use_model, F.col("score")).alias("score"), (~use_model).alias("fallback")))


def rerank_lists(lists: DataFrame, uf: DataFrame, top_k: int = 10, model: TreeModel | None = SAVED_RANKER) -> DataFrame:
    """Key 38 on one row per user: ``list`` has the candidates in order with their item features (``merged_lists``), and the
    result's ``list`` the rows of ``rerank_topk``: pos, article_id, score, fallback. A user's candidates stay one array, so
    a task scores and sorts one user at a time."""
    u = uf.select("customer_id", "purchase_count", "recency",
                  frequency_encoded(F.col("purchase_frequency")).alias("purchase_frequency_encoded"))
    ok = lambda x: x["popularity_rank"].isNotNull() & x["sales_count"].isNotNull() & F.col("purchase_count").isNotNull()
    j = lists.join(u, "customer_id", "left").withColumn("known", F.filter("list", ok))
    value = lambda x: [x[c] if c in ITEM_FEATURES else F.col(c) for c in FEATURES]
    entry = lambda key: lambda x: F.struct(key(x).alias("key"), x["pos"].alias("cand_pos"), x["article_id"].alias("article_id"))
    in_order = lambda x: F.lit(None).cast("double")
    by_score = in_order if model is None else lambda x: -tree_score(model, value(x))
    # candidates without features are dropped, unless none has them (then the list is kept as is)
    any_known = F.size("known") > 0
    ranked = F.sort_array(F.when(any_known, F.transform("known", entry(by_score))).otherwise(F.transform("list", entry(in_order))))
    fallback = ~(any_known & F.lit(model is not None))
    return j.select("customer_id", F.transform(F.slice(ranked, 1, int(top_k)), lambda x, i: F.struct(
        (i + 1).cast("long").alias("pos"), x["article_id"].alias("article_id"), (-x["key"]).alias("score"), fallback.alias("fallback"))).alias("list"))


def recommend(users: DataFrame, tx: DataFrame, uf: DataFrame, itf: DataFrame, articles: DataFrame,
              segments: DataFrame, top_k: int = 10, candidate_k: int = 300, cf_window_days: int = 28,
              model: TreeModel | None = SAVED_RANKER, cooc: DataFrame | None = None) -> DataFrame:
    """Key 39: active users → fused candidates + model rerank (``cf_ranker``); everyone else →
    popularity/recency/category blend (``enhanced_fallback``). Both branches are plans over all users; each is built
    once, as one list per user that the users are joined to, and unfolds last. A user with an empty list has one row with
    NULL pos and article_id and ``fallback`` true. Columns: customer_id, pos, article_id, score, segment, strategy, fallback."""
    parts = user_parts(users, users.count() * LIST_ROWS)
    u = dealt(users.select("customer_id"), parts, "customer_id").distinct() if parts else users.select("customer_id").distinct()
    segs = u.join(segments.select("customer_id", "segment"), "customer_id", "left").select(
        "customer_id", F.coalesce(F.col("segment"), F.lit(LOW_ACTIVITY)).alias("segment"))
    active, low = (segs.filter(c) for c in (F.col("segment") == ACTIVE, F.col("segment") != ACTIVE))
    cfw = cf_window(tx, cf_window_days)
    a = rerank_lists(merged_lists(active, cfw, itf, total_k=candidate_k, cooc=cooc, carry=tuple(ITEM_FEATURES), parts=parts), uf, top_k, model)
    # a null id has no list; with equal numbers of partitions one task would run the operators of both branches
    b = low_activity_lists(low, cfw, itf, articles, total_k=top_k, keep=("segment",), parts=parts and parts + 1).select("customer_id", "segment", F.when(
        F.col("customer_id").isNotNull(), F.transform("list", lambda x: F.struct(
            x["pos"].alias("pos"), x["article_id"].alias("article_id"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("fallback")))).alias("list"))

    def answered(lists: DataFrame, listed: str, strategy: str) -> DataFrame:
        return lists.select("customer_id", "segment", F.inline_outer("list")).select(
            "customer_id", "pos", "article_id", "score", F.when(F.col("pos").isNotNull(), listed).otherwise(F.col("segment")).alias("segment"),
            F.lit(strategy).alias("strategy"), F.coalesce("fallback", F.lit(True)).alias("fallback"))

    return answered(a.withColumn("segment", F.lit(ACTIVE)), ACTIVE, "cf_ranker").unionByName(answered(b, LOW_ACTIVITY, "enhanced_fallback"))


def batch_recommend(recs: DataFrame, sampled: DataFrame) -> DataFrame:
    """Key 40: over a user sample, users with a non-empty list (success), without (failed), and items."""
    per = sampled.select("customer_id").distinct().join(
        recs.groupBy("customer_id").agg(F.count("article_id").alias("_n")), "customer_id", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return per.agg(F.count(F.lit(1)).alias("n_users"), F.count(F.when(n > 0, 1)).alias("n_success"),
                   F.count(F.when(n == 0, 1)).alias("n_failed"), F.sum(n).cast("long").alias("n_recommendations"))


def experiment_arms(assigned: DataFrame, itf: DataFrame, recs: DataFrame, top_n: int = 10) -> DataFrame:
    """Key 61: items shown per user: A = the top-n popularity list, B = the user's recommendations.
    Columns: customer_id, grp, num_items, segment, strategy."""
    n_pop = popularity_candidates(itf, top_n).select(F.count(F.lit(1))).scalar()
    a = assigned.filter(F.col("grp") == "A").select(
        "customer_id", "grp", n_pop.cast("long").alias("num_items"),
        F.lit(None).cast("string").alias("segment"), F.lit(None).cast("string").alias("strategy"))
    per = recs.groupBy("customer_id").agg(F.count("article_id").alias("num_items"),
                                          F.first("segment").alias("segment"), F.first("strategy").alias("strategy"))
    b = (assigned.filter(F.col("grp") == "B").join(per, "customer_id", "left")
                 .select("customer_id", "grp", F.coalesce(F.col("num_items"), F.lit(0)).cast("long").alias("num_items"),
                         "segment", "strategy"))
    return a.unionByName(b)
