"""Candidate generation for all users at once: popularity, category, trending, item-to-item
co-purchase with time decay, and reciprocal-rank fusion.

Plan shapes (see README, "Scale"):

* Popularity, trending and category lists are global top-k lists whose size is a parameter, so they
  are small by construction. They reach each user as one array built by a scalar subquery and
  ``explode`` (a Generate, no join and no shuffle), never as a cross join of tables.
* The co-purchase matrix does not depend on the user: for a user u, seed s and candidate k the score is
  ``W_u(s) * C(s, k)`` where ``C`` sums time-decayed same-basket co-purchases over all customers. ``C``
  is built once from per-(customer, day, item) counts, pruned to the top N per seed, and then joined
  to every user's seeds: at most ``recent_items * cooc_top_per_seed`` rows per user.
* Baskets with many distinct items are split by a salt on the seed side and the matching rows are
  replicated once per salt, so no task has to emit every pair of a huge basket on its own.
* Per-user top-k uses ``row_number() <= k`` over ``partitionBy(user)``, which Spark plans as a
  ``WindowGroupLimit`` before the shuffle, so a heavy user sends at most k rows per task.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.order import top_k_list
from basketry.functions.windows import max_date, significant, trailing_window
from basketry.session import ensure_checkpoint_dir

NULL_RANK = 1e12  # score of an item without a rank: 1 / (1 + 1e12)
BASKET_SPLIT = 512  # distinct items per basket handled by one join key
# Most rows that a task holds on average, whatever the size of the tables; as many tasks' rows are left to the session; rows
# that a user's list and a purchase's pairs count for.
TASK_ROWS, FEW_TASKS, LIST_ROWS, PAIR_ROWS = 250_000, 16, 16, 4


def cf_window(tx: DataFrame, cf_window_days: int = 28) -> DataFrame:
    """Key 15: rows with ``t_dat >= max - cf_window_days`` (duplicates kept).

    The window carries its end date as a constant column ``dmax`` (the same scalar subquery that
    defines the window, evaluated once), so seeds, decay and trending need no further max, and its length as ``span``."""
    dmax = max_date(tx)
    return trailing_window(tx.select("customer_id", "article_id", "t_dat"), cf_window_days, dmax=dmax).withColumns(
        {"dmax": dmax, "span": F.lit(int(cf_window_days))})


def _window_end(cfw: DataFrame) -> Column:
    return F.col("dmax") if "dmax" in cfw.columns else max_date(cfw)


def rank_score(rank: Column) -> Column:
    r = F.coalesce(rank.cast("double"), F.lit(NULL_RANK))
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(r, F.lit(0.0)))


def popularity_candidates(itf: DataFrame, top_k: int = 50) -> DataFrame:
    """Key 16: top-k ids by rank ascending (NULLs last), id ascending."""
    return top_k_list(itf.select("article_id", "popularity_rank"),
                      [F.col("popularity_rank").asc_nulls_last(), F.col("article_id").asc()], top_k
                      ).select("pos", "article_id")


def popularity_scored(itf: DataFrame, top_k: int = 50) -> DataFrame:
    """Key 17: same list with score ``1 / (1 + max(rank, 0))``."""
    return top_k_list(itf.select("article_id", "popularity_rank"),
                      [F.col("popularity_rank").asc_nulls_last(), F.col("article_id").asc()], top_k
                      ).select("pos", "article_id", rank_score(F.col("popularity_rank")).alias("score"))


def category_scored(itf: DataFrame, articles: DataFrame, top_k: int = 50,
                    category_col: str = "product_group_name") -> DataFrame:
    """Key 18: per category, its top-k items by global popularity (every category at once)."""
    j = itf.select("article_id", "popularity_rank").join(
        articles.select("article_id", F.col(category_col).alias("category")), "article_id")
    w = Window.partitionBy("category").orderBy(F.col("popularity_rank").asc_nulls_last(), F.col("article_id").asc())
    return (j.withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= top_k)
             .select("category", "pos", "article_id", rank_score(F.col("popularity_rank")).alias("score")))


def decay(days: Column, half_life_days: int) -> Column:
    """``0.5 ** (days / half_life)``, one rule for every age."""
    return F.pow(F.lit(0.5), days.cast("double") / F.lit(float(max(int(half_life_days), 1))))


#: Bits of a decay weight below one half-life, and the most halvings at which a weight keeps all of them.
DECAY_BITS, MOST_HALVINGS = 40, 62


def _halvings(cfw: DataFrame, half_life_days: int) -> Column:
    """Whole half-lives in the window (at most MOST_HALVINGS): the scale of ``decay_units`` is 2^(DECAY_BITS + this)."""
    span = F.col("span") if "span" in cfw.columns else cfw.select(F.datediff(_window_end(cfw), F.min("t_dat"))).scalar()
    return F.least(F.floor(span / F.lit(max(int(half_life_days), 1))).cast("int"), F.lit(MOST_HALVINGS))


def decay_units(days: Column, half_life_days: int, halvings: Column) -> Column:
    """``decay`` as a whole number (decimal) of units: sums of it are exact in any order, and ages that lie whole half-lives
    apart weigh exact powers of two. The fraction of a half-life has DECAY_BITS bits."""
    hl = max(int(half_life_days), 1)
    part = F.round(F.pow(F.lit(0.5), (days % hl).cast("double") / F.lit(float(hl))) * F.lit(2.0 ** DECAY_BITS)).cast("long")
    shift = (halvings - F.floor(days / F.lit(hl))).cast("int")
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(shift, F.lit(0)))
    late = F.call_function("shiftright", part, F.least(-shift, F.lit(63)))
    return F.when(shift >= 0, part.cast("decimal(19,0)") * power.cast("decimal(19,0)")).otherwise(late.cast("decimal(38,0)"))


def from_units(units: Column, halvings: Column) -> Column:
    """Units as a double, rounded once."""
    return units.cast("double") / F.pow(F.lit(2.0), F.lit(DECAY_BITS) + halvings)


def recent_seeds(cfw: DataFrame, recent_items: int = 10, half_life_days: int = 14) -> DataFrame:
    """Key 19: each user's last N purchase rows (date desc, id asc) with weight 0.5^(age/half_life)."""
    age = F.datediff(_window_end(cfw), F.col("t_dat"))
    return _last_rows(cfw, recent_items).select("customer_id", "rnk", F.col("article_id").alias("seed_item"),
                                                F.col("t_dat").alias("seed_date"), decay(age, half_life_days).alias("w_seed"))


def _last_rows(cfw: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("customer_id").orderBy(F.col("t_dat").desc(), F.col("article_id").asc())
    return cfw.withColumn("rnk", F.row_number().over(w).cast("long")).filter(F.col("rnk") <= n)


def _seed_weights(cfw: DataFrame, recent_items: int, half_life_days: int) -> DataFrame:
    """(customer_id, seed_item, w, nth): a user's seeds with the exact sum of their rows' weights, numbered by id."""
    halvings = _halvings(cfw, half_life_days)
    units = decay_units(F.datediff(_window_end(cfw), F.col("t_dat")), half_life_days, halvings)
    seeds = _last_rows(cfw, recent_items).groupBy("customer_id", F.col("article_id").alias("seed_item")).agg(
        F.sum(units).alias("units"), F.first(halvings).alias("halvings"))
    nth = F.row_number().over(Window.partitionBy("customer_id").orderBy("seed_item"))
    return seeds.select("customer_id", "seed_item", from_units(F.col("units"), F.col("halvings")).alias("w"), nth.alias("nth"))


def _basket_counts(cfw: DataFrame) -> DataFrame:
    """(customer, day, item) row counts, with the day's age in days (a function of the day) and the window's halvings."""
    age = F.datediff(_window_end(cfw), F.col("t_dat"))
    return cfw.groupBy("customer_id", "t_dat", "article_id", age.alias("age"), "_halvings").agg(F.count(F.lit(1)).alias("m"))


def item_cooccurrence(cfw: DataFrame, cooc_same_day_only: bool = True, cooc_max_day_gap: int = 3,
                      cooc_top_per_seed: int = 200, half_life_days: int = 14,
                      basket_split: int = BASKET_SPLIT) -> DataFrame:
    """Key 20: ``C(seed, cand)`` = sum over same-customer row pairs (seed row, cand row, cand != seed)
    on the same day (or within ±gap days) of ``0.5^(age(cand row)/half_life)``; top N per seed by
    score desc, cand asc. Columns: seed_item, cand_item, score, rr.

    Scores are exact sums of whole units, divided once, and rank unrounded: equal sums tie whatever the order in which
    they were added. A basket with many items is split on both sides, so a task meets at most ``basket_split`` seeds and
    about as many candidates of one basket."""
    halvings = _halvings(cfw, half_life_days)
    m = _basket_counts(cfw.withColumn("_halvings", halvings)).withColumn("_w", decay_units(F.col("age"), half_life_days, F.col("_halvings")))
    gap = 0 if cooc_same_day_only else max(int(cooc_max_day_gap), 0)
    # parts of a basket: its own items on one side, the items of all days it meets on the other
    sizes = m.groupBy("customer_id", "t_dat").agg(F.count(F.lit(1)).alias("n_items"))
    days = F.sequence(F.lit(-gap), F.lit(gap))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(float(basket_split)))).cast("int")
    if gap > 0:
        met = (sizes.withColumn("d1", F.explode(F.transform(days, lambda o: F.date_add("t_dat", o))))
                    .groupBy("customer_id", "d1").agg(F.sum("n_items").alias("met")))
        sizes = sizes.select("customer_id", F.col("t_dat").alias("d1"), "n_items").join(met, ["customer_id", "d1"])
    else:
        sizes = sizes.select("customer_id", F.col("t_dat").alias("d1"), "n_items", F.col("n_items").alias("met"))
    sizes = sizes.select("customer_id", "d1", parts(F.col("n_items")).alias("n1"), parts(F.col("met")).alias("n2"))
    part = lambda item, n: F.pmod(F.xxhash64(item), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (m.select("customer_id", F.col("t_dat").alias("d1"), F.col("article_id").alias("seed_item"),
                     F.col("m").alias("m_seed"))
              .join(sizes, ["customer_id", "d1"])
              .withColumn("p1", part("seed_item", "n1")).withColumn("p2", every("n2")).drop("n1", "n2"))
    right = m.select("customer_id", F.col("t_dat").alias("d2"), F.col("article_id").alias("cand_item"),
                     (F.col("m").cast("decimal(19,0)") * F.col("_w")).cast("decimal(38,0)").alias("w_cand"), F.col("_halvings").alias("halvings"))
    right = (right.withColumn("d1", F.explode(F.transform(days, lambda o: F.date_add("d2", o)))) if gap > 0
             else right.withColumn("d1", F.col("d2")))
    right = (right.join(sizes, ["customer_id", "d1"])
                  .withColumn("p2", part("cand_item", "n2")).withColumn("p1", every("n1")).drop("n1", "n2"))
    keys, n = ["customer_id", "d1", "p1", "p2"], user_parts(cfw, cfw.count() * PAIR_ROWS)
    if n:
        left, right = dealt(left, n, *keys), dealt(right, n, *keys)
    pairs = (left.join(right, keys)
                 .filter(F.col("seed_item") != F.col("cand_item"))
                 .select("seed_item", "cand_item", (F.col("w_cand") * F.col("m_seed").cast("decimal(19,0)")).cast("decimal(38,0)").alias("units"),
                         "halvings"))
    c = pairs.groupBy("seed_item", "cand_item").agg(F.sum("units").alias("units"), F.first("halvings").alias("halvings"))
    w = Window.partitionBy("seed_item").orderBy(F.col("units").desc(), F.col("cand_item").asc())
    return (c.withColumn("rr", F.row_number().over(w).cast("long")).filter(F.col("rr") <= cooc_top_per_seed)
             .select("seed_item", "cand_item", from_units(F.col("units"), F.col("halvings")).alias("score"), "rr"))


def user_parts(df: DataFrame, rows: float) -> int:
    """Partitions for so many rows; 0 leaves a few tasks' rows to the session, which coalesces them. Else never fewer than the
    session's, so that a later join by the same key deals nothing out again."""
    n = ceil(rows / TASK_ROWS)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n) if n > FEW_TASKS else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys``. A number that is asked for is not coalesced, so a task's share stays the same as tables grow."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def _gain_rows(mine: DataFrame, cooc: DataFrame) -> float:
    """Rows of seeds × matrix or more: an item's purchase rows times the length of its list. One aggregate by item."""
    times = mine.groupBy(F.col("article_id").alias("seed_item")).agg(F.count(F.lit(1)).alias("n"))
    lengths = cooc.groupBy("seed_item").agg(F.count(F.lit(1)).alias("m"))
    return times.join(lengths, "seed_item").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0


def cf_candidates(cfw: DataFrame, itf: DataFrame, top_k: int = 50, recent_items: int = 10,
                  cooc_top_per_seed: int = 200, half_life_days: int = 14, popularity_penalty_alpha: float = 0.20,
                  exclude_already_purchased: bool = True, cooc_same_day_only: bool = True,
                  cooc_max_day_gap: int = 3, cooc: DataFrame | None = None, users: DataFrame | None = None,
                  carry: tuple[str, ...] = (), parts: int = 0) -> DataFrame:
    """Key 21: per user, sum over seeds of pruned co-purchase scores × seed weight, divided by
    ``1 + alpha * ln(1 + rank)`` when the item is ranked; already-bought items dropped; top-k by
    score desc, id asc. Columns: customer_id, pos, article_id, score_cf.

    The products of a user's seeds are added in the order of the seeds' ids, so the sum is one number whatever the
    partitions; it ranks unrounded and is reported with about ten digits. The penalty depends on the item alone, so it
    joins the matrix (items × list rows), not the users × list rows. ``users`` restricts the work to them; the matrix still counts all customers.
    The matrix is read twice (its list lengths set the number of tasks, ``parts`` at least), so one that is not given is stored first."""
    if cooc is None:
        ensure_checkpoint_dir(cfw.sparkSession)
        cooc = item_cooccurrence(cfw, cooc_same_day_only, cooc_max_day_gap, cooc_top_per_seed, half_life_days).checkpoint(eager=True)
    mine = cfw if users is None else cfw.join(users.select("customer_id"), "customer_id", "left_semi")
    wsum = _seed_weights(mine, recent_items, half_life_days)
    rank = F.col("popularity_rank").cast("double")
    pen = F.lit(1.0) + F.lit(float(popularity_penalty_alpha)) * F.log(F.lit(1.0) + rank)
    items = itf.select(F.col("article_id").alias("cand_item"), *dict.fromkeys(("popularity_rank", *carry)))
    matrix = cooc.select("seed_item", "cand_item", "score").join(items, "cand_item", "left").select(
        "seed_item", F.col("cand_item").alias("article_id"), (F.col("score") / F.coalesce(pen, F.lit(1.0))).alias("gain"), *carry)
    # one column for each seed (at most ``recent_items``), so that the order of the additions is fixed
    by_seed = [F.max(F.when(F.col("nth") == i, F.col("gain"))).alias(f"_s{i}") for i in range(1, int(recent_items) + 1)]
    total = reduce(add, [F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(1, int(recent_items) + 1)], F.lit(0.0))
    # narrow rows are dealt out by user once: sums, items already bought and the top-k all need nothing else
    gains = wsum.join(matrix, "seed_item").select("customer_id", "article_id", "nth", (F.col("w") * F.col("gain")).alias("gain"), *carry)
    no_item = [F.lit(None).cast(t).alias(c) for c, t in gains.dtypes if c not in ("customer_id", "article_id")]
    own = F.lit(False)
    if exclude_already_purchased:
        bought = mine.filter("customer_id IS NOT NULL AND article_id IS NOT NULL").select("customer_id", "article_id").distinct()
        gains = gains.unionByName(bought.select("customer_id", "article_id", *no_item))
        own = F.max(F.col("nth").isNull())
    scored = dealt(gains, max(parts, user_parts(mine, _gain_rows(mine, cooc))), "customer_id").groupBy("customer_id", "article_id").agg(
        *by_seed, own.alias("_own"), *[F.max(c).alias(c) for c in carry]).filter(~F.col("_own")).select(
        "customer_id", "article_id", total.alias("score_cf"), *carry)
    w = Window.partitionBy("customer_id").orderBy(F.col("score_cf").desc(), F.col("article_id").asc())
    return (scored.withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= top_k)
                  .select("customer_id", "pos", "article_id", significant(F.col("score_cf"), 20).alias("score_cf"), *carry))


def rrf(pos: Column, k: int = 60) -> Column:
    """Reciprocal rank fusion weight of a 1-based list position."""
    return F.lit(1.0) / (F.lit(float(k)) + pos.cast("double"))


def rrf_scores(ordered: DataFrame, k: int = 60, source: str | None = None) -> DataFrame:
    """Key 22: ``1 / (k + pos)`` for an ordered list (``pos`` from 1)."""
    out = ordered.withColumn("rrf", rrf(F.col("pos"), k))
    return out.withColumn("source", F.lit(source)) if source is not None else out


def list_array(lst: DataFrame, fields: list[str]) -> Column:
    """A bounded list (a parameter-sized top-k) as one array value, computed once as a scalar subquery."""
    return lst.agg(F.array_sort(F.collect_list(F.struct(*fields)))).scalar()


def merged_candidates(users: DataFrame, cfw: DataFrame, itf: DataFrame, total_k: int = 100, pop_top: int = 200,
                      cf_top: int = 300, w_pop: float = 0.15, w_cf: float = 0.70, recent_items: int = 10,
                      cooc_top_per_seed: int = 200, half_life_days: int = 14,
                      popularity_penalty_alpha: float = 0.20, fallback_pop_expand: int = 1000, rrf_k: int = 60,
                      cooc_same_day_only: bool = True, cooc_max_day_gap: int = 0,
                      cf: DataFrame | None = None, cooc: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Key 23: per user, fuse the popularity list (``pop_top``) and the user's CF list (``cf_top``) by
    reciprocal rank; if the union is smaller than ``total_k`` fill from the expanded popularity list in
    order; sort by (final, cf, pop, id) all descending; keep ``total_k``. ``carry`` names number columns of ``itf`` that
    travel inside the lists, so a reader need not join users × list rows with the items (a given ``cf`` must have them).
    Columns: customer_id, pos, article_id, final_score, cf_rrf, pop_rrf, and those carried."""
    lists = merged_lists(users, cfw, itf, total_k, pop_top, cf_top, w_pop, w_cf, recent_items, cooc_top_per_seed, half_life_days,
                         popularity_penalty_alpha, fallback_pop_expand, rrf_k, cooc_same_day_only, cooc_max_day_gap, cf, cooc, carry)
    return lists.select("customer_id", F.inline("list"))


def merged_lists(users: DataFrame, cfw: DataFrame, itf: DataFrame, total_k: int = 100, pop_top: int = 200,
                 cf_top: int = 300, w_pop: float = 0.15, w_cf: float = 0.70, recent_items: int = 10,
                 cooc_top_per_seed: int = 200, half_life_days: int = 14,
                 popularity_penalty_alpha: float = 0.20, fallback_pop_expand: int = 1000, rrf_k: int = 60,
                 cooc_same_day_only: bool = True, cooc_max_day_gap: int = 0,
                 cf: DataFrame | None = None, cooc: DataFrame | None = None, carry: tuple[str, ...] = (),
                 parts: int | None = None) -> DataFrame:
    """Key 23 as one row per user: customer_id and ``list``, an array of the rows of ``merged_candidates`` in order.

    CF rows get their place in the popularity list by a broadcast join and their scores before they become a list. The
    popularity list is one constant, scored once; a user takes the places that the own list lacks. So nothing is grouped or
    sorted as users × list rows: a task holds one user's list at a time, and users without a CF list share one constant. Users are dealt out to ``parts``
    partitions (by their number)."""
    parts = user_parts(users, users.count() * LIST_ROWS) if parts is None else parts
    spark_users = dealt(users.select("customer_id"), parts, "customer_id").distinct() if parts else users.select("customer_id").distinct()
    numbers = {c: F.col(c).cast("long").alias(c) for c in carry}
    if total_k <= 0:
        fields = ["pos:bigint", "article_id:string", "final_score:double", "cf_rrf:double", "pop_rrf:double", *[f"{c}:bigint" for c in carry]]
        return spark_users.select("customer_id", F.array().cast(f"array<struct<{','.join(fields)}>>").alias("list")).limit(0)
    # Every pop-list item is in the union, so a user lacks at most total_k - pop_top items, and at most
    # cf_top expansion items can be skipped (already in the CF list): positions beyond
    # total_k + cf_top can never be used. With total_k <= pop_top no fill is possible at all.
    need = int(pop_top) if int(total_k) <= int(pop_top) else int(total_k) + int(cf_top)
    expand = min(max(int(fallback_pop_expand), int(pop_top)), max(need, int(pop_top)))
    # bounded by the parameters, not by the data
    exp_list = top_k_list(itf.select("article_id", *dict.fromkeys(("popularity_rank", *carry))),
                          [F.col("popularity_rank").asc_nulls_last(), F.col("article_id").asc()], expand)
    same = Window.partitionBy("article_id")  # an item listed twice counts at its first place
    exp_list = exp_list.select("article_id", "pos", F.min("pos").over(same).alias("e_pos"),
                               *[F.max(x).over(same).alias(c) for c, x in numbers.items()])
    if cf is None:
        cf = cf_candidates(cfw, itf, cf_top, recent_items, cooc_top_per_seed, half_life_days,
                           popularity_penalty_alpha, True, cooc_same_day_only, cooc_max_day_gap, cooc, spark_users, carry, parts)
    else:
        cf = cf.groupBy("customer_id", "article_id").agg(F.min("pos").alias("pos"), *[F.max(c).alias(c) for c in carry])

    def scored(cf_rrf: Column, pop_rrf: Column, more: list[Column]) -> Column:
        """An entry; entries sort by their fields in this order."""
        return F.struct((F.lit(float(w_pop)) * pop_rrf + F.lit(float(w_cf)) * cf_rrf).alias("final_score"), cf_rrf.alias("cf_rrf"),
                        pop_rrf.alias("pop_rrf"), F.col("article_id"), *more)

    none = F.lit(0.0)
    in_pop = F.col("e_pos") <= int(pop_top)
    fields = ["final_score", "cf_rrf", "pop_rrf", "article_id", *carry]
    listed = lambda x, i: F.struct((i + 1).cast("long").alias("pos"), *[x[c].alias(c) for c in
                                                                        ["article_id", "final_score", "cf_rrf", "pop_rrf", *carry]])

    def fused(own: Column, taken: Column, taken_in_pop: Column, entries: Column, places: Column, in_union: Column) -> Column:
        # the places not in the own list: those of the pop list, and then as many as the union is short of total_k
        most = F.greatest(in_union - taken_in_pop, F.lit(int(total_k)) - F.size(own)).cast("int")
        if w_pop >= 0 and rrf_k >= 0:  # later places score less, so no more than total_k of them can stay
            most = F.least(most, F.lit(int(total_k)))
        rest = F.transform(F.slice(F.array_except(places, taken), F.lit(1), most), lambda p: F.element_at(entries, p.cast("int")))
        return F.transform(F.slice(F.sort_array(F.concat(own, rest), False), 1, int(total_k)), listed)

    first = F.col("pos") == F.col("e_pos")
    pop = exp_list.select("pos", "e_pos", scored(none, rrf(F.col("e_pos"), rrf_k), list(map(F.col, carry))).alias("entry")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("by_pos"), F.array_sort(F.collect_list(F.when(first, F.col("e_pos")))).alias("places"),
        F.count(F.when(first & in_pop, 1)).alias("in_union")).select(
        F.transform("by_pos", lambda x: x["entry"]).alias("entries"), "places", "in_union")
    nothing = F.array().cast("array<struct<" + ",".join([f"{c}:{'string' if c == 'article_id' else 'bigint' if c in carry else 'double'}" for c in fields]) + ">>")
    no_places = F.array().cast("array<bigint>")
    pop = pop.select(F.struct("entries", "places", "in_union", fused(nothing, no_places, F.lit(0), F.col("entries"), F.col("places"), F.col("in_union")).alias("alone"))).scalar()

    place = exp_list.filter(first).select(F.col("article_id").alias("_item"), "e_pos", *[F.col(c).alias(f"_{c}") for c in carry])
    mine = cf.join(F.broadcast(place), F.col("article_id").eqNullSafe(F.col("_item")), "left")
    mine = mine.select("customer_id", "e_pos", scored(rrf(F.col("pos"), rrf_k), F.when(in_pop, rrf(F.col("e_pos"), rrf_k)).otherwise(none),
                                                      [F.greatest(x, F.col(f"_{c}")).alias(c) for c, x in numbers.items()]).alias("entry"))
    mine = mine.groupBy("customer_id").agg(F.collect_list("entry").alias("own"), F.collect_list("e_pos").alias("taken"),
                                           F.count(F.when(in_pop, 1)).alias("taken_in_pop"))
    merged = fused(F.col("own"), F.col("taken"), F.col("taken_in_pop"), F.col("pop.entries"), F.col("pop.places"), F.col("pop.in_union"))
    return spark_users.join(mine, "customer_id", "left").withColumn("pop", pop).select(
        "customer_id", F.when(F.col("own").isNull(), F.col("pop.alone")).otherwise(merged).alias("list"))


def trending_items(cfw: DataFrame, top_n: int = 200, recency_window_days: int = 30) -> DataFrame:
    """Key 24: inside the CF window, sales in the last N days; ``count / (1 + max count)``; top N by
    score desc, id asc. Columns: pos, article_id, recent_count, recency_score."""
    recent = trailing_window(cfw, recency_window_days, dmax=_window_end(cfw))
    counts = recent.groupBy("article_id").agg(F.count(F.lit(1)).alias("recent_count"))
    mx = counts.select(F.max("recent_count")).scalar()
    scored = counts.withColumn("recency_score", F.col("recent_count").cast("double") / (F.lit(1.0) + mx))
    return top_k_list(scored, [F.col("recency_score").desc(), F.col("article_id").asc()], top_n).select(
        "pos", "article_id", "recent_count", "recency_score")


def popularity_recency(itf: DataFrame, cfw: DataFrame, top_k: int = 100, recency_window_days: int = 30,
                       w_popularity: float = 0.6, w_recency: float = 0.4) -> DataFrame:
    """Key 25: full outer merge of popularity (2k) and trending (2k): ``w_pop*pop + w_rec*rec``,
    missing = 0; top-k by score desc, id asc. Columns: pos, article_id, score."""
    pop = popularity_scored(itf, 2 * top_k).select("article_id", F.col("score").alias("s_pop"))
    rec = trending_items(cfw, 2 * top_k, recency_window_days).select("article_id", F.col("recency_score").alias("s_rec"))
    both = pop.join(rec, "article_id", "full_outer")  # two lists of at most 2k rows each
    score = (F.lit(float(w_popularity)) * F.coalesce(F.col("s_pop"), F.lit(0.0))
             + F.lit(float(w_recency)) * F.coalesce(F.col("s_rec"), F.lit(0.0)))
    return top_k_list(both.select("article_id", score.alias("score")),
                      [F.col("score").desc(), F.col("article_id").asc()], top_k).select("pos", "article_id", "score")


def preferred_category(cfw: DataFrame, articles: DataFrame, limit: int = 10,
                       category_col: str = "product_group_name") -> DataFrame:
    """Key 26: most frequent category among each user's last ``limit`` rows (date desc, id asc);
    ties to the smaller category name. Columns: customer_id, product_group_name, cnt."""
    w = Window.partitionBy("customer_id").orderBy(F.col("t_dat").desc(), F.col("article_id").asc())
    last = cfw.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    counts = (last.join(articles.select("article_id", F.col(category_col).alias("cat")), "article_id")
                  .groupBy("customer_id", "cat").agg(F.count(F.lit(1)).alias("cnt")))
    w2 = Window.partitionBy("customer_id").orderBy(F.col("cnt").desc(), F.col("cat").asc())
    return (counts.withColumn("r", F.row_number().over(w2)).filter(F.col("r") == 1)
                  .select("customer_id", F.col("cat").alias(category_col), "cnt"))


def low_activity_candidates(users: DataFrame, cfw: DataFrame, itf: DataFrame, articles: DataFrame,
                            total_k: int = 100, recency_window_days: int = 30, w_popularity: float = 0.5,
                            w_recency: float = 0.2, w_category: float = 0.3,
                            category_col: str = "product_group_name") -> DataFrame:
    """Key 27: global trend list (``int(1.5 * total_k)`` items of key 25) plus the top ``total_k``
    items of the user's preferred category: ``trend + w_category * cat``; top ``total_k`` by score
    desc, id asc. Columns: customer_id, pos, article_id, score."""
    return low_activity_lists(users, cfw, itf, articles, total_k, recency_window_days, w_popularity, w_recency, w_category,
                              category_col).select("customer_id", F.inline("list"))


def low_activity_lists(users: DataFrame, cfw: DataFrame, itf: DataFrame, articles: DataFrame,
                       total_k: int = 100, recency_window_days: int = 30, w_popularity: float = 0.5,
                       w_recency: float = 0.2, w_category: float = 0.3,
                       category_col: str = "product_group_name", keep: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Key 27 as one row per user: customer_id, the columns of ``users`` named in ``keep`` and ``list``, an array of the rows
    of ``low_activity_candidates`` in order.

    A user's list depends on the preferred category alone, so lists are put together and ranked once per category, and
    users meet them whole; users without a category share the list of the trend alone. Users are dealt out to ``parts``
    partitions (by their number)."""
    parts = user_parts(users, users.count() * LIST_ROWS) if parts is None else parts
    u = users.select("customer_id", *keep)
    u = dealt(u, parts, "customer_id").distinct() if parts else u.distinct()
    if total_k <= 0:
        return u.select("customer_id", *keep, F.array().cast("array<struct<pos:bigint,article_id:string,score:double>>").alias("list")).limit(0)
    trend = popularity_recency(itf, cfw, int(total_k * 1.5), recency_window_days, w_popularity, w_recency)
    none = F.lit(None).cast("double")
    trend_part = list_array(trend.select("article_id", F.col("score").alias("s_trend"), none.alias("s_cat")),
                            ["article_id", "s_trend", "s_cat"])
    score = F.coalesce(F.col("s_trend"), F.lit(0.0)) + F.coalesce(F.col("s_cat"), F.lit(0.0)) * F.lit(float(w_category))

    def best(rows: DataFrame, *key: str) -> DataFrame:
        """Per key (or once without one), the list of its rows (article_id, s_trend, s_cat)."""
        comb = rows.groupBy(*key, "article_id").agg(F.max("s_trend").alias("s_trend"), F.max("s_cat").alias("s_cat")).select(*key, "article_id", score.alias("score"))
        ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "article_id", "score"))), 1, int(total_k))
        return comb.groupBy(*key).agg(F.transform(ranked, lambda x, i: F.struct(
            (i + 1).cast("long").alias("pos"), x["article_id"].alias("article_id"), x["score"].alias("score"))).alias("list"))

    cats = category_scored(itf, articles, total_k, category_col)  # categories × total_k rows
    cats = cats.groupBy(F.col("category").alias(category_col)).agg(F.collect_list(F.struct(
        "article_id", none.alias("s_trend"), F.col("score").alias("s_cat"))).alias("cat_list"))
    by_category = best(cats.select(category_col, F.inline(F.concat(trend_part, "cat_list"))), category_col)
    alone = best(trend.select("article_id", F.col("score").alias("s_trend"), none.alias("s_cat"))).scalar()
    pref = preferred_category(cfw.join(u, "customer_id", "left_semi"), articles, 10, category_col)
    return u.join(pref.join(by_category, category_col).select("customer_id", "list"), "customer_id", "left").select(
        "customer_id", *keep, F.coalesce("list", alone).alias("list"))
