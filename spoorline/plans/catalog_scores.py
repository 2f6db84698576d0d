"""Registered queries over scores: matching, ranking, metrics, calibration, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions.stats import rate as rate_of
from spoorline.functions.stats import wilson_interval as wilson_of
from spoorline.operators import decision, ranking, scorers, similarity
from spoorline.operators import metrics as mt
from spoorline.plans.registry import query, r6, rounded
from spoorline.session import durable
from spoorline.sources.adapters import table, view

Z = 1.959963984540054
THRESHOLD = 0.6
GALLERY_SIDES = 50


def gallery(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "features_v").filter("k < 6").select(
        F.col("image_id").alias("gallery_id"), "side_id", "vector"
    )


def queries_of(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "features_v").filter("k >= 6").select(
        F.col("image_id").alias("query_id"), "vector", F.col("side_id").alias("truth")
    )


DENSE = """dense as (select q.image_id as query_id, g.image_id as gallery_id, g.side_id,
    list_dot_product(q.vector, g.vector) as score, q.side_id as truth
  from features_v q join features_v g on q.k >= 6 and g.k < 6)"""
MATCHED = f"""with {DENSE},
  best as (select query_id, side_id, truth, max(score) as score from dense group by 1, 2, 3),
  ranked as (select *, row_number() over (partition by query_id order by score desc, side_id) as rank
    from best),
  answers as (select query_id, rank from ranked where side_id = truth)"""


@query(
    "similarity_join",
    f"with {DENSE} select query_id, gallery_id, side_id, round(score, 6) as score from dense",
)
def similarity_join(spark, sf):
    return rounded(similarity.similarity_join(queries_of(spark, sf), gallery(spark, sf)))


@query(
    "evaluate_retrieval",
    MATCHED
    + """ select cast(count(*) as bigint) as n, round(avg(1.0 / rank), 6) as mrr,
  cast(count(*) filter (where rank <= 1) as bigint) as top1_count,
  cast(count(*) filter (where rank <= 3) as bigint) as top3_count,
  cast(count(*) filter (where rank <= 5) as bigint) as top5_count from answers""",
)
def evaluate_retrieval(spark, sf):
    """Vectors to closed-set metrics through block ranking, the flagship flow."""
    ranked = similarity.true_rank_blocks(queries_of(spark, sf), gallery(spark, sf))
    found = mt.closed_set_metrics(ranked.select("query_id", "rank"))
    return rounded(found.select("n", "mrr", "top1_count", "top3_count", "top5_count"))


@query(
    "true_rank_blocks",
    MATCHED
    + """ select query_id, cast(rank as bigint) as rank, round(best, 6) as best from answers
  join (select query_id, max(score) as best from best group by 1) using (query_id)""",
)
def true_rank_blocks(spark, sf):
    # small blocks, so that identities cross block edges even on small tables
    return rounded(
        similarity.true_rank_blocks(queries_of(spark, sf), gallery(spark, sf), block_rows=100)
    )


@query(
    "best_per_identity_blocks",
    MATCHED + " select query_id, side_id, round(score, 6) as score from best",
)
def best_per_identity_blocks(spark, sf):
    return rounded(similarity.best_per_identity_blocks(queries_of(spark, sf), gallery(spark, sf)))


def descriptors(spark: SparkSession, sf: str, name: str, condition: str) -> DataFrame:
    """Eight 8-dimensional descriptors per image, cut from its vector."""
    rows = view(spark, sf, "features_v").filter(condition)
    cut = rows.select(
        F.col("image_id").alias(name), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("kp_id"),
        "vector",
    )
    return cut.select(
        name,
        "kp_id",
        (F.col("kp_id") * 10.0).alias("x"),
        (F.element_at("vector", F.col("kp_id") + 1) * 100).alias("y"),
        F.slice("vector", F.col("kp_id") * 8 + 1, 8).alias("descriptor"),
    )


def keypoints(spark: SparkSession, sf: str, name: str, condition: str) -> DataFrame:
    """The same descriptors as one array an image."""
    return descriptors(spark, sf, name, condition).groupBy(name).agg(
        F.sort_array(F.collect_list(F.struct("kp_id", "x", "y", "descriptor"))).alias("keypoints")
    )


MATCHES = """cut as (select image_id, side_id, k, kp, vector[kp * 8 + 1 : kp * 8 + 8] as d
    from features_v, (select unnest(range(8)) as kp) t(kp)),
  near as (select q.image_id as query_id, g.image_id as gallery_id, q.kp,
      list_sort(list(list_distance(q.d, g.d)))[1:2] as dist
    from cut q join cut g on q.k >= 6 and g.k < 6 group by 1, 2, 3),
  counted as (select query_id, gallery_id, count(*) filter (where dist[1] < 0.8 * dist[2]) as n
    from near group by 1, 2),
  matched as (select query_id, gallery_id, case when n >= 4 then n else 0 end as n from counted)"""


@query(
    "descriptor_ratio_match",
    f"with {MATCHES} select query_id, gallery_id, cast(n as int) as good_matches from matched",
)
def descriptor_ratio_match(spark, sf):
    return similarity.descriptor_ratio_match(
        descriptors(spark, sf, "query_id", "k >= 6"), descriptors(spark, sf, "gallery_id", "k < 6")
    )


@query(
    "evaluate_descriptors",
    f"""with {MATCHES},
  named as (select query_id, q.side_id as truth, g.side_id, n from matched
    join features_v q on q.image_id = query_id join features_v g on g.image_id = gallery_id),
  best as (select query_id, truth, side_id, max(n) as score from named group by 1, 2, 3),
  ranked as (select *, row_number() over (partition by query_id order by score desc, side_id) as rank,
    max(score) over (partition by query_id) as top from best)
  select query_id, cast(rank as bigint) as rank, cast(top as double) as best from ranked where side_id = truth""",
)
def evaluate_descriptors(spark, sf):
    """Ranks by descriptor matches instead of cosine, through the same blocks."""
    return descriptor_ranks(spark, sf, scorers.MatchScorer())


@query("evaluate_homography")
def evaluate_homography(spark, sf):
    """Ranks by matches that agree with one homography."""
    return descriptor_ranks(spark, sf, scorers.HomographyScorer())


def descriptor_ranks(spark: SparkSession, sf: str, scorer: scorers.Scorer) -> DataFrame:
    sides = view(spark, sf, "features_v").select("image_id", "side_id")
    asked = keypoints(spark, sf, "query_id", "k >= 6").join(
        sides.withColumnsRenamed({"image_id": "query_id", "side_id": "truth"}), "query_id"
    )
    shown = keypoints(spark, sf, "gallery_id", "k < 6").join(
        sides.withColumnRenamed("image_id", "gallery_id"), "gallery_id"
    )
    return similarity.true_rank_blocks(asked, shown, scorer=scorer)


@query("ransac_inliers")
def ransac_inliers(spark, sf):
    """Inliers of one homography among the matched points of each image pair."""
    asked, shown = descriptors(spark, sf, "query_id", "k >= 6"), descriptors(spark, sf, "gallery_id", "k < 6")
    return similarity.descriptor_inliers(asked, shown, threshold=5.0)


# --- ranking over the score table -------------------------------------------------------------------


def best(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.best_per_identity(view(spark, sf, "scores_v"))


def known_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.true_rank(best(spark, sf), view(spark, sf, "truth_v"))


def known_best(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.best_score(best(spark, sf), view(spark, sf, "truth_v"))


def unknown_best(spark: SparkSession, sf: str) -> DataFrame:
    unknown = view(spark, sf, "scores_v").filter("is_unknown")
    tops = ranking.best_per_identity(unknown).groupBy("query_id")
    return tops.agg(F.max("score").alias("best"))


def scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known ranks, known best, unknown best) from one materialised identity table."""
    table_ = durable(best(spark, sf))
    truth = durable(view(spark, sf, "truth_v").select("query_id", "side_id"))
    tops = durable(table_.groupBy("query_id").agg(F.max("score").alias("best")))
    known = truth.select("query_id")
    return (
        ranking.true_rank(table_, truth),
        tops.join(known, "query_id", "left_semi"),
        tops.join(known, "query_id", "left_anti"),
    )


RANKED = """with best as (select query_id, side_id, max(score) as score from scores_v group by 1, 2),
  ranked as (select *, row_number() over (partition by query_id order by score desc, side_id) as rank
    from best),
  tops as (select query_id, max(score) as best from best group by 1),
  answers as (select t.query_id, r.rank, tops.best, t.light from truth_v t
    join ranked r on r.query_id = t.query_id and r.side_id = t.side_id
    join tops on tops.query_id = t.query_id),
  strangers as (select query_id, best from tops where query_id in
    (select query_id from scores_v where is_unknown))"""


@query("best_per_identity", RANKED + " select query_id, side_id, score from best")
def best_per_identity(spark, sf):
    return best(spark, sf)


@query("rank_identities", RANKED + " select query_id, side_id, score, cast(rank as int) as rank from ranked")
def rank_identities(spark, sf):
    return ranking.rank_identities(best(spark, sf))


@query("true_rank", RANKED + " select query_id, cast(rank as bigint) as rank from answers")
def true_rank(spark, sf):
    return known_ranks(spark, sf)


@query(
    "best_score",
    RANKED
    + """ select query_id, coalesce(best, cast('-Infinity' as double)) as best from
  (select 'q-' || lpad(cast(o_orderkey as string), 10, '0') as query_id from orders)
  left join tops using (query_id)""",
)
def best_score(spark, sf):
    """Orders without lines stand for queries against an empty gallery."""
    named = F.concat(F.lit("q-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    asked = table(spark, sf, "orders").select(named.alias("query_id"))
    return ranking.best_score(best(spark, sf), asked)


@query(
    "top_candidates",
    RANKED
    + """ select query_id, string_agg(side_id || '=' || printf('%.2f', score), ',' order by rank)
  as candidates from ranked where rank <= 3 group by 1""",
)
def top_candidates(spark, sf):
    top = ranking.top_candidates(best(spark, sf), 3)
    shown = F.transform(
        "candidates",
        lambda c: F.concat(c["side_id"], F.lit("="), F.format_string("%.2f", c["score"])),
    )
    return top.select("query_id", F.array_join(shown, ",").alias("candidates"))


# --- metrics ---------------------------------------------------------------------------------------------


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    k, n = f"cast({k} as double)", f"cast({n} as double)"
    middle = f"({k} / {n} + {Z * Z} / (2 * {n}))"
    half = f"({Z} * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + {Z * Z} / (4 * {n} * {n})))"
    scale = f"(1 + {Z * Z} / {n})"
    return (
        f"case when {n} = 0 then 0.0 else round(greatest(0, ({middle} - {half}) / {scale}), 6) end",
        f"case when {n} = 0 then 1.0 else round(least(1, ({middle} + {half}) / {scale}), 6) end",
    )


def rate_sql(name: str, k: str, n: str) -> str:
    lo, hi = wilson_sql(k, n)
    return (
        f"cast({k} as bigint) as {name}_count, round({k} / cast({n} as double), 6) as {name}_rate, "
        f"{lo} as {name}_lo, {hi} as {name}_hi"
    )


LO, HI = wilson_sql("hits", "n")


@query(
    "wilson_interval",
    f"""select side_id, {LO} as lo, {HI} as hi from (select side_id, count(*) as n,
  count(*) filter (where score > {THRESHOLD}) as hits from scores_v group by 1)""",
)
def wilson_interval(spark, sf):
    counted = view(spark, sf, "scores_v").groupBy("side_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > THRESHOLD).alias("hits")
    )
    interval = wilson_of("hits", "n")
    return counted.select("side_id", r6(interval["lo"]).alias("lo"), r6(interval["hi"]).alias("hi"))


@query(
    "rate",
    f"""select query_id, cast(hits as bigint) as count, cast(n as bigint) as n,
  round(case when n = 0 then cast('NaN' as double) else hits / cast(n as double) end, 6) as rate,
  {LO} as lo, {HI} as hi from (
  select 'q-' || lpad(cast(o_orderkey as string), 10, '0') as query_id, count(score) as n,
    count(*) filter (where score > {THRESHOLD}) as hits from orders left join scores_v
    on query_id = 'q-' || lpad(cast(o_orderkey as string), 10, '0') group by 1)""",
)
def rate(spark, sf):
    """Share of strong candidates per query; orders without lines have n = 0."""
    named = F.concat(F.lit("q-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    asked = table(spark, sf, "orders").select(named.alias("query_id"))
    counted = (
        asked.join(view(spark, sf, "scores_v"), "query_id", "left")
        .groupBy("query_id")
        .agg(F.count("score").alias("n"), F.count_if(F.col("score") > THRESHOLD).alias("hits"))
    )
    return rounded(counted.select("query_id", F.inline(F.array(rate_of("hits", "n")))))


def _top(k: int) -> str:
    return f"count(*) filter (where rank <= {k})"


@query(
    "closed_set_metrics",
    RANKED
    + f""" select cast(count(*) as bigint) as n, round(avg(1.0 / rank), 6) as mrr,
  {rate_sql("top1", _top(1), "count(*)")}, {rate_sql("top3", _top(3), "count(*)")},
  {rate_sql("top5", _top(5), "count(*)")} from answers""",
)
def closed_set_metrics(spark, sf):
    return rounded(mt.closed_set_metrics(known_ranks(spark, sf)))


@query(
    "cmc_curve",
    RANKED
    + f""" select cast(k as bigint) as k, round((select count(*) from answers where rank <= k) /
  cast((select count(*) from answers) as double), 6) as share
  from (select unnest(range(1, {GALLERY_SIDES + 1})) as k)""",
)
def cmc_curve(spark, sf):
    return rounded(mt.cmc_curve(durable(known_ranks(spark, sf)), GALLERY_SIDES))


KNOWN_IN = f"count(*) filter (where known and best >= {THRESHOLD})"
NK, NU = "count(*) filter (where known)", "count(*) filter (where not known)"


@query(
    "open_set_metrics",
    RANKED
    + f""", everyone as (select best, rank, true as known from answers
    union all select best, null, false from strangers)
  select cast({NK} as bigint) as n_known, cast({NU} as bigint) as n_unknown,
  {rate_sql("known_acceptance", KNOWN_IN, NK)},
  {rate_sql("false_rejection", f"({NK} - {KNOWN_IN})", NK)},
  """
    + ",\n".join(
        rate_sql(f"top{k}_after", f"count(*) filter (where known and best >= {THRESHOLD} and rank <= {k})", NK)
        for k in (1, 3, 5)
    )
    + f""",
  {rate_sql("unknown_false_accept", f"count(*) filter (where not known and best >= {THRESHOLD})", NU)}
  from everyone""",
)
def open_set_metrics(spark, sf):
    return rounded(mt.open_set_metrics(*scored(spark, sf), THRESHOLD))


@query(
    "open_set_decisions",
    RANKED
    + f""" select query_id, case when best >= {THRESHOLD} then 'CANDIDATES' else 'UNKNOWN' end
  as decision from (select query_id, best from answers union all select query_id, best from strangers)""",
)
def open_set_decisions(spark, sf):
    everyone = known_best(spark, sf).unionByName(unknown_best(spark, sf))
    return mt.decisions(everyone, THRESHOLD)


@query(
    "calibrate_threshold",
    RANKED
    + """, placed as (select best, row_number() over (order by best desc) as place,
    count(*) over () as n from strangers)
  select cast(n as bigint) as n, best as boundary,
    nextafter(best, cast('Infinity' as double)) as threshold from placed
  where place = floor(cast(0.05 as double) * n) + 1""",
)
def calibrate_threshold(spark, sf):
    return mt.calibrate_threshold(unknown_best(spark, sf), 0.05)


@query(
    "stratify",
    RANKED
    + f""" select value, cast(n as bigint) as n, round(hits / cast(n as double), 6) as top_k_rate,
  {LO} as lo, {HI} as hi, n >= 10 as reportable from (
    select coalesce(nullif(light, ''), 'unrecorded') as value, count(*) as n,
      count(*) filter (where rank <= 5) as hits from answers group by 1)""",
)
def stratify(spark, sf):
    lit = known_ranks(spark, sf).join(view(spark, sf, "truth_v").select("query_id", "light"), "query_id")
    return rounded(mt.stratify(lit, "light", k=5))


@query(
    "stratify_all_attributes",
    RANKED
    + f""", valued as (select query_id, rank, 'light' as attribute, light as value from answers
    union all select query_id, rank, 'clerk', case when best > 0.9 then 'hot' else '' end from answers)
  select attribute, value, cast(n as bigint) as n, round(hits / cast(n as double), 6) as top_k_rate,
    {LO} as lo, {HI} as hi, n >= 10 as reportable from (
    select attribute, coalesce(nullif(value, ''), 'unrecorded') as value, count(*) as n,
      count(*) filter (where rank <= 5) as hits from valued group by 1, 2)""",
)
def stratify_all_attributes(spark, sf):
    ranks, tops, _ = scored(spark, sf)
    described = view(spark, sf, "truth_v").join(tops, "query_id")
    attributes = F.map_filter(
        F.create_map(
            F.lit("light"),
            F.col("light"),
            F.lit("clerk"),
            F.when(F.col("best") > 0.9, "hot").otherwise(""),
            F.lit("head_bbox"),
            F.lit("0,0,1,1"),
        ),
        lambda _, v: v != "",
    )
    rows = durable(
        ranks.join(described.select("query_id", attributes.alias("attributes")), "query_id")
    )
    return rounded(
        mt.stratify_all_attributes(
            rows.select("query_id", "rank"), rows.select("query_id", "attributes")
        )
    )


@query(
    "value_counts",
    """select case when quality = 1 and toxic = 0 then 'ACCEPT' when quality = 1 then 'RETRY PHOTO'
  else 'INSUFFICIENT HEAD VIEW' end as value, cast(count(*) as bigint) as n from labels group by 1""",
)
def value_counts(spark, sf):
    verdict = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ACCEPT")
        .when(F.col("quality") == 1, "RETRY PHOTO")
        .otherwise("INSUFFICIENT HEAD VIEW")
    )
    return mt.value_counts(table(spark, sf, "labels").select(verdict.alias("verdict")), "verdict")


@query(
    "latency_summary",
    """with ordered as (select value, row_number() over (order by value) as place, count(*) over () as n
    from events)
  select (select median(value) from events) as median,
    max(value) filter (where place = round_even(0.95 * (n - 1), 0) + 1) as p95, max(value) as max
  from ordered""",
)
def latency_summary(spark, sf):
    return mt.latency_summary(table(spark, sf, "events"), "value")


# --- examples ---------------------------------------------------------------------------------------------


@query(
    "false_positive_examples",
    RANKED
    + f""" select query_id, best from strangers where best >= {THRESHOLD}
  order by best desc, query_id limit 10""",
)
def false_positive_examples(spark, sf):
    return mt.false_positive_examples(unknown_best(spark, sf), THRESHOLD)


@query(
    "false_negative_examples",
    RANKED
    + f""" select query_id, cast(rank as bigint) as rank, best < {THRESHOLD} as rejected_as_unknown
  from answers where rank > 5 or best < {THRESHOLD} order by rank desc, query_id limit 10""",
)
def false_negative_examples(spark, sf):
    ranks, tops, _ = scored(spark, sf)
    return mt.false_negative_examples(ranks, tops, THRESHOLD)


@query(
    "hardest_correct",
    RANKED + " select query_id, best from answers where rank = 1 order by best, query_id limit 10",
)
def hardest_correct(spark, sf):
    ranks, tops, _ = scored(spark, sf)
    return mt.hardest_correct(ranks, tops)


@query(
    "compare_metric_tables",
    """with a as (select l_orderkey as k, sum(l_quantity) as q, max(l_returnflag) as f from lineitem
    group by 1),
  b as (select l_orderkey as k, sum(case when l_partkey % 211 = 0 then l_quantity + 1
      else l_quantity + 1e-12 end) as q,
    max(case when l_partkey % 307 = 0 then 'Z' else l_returnflag end) as f from lineitem
    where l_quantity < 49 group by 1)
  select cast(coalesce(a.k, b.k) as string) || '.quantity' as path,
    case when a.k is null or b.k is null then 'present in only one run' else 'number differs' end
    as problem from a full join b on a.k = b.k
    where a.k is null or b.k is null or abs(a.q - b.q) > 1e-9
  union all select cast(coalesce(a.k, b.k) as string) || '.flag',
    case when a.k is null or b.k is null then 'present in only one run' else 'value differs' end
    from a full join b on a.k = b.k where a.k is null or b.k is null or a.f <> b.f""",
)
def compare_metric_tables(spark, sf):
    """Two runs of one report, the second with planted changes and missing groups."""
    lines = table(spark, sf, "lineitem")

    def report(rows: DataFrame, quantity, flag) -> DataFrame:
        wide = rows.groupBy("l_orderkey").agg(
            F.sum(quantity).alias("quantity"), F.max(flag).alias("flag")
        )
        return mt.flatten_record(wide, "l_orderkey", ["quantity", "flag"])

    q, f, p = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_partkey")
    first = report(lines, q, f)
    second = report(
        lines.filter(q < 49),
        F.when(p % 211 == 0, q + 1).otherwise(q + 1e-12),
        F.when(p % 307 == 0, "Z").otherwise(f),
    )
    return mt.compare_metric_tables(first, second).select("path", "problem")


# --- budget and decisions -------------------------------------------------------------------------------------


@query(
    "config_budget",
    """select algorithm_family as entity_id, 'budget' as code from configs_v group by 1
    having count(distinct config_sha256) > 3
  union all select 'C', 'fine_tuned' from configs_v where algorithm_family = 'C'
    having count(distinct model_identifier) > 1""",
)
def config_budget(spark, sf):
    found = decision.config_budget(view(spark, sf, "configs_v"))
    return found.select("entity_id", "code")


RESULTS = """results as (select 'run-' || cast(c_custkey as string) as run,
    case when c_custkey % 11 = 0 then 'TIER A — CONTROLLED REAL DATA'
      else 'TIER B — MOBILE-LIKE REAL DATA' end as evidence_label,
    c_custkey % 11 > 0 as counts, c_custkey % 13 > 0 as representative,
    c_custkey % 17 > 0 as reproducible, c_custkey % 19 > 0 as provenance_complete,
    c_custkey % 23 > 0 as sealed, case when c_custkey % 29 = 0 then 'validation' else 'test' end as part,
    c_custkey % 31 = 0 as leaky,
    round(0.6 + (c_custkey % 37) * 0.01, 2) as top5, round(0.5 + (c_custkey % 5) * 0.05, 2) as top1,
    round((c_custkey % 10) * 0.01, 3) as far, case when c_custkey % 7 = 0 then null
      else round(0.02 + (c_custkey % 12) * 0.01, 2) end as far_hi,
    round(0.66 + (c_custkey % 8) * 0.03, 2) as recall,
    cast(18 + c_custkey % 41 as int) as known, cast(2 + c_custkey % 9 as int) as images,
    cast(17 + c_custkey % 43 as int) as unseen from customer)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """One result row per customer, spread over every branch of the decision."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("run-"), k.cast("string")).alias("run"),
        F.when(k % 11 == 0, "TIER A — CONTROLLED REAL DATA")
        .otherwise("TIER B — MOBILE-LIKE REAL DATA")
        .alias("evidence_label"),
        (k % 11 > 0).alias("counts_toward_product_gates"),
        (k % 13 > 0).alias("representative"),
        (k % 17 > 0).alias("reproducible"),
        (k % 19 > 0).alias("provenance_complete"),
        (k % 23 > 0).alias("sealed"),
        F.when(k % 29 == 0, "validation").otherwise("test").alias("partition"),
        F.when(k % 31 == 0, F.array(F.lit("session leakage"))).alias("leakage_errors"),
        F.round(0.6 + (k % 37) * 0.01, 2).alias("top5"),
        F.round(0.5 + (k % 5) * 0.05, 2).alias("top1"),
        F.round((k % 10) * 0.01, 3).alias("far"),
        F.when(k % 7 != 0, F.round(0.02 + (k % 12) * 0.01, 2)).alias("far_hi"),
        F.round(0.66 + (k % 8) * 0.03, 2).alias("known_top5_after_threshold"),
        (18 + k % 41).cast("int").alias("known_side_ids"),
        (2 + k % 9).cast("int").alias("min_images_per_known_side_id"),
        (17 + k % 43).cast("int").alias("unseen_side_ids"),
    )


@query(
    "data_shortfalls",
    f"""with {RESULTS} select run, concat_ws('; ',
    case when known < 20 then 'known identities ' || cast(known as string) || ' < 20' end,
    case when images < 3 then 'images of the scarcest identity ' || cast(images as string) || ' < 3' end,
    case when unseen < 20 then 'unseen identities ' || cast(unseen as string) || ' < 20' end)
  as shortfalls from results""",
)
def data_shortfalls(spark, sf):
    return decision.data_shortfalls(results(spark, sf)).select(
        "run", F.array_join("shortfalls", "; ").alias("shortfalls")
    )


@query(
    "gate_decision",
    f"""with {RESULTS},
  judged as (select *, case when reproducible then 'PASS' else 'FAIL' end as a,
    case when leaky or not provenance_complete or not sealed then 'FAIL' else 'PASS' end as b,
    case when top5 >= 0.8 then 'PASS' when top5 >= 0.7 then 'NEAR' else 'FAIL' end as c,
    case when recall < 0.7 then 'FAIL' when far <= 0.05 then 'PASS' when far <= 0.075 then 'NEAR'
      else 'FAIL' end as d, coalesce(far_hi > 0.1, true) as wide,
    known < 20 or images < 3 or unseen < 20 as short from results),
  open as (select *, not counts or part <> 'test' or not representative or short or a = 'FAIL'
    or b = 'FAIL' as early from judged)
  select run, a as gate_a, b as gate_b, case when not early then c end as gate_c,
    case when not early then d end as gate_d, case when not early then c end as gate_e,
    case when early then 'INSUFFICIENT DATA' when c = 'FAIL' or d = 'FAIL' then 'NO-GO'
      when c = 'NEAR' and d = 'NEAR' then 'NO-GO' when c = 'NEAR' or d = 'NEAR' or wide
      then 'CONDITIONAL GO' else 'GO' end as decision,
    case when not counts then 'this evidence does not count: (' || evidence_label || ')'
      when part <> 'test' or not representative
        then 'only a representative sealed test can decide'
      when short then 'too little data: ' || concat_ws('; ',
        case when known < 20 then 'known identities ' || cast(known as string) || ' < 20' end,
        case when images < 3 then 'images of the scarcest identity ' || cast(images as string) || ' < 3' end,
        case when unseen < 20 then 'unseen identities ' || cast(unseen as string) || ' < 20' end)
      when early then 'gates A and B come first'
      when c = 'FAIL' and d = 'FAIL' then 'failed: C, D, E'
      when c = 'FAIL' then 'failed: C, E' when d = 'FAIL' then 'failed: D'
      when c = 'NEAR' and d = 'NEAR'
        then 'two near misses are one too many'
      when c = 'NEAR' then 'near miss in retrieval alone'
      when d = 'NEAR' then 'near miss in open-set safety alone'
      when wide then 'false accepts may still exceed 0.1 within their interval'
      else 'every gate passed' end as reason,
    case when early then 0 else (top1 < 0.6)::int + (far <= 0.01)::int + wide::int end as n_notes
  from open""",
)
def gate_decision(spark, sf):
    judged = decision.gate_decision(results(spark, sf))
    return judged.select(
        "run", "gate_a", "gate_b", "gate_c", "gate_d", "gate_e", "decision", "reason",
        F.size("notes").alias("n_notes"),
    )
