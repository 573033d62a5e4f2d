"""Model, ensemble and registry queries. Training settings are small here; the published ones are the defaults.

A model's scores depend on the learner, so the queries return what SQL can state of them: which rows were scored by
which model, how many, on which side of the split, and whether the numbers keep their bounds.
"""


from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from clickloom.catalog.registry import query
from clickloom.catalog.splits import RANKED
from clickloom.functions import scalars as S
from clickloom.operators import aggregates as A
from clickloom.operators.ranks import group_totals
from clickloom.operators.splits import train_valid
from clickloom.plans import models as M
from clickloom.plans import ranking as K
from clickloom.plans.bayes import kernel_bayes_grid
from clickloom.session import fresh_dir, materialise
from clickloom.sources import writers as O
from clickloom.sources.stages import StageStore
from clickloom.views import SPLIT_SEED

FEATURES = ("ad_prob", "ad_tot", "doc_prob", "user_tot", "adv_prob", "hour", "day", "platform")


SIZES = "SELECT display_id, ad_id, clicked, count(*) OVER (PARTITION BY display_id) AS num_ads FROM impressions"


def scored():
    return F.coalesce(F.col("prob").between(0, 1), F.lit(False)).alias("scored")


#: What a row's ad and its display are told by, and what else the models need of it.
AD, DISPLAY = ("ad_id", "ad_document_id", "ad_advertiser_id"), ("display_id", "uuid")
ROW_COLUMNS = (*DISPLAY, *AD, "clicked", "part", "hour", "day", "platform")


def add_rates(rows):
    """``rows`` with the rates and counts of their four keys in the training rows, and their display's number of rows."""
    seen = (F.col("part") == "train").cast("int")
    mean = rows.where("part = 'train'").agg(F.avg("clicked")).first()[0] or 0.0

    def counted(by):
        return materialise(rows.groupBy(*by).agg(
            F.sum(F.col("clicked") * seen).alias("_clicks"), F.sum(seen).alias("_seen"), F.count("*").alias("_rows")
        ))

    def rated(counts, keys):
        out = counts
        for key, prefix in keys:
            rate = A.smoothed_rate(counts.where("_seen > 0"), key, "_clicks", reg=4, rows="_seen").select(
                F.col(key).alias("_k"), F.col("prob").alias("_p"), F.col("tot").cast("double").alias("_t")
            )
            out = out.join(rate, F.col(key).eqNullSafe(F.col("_k")), "left").withColumns({
                f"{prefix}_prob": F.coalesce("_p", F.lit(mean)), f"{prefix}_tot": F.coalesce("_t", F.lit(0.0)),
            }).drop("_k", "_p", "_t")
        return out

    def met(df, other, by):
        other = other.drop("_clicks", "_seen", "_rows").withColumnsRenamed({c: f"_{c}" for c in by})
        return df.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])).drop(*[f"_{c}" for c in by])

    ads = rated(counted(AD), (("ad_id", "ad"), ("ad_document_id", "doc"), ("ad_advertiser_id", "adv")))
    displays = group_totals(rated(counted(DISPLAY), [("uuid", "user")]), ["display_id"], {"num_ads": F.sum("_rows")})
    return met(met(rows, ads, AD), displays, DISPLAY).select("display_id", "ad_id", "clicked", "num_ads", "part", *FEATURES)


def training_rows(v):
    """Keyed rows with a few features and their side of the split, kept as a table partitioned by group size.

    Rates come from the training displays alone; a key that they do not have gets their mean rate and no count.
    The wide rows are computed once. Rates meet the ads and the displays, whose clicks were counted first, and the rows then
    move once for their ad and once for their display, never for a key of few values.
    """
    def compute():
        wide = train_valid(v.wide, "display_id", 0.8, SPLIT_SEED, ids=v.display_ids)
        return add_rates(materialise(wide.select(*ROW_COLUMNS)))

    return StageStore.of_tables(v.spark, v.sf_dir).get("training_rows", compute, partition_by=["num_ads"])


def small_boosting(features=FEATURES, **params):
    return M.boosting(features, **{"maxIter": 5, "maxDepth": 3, "stepSize": 0.3, **params})


def small_forest(features=FEATURES, **params):
    return M.forest(features, **{"numTrees": 8, "maxDepth": 4, **params})


#: A fit of a cohort ends once a round lowers the loss of its held-out fifth by less than this share.
COHORT_TOLERANCE = 0.002


def cohort_boosting(**limits):
    return M.boosting(FEATURES, **{"checkpointInterval": M.DEEP_CHECKPOINTS, **limits})


def cohort_scores(v):
    """All rows scored by the model of their group size, kept as a table: (keys, clicked, num_ads, part, fitted, model, rounds, prob).

    The models have the published depth, step and limits; of their 200 rounds they run those that lower the held-out loss.
    ``fitted`` marks the rows that a cohort's fit was given, all its training rows; ``rounds`` is the number of trees of the model.
    """
    def compute():
        rows = training_rows(v)
        models, _ = M.fit_bounded_cohorts(
            rows.where("part = 'train'"), "num_ads", "display_id", cohort_boosting, tolerance=COHORT_TOLERANCE
        )
        keep = ["display_id", "ad_id", "clicked", "num_ads", "part"]
        routed = M.route(rows, "num_ads", models, max(models), keep, used="model")
        rounds = F.create_map(*[F.lit(x) for c, m in models.items() for x in (c, m.stages[-1].getNumTrees)])
        fitted = (F.col("part") == "train") & F.col("num_ads").isin(list(models))
        return routed.select(*keep, fitted.alias("fitted"), "model", rounds[F.col("model")].alias("rounds"), "prob")

    return StageStore.of_tables(v.spark, v.sf_dir).get("cohort_scores", compute)


FITTED = """SELECT DISTINCT num_ads, display_id FROM sized JOIN split_ids USING (display_id) WHERE part = 'train' AND num_ads BETWEEN 2 AND 12"""


@query(
    "mdl_cohort_boosting",
    """WITH f AS (SELECT num_ads, sum(num_ads) AS fit_rows, count(*) AS fit_displays FROM fit_sets GROUP BY 1)
       SELECT num_ads, count(*) AS rows, count(DISTINCT display_id) AS displays, any_value(fit_rows)::BIGINT AS fit_rows, any_value(fit_displays) AS fit_displays, round(1.0 / num_ads, 8) AS chance
       FROM sized JOIN split_ids USING (display_id) JOIN f USING (num_ads) WHERE part = 'valid' GROUP BY 1""", sized=SIZES, fit_sets=FITTED,
)
def _(v):
    """Each cohort's own model: the rows it was fitted on, and the held-out displays that it ranks (``mdl_cohort_map``)."""
    scored_rows = cohort_scores(v).where(F.col("num_ads") == F.col("model"))
    held, fit = F.col("part") == "valid", F.col("fitted")
    out = scored_rows.groupBy(F.col("num_ads").cast("bigint").alias("num_ads")).agg(
        F.count_if(held).alias("rows"), F.count_distinct(F.when(held, F.col("display_id"))).alias("displays"),
        F.count_if(fit).alias("fit_rows"), F.count_distinct(F.when(fit, F.col("display_id"))).alias("fit_displays"),
    )
    return out.withColumn("chance", F.round(1 / F.col("num_ads"), 8)).where("rows > 0")


@query("mdl_cohort_map")
def _(v):
    """Each cohort's rounds and its MAP on the held-out displays against the chance rate, as it came out.

    The numbers depend on the learner, so there is no SQL for them.
    """
    held = cohort_scores(v).where("part = 'valid' AND num_ads = model")
    rounds = held.groupBy(F.col("num_ads").alias("size")).agg(F.max("rounds").alias("rounds"))
    return K.improvement_by_size(held).join(rounds, F.col("num_ads") == F.col("size")).drop("size")


@query("mdl_cohort_scores")
def _(v):
    """The score of every row, with the cohort whose model gave it; no SQL, as for ``mdl_cohort_map``."""
    return cohort_scores(v).select("display_id", "ad_id", "num_ads", "model", "prob")


@query("mdl_rounds_by_cv")
def _(v):
    """MAP, AUC and error of the rounds of four folds with the published depth, step and 200 rounds, the best round by each marked.

    Rounds after 25 without a better MAP are left out, as published. The numbers depend on the learner, so there is no SQL for them.
    """
    return M.rounds_by_cv(
        training_rows(v), "display_id", "ad_id", lambda: M.boosting(FEATURES, checkpointInterval=M.DEEP_CHECKPOINTS), folds=4
    )


@query("mdl_forest", "SELECT display_id, ad_id, clicked, part, TRUE AS scored FROM impressions JOIN split_ids USING (display_id)")
def _(v):
    """The published forest: 1000 trees of depth 15, three quarters of the rows and half of the columns."""
    rows = training_rows(v)
    keep = ["display_id", "ad_id", "clicked", "part"]
    train = M.spread(M.with_class_weight(rows.where("part = 'train'")))
    return M.forest_scores(train, rows, lambda **p: M.forest(FEATURES, weight="weight", **p), keep).select(*keep, scored())


@query("mdl_class_weight", "SELECT display_id, ad_id, round(CASE WHEN clicked = 1 THEN (SELECT sum(1 - clicked) / sum(clicked) FROM impressions) ELSE 1.0 END, 8) AS weight FROM impressions")
def _(v):
    out = M.with_class_weight(v.impressions)
    return out.select("display_id", "ad_id", F.round("weight", 8).alias("weight"))


# The same folds, bins, kernel sums and log ratios, feature by feature; 0 and 1 are numeric, 2 and 3 are codes.
_BAYES = """WITH r AS (SELECT i.display_id, i.clicked AS y, CAST(rn % 5 AS INTEGER) AS fold, CAST(price AS DOUBLE) AS price, CAST(ts AS DOUBLE) AS ts, hour, platform, row_number() OVER () AS id
    FROM impressions i JOIN events_derived USING (display_id) JOIN ranked USING (display_id)),
  b AS (SELECT min(price) AS p0, max(price) AS p1, min(ts) AS t0, max(ts) AS t1 FROM r),
  l AS (SELECT id, y, fold, unnest([0, 1, 2, 3]) AS feature, unnest([least(floor((price - p0) / (p1 - p0) * 64), 63)::INTEGER, least(floor((ts - t0) / (t1 - t0) * 64), 63)::INTEGER, hour, platform]) AS bin FROM r, b),
  h AS (SELECT fold, feature, bin, sum(1 - y) AS n0, sum(y) AS n1 FROM l GROUP BY ALL),
  t AS (SELECT feature, bin, sum(n0) AS n0, sum(n1) AS n1 FROM h GROUP BY ALL),
  seen AS MATERIALIZED (SELECT f.fold, t.feature, t.bin, t.n0 - coalesce(h.n0, 0) AS n0, t.n1 - coalesce(h.n1, 0) AS n1
    FROM t CROSS JOIN (SELECT unnest(range(0, 5))::INTEGER AS fold) f LEFT JOIN h ON h.fold = f.fold AND h.feature = t.feature AND h.bin = t.bin),
  c AS (SELECT fold, feature, bin, 0 AS c, n0 AS n FROM seen WHERE feature < 2 UNION ALL SELECT fold, feature, bin, 1, n1 FROM seen WHERE feature < 2),
  m AS (SELECT fold, feature, c, 0.9 * sqrt((sum(n * bin * bin) - sum(n * bin)::DOUBLE * sum(n * bin) / sum(n)) / (sum(n) - 1)) * sum(n) ** (-0.2::DOUBLE) AS width FROM c GROUP BY ALL),
  a AS (SELECT unnest([0.001, 0.1])::DOUBLE AS adjust),
  k AS (SELECT fold, feature, c, adjust, x.bin, sum(y.n * exp(-0.5 * ((x.bin - y.bin) / (adjust * width)) ** 2)) AS k
    FROM c x JOIN c y USING (fold, feature, c) JOIN m USING (fold, feature, c) CROSS JOIN a WHERE y.n > 0 GROUP BY ALL),
  d AS (SELECT *, greatest(k / sum(k) OVER (PARTITION BY fold, feature, c, adjust), 0.001) AS p FROM k),
  dr AS MATERIALIZED (SELECT x.fold, x.feature, x.bin, x.adjust, ln(y.p / x.p) AS ratio FROM d x JOIN d y USING (fold, feature, bin, adjust) WHERE x.c = 0 AND y.c = 1),
  s AS (SELECT fold, feature, sum(n0) AS m0, sum(n1) AS m1, count(*) AS levels FROM seen WHERE feature >= 2 GROUP BY ALL),
  lr AS MATERIALIZED (SELECT fold, feature, bin, laplace, ln(greatest((n1 + laplace) / (m1 + laplace * levels), 0.001) / greatest((n0 + laplace) / (m0 + laplace * levels), 0.001)) AS ratio
    FROM seen JOIN s USING (fold, feature) CROSS JOIN (SELECT unnest([1.0, 100.0])::DOUBLE AS laplace) WHERE feature >= 2),
  o AS (SELECT f.fold, ln(sum(y)::DOUBLE / sum(1 - y)) AS prior FROM r JOIN (SELECT unnest(range(0, 5))::INTEGER AS fold) f ON r.fold <> f.fold GROUP BY f.fold),
  e AS (SELECT id, laplace, sum(ratio) AS e FROM l JOIN lr USING (fold, feature, bin) GROUP BY ALL),
  g AS (SELECT id, adjust, sum(ratio) AS g FROM l JOIN dr USING (fold, feature, bin) GROUP BY ALL),
  v AS (SELECT fold, laplace, adjust, avg(CASE WHEN (prior + e + g > 0) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a FROM r JOIN e USING (id) JOIN g USING (id) JOIN o USING (fold) GROUP BY ALL),
  w AS (SELECT laplace, adjust, avg(a) AS accuracy FROM v GROUP BY ALL)
  SELECT laplace, adjust, round(accuracy, 5) AS accuracy, row_number() OVER (ORDER BY round(accuracy, 9) DESC, laplace, adjust) = 1 AS best FROM w"""


@query("mdl_naive_bayes_grid", _BAYES, ranked=RANKED)
def _(v):
    """Laplace 1 and 100 by bandwidth .001 and .1: five-fold accuracy."""
    rows = v.impressions.join(v.events_derived.select("display_id", "ts", "hour", "platform"), "display_id")
    grid = kernel_bayes_grid(rows, ["price", "ts"], ["hour", "platform"], "display_id")
    return grid.withColumn("accuracy", F.round("accuracy", 5))


@query("mdl_importance", "SELECT 1.0::DOUBLE AS gain, 1.0::DOUBLE AS cover, 1.0::DOUBLE AS frequency, TRUE AS known")
def _(v):
    """The shares of all features add up to one."""
    model = small_boosting().fit(training_rows(v).where("part = 'train'"))
    shares = M.importance(v.spark, model, fresh_dir(v.spark, "trees"), FEATURES)
    sums = [F.round(F.sum(c), 6).alias(c) for c in ("gain", "cover", "frequency")]
    return shares.agg(*sums, F.bool_and(F.col("feature").isin(*FEATURES)).alias("known"))


@query("snk_importance_report")
def _(v):
    model = small_forest().fit(M.spread(training_rows(v).where("part = 'train'")))
    path = fresh_dir(v.spark, "importance")
    O.log_importance(M.importance(v.spark, model, fresh_dir(v.spark, "trees"), FEATURES), path, "RF_v001")
    return v.spark.read.parquet(path)


_FILTER = ("ts", "day", "platform", "document_id", "ad_document_id")
_AUC = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, sum(CASE WHEN clicked = 1 THEN r END) AS s, sum(clicked) AS p, sum(1 - clicked) AS n FROM
        (SELECT clicked, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r FROM wide) t""" for c in _FILTER
)


@query(
    "mdl_filter_importance",
    f"""WITH a AS ({_AUC}), u AS (SELECT feature, (s - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n) AS auc FROM a), g AS (SELECT feature, greatest(auc, 1 - auc) AS auc FROM u)
        SELECT feature, round(auc, 8) AS auc, round(100 * auc / (SELECT max(auc) FROM g), 6) AS importance FROM g""",
)
def _(v):
    out = A.filter_importance(v.wide, _FILTER, "clicked")
    return out.withColumns({"auc": F.round("auc", 8), "importance": F.round("importance", 6)})


@query("mdl_feature_elimination", "SELECT n_features, n_features AS named, TRUE AS in_bounds FROM (SELECT unnest([8, 2, 1])::INTEGER AS n_features)")
def _(v):
    out = M.feature_elimination(training_rows(v), FEATURES, "display_id", lambda f: small_forest(f, numTrees=4))
    named = F.size(F.split("features", " ")).alias("named")
    return out.select("n_features", named, F.col("error").between(0, 1).alias("in_bounds"))


LONG = """SELECT display_id, ad_id, n, model, prob FROM (
  SELECT i.display_id, i.ad_id, count(*) OVER (PARTITION BY i.display_id) AS n, a.prob AS m1, d.prob AS m2 FROM impressions i
    JOIN ad_rate a USING (ad_id) JOIN (SELECT ad_id, sum(clicked) / (count(*) + 6.0) AS prob FROM impressions GROUP BY 1) d USING (ad_id)) w
  CROSS JOIN LATERAL (SELECT 'm1' AS model, m1 AS prob UNION ALL SELECT 'm2', m2 UNION ALL SELECT 'm3', 1.0 / n) x"""


def long_scores(v):
    """Three models' scores in long form: two smoothings of the ad rate and the chance rate."""
    rates = v.impressions.groupBy("ad_id").agg(
        *[(F.sum("clicked") / (F.count("*") + F.lit(float(r)))).alias(m) for m, r in (("m1", 4), ("m2", 6))]
    )
    sized = group_totals(v.impressions.select("display_id", "ad_id"), ["display_id"], {"n": F.count("*")})
    wide = sized.join(rates, "ad_id").withColumn("m3", 1 / F.col("n"))
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prob")) for m in ("m1", "m2", "m3")])
    return wide.select("display_id", "ad_id", "n", F.explode(cells).alias("c")).select("display_id", "ad_id", "n", "c.*")


def rounded(df):
    return df.withColumn("prob", F.round("prob", 8))


@query("mdl_mean_ensemble", "SELECT display_id, ad_id, round(avg(prob), 8) AS prob FROM long_scores GROUP BY 1, 2", long_scores=LONG)
def _(v):
    return rounded(M.mean_ensemble(long_scores(v)))


@query(
    "mdl_weighted_ensemble",
    "SELECT display_id, ad_id, round(sum(w * prob) / sum(w), 8) AS prob FROM long_scores JOIN (VALUES ('m1', 0.5), ('m2', 0.3), ('m3', 0.4)) t(model, w) USING (model) GROUP BY 1, 2",
    long_scores=LONG,
)
def _(v):
    weights = v.spark.createDataFrame([("m1", 0.5), ("m2", 0.3), ("m3", 0.4)], "model string, weight double")
    return rounded(M.weighted_ensemble(long_scores(v), weights))


@query(
    "mdl_cohort_weighted",
    """WITH sizes AS (SELECT n, model, count(*) AS w FROM long_scores WHERE prob > 0.15 GROUP BY 1, 2)
       SELECT display_id, ad_id, round(sum(w * prob) / sum(w), 8) AS prob FROM long_scores JOIN sizes USING (model, n) GROUP BY 1, 2""",
    long_scores=LONG,
)
def _(v):
    scores = long_scores(v)
    # The weight of a model in a cohort: how many rows it scores above 0.15 there.
    weights = scores.where("prob > 0.15").groupBy("model", "n").agg(F.count("*").alias("weight"))
    return rounded(M.weighted_ensemble(scores, weights, on=["model", "n"]))


@query(
    "mdl_cohort_routing",
    """WITH top AS (SELECT max(num_ads) AS most FROM sized JOIN split_ids USING (display_id) WHERE part = 'train' AND num_ads BETWEEN 2 AND 12)
       SELECT display_id, ad_id, CAST(CASE WHEN num_ads BETWEEN 2 AND most THEN num_ads ELSE most END AS INTEGER) AS model, TRUE AS scored
       FROM sized CROSS JOIN top""", sized=SIZES,
)
def _(v):
    return cohort_scores(v).select("display_id", "ad_id", "model", scored())


@query(
    "mdl_out_of_fold",
    "SELECT i.display_id, ad_id, CAST(rn % 3 AS INTEGER) AS fold, TRUE AS scored FROM impressions i JOIN ranked USING (display_id)", ranked=RANKED,
)
def _(v):
    out = M.out_of_fold(training_rows(v), "display_id", lambda: small_boosting(maxIter=3), folds=3)
    return out.select("display_id", "ad_id", "fold", scored())


_NAMES = """SELECT 'XGB_v' || CAST(500 + c_nationkey AS VARCHAR) || '_' || CAST(c_custkey AS VARCHAR) || '.' || lpad(CAST(1 + c_custkey % 11 AS VARCHAR), 3, '0') AS name,
            500 + c_nationkey AS version, c_custkey % 11 + 2 AS cohort FROM customer"""


@query(
    "mdl_registry",
    """WITH c AS (SELECT version, cohort, min(name) AS name FROM names GROUP BY 1, 2),
       r AS (SELECT version FROM c GROUP BY 1 HAVING count(*) = 11 AND version NOT IN (SELECT 500 + s_nationkey FROM supplier WHERE s_acctbal < 1000))
       SELECT CAST(version AS INTEGER) AS version, CAST(cohort AS INTEGER) AS cohort, name FROM c WHERE version IN (SELECT version FROM r)""",
    names=_NAMES,
)
def _(v):
    name = F.concat(
        F.lit("XGB_v"), (500 + F.col("c_nationkey")).cast("string"), F.lit("_"), F.col("c_custkey").cast("string"),
        F.lit("."), F.lpad((1 + F.col("c_custkey") % 11).cast("string"), 3, "0"),
    )
    names = v.table("customer").select(name.alias("name"))
    models = names.select("name", S.model_version("name").alias("version"), S.model_cohort("name").alias("cohort"))
    outputs = v.table("supplier").where("s_acctbal < 1000").select((500 + F.col("s_nationkey")).alias("version"))
    return M.ready_versions(models, outputs)


@query("mdl_pluggable_scorer", "SELECT display_id, ad_id, round(1 / (1 + exp(-(0.5 * prob - 0.1 * day))), 8) AS prob FROM scores")
def _(v):
    def prepare(pdf):
        return pdf[["prob", "day"]].astype("float64")

    def to_matrix(pdf):
        return pdf.to_numpy()

    def load():
        return [0.5, -0.1]

    def predict(weights, x):
        import numpy as np

        return np.round(1 / (1 + np.exp(-(x @ np.array(weights)))), 8)

    return M.score_with(v.scores.drop("clicked"), prepare, to_matrix, predict, load)


@query("mdl_save_load", "SELECT display_id, ad_id, TRUE AS scored, 0.0::DOUBLE AS difference FROM impressions")
def _(v):
    """Scores before saving and after loading; the difference is 0."""
    from pyspark.ml import PipelineModel

    rows = training_rows(v)
    model = small_boosting().fit(rows.where("part = 'train'"))
    path = fresh_dir(v.spark, "model")
    model.save(path)
    before = M.score(model, rows, ["display_id", "ad_id"])
    after = M.score(PipelineModel.load(path), rows, ["display_id", "ad_id"], "again")
    return before.join(after, ["display_id", "ad_id"]).select("display_id", "ad_id", scored(), (F.col("prob") - F.col("again")).alias("difference"))


