"""Queries that train and measure models; their results depend on the library's numerics, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webwarden.functions import decide, urls
from webwarden.operators import models as m
from webwarden.operators.registry import stratified_split
from webwarden.plans.decisions import _lex, signals
from webwarden.plans.training import table
from webwarden.session import materialize


def url_measures(spark, sf_dir):
    """(feature_id, label, 79 measures) of every scan; the label is whether the scan was matched to a brand."""
    t = table(spark, sf_dir, "lexical_features").filter("url is not null").select("feature_id", F.when(F.coalesce("matched_brand", F.lit("")) != "", 1).otherwise(0).alias("label"), urls.url_struct(F.col("url")).alias("s"))
    cols = urls.lexical_measures(F.col("s"))
    return materialize(t.select("feature_id", "label", *[F.coalesce(c, F.lit(0.0)).alias(k.replace(".", "_")) for k, c in cols.items()]), "measures"), [k.replace(".", "_") for k in cols]


def model_url_ensemble(spark, sf_dir):
    rows, names = url_measures(spark, sf_dir)
    split = stratified_split(rows, "feature_id", 0.8)
    model = m.ensemble(split.filter("is_train"), names, "label", "feature_id")
    return m.metrics(m.ensemble_score(model, split.filter("not is_train")), "label", "score")


def model_fusion(spark, sf_dir):
    f = decide.fusion_vector(_lex(), F.col("s_dom"), F.col("s_vis"))
    label = F.when(F.coalesce("page_brand", F.lit("")) != "", 1).otherwise(0)
    rows = materialize(signals(spark, sf_dir).select("scan_id", label.alias("label"), *[c.alias(k) for k, c in f.items()]), "vectors")
    split = stratified_split(rows, "scan_id", 0.8)
    model = m.boosted(split.filter("is_train"), decide.VECTOR, "label", "scan_id")
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(split.filter("not is_train")).select("label", F.round(vector_to_array("probability")[1], 4).alias("score"))
    return m.metrics(scored, "label", "score")


def model_ablation(spark, sf_dir):
    f = decide.fusion_vector(_lex(), F.col("s_dom"), F.col("s_vis"))
    label = F.when(F.coalesce("page_brand", F.lit("")) != "", 1).otherwise(0)
    rows = materialize(signals(spark, sf_dir).select("scan_id", label.alias("label"), *[c.alias(k) for k, c in f.items()]), "vectors")
    model = m.boosted(rows, decide.VECTOR, "label", "scan_id", trees=10)
    groups = {"lexical": decide.VECTOR[:13], "structure": ["s_dom", "discrepancy"], "visual": ["s_vis", "max_similarity", "impersonation"], "dns": decide.VECTOR[19:]}
    return m.ablation(model, rows, groups, "scan_id")


QUERIES = {f.__name__: f for f in (model_url_ensemble, model_fusion, model_ablation)}
SQL: dict[str, str] = {}
