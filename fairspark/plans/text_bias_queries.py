"""Text-bias operators over customers, suppliers, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.functions.vectors import l2_normalise
from fairspark.operators import text_bias as tb
from fairspark.plans import views
from fairspark.plans.views import table


def _r(df, *cols, digits=6):
    return df.select(*[F.bround(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _distances(spark, sf):
    return tb.pair_distances(views.pairs(spark, sf))


def x1(spark, sf):
    return tb.prompt_pairs(table(spark, sf, "customer"), "c_custkey")


def x1_audit_set(spark, sf):
    return tb.audit_set(table(spark, sf, "supplier"), "s_suppkey")


def x2(spark, sf):
    return tb.stereotype_pairs(table(spark, sf, "supplier"), "s_suppkey", 3)


def x3(spark, sf):
    conv = table(spark, sf, "conversations")
    context = F.when(F.col("role") == "user", "Social").when(F.col("role") == "assistant", "professional").otherwise("unlisted")
    demographic = F.concat(F.col("role"), F.lit(" speaker"))
    return conv.select("conv_id", "turn", tb.frame_with_context(F.col("text"), demographic, context).alias("prompt"))


def x4(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", tb.hash_embedding(F.col("text")).alias("e"))
    return conv.select("conv_id", "turn", F.posexplode("e").alias("dim", "v")).select("conv_id", "turn", "dim", F.bround("v", 6).alias("v"))


def x5(spark, sf):
    out = tb.pool_embeddings(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", "dim", *[F.bround(F.col(c).cast("double"), 6).alias(c) for c in ("mean", "max", "first")])


def x6(spark, sf):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    emb = table(spark, sf, "embeddings").select("vec_id", F.posexplode(l2_normalise(v)).alias("dim", "v"))
    return _r(emb, "v")


def x7(spark, sf):
    return _r(_distances(spark, sf), "similarity", "distance")


def x8(spark, sf):
    return _r(tb.mean_cosine_matrix(table(spark, sf, "embeddings"), "label", "embedding"), "mean_cosine")


def x9(spark, sf):
    out = tb.mean_difference_test(_distances(spark, sf), "pair_id", "distance", F.col("category") < "c5")
    return _r(out, "observed", "p_value")


def x10(spark, sf):
    return _r(tb.score_pairs(_distances(spark, sf)), "distance").select("pair_id", "category", "distance", "level", "score")


def x11(spark, sf):
    return tb.bias_index(tb.score_pairs(_distances(spark, sf)))


def x12(spark, sf):
    return tb.summarise(tb.score_pairs(_distances(spark, sf)))


def x12_advice(spark, sf):
    return tb.recommendations(tb.summarise(tb.score_pairs(_distances(spark, sf))))


def x13(spark, sf):
    return tb.distance_histogram(_distances(spark, sf))


def x14(spark, sf):
    pairs = views.pairs(spark, sf)
    positive = pairs.select(
        "category", *[F.transform(c, lambda x: F.abs(x)).alias(c) for c in ("emb_a", "emb_b")]
    )
    a = tb.score_pairs(tb.pair_distances(pairs)).select(F.lit("signed").alias("model"), "category", "distance", "score", "level")
    b = tb.score_pairs(tb.pair_distances(positive)).select(F.lit("absolute").alias("model"), "category", "distance", "score", "level")
    return tb.compare_models(a.unionByName(b), "model", "signed", "absolute")


def x15(spark, sf):
    return tb.full_text_audit(views.pairs(spark, sf))


def x16(spark, sf):
    conv = table(spark, sf, "conversations")
    first = F.col("turn") % 2 == 0  # turns 0 and 1, 2 and 3, ... are pairs
    turns = conv.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(
        F.max(F.when(first, F.col("text"))).alias("sent_more"),
        F.max(F.when(~first, F.col("text"))).alias("sent_less"),
        F.max(F.when(first, F.upper("role"))).alias("bias_type"),
    )
    return tb.prepare_stereotype_corpus(turns, "sent_more", "sent_less", "bias_type")


QUERIES = {
    "x1_prompt_pairs": x1,
    "x1_audit_set": x1_audit_set,
    "x2_stereotype_pairs": x2,
    "x3_context_framing": x3,
    "x4_hash_embedding": x4,
    "x5_pooling": x5,
    "x6_l2_normalise": x6,
    "x7_cosine_distance": x7,
    "x8_mean_cosine_matrix": x8,
    "x9_mean_difference_test": x9,
    "x10_pair_scores": x10,
    "x11_bias_index": x11,
    "x12_dataset_summary": x12,
    "x12_recommendations": x12_advice,
    "x13_distance_histogram": x13,
    "x14_compare_models": x14,
    "x15_full_text_audit": x15,
    "x16_stereotype_corpus": x16,
}
