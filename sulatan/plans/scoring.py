"""Queries on feature vectors and on labelled predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sulatan.operators import kernel as K
from sulatan.operators import metrics as M
from sulatan.operators.ranking import top_k
from sulatan.plans import views as V
from sulatan.plans.views import with_views

GAMMA = 0.5
THRESHOLD = 0.62


def _model(spark, sf):
    """Pairwise coefficients: +1 for vectors of the lower class, -1 for the higher."""
    sv = V.v_sv(spark, sf)
    classes = sv.select("class").distinct()
    # every class below another one, numbered in order of (i, j)
    both = classes.agg(F.sort_array(F.collect_set("class")).alias("c"))
    n, c = F.size("c"), F.col("c")
    ranks = both.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(
        F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > i),
        lambda j: F.struct((i * (2 * n - i - 1) / 2 + j - i - 1).cast("int").alias("pair_id"), F.get(c, i).alias("i"), F.get(c, j).alias("j")))))).alias("p"))
    pair = ranks.select("p.*", F.lit(0.0).alias("intercept"), F.lit(-2.0).alias("prob_a"), F.lit(0.1).alias("prob_b"))
    sides = pair.select("pair_id", F.explode(F.array(
        F.struct(F.col("i").alias("class"), F.lit(1.0).alias("coef")), F.struct(F.col("j").alias("class"), F.lit(-1.0).alias("coef")))).alias("s"))
    coef = sv.select("sv_id", "class").join(sides.select("pair_id", "s.*"), "class").select("sv_id", "pair_id", "coef")
    return sv, coef, pair


def _similarity(spark, sf):
    k = K.kernel_similarity(V.v_query_vec(spark, sf), V.v_sv(spark, sf), GAMMA)
    return k.select("vec_id", "sv_id", "class", F.round("k", 9).alias("k"))


def _decisions(spark, sf, **sizes):
    d = K.pair_decisions(V.v_query_vec(spark, sf), *_model(spark, sf), GAMMA, **sizes)
    p = K.platt_probability(F.col("decision"), F.col("prob_a"), F.col("prob_b"))
    return d.select("vec_id", "pair_id", "i", "j", (F.round("decision", 8) + F.lit(0.0)).alias("decision"), F.round(p, 8).alias("probability"))


def _vote(spark, sf):
    return K.ovo_vote(K.pair_decisions(V.v_query_vec(spark, sf), *_model(spark, sf), GAMMA))


def _top5(spark, sf):
    near = K.nearest_vectors(V.v_query_vec(spark, sf), V.v_sv(spark, sf), GAMMA)
    return near.select("vec_id", "rank", "sv_id", F.round("k", 9).alias("k"))


def _top3(spark, sf):
    k = K.class_similarity(V.v_query_vec(spark, sf), V.v_sv(spark, sf), GAMMA)
    per = k.select("vec_id", "class", F.round(F.col("k_sum") / F.col("n"), 9).alias("p"))
    return top_k(per, ["vec_id"], [F.col("p").desc(), F.col("class")], 3)


def _rejected(score):
    def run(spark, sf):
        f = K.familiarity(V.v_query_vec(spark, sf), V.v_sv(spark, sf), GAMMA, score)
        f = f.withColumn("familiarity", F.round("familiarity", 9))
        return K.reject_unknown_letters(f, THRESHOLD)
    return run


#: letters of a made-up word
WORD_LETTERS = 4


def _unknown_words(score, mode):
    """Words of four vectors each; every fifth word is in the dictionary."""
    def run(spark, sf):
        vectors = V.v_query_vec(spark, sf).withColumns({"p": F.col("vec_id") % 100 / F.lit(100.0), "word_id": F.floor(F.col("vec_id") / WORD_LETTERS)})
        f = K.familiarity(vectors, V.v_sv(spark, sf), GAMMA, score).withColumn("familiarity", F.round("familiarity", 9))
        letters = vectors.select("vec_id", "word_id", F.col("vec_id").alias("pos"), F.char(F.col("label") + 97).alias("char"))
        spelled = letters.filter("word_id % 5 = 0").groupBy("word_id").agg(F.sort_array(F.collect_list(F.struct("pos", "char"))).alias("l"))
        known = spelled.select(F.array_join("l.char", "").alias("word")).distinct()
        return K.reject_in_words(letters.join(f, "vec_id"), ["word_id"], known, THRESHOLD, mode)
    return run


def _joined(spark, sf):
    return M.label_prediction_join(*V.v_eval(spark, sf))


def _metrics(by):
    def run(spark, sf):
        out = M.classification_metrics(_joined(spark, sf), by=by)
        return out.select(*by, *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "total", "num_classes")
    return run


def _class_scores(spark, sf):
    out = M.class_scores(M.confusion_matrix(_joined(spark, sf)))
    return out.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


QUERIES = {
    "kernel_similarity": _similarity,
    "pair_decisions": _decisions,
    "ovo_vote": _vote,
    "top5_similarity": _top5,
    "top3_candidates": _top3,
    "unknown_letter_reject": _rejected("sim5"),
    "unknown_letter_reject_sim1": _rejected("sim1"),
    "unknown_letter_words_drop": _unknown_words("sim5", "drop"),
    "unknown_letter_words_mark": _unknown_words("sim1", "mark"),
    "unknown_letter_words_prob": _unknown_words("prob", "mark"),
    "label_prediction_join": _joined,
    "confusion_matrix": lambda s, d: M.confusion_matrix(_joined(s, d), by=["script_type"]),
    "class_scores": _class_scores,
    "classification_metrics": _metrics([]),
    "classification_metrics_by_script": _metrics(["script_type"]),
}

_PAIRS = """cl AS (SELECT DISTINCT class FROM v_sv),
    pr AS (SELECT (row_number() OVER (ORDER BY a.class, b.class) - 1)::INTEGER AS pair_id, a.class AS i, b.class AS j FROM cl a JOIN cl b ON a.class < b.class),
    dv AS (SELECT vec_id, pair_id, i, j, sum(CASE WHEN k.class = i THEN k.k ELSE -k.k END) AS decision FROM v_kernel k JOIN pr ON k.class IN (i, j) GROUP BY ALL)"""
_EVAL = """ev AS (SELECT l.doc_id AS item_id, quality AS actual, CASE WHEN toxic = 1 THEN 'Printed' ELSE 'Handwritten' END AS script_type,
    CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _sql_scores(by: str) -> str:
    key = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    same = f"AND e.{by} = c.{by}" if by else ""
    return f"""WITH {_EVAL}, c AS (SELECT DISTINCT {key} class FROM (SELECT {key} actual AS class FROM ev UNION SELECT {key} predicted FROM ev)),
    s AS (SELECT {('c.' + by + ',') if by else ''} class, count(*) FILTER (WHERE actual = class AND predicted = class) AS tp, count(*) FILTER (WHERE actual = class) AS support,
            count(*) FILTER (WHERE predicted = class) AS pred FROM c JOIN ev e ON true {same} GROUP BY ALL),
    p AS (SELECT *, CASE WHEN pred = 0 THEN 0 ELSE tp / pred::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall FROM s),
    f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p)"""


_MACRO = """round(sum(tp) / sum(support)::DOUBLE, 9) AS accuracy, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
    round(avg(f1), 9) AS f1, sum(support)::BIGINT AS total, count(*) AS num_classes FROM f"""

def _sql_unknown(score: str, mode: str) -> str:
    value = {"prob": "any_value(vec_id % 100 / 100.0::DOUBLE)", "sim1": "max(k)", "sim5": "avg(k) FILTER (WHERE rk <= 5)"}[score]
    kept = "''" if mode == "drop" else "'?'"
    return with_views(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY k DESC, sv_id) AS rk FROM v_kernel),
        f AS (SELECT vec_id, vec_id // {WORD_LETTERS} AS word_id, chr((any_value(label) + 97)::INTEGER) AS c, round({value}, 9) AS fam FROM r GROUP BY vec_id),
        w AS (SELECT word_id, string_agg(c, '' ORDER BY vec_id) AS word FROM f GROUP BY 1),
        d AS (SELECT DISTINCT word FROM w WHERE word_id % 5 = 0 AND length(word) > 1),
        x AS (SELECT f.*, word, fam < {THRESHOLD} AND word NOT IN (SELECT word FROM d) AS bad FROM f JOIN w USING (word_id)),
        o AS (SELECT word_id, word, string_agg(CASE WHEN bad THEN {kept} ELSE c END, '' ORDER BY vec_id) AS word_out, count(*) FILTER (WHERE bad) AS n_rejected FROM x GROUP BY 1, 2)
        SELECT *, {"'known'" if mode == "drop" else "CASE WHEN n_rejected > 0 THEN 'unknown_letters' ELSE 'known' END"} AS status FROM o {"WHERE word_out <> ''" if mode == "drop" else ""}""", "v_kernel")


ORACLES = {
    "unknown_letter_words_drop": _sql_unknown("sim5", "drop"),
    "unknown_letter_words_mark": _sql_unknown("sim1", "mark"),
    "unknown_letter_words_prob": _sql_unknown("prob", "mark"),
    "kernel_similarity": with_views("SELECT vec_id, sv_id, class, round(k, 9) AS k FROM v_kernel", "v_kernel"),
    "pair_decisions": with_views(f"""WITH {_PAIRS} SELECT vec_id, pair_id, i, j, round(decision, 8) + 0.0 AS decision,
        round(1 / (1 + exp(decision * -2.0 + 0.1)), 8) AS probability FROM dv""", "v_kernel", "v_sv"),
    "ovo_vote": with_views(f"""WITH {_PAIRS}, vt AS (SELECT vec_id, CASE WHEN decision > 0 THEN i ELSE j END AS class, count(*) AS votes FROM dv GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, class) AS rn FROM vt)
        SELECT vec_id, class AS predicted, votes FROM r WHERE rn = 1""", "v_kernel", "v_sv"),
    "top5_similarity": with_views("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY k DESC, sv_id) AS rank FROM v_kernel)
        SELECT vec_id, rank, sv_id, round(k, 9) AS k FROM r WHERE rank <= 5""", "v_kernel"),
    "top3_candidates": with_views("""WITH c AS (SELECT vec_id, class, round(avg(k), 9) AS p FROM v_kernel GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS rank FROM c) SELECT vec_id, class, p, rank FROM r WHERE rank <= 3""", "v_kernel"),
    "unknown_letter_reject": with_views(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY k DESC, sv_id) AS rank FROM v_kernel),
        f AS (SELECT vec_id, round(avg(k), 9) AS familiarity FROM r WHERE rank <= 5 GROUP BY ALL) SELECT *, familiarity < {THRESHOLD} AS rejected FROM f""", "v_kernel"),
    "unknown_letter_reject_sim1": with_views(f"""WITH f AS (SELECT vec_id, round(max(k), 9) AS familiarity FROM v_kernel GROUP BY ALL)
        SELECT *, familiarity < {THRESHOLD} AS rejected FROM f""", "v_kernel"),
    "label_prediction_join": f"WITH {_EVAL} SELECT * FROM ev",
    "confusion_matrix": f"""WITH {_EVAL}, c AS (SELECT DISTINCT script_type, class FROM (SELECT script_type, actual AS class FROM ev UNION SELECT script_type, predicted FROM ev))
        SELECT a.script_type, a.class AS actual, b.class AS predicted, (SELECT count(*) FROM ev WHERE ev.script_type = a.script_type AND actual = a.class AND predicted = b.class) AS n
        FROM c a JOIN c b ON a.script_type = b.script_type""",
    "class_scores": _sql_scores("") + " SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM f",
    "classification_metrics": _sql_scores("") + f" SELECT {_MACRO}",
    "classification_metrics_by_script": _sql_scores("script_type") + f" SELECT script_type, {_MACRO} GROUP BY script_type",
}
