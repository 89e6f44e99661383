"""SQL for the counterfactual operators."""

from oracles.views import sql

APPLICANTS = """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, l_quantity / 50.0::DOUBLE AS q, l_discount * 10.0::DOUBLE AS d,
    l_tax * 10.0::DOUBLE AS t, (l_linestatus = 'O')::INT::DOUBLE AS s, (l_returnflag = 'A')::INT::DOUBLE AS f FROM lineitem"""
C = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {}))".format
FLIPPED = f"SELECT *, {C('q')} AS cq, {C('d')} AS cd, {C('t')} AS ct, 0.0::DOUBLE AS cs, {C('f')} AS c_f FROM applicants"
SCORED = """SELECT *, 0.0::DOUBLE + q * 1.5::DOUBLE + d * -1.0::DOUBLE + t * -0.5::DOUBLE + s * -0.8::DOUBLE + f * 0.6::DOUBLE + 0.1::DOUBLE AS z0,
    0.0::DOUBLE + cq * 1.5::DOUBLE + cd * -1.0::DOUBLE + ct * -0.5::DOUBLE + cs * -0.8::DOUBLE + c_f * 0.6::DOUBLE + 0.1::DOUBLE AS z1 FROM flipped"""
L2 = "sqrt((cq - q) * (cq - q) + (cd - d) * (cd - d) + (ct - t) * (ct - t) + (cs - s) * (cs - s) + (c_f - f) * (c_f - f))"
MOVED = " + ".join(f"(abs({a} - {b}) > 0.01)::INT" for a, b in (("cq", "q"), ("cd", "d"), ("ct", "t"), ("cs", "s"), ("c_f", "f")))
VIEWS = {"applicants": APPLICANTS, "flipped": FLIPPED, "scored": SCORED}
STEPS = "unnest(range(0, 64))::INT AS dim, unnest(emb_a) AS a, unnest(emb_b) AS b"



def jittered(noise: float, sample: str) -> str:
    """Clipped features with Box-Muller noise from md5 draws; the flipped one is 0."""

    def draw(position: int, salt: str) -> str:
        return f"(('0x' || substring(md5(row_id || '|' || {sample} || '|{position}|{salt}|42'), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370497.0::DOUBLE"

    def moved(column: str, position: int) -> str:
        normal = f"sqrt(-2.0::DOUBLE * ln({draw(position, 'radius')})) * cos(2.0::DOUBLE * pi() * {draw(position, 'angle')})"
        return f"round_even({C(f'{column} + {noise}::DOUBLE * ({normal})')}, 6)"

    named = (("q", 0, "quantity"), ("d", 1, "discount"), ("t", 2, "tax"), ("f", 4, "flag"))
    return ", ".join(f"{moved(c, i)} AS {name}" for c, i, name in named) + ", 0.0::DOUBLE AS status"


ORACLES = {
    "k1_attribute_flip_noise": sql(f"SELECT row_id, {jittered(0.02, '0')} FROM applicants", **VIEWS),
    "k2_variants": sql(f"SELECT row_id, sample::INT AS sample, {jittered(0.01, 'sample')} FROM applicants, range(1, 6) g(sample)", **VIEWS),
    "k1_attribute_flip": sql("SELECT row_id, cq AS quantity, cd AS discount, ct AS tax, cs AS status, c_f AS flag FROM flipped", **VIEWS),
    "k3_explain_changes": sql("SELECT row_id, 'status' AS feature, s AS original, cs AS counterfactual, cs - s AS change FROM flipped WHERE abs(cs - s) > 0.01", **VIEWS),
    "k4_validation": sql(f"""SELECT count(*) AS n, count(*) FILTER (WHERE (z0 >= 0) <> (z1 >= 0)) AS n_flipped, round_even(avg(((z0 >= 0) <> (z1 >= 0))::INT), 6) AS flip_rate, round_even(avg({L2}), 6) AS mean_l2,
        round_even(min({L2}), 6) AS min_l2, round_even(max({L2}), 6) AS max_l2, round_even(avg({MOVED}), 6) AS mean_changed FROM scored""", **VIEWS),
    "k4_scored_rows": sql("SELECT row_id, round_even(1 / (1 + exp(-z0)), 6) AS p_original, round_even(1 / (1 + exp(-z1)), 6) AS p_counterfactual, (z0 >= 0) <> (z1 >= 0) AS prediction_changed FROM scored", **VIEWS),
    "k5_interpolate_linear": sql("SELECT pair_id, step::INT AS step, dim, round_even((1 - step / 4.0::DOUBLE) * a + step / 4.0::DOUBLE * b, 6) AS v FROM long, range(0, 5) g(step)", "pairs",
        long=f"SELECT pair_id, {STEPS} FROM pairs"),
    "k5_interpolate_slerp": sql("""SELECT pair_id, step::INT AS step, dim, round_even(CASE WHEN abs(c) > 0.9995 THEN (1 - step / 4.0::DOUBLE) * a + step / 4.0::DOUBLE * b
        ELSE sin((1 - step / 4.0::DOUBLE) * acos(c)) / sin(acos(c)) * a + sin(step / 4.0::DOUBLE * acos(c)) / sin(acos(c)) * b END, 6) AS v FROM long, range(0, 5) g(step)""", "pairs",
        long=f"SELECT pair_id, list_cosine_similarity(emb_a, emb_b) AS c, {STEPS} FROM pairs"),
    "k6_decision_boundary": sql("""SELECT pair_id, (za >= 0)::INT AS first_prediction, coalesce((SELECT min(s) FROM range(0, 21) g(s) WHERE ((1 - s / 20.0::DOUBLE) * za + s / 20.0::DOUBLE * zb >= 0) <> (za >= 0)), -1)::INT AS boundary_step
        FROM (SELECT pair_id, list_sum([x * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END for x, i in emb_a]) AS za, list_sum([x * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END for x, i in emb_b]) AS zb FROM pairs)""", "pairs"),
}
