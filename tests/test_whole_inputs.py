from tidewheel.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_ols_scores_every_line(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert QUERIES["ols_score_all"](spark, SF).where("prediction is not null").count() == lines


def test_unique_lookup_reads_every_part(spark):
    parts = [r.asDict() for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    by = {}
    for p in parts:
        by.setdefault((p["p_brand"], p["p_type"], p["p_size"]), []).append(p["p_name"])
    found = [by.get((p["p_brand"], p["p_type"], p["p_size"] + 1), []) for p in parts]
    assert {min(len(f), 2) for f in found} == {0, 1, 2}
    got = {r.p_partkey: r.larger for r in QUERIES["lookup_unique_all"](spark, SF).collect()}
    assert got == {p["p_partkey"]: f[0] if len(f) == 1 else None for p, f in zip(parts, found, strict=True)}


def test_outer_total_leaves_no_row_out(spark):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    want = orders.agg({"o_totalprice": "sum"}).first()[0] + lines.agg({"l_extendedprice": "sum"}).first()[0]
    out = QUERIES["outer_merge_total_all"](spark, SF)
    assert abs(out.agg({"amount": "sum"}).first()[0] - want) < 1
    ordered, shipped = orders.selectExpr("date(o_orderdate) AS day").distinct(), lines.selectExpr("date(l_shipdate) AS day").distinct()
    assert out.count() == ordered.union(shipped).distinct().count()
    assert ordered.subtract(shipped).count() and shipped.subtract(ordered).count()
