"""Queries against their SQL on the odd inputs and larger tables of round 2's findings."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry


def both(spark, tmp_path, query, tables, setup=""):
    """Sorted rows of a query and of its SQL; tables: name -> (schema, rows)."""
    con = duckdb.connect()
    con.execute(setup or "SELECT 1")
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = [tuple(r) for r in entry.queries()[query](spark, str(tmp_path)).collect()]
    want = con.execute(entry.oracle_sql()[query]).fetchall()
    return sorted(got, key=repr), sorted(want, key=repr)


def test_customers_without_a_month_have_no_row(spark, tmp_path):
    day = lambda y, m: datetime.datetime(y, m, 3)
    rows = [(3, 1, day(2000, 2)), (6, 2, day(1999, 7)), (9, 2, day(1998, 1)), (10, 3, day(2001, 1))]  # 3, 6, 9 are open ranges, up to June 1999
    got, want = both(spark, tmp_path, "experience_total", {"orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp", rows)})
    assert got == want and [r[0] for r in got] == [2, 3]


ODD = [(i, [float((i * j) % 7 - 2) for j in range(1, 5)], f"l{i % 3}") for i in range(50)] + [(60, None, "l0"), (80, [0.0] * 4, "l1"), (100, [1.0, 2.0], "l2"), (120, [1.0, None, 3.0, 4.0], None)]


@pytest.mark.parametrize("query", ["vector_cosine_topk", "max_pool_by_label"])
def test_cosines_come_by_blocks_and_not_from_a_cross_join(spark, tmp_path, query):
    """Vectors repeat, so cosines tie. Null, zero and shorter ones have cosine 0."""
    kind = "vec_id long, embedding array<double>, label string"
    got, want = both(spark, f"{tmp_path}/a", query, {"embeddings": (kind, ODD[:50])})
    assert [tuple(r) for r in got] == want
    spark.createDataFrame(ODD, kind).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    d = entry.queries()[query](spark, f"{tmp_path}/b")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = d.collect()
    if query == "vector_cosine_topk":
        assert [r.vec_id for r in rows if r.query_id == 60 and r.cosine == 0.0] == list(range(10))


def test_letter_vectors_lower_a_text_once(spark):
    from pyspark.sql import functions as F

    from corpusloom.plans.built import letters

    assert str(letters(F.col("x"))).count("lower(") == 1
    got = spark.createDataFrame([("Aab!",), ("",)], "x string").select(letters(F.col("x")).alias("v")).collect()
    assert [round(x, 6) for x in got[0].v[:3]] == [0.894427, 0.447214, 0.0] and len(got[0].v) == 26 and set(got[1].v) == {0.0}


def test_the_analysis_computes_shared_steps_once(spark, tmp_path):
    """What is left of the plan reads rows at hand: no text is read, and none cut into lines, again for each of its uses."""
    rows = [(i,) for i in range(40)]
    got, want = both(spark, tmp_path, "analysed_resumes", {"customer": ("c_custkey long", rows)})
    assert got == want and len(got) == 40
    plan = entry.queries()["analysed_resumes"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and plan.count("Scan ExistingRDD") + plan.count("LogicalRDD") <= 3


def test_matches_of_a_date_range_are_zipped_and_not_searched_for_again(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators import facts

    d = spark.createDataFrame([("Jan 2001 - 3/2002, 2003 to present; 2009 - 2005",), ("none",), (None,)], "x string").select(facts.date_ranges(F.col("x")).alias("r"))
    assert d._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 3
    got = [[tuple(x) for x in r.r] for r in d.collect()]
    assert got == [[("Jan 2001 - 3/2002", 2001, 1, 2002, 3, False), ("2003 to present", 2003, None, None, None, True)], [], []]
