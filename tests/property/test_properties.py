from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusframe.functions import dna, packed, rounding

SOME = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SOME
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200), st.integers(-6, 8))
def test_rounding_is_pythons(spark, values, nd):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = {r["k"]: r["r"] for r in df.select("k", rounding.py_round(F.col("v"), nd).alias("r")).collect()}
    assert got == {k: round(v, nd) for k, v in enumerate(values)}


@SOME
@given(st.lists(st.text("ACGTN", max_size=168), min_size=1, max_size=30))
def test_packing_and_complement_round_trip(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    s = F.col("s")
    again = df.select("s", packed.bases(packed.pack(s)).alias("p"), dna.reverse_complement(dna.reverse_complement(s)).alias("c"))
    assert all(r["s"] == r["p"] == r["c"] for r in again.collect())
