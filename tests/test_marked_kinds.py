from pyspark.sql import functions as F

from logarc.functions import tokens


def test_marked_kinds_are_those_of_the_numbers(spark):
    limits = [2**63 - 1, 2**31 - 1, 2**25 - 1, 10**18 - 1, 9_199_999_999_999_999_999, 2_100_000_000]
    whole = [sign + str(limit + d) for limit in limits for d in (-1, 0, 1, 2) for sign in ("", "-", "0", "+")]
    found = [*whole, *(t[:i] + "." + t[i:] for t in whole for i in range(len(t) + 1)), "-0", "0", "1..2", "1.2.3", "00.10"]
    df = spark.createDataFrame([(t,) for t in found], "t string")
    for mode in ("int_only", "standard", "compact"):
        marked = df.withColumn("m", tokens.marked_message(F.concat(F.lit("x "), F.col("t"), F.lit(" y")), mode))
        coded = marked.withColumn("v", tokens.marked_variables(F.col("m"), mode)).withColumn("kind", tokens.classify_variable(F.col("t"), mode))
        assert coded.where("size(v) <> 1 OR v[0].text <> t OR v[0].kind <> kind").count() == 0
