"""Sources/sinks round trips, streaming reuse, and plan properties."""

import os

from pyspark.sql import functions as F

from tabsmith import sources as S
from tabsmith.operators import clean as C
from tabsmith.operators import profile as P
from tabsmith.plans import catalog as CAT
from tabsmith.plans.contacts import contacts, table
from tests.conftest import SF_SMALL


def test_csv_round_trip_with_na_vocabulary(spark, tmp_path):
    c = contacts(spark, SF_SMALL)
    # write numbers as text with NA markers mixed in, as a delimited export would
    txt = c.select("id", F.when(F.col("balance_n").isNull(), F.lit("NA"))
                   .otherwise(F.col("balance_n").cast("string")).alias("balance_n"),
                   F.when(F.col("id") % 7 == 0, F.lit("n/a")).otherwise(F.col("job")).alias("job"))
    path = str(tmp_path / "c.csv")
    S.write_table(txt, path, fmt="csv")
    back = S.read_table(spark, path, schema="id long, balance_n double, job string", fmt="csv")
    assert dict(back.dtypes)["balance_n"] == "double"
    exp = c.select("id", "balance_n", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("job")).alias("job"))
    assert back.exceptAll(exp).count() == 0 and exp.exceptAll(back).count() == 0


def test_column_info_json_to_domains(spark, tmp_path):
    c = contacts(spark, SF_SMALL)
    info = P.column_info(c.select("job", "marital", "age"))
    path = str(tmp_path / "info")
    S.write_report(info.withColumnRenamed("column_name", "column"), path)
    dom = S.read_domains(spark, path)
    got = {(r["column"], r["value"]) for r in dom.collect()}
    exp = {(k, r[0]) for k in ("job", "marital") for r in c.select(k).distinct().collect()}
    assert got == exp


def test_load_encoded_missing_mapping_warns(spark, tmp_path):
    t = str(tmp_path / "t")
    S.write_table(spark.range(3), t)
    import pytest
    with pytest.warns(UserWarning):
        table_df, mapping = S.load_encoded(spark, t, str(tmp_path / "nope"))
    assert mapping is None and table_df.count() == 3


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_in_any_oracle_query(spark):
    import __spark_entry__ as E
    for name in sorted(E.oracle_sql()):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_rule_filter_pushes_down(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    li = table(spark, SF_SMALL, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber")
    plan = _plan(C.apply_rules(li, CAT.LINEITEM_RULES))
    import re
    pushed = " ".join(re.findall(r"PushedFilters: \[[^\]]*\]", plan))
    for f in ("GreaterThanOrEqual(l_quantity,3.0)", "LessThanOrEqual(l_quantity,48.0)",
              "GreaterThanOrEqual(l_discount,0.01)", "GreaterThan(l_tax,0.0)"):
        assert f in pushed, pushed


def test_describe_reads_pruned_columns_three_times_at_most(spark, collected_plans):
    li = table(spark, SF_SMALL, "lineitem")
    with collected_plans(li) as plans:
        P.describe(li, ["l_quantity", "l_tax"])
    assert 1 <= len(plans) <= 3
    for plan in plans:
        assert plan.count("FileScan parquet") == 1
        assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_streaming_clean_matches_batch(spark, tmp_path):
    c = contacts(spark, SF_SMALL).drop("poutcome")
    src = str(tmp_path / "in")
    c.write.parquet(src)
    from tabsmith.streaming import clean_stream
    wm = C.WinsorModel.fit(c)
    stream = spark.readStream.schema(c.schema).parquet(src)
    q = (clean_stream(stream, winsor=wm).writeStream.format("memory").queryName("clean_out")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM clean_out")
    exp = wm.transform(C.apply_rules(c))
    assert got.count() == exp.count() and got.exceptAll(exp).count() == 0



def test_csv_keeps_quotes_breaks_and_blanks(spark, tmp_path):
    rows = [(1, 'say "hi"', 1.5), (2, "two\nlines", 2.0), (3, " lead", None), (4, "back\\slash,comma", -1.0)]
    df = spark.createDataFrame(rows, "id long, s string, x double")
    path = str(tmp_path / "q.csv")
    S.write_table(df, path, fmt="csv")
    back = S.read_table(spark, [str(tmp_path / "absent.csv"), path, str(tmp_path / "never.csv")], fmt="csv", multiline=True)
    assert [t for _, t in back.dtypes] == ["bigint", "string", "double"]
    assert sorted(map(tuple, back.collect())) == rows


def test_csv_types_by_pattern(spark, tmp_path):
    """Type suffixes and other Java spellings stay text; infinities and exponents are numbers."""
    rows = [("1d", "1", "1.5", "0x1p3", "inf", "99999999999999999999", "1_0"), ("2f", "+2", "2e3", "1", "-Infinity", "1", "2"),
            ("3D", "-3", ".5", None, "3.", None, "3")]
    names = ["suffix", "whole", "number", "hexa", "inf", "long", "grouped"]
    path = str(tmp_path / "t.csv")
    S.write_table(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), path, fmt="csv")
    back = S.read_table(spark, path, fmt="csv")
    assert dict(back.dtypes) == {"suffix": "string", "whole": "bigint", "number": "double", "hexa": "string", "inf": "double",
                                 "long": "double", "grouped": "string"}
    assert sorted(r.suffix for r in back.collect()) == ["1d", "2f", "3D"]
    assert sorted(r.inf for r in back.collect()) == [float("-inf"), 3.0, float("inf")]


def test_csv_is_split_between_tasks(spark, tmp_path):
    import pytest
    path = str(tmp_path / "big.csv")
    S.write_table(spark.range(60_000).select("id", F.lit('a "b", c').alias("s")).repartition(1), path, fmt="csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        back = S.read_table(spark, path, fmt="csv", schema="id long, s string")
        assert back.rdd.getNumPartitions() > 2
        assert back.count() == 60_000 and back.select("s").distinct().collect()[0].s == 'a "b", c'
        assert back.where("id IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    broken = str(tmp_path / "broken.csv")
    S.write_table(spark.createDataFrame([(1, "two\nlines"), (2, "x")], "id long, s string"), broken, fmt="csv")
    with pytest.raises(Exception, match="multiline=True"):
        S.read_table(spark, broken, fmt="csv", schema="id long, s string").collect()
    assert S.read_table(spark, broken, fmt="csv", multiline=True).count() == 2


def test_domains_of_any_size(spark, tmp_path):
    df = spark.range(1500).select(F.concat(F.lit("v"), "id").alias("v"), "id")
    doc = P.domain_document(df).withColumnRenamed("column_name", "column")
    S.write_table(doc, str(tmp_path / "long"), fmt="json")
    domain = S.read_domains(spark, str(tmp_path / "long")).withColumnRenamed("column", "column_name")
    assert domain.count() == 1500 and C.unexpected_values(df, domain, ["v"]).count() == 0
    import pytest
    S.write_report(P.column_info(df).withColumnRenamed("column_name", "column"), str(tmp_path / "cut"))
    with pytest.raises(Exception, match="domain list was cut"):
        S.read_domains(spark, str(tmp_path / "cut")).collect()
