"""Numbers wider than their names: queries say what their SQL says, whose names are cut at six digits."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from stratavox.functions import scalars
from stratavox.sources import sequence

KEYS = [999_902, 999_905, 999_990, 1_000_000, 1_000_011, 1_000_012, 1_000_036, 1_000_777, 1_200_003]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide"))
    spark.createDataFrame([(k,) for k in KEYS], "p_partkey long").write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["missing_runs", "sequence_missing", "sequence_present", "pair_names"])
def test_wide_keys_are_named_as_in_sql(spark, wide, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{wide}/part.parquet/*.parquet')")
    want = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = contract.queries()[name](spark, wide).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


@pytest.mark.parametrize(("begin", "end"), [(0, 2_345), (3, 120), (5, 9_999), (17, 99), (12_000, 20_500)])
def test_names_of_fixed_width_stand_for_all_numbers_that_share_them(spark, begin, end):
    names = {f"{k:02d}" for k in (0, 1, 7, 10, 11, 20, 23, 24, 25, 98, 99)}
    files = spark.createDataFrame([(f"s_{n}.tif",) for n in sorted(names)] * 2 + [("s_5.tif",), ("s_006.tif",), ("s_123.tif",)], "name string")
    row = spark.createDataFrame([("s_", "tif", 2, begin, end)], "prefix string, file_type string, index_length int, seq_begin long, seq_end long")
    there = [i for i in range(begin, end + 1) if f"{i:02d}"[:2] in names]
    absent = sorted(set(range(begin, end + 1)) - set(there))
    assert sorted(r["index"] for r in sequence.present(row, files, fixed=True).collect()) == there
    assert sorted(r["index"] for r in sequence.missing(row, files, fixed=True).collect()) == absent
    runs = sorted((r["first"], r["last"]) for r in sequence.missing_runs(row, files, fixed=True).collect())
    assert [i for a, b in runs for i in range(a, b + 1)] == absent
    assert all(b + 1 < c for (_, b), (c, _) in zip(runs, runs[1:]))


def test_ranges_up_to_the_end_of_64_bits(spark):
    end = (1 << 63) - 2
    files = spark.createDataFrame([("s_92.tif",), ("s_93.tif",)], "name string")
    row = spark.createDataFrame([("s_", "tif", 2, end - 9, end)], "prefix string, file_type string, index_length int, seq_begin long, seq_end long")
    assert sequence.present(row, files, fixed=True).count() == 10 and sequence.missing(row, files, fixed=True).isEmpty()


def test_names_are_not_cut_unless_asked(spark):
    index, width = F.lit(1_234_567), F.lit(3)
    made = [f(index, *rest, **k) for f, rest in ((scalars.level_file_name, ()), (lambda i, **k: scalars.sequence_name(F.lit("s_"), i, width, F.lit("png"), **k), ())) for k in ({}, {"fixed": True})]
    got = tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(made)]).first())
    assert got == ("1234567.tif", "123456.tif", "s_1234567.png", "s_123.png")
