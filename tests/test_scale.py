"""Plans and behaviour that matter when the tables are large."""

import random
import re
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from repeatlens.operators import adherence, filters, monitoring, ranking, refills, volumes
from repeatlens.sources.tables import load_tables
from tests.frames import CLOCK, frame, random_dispenses

SF_DIR = "/root/testdata/sf0.01"
NOT_SCALABLE = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
)


def plan(df, mode="formatted") -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_no_products_and_no_python(spark, conf, key):
    # As if every table were too large to broadcast.
    conf(autoBroadcastJoinThreshold="-1")
    text = plan(registry.queries()[key](spark, SF_DIR), "simple")
    assert [word for word in NOT_SCALABLE if word in text] == []
    # Rows meet in one partition only as merged partial aggregates.
    for match in re.finditer(r"(\w+)[^\n]*\n[^\n]*Exchange SinglePartition[^\n]*\n\s*\W*(\w+)", text):
        assert match.group(2) in ("HashAggregate", "SortAggregate", "ObjectHashAggregate")


@pytest.mark.parametrize("key", ["refill_predictions", "refill_summary", "store_ranking", "today_stats"])
def test_date_filters_reach_the_scan(spark, key):
    text = plan(registry.queries()[key](spark, SF_DIR))
    scan = next(line for line in text.splitlines() if "PushedFilters" in line and "l_shipdate" in line)
    assert "GreaterThanOrEqual(l_shipdate" in scan


def test_only_needed_columns_are_read(spark):
    text = plan(registry.queries()["daily_trend"](spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: (\S+)", text)
    assert "struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in schemas
    assert "struct<p_partkey:bigint>" in schemas


def test_filters_reach_a_stored_dispense_table(spark, tmp_path):
    for name in ("dispense", "contacts", "sales"):
        frame(spark, name, []).write.parquet(f"{tmp_path}/{name}.parquet")
    t = load_tables(spark, str(tmp_path))

    def pushed(df):
        return re.findall(r"PushedFilters: \[(.*)\]", plan(df))

    due = pushed(refills.refill_predictions(t.dispense, t.contacts, CLOCK, store_id=3))
    assert all(
        part in due[0]
        for part in (
            "EqualTo(StoreId,3)",
            "GreaterThanOrEqual(DispensedDate,2024-01-31T10:30)",
            "GreaterThan(TotalRepeats,1)",
            "IsNotNull(Drugname)",
            "IsNotNull(PatPharmSysID)",
        )
    )
    assert "EqualTo(storeid,3)" in due[1]
    today = pushed(volumes.today_stats(t.dispense, CLOCK))[0]
    assert "GreaterThanOrEqual(DispensedDate,2024-03-15T00:00)" in today
    assert "LessThan(DispensedDate,2024-03-16T00:00)" in today
    assert "EqualTo(StoreId,12)" in pushed(monitoring.last_sale(t.sales, store_id=12))[0]
    columns = re.findall(r"ReadSchema: struct<(.*)>", plan(volumes.schedule_mix(t.dispense, CLOCK)))
    assert columns == ["DrugSchedule:string"]


@pytest.mark.parametrize(
    "key",
    ["latest_dispense", "refill_predictions", "recent_errors", "heartbeat_pings", "top_drugs_by_store"],
)
def test_groups_are_cut_before_the_shuffle(spark, key):
    text = plan(registry.queries()[key](spark, SF_DIR), "simple")
    assert re.search(r"WindowGroupLimit .* Final", text)
    assert re.search(r"WindowGroupLimit .* Partial", text)


def test_top_lists_keep_few_rows_per_task(spark):
    for key in ("top_drugs", "store_ranking", "medication_gaps", "chronic_medications",
                "recent_dispenses", "page_rows"):
        assert "TakeOrderedAndProject" in plan(registry.queries()[key](spark, SF_DIR), "simple"), key


@pytest.mark.parametrize(
    "operator",
    [
        refills.latest_dispense,
        adherence.repeat_sequence,
        monitoring.last_dispense,
        volumes.recent_dispenses,
        lambda df: volumes.top_drugs(df, CLOCK),
        lambda df: adherence.medication_gaps(df, CLOCK),
        lambda df: adherence.chronic_medications(df, CLOCK),
    ],
)
def test_results_do_not_depend_on_the_partitioning(spark, conf, operator):
    rows = random_dispenses(400, seed=31)
    # Many equal dates, scripts and values, so that ties decide.
    for place, row in enumerate(rows):
        row["ScriptNo"], row["DrugVal"] = place % 3, "1.00"
        row["DispensedDate"] = CLOCK - timedelta(days=place % 4)
    results = []
    for seed, parts in ((1, "1"), (2, "7"), (3, "31")):
        conf(shuffle__partitions=parts, adaptive__enabled="false")
        shuffled = random.Random(seed).sample(rows, len(rows))
        df = frame(spark, "dispense", shuffled).repartition(int(parts))
        results.append(Counter(map(str, operator(df).collect())))
    assert results[0] == results[1] == results[2]


ROWS = 300_000


def skewed(spark):
    """A third of the rows belongs to one patient."""
    patient = F.when(F.col("id") % 3 == 0, "7").otherwise(F.col("id").cast("string"))
    return spark.range(ROWS).select(
        patient.alias("PatPharmSysID"), F.lit(1).alias("StoreId"), F.col("id").alias("ScriptNo")
    )


def everyone(spark):
    return spark.range(ROWS).select(
        F.col("id").cast("string").alias("patientid"),
        F.lit(1).cast("long").alias("storeid"),
        F.lit("a@example.com").alias("contactemail"),
    )


@pytest.mark.parametrize("kind", ["contact", "lookup", "insert"])
def test_a_hot_patient_is_split(spark, conf, kind):
    conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        adaptive__advisoryPartitionSizeInBytes="50KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
    )
    rows, people = skewed(spark), everyone(spark)
    keys = people.select(F.col("patientid").alias("PatPharmSysID"))
    known = keys.where("CAST(PatPharmSysID AS INT) >= 1000")
    df, expected = {
        "contact": lambda: (refills.dispense_with_contact(rows, people), ROWS),
        # Every key twice, which must not repeat a row.
        "lookup": lambda: (filters.lookup_by_keys(rows, keys.union(keys), ["PatPharmSysID"]), ROWS),
        # New are the hot patient's rows and those of the other ids below 1000.
        "insert": lambda: (
            filters.not_exists_insert(rows, known, ["PatPharmSysID"]),
            ROWS // 3 + sum(n % 3 != 0 for n in range(1000)),
        ),
    }[kind]()
    assert len(df.collect()) == expected
    assert "skew=true" in plan(df, "simple").split("Initial Plan")[0]


def test_a_hot_script_on_one_minute_is_numbered_in_ranges(spark, conf, monkeypatch):
    conf(shuffle__partitions="12", adaptive__coalescePartitions__enabled="false")
    kept = []

    def stored(df, write=ranking.stored):
        kept.append(write(df))
        return kept[-1]

    monkeypatch.setattr(ranking, "stored", stored)
    hot = F.col("id") % 3 == 0
    rows = spark.range(60_000).select(
        F.when(hot, 0).otherwise(F.col("id")).alias("script"),
        F.when(hot, F.lit("2024-01-01 10:00")).otherwise(F.col("id").cast("string")).alias("minute"),
        # Of the hot rows a half are copies of one row.
        F.when(hot & (F.col("id") % 2 == 0), F.lit(None)).otherwise(F.col("id")).alias("drug"),
    )
    got = ranking.number_rows(rows, ["script"], ["minute", "drug"])
    assert got.count() == 60_000
    spots = got.where("script = 0").agg(F.count_distinct("_position"), F.max("_position")).first()
    assert tuple(spots) == (20_000, 20_000)
    assert got.where("script = 0 AND drug IS NULL").agg(F.max("_position")).first()[0] == 10_000
    shares = [r["count"] for r in kept[0].groupBy("_range").count().collect()]
    assert max(shares) < 2 * 60_000 / 12
