"""Adherence panels against loops over the same rows."""

from collections import Counter, defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from repeatlens.operators import adherence, ranking
from repeatlens.operators.ranking import number_rows
from tests.frames import CLOCK, dispense_row, frame, random_dispenses, rows_of

ROWS = random_dispenses(900, seed=5)


@pytest.fixture(scope="module")
def dispense(spark):
    return frame(spark, "dispense", ROWS).cache()


def eligible(days=None, store=None, min_repeats=2, script=True):
    start = None if days is None else CLOCK - timedelta(days=days)
    return [
        r
        for r in ROWS
        if (r["TotalRepeats"] or 0) >= min_repeats
        and r["PatPharmSysID"]
        and (not script or r["OriginalScriptNumber"])
        and (start is None or r["DispensedDate"] >= start)
        and (store is None or r["StoreId"] == store)
    ]


def scripts(rows, with_store=True):
    grouped = defaultdict(list)
    for r in rows:
        key = (r["PatPharmSysID"], r["OriginalScriptNumber"], r["Drugname"], r["TotalRepeats"])
        grouped[key + ((r["StoreId"],) if with_store else ())].append(r)
    return grouped


@pytest.mark.parametrize("args", [{}, {"days": 30}, {"store": 3}, {"min_repeats": 5}])
def test_summary(dispense, args):
    grouped = scripts(eligible(**args))
    rates = [len(v) / (k[3] + 1) for k, v in grouped.items()]
    got = rows_of(
        adherence.adherence_summary(
            dispense, CLOCK, args.get("days"), args.get("store"),
            min_repeats=args.get("min_repeats", 2),
        )
    )[0]
    assert got["TotalScripts"] == len(grouped)
    assert got["TotalPatients"] == len({k[0] for k in grouped})
    assert got["FullyCompliantScripts"] == sum(len(v) == k[3] + 1 for k, v in grouped.items())
    assert got["HighCompliantScripts"] == sum(
        10 * len(v) > 8 * (k[3] + 1) for k, v in grouped.items()
    )
    assert got["LowCompliantScripts"] == sum(
        10 * len(v) < 5 * (k[3] + 1) for k, v in grouped.items()
    )
    assert got["OverallComplianceRate"] == pytest.approx(100 * sum(rates) / len(rates))


def test_fills_add_up_to_the_filtered_rows(dispense):
    got = adherence.patient_scripts(dispense, CLOCK).agg(F.sum("DispensedRepeats")).first()[0]
    assert got == len(eligible())


def test_exactly_eighty_percent_is_not_high(spark):
    # Four of five expected fills, and three of six.
    rows = [dispense_row(TotalRepeats=4, RepeatNo=n) for n in range(4)]
    rows += [
        dispense_row(OriginalScriptNumber="s2", TotalRepeats=5, RepeatNo=n) for n in range(3)
    ]
    got = rows_of(adherence.adherence_summary(frame(spark, "dispense", rows), CLOCK))[0]
    assert (got["HighCompliantScripts"], got["LowCompliantScripts"]) == (0, 0)


def test_medications_merge_stores(dispense):
    grouped = defaultdict(list)
    for key, rows in scripts(eligible(), with_store=False).items():
        grouped[key[2]].append((key, 100 * len(rows) / (key[3] + 1)))
    got = {r["Drugname"]: r for r in rows_of(adherence.medication_compliance(dispense, CLOCK))}
    assert set(got) == set(grouped)
    for drug, entries in grouped.items():
        assert got[drug]["TotalScripts"] == len(entries)
        assert got[drug]["FullyCompliant"] == sum(rate >= 100 for _, rate in entries)
        assert got[drug]["LowCompliance"] == sum(rate < 50 for _, rate in entries)
        assert got[drug]["AvgComplianceRate"] == pytest.approx(
            sum(rate for _, rate in entries) / len(entries)
        )


def test_repeat_buckets(dispense):
    rows = [r for r in eligible(script=False) if r["RepeatNo"] is not None]
    buckets = defaultdict(list)
    for r in rows:
        gap = (r["DispensedDate"].date() - r["DatePrescribed"].date()).days
        buckets["5+" if r["RepeatNo"] > 5 else str(r["RepeatNo"])].append(gap)
    got = rows_of(adherence.compliance_by_repeat(dispense, CLOCK))
    assert [r["RepeatNo"] for r in got] == ["0", "1", "2", "4", "5", "5+"]
    for r in got:
        gaps = buckets[r["RepeatNo"]]
        assert r["TotalDispenses"] == len(gaps)
        assert r["AvgDaysFromPrescription"] == int(sum(gaps) / len(gaps))


def test_gaps(dispense):
    expected = Counter()
    for key, rows in scripts(eligible()).items():
        highest = max((r["RepeatNo"] for r in rows if r["RepeatNo"] is not None), default=None)
        if highest is not None and highest < key[3]:
            expected[(*key, key[3] + 1 - len(rows))] += 1
    got = rows_of(adherence.medication_gaps(dispense, CLOCK, n=None))
    names = ("PatPharmSysID", "OriginalScriptNumber", "Drugname", "TotalRepeats", "StoreId",
             "MissedRepeats")
    assert Counter(tuple(r[n] for n in names) for r in got) == expected
    top = rows_of(adherence.medication_gaps(dispense, CLOCK, n=5))
    missed = sorted((-r["MissedRepeats"], -r["TotalRepeats"]) for r in got)
    assert [(-r["MissedRepeats"], -r["TotalRepeats"]) for r in top] == missed[:5]


def test_chronic_needs_ten_patients(spark):
    rows = [
        dispense_row(PatPharmSysID=f"p{i}", Drugname=drug, TotalRepeats=5 if i % 2 else 2)
        for drug, patients in (("rare", 9), ("common", 10))
        for i in range(patients)
    ]
    got = rows_of(adherence.chronic_medications(frame(spark, "dispense", rows), CLOCK))
    assert got == [
        {
            "Drugname": "common",
            "TotalPatients": 10,
            "TotalDispenses": 10,
            "AvgTotalRepeats": 3.5,
            "LongTermScripts": 5,
            "ChronicMedicationRate": 50.0,
        }
    ]


def test_one_store_equals_the_filtered_whole(dispense):
    for operator in (adherence.patient_scripts, adherence.medication_gaps):
        extra = {"n": None} if operator is adherence.medication_gaps else {}
        whole = operator(dispense, CLOCK, **extra).where("StoreId = 2")
        single = operator(dispense, CLOCK, store_id=2, **extra)
        assert Counter(whole.collect()) == Counter(single.collect())


@pytest.mark.parametrize(
    "operator",
    [adherence.medication_gaps, adherence.medication_compliance, adherence.adherence_summary],
)
def test_by_store_equals_one_call_per_store(dispense, operator):
    whole = rows_of(operator(dispense, CLOCK, by_store=True))
    for store in (1, 2, 3):
        single = rows_of(operator(dispense, CLOCK, store_id=store))
        mine = [{k: v for k, v in r.items() if k in single[0]} for r in whole if r["StoreId"] == store]
        assert [approximate(r) for r in mine] == [approximate(r) for r in single]


def approximate(row):
    return {k: round(v, 9) if isinstance(v, float) else v for k, v in row.items()}


def expected_positions(rows, group, order):
    """Positions by sorting each group in Python."""
    grouped = defaultdict(list)
    for r in rows:
        grouped[tuple(r[g] for g in group)].append(tuple(r[o] for o in order))
    result = Counter()
    for key, members in grouped.items():
        members.sort(key=lambda m: [(v is not None, v if v is not None else 0) for v in m])
        result.update((*key, *m, place) for place, m in enumerate(members, 1))
    return result


GROUP = ["StoreId", "PatPharmSysID", "OriginalScriptNumber"]
ORDER = ["RepeatNo", "DispensedDate", "Drugname", "TotalRepeats"]


@pytest.mark.parametrize("chunk", [100_000, 7, 1])
@pytest.mark.parametrize("parts", ["1", "8", "61"])
def test_positions_do_not_depend_on_how_groups_are_split(spark, conf, parts, chunk, monkeypatch):
    conf(shuffle__partitions=parts, adaptive__coalescePartitions__enabled="false")
    monkeypatch.setattr(ranking, "CHUNK", chunk)
    rows = [r for r in random_dispenses(300, seed=9) if all(r[g] is not None for g in GROUP)]
    # A third of all rows are copies of one row, another part only shares its script.
    copy = dispense_row(RepeatNo=2, Drugname=None)
    rows += [copy] * 150
    rows += [dispense_row(RepeatNo=n % 3, ScriptNo=n,
                          DispensedDate=CLOCK - timedelta(days=n % 5, hours=n % 7))
             for n in range(60)]
    df = frame(spark, "dispense", rows)
    got = number_rows(df, GROUP, ORDER)
    assert got.columns == [*GROUP, *ORDER, "_position"]
    assert Counter(tuple(r) for r in got.collect()) == expected_positions(rows, GROUP, ORDER)
    assert got.count() == len(rows)


def test_repeat_sequence_restarts_per_script(spark):
    rows = [dispense_row(RepeatNo=n, ScriptNo=n) for n in (3, 1, 2)]
    rows += [dispense_row(OriginalScriptNumber="s2", RepeatNo=4), dispense_row(TotalRepeats=1)]
    got = rows_of(adherence.repeat_sequence(frame(spark, "dispense", rows)))
    assert sorted((r["OriginalScriptNumber"], r["RepeatNo"], r["ExpectedSequence"]) for r in got) \
        == [("s1", 1, 1), ("s1", 2, 2), ("s1", 3, 3), ("s2", 4, 1)]
