"""Small hand-made tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from repeatlens.sources.schemas import SCHEMAS

CLOCK = datetime(2024, 3, 15, 10, 30)


def frame(spark, table: str, rows: list[dict]):
    """A table in its declared schema; columns a row leaves out are null."""
    schema = SCHEMAS[table]
    return spark.createDataFrame([[row.get(f.name) for f in schema] for row in rows], schema)


def rows_of(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def dispense_row(**values) -> dict:
    row = {
        "PatPharmSysID": "p1",
        "OriginalScriptNumber": "s1",
        "ScriptNo": 1,
        "Drugname": "aspirin",
        "BrandName": "A",
        "DrugSchedule": "S4",
        "StoreId": 1,
        "TotalRepeats": 5,
        "RepeatNo": 1,
        "DispensedDate": CLOCK - timedelta(days=10),
        "DatePrescribed": CLOCK - timedelta(days=20),
        "DrugVal": "10.50",
        "PatientPrice": 4.25,
    }
    return row | values


def random_dispenses(n: int, seed: int = 1) -> list[dict]:
    """Rows with few different keys, nulls everywhere, and dates around the clock."""
    rng = random.Random(seed)
    return [
        dispense_row(
            PatPharmSysID=rng.choice(["p1", "p2", "p3", None]),
            OriginalScriptNumber=rng.choice(["s1", "s2", "s3", "s4", None]),
            ScriptNo=number,
            Drugname=rng.choice(["aspirin", "Ibuprofen", "100% salt", None]),
            BrandName=rng.choice(["A", "B", None]),
            DrugSchedule=rng.choice(["S4", "S8", "", None]),
            StoreId=rng.choice([1, 2, 3, None]),
            TotalRepeats=rng.choice([1, 2, 3, 5, 6, None]),
            RepeatNo=rng.choice([0, 1, 2, 4, 5, 6, 7, None]),
            DispensedDate=CLOCK
            + timedelta(days=rng.randint(-60, 2), hours=rng.choice([-9, 0, 0, 5])),
            DatePrescribed=CLOCK + timedelta(days=rng.randint(-80, 10)),
            DrugVal=f"{rng.randint(0, 5000) / 100:.2f}",
            PatientPrice=rng.choice([1.25, 3.5, None]),
        )
        for number in range(n)
    ]
