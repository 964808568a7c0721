"""The refill page from a stored state: the latest dispense of every patient and drug.

The newest of two dispenses does not depend on the clock or on the order in which they
arrive, so the latest rows can be kept and merged: new dispenses are cut down to their
latest rows and meet the stored ones. A batch that is added twice changes nothing.

Latest rows and contacts are stored in buckets by patient and store. What is asked of them
needs no shuffle but the final sort: the join finds both sides in the same buckets. The
dispenses themselves are not bucketed, since a patient with a large share of all rows would
be one bucket; of the latest rows a patient has one for each drug.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import Clock
from ..operators import refills
from ..operators.filters import for_store, present, recent_window
from ..sources.schemas import SCHEMAS

BY = ["PatPharmSysID", "StoreId"]
CONTACTS = "PatPharmSysID STRING, StoreId INT, ContactEmail STRING"


@dataclass(frozen=True)
class RefillState:
    """A state in a folder that all executors share. States do not change: ``build`` and
    ``add`` write a new folder each and are simply repeated, into another folder, if the
    driver is lost. Call the constructor to open a finished one.

    ``buckets`` belongs to the folder: choose it so that a bucket of latest rows fits a task.
    """

    spark: SparkSession
    folder: str
    buckets: int = 200

    def build(self, dispense: DataFrame, contacts: DataFrame) -> RefillState:
        """Write the state of these tables. Columns beyond the declared ones are left out."""
        reachable = (
            present(contacts, "patientid", "storeid")
            .groupBy(
                F.col("patientid").cast("string").alias("PatPharmSysID"),
                F.col("storeid").try_cast("int").alias("StoreId"),  # no dispense has a larger one
            )
            .agg(F.min("contactemail").alias("ContactEmail"))
        )
        self._save(present(reachable, *BY), "contacts")
        self._save(_latest(dispense), "latest")
        return self

    def add(self, dispense: DataFrame, folder: str) -> RefillState:
        """The state after more dispenses, early or late ones, in a folder of its own."""
        after = RefillState(self.spark, folder, self.buckets)
        after._save(self.contacts(), "contacts")
        after._save(_latest(self.latest().unionByName(_latest(dispense))), "latest")
        return after

    def latest(self) -> DataFrame:
        return self._open("latest", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS["dispense"]))

    def contacts(self) -> DataFrame:
        return self._open("contacts", CONTACTS)

    def due(self, as_of: Clock, days: int = 3, store_id=None, require_drug: bool = True) -> DataFrame:
        """What ``refills.due_refills`` gives for all dispenses of the state."""
        rows = recent_window(for_store(self.latest(), store_id), "DispensedDate", as_of, refills.LOOK_BACK_DAYS)
        rows = present(rows, "Drugname") if require_drug else rows
        return refills.due_of_latest(rows, as_of, days).join(self.contacts(), BY)

    def predictions(self, as_of: Clock, days: int = 3, store_id=None) -> DataFrame:
        return refills.list_due(self.due(as_of, days, store_id), as_of)

    def summary(self, as_of: Clock, days: int = 3, store_id=None, by_store: bool = False) -> DataFrame:
        return refills.summarise_due(self.due(as_of, days, store_id, require_drug=False), as_of, days, by_store)

    def _save(self, df: DataFrame, part: str) -> None:
        name = f"refill_state_{uuid.uuid4().hex}"
        writer = df.repartition(self.buckets, *BY).write.format("parquet")
        writer.bucketBy(self.buckets, *BY).sortBy(*BY).option("path", f"{self.folder}/{part}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def _open(self, part: str, columns: str) -> DataFrame:
        """Buckets are known to the catalog only, so the files get an entry there, under a
        name that follows from the folder."""
        name = f"refill_state_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.folder}/{part}/{self.buckets}').hex}"
        by = ", ".join(BY)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
            f" CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS"
            f" LOCATION '{self.folder}/{part}'"
        )
        return self.spark.table(name)


def _latest(dispense: DataFrame) -> DataFrame:
    """Per store, patient and drug the newest dispense of a script with repeats."""
    rows = present(dispense.where(F.col("TotalRepeats") > 1), *BY)
    return refills.latest_dispense(rows.select(*SCHEMAS["dispense"].names))
