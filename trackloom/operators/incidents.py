"""Incidents that are kept between runs: a batch of reports joins the stored ones, and only what it touches is read and rewritten.

Reports lie in folders by blocks of days, each row with its incident. Reports of one incident are linked in steps of at most
a block, so a batch can touch incidents in its own blocks and those beside them only; an incident that gets another name
is followed from there, block by block, as far as it reaches. An incident is named by its least report, so the names don't
depend on the order of the batches, and n batches give what one run over all reports gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.spread import hot_least, join_by_key
from trackloom.operators.dedupe import ORACLES as ONE_RUN
from trackloom.operators.graph import connected_components
from trackloom.operators.joins import within_days
from trackloom.session import discard, fresh_path, materialize, remove
from trackloom.sources.standins import reports

ROW = "report_id long, category string, lat double, lon double, day int, incident long"
LIVE = "block int, folder string, rows long"


class Incidents:
    """A store in a folder. Each batch writes its own folders and then the list of live ones, so a batch that failed can be run again."""

    def __init__(self, spark: SparkSession, path: str, km: float = 50.0, days: int = 2):
        self.spark, self.path, self.km, self.days = spark, path.rstrip("/"), km, days

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def live(self, batch: int) -> dict[int, tuple[str, int]]:
        """Block: folder and rows, after a batch; there is an entry for each block of days that has reports."""
        if batch < 0:
            return {}
        if not self._exists(f"{self.path}/live-{batch}/_SUCCESS"):
            raise ValueError(f"batch {batch} hasn't been taken in")
        return {r["block"]: (r["folder"], r["rows"]) for r in self.spark.read.schema(LIVE).parquet(f"{self.path}/live-{batch}").collect()}

    def read(self, batch: int, blocks: set[int] | None = None) -> DataFrame:
        """Reports with their incidents after a batch, of some blocks or all."""
        folders = [f for b, (f, _) in sorted(self.live(batch).items()) if blocks is None or b in blocks]
        return self.spark.read.schema(ROW).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], ROW)

    def add(self, batch: int, new: DataFrame) -> dict[str, int]:
        """Takes in the reports (report_id, category, lat, lon, day) of a batch, numbered from 0 on; gives the blocks read and rewritten.

        Reports must be new: a report_id that is stored already in the batch's blocks is left as it is. Rows with a null id,
        category, place or day can't be linked or stored and are left out. Superseded incidents are listed by superseded().
        """
        width = self.days
        block = F.floor(F.col("day") / width).cast("int")
        live = self.live(batch - 1)
        rows = new.select(F.col("report_id").cast("long"), F.col("category").cast("string"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("day").cast("int")).dropna().dropDuplicates(["report_id"])
        rows = materialize(rows, "incident-batch", rows=F.count("*"))
        own = {r["b"] for r in rows.select(block.alias("b")).distinct().collect()}
        beside = {b + k for b in own for k in (-1, 0, 1)}
        old = self.read(batch - 1, beside)
        fresh = rows.join(old.select("report_id"), "report_id", "left_anti")
        both = old.unionByName(fresh.withColumn("incident", F.col("report_id")))
        edges = materialize(self._edges(fresh, both).distinct(), "incident-edges")
        named = materialize(connected_components(edges).where("node <> component"), "incident-names", rows=F.count("*"))
        count = named.measured["rows"] or 0
        renamed = named.select(F.col("node").alias("incident"), F.col("component").alias("now"))
        # the blocks that a renamed incident reaches: from those beside the batch outwards, while it is found there
        reach = beside & set(live)
        ahead = set(reach)
        while ahead and count:
            found = {r["b"] for r in self.read(batch - 1, ahead).join(renamed, "incident", "left_semi").select(block.alias("b")).distinct().collect()}
            ahead = ({b + k for b in found for k in (-1, 1)} & set(live)) - reach
            reach |= ahead
        touched = self.read(batch - 1, reach).unionByName(fresh.withColumn("incident", F.col("report_id")))
        members = touched.groupBy("incident").agg(F.count("*").alias("n"))
        keyed = renamed.join(members, "incident")
        moved = join_by_key(touched, keyed, "incident", hot_least(sum(n for b, (_, n) in live.items() if b in reach) + (rows.measured["rows"] or 0)))
        after = touched.join(renamed, "incident", "left_anti").unionByName(moved.withColumn("incident", F.col("now")).drop("now")).withColumn("block", block)
        # blocks without a new report or a renamed one keep their folder
        changed = own | ({r["b"] for r in moved.select(block.alias("b")).distinct().collect()} if count else set())
        after.where(F.col("block").isin(*changed) if changed else F.lit(False)).repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{self.path}/{batch}")
        renamed.select(F.col("incident").alias("id"), F.col("now").alias("by")).join(old.select(F.col("incident").alias("id")).distinct(), "id", "left_semi").write.mode("overwrite").parquet(f"{self.path}/superseded-{batch}")
        written = {r["block"]: r["n"] for r in self.spark.read.schema(ROW + ", block int").parquet(f"{self.path}/{batch}").groupBy("block").agg(F.count("*").alias("n")).collect()} if changed else {}
        now = {b: v for b, v in live.items() if b not in written} | {b: (f"{batch}/block={b}", n) for b, n in written.items()}
        self.spark.createDataFrame([(b, f, n) for b, (f, n) in sorted(now.items())], LIVE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live-{batch}")
        for t in (rows, edges, named):
            discard(t)
        return {"read": len(reach), "written": len(written)}

    def _edges(self, fresh: DataFrame, both: DataFrame) -> DataFrame:
        """Links of new reports with reports near in place and time, as pairs of incidents."""
        left = fresh.select("report_id", "category", "lat", "lon", "day")
        right = both.select("incident", "category", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("day").alias("day2"))
        near = within_days(left, right, self.km, self.days, ("category",), "report_id <> incident")
        return near.select(F.col("report_id").alias("u"), F.col("incident").alias("v"))

    def superseded(self, batch: int) -> DataFrame:
        """Incidents that a batch merged into others: id, by."""
        return self.spark.read.schema("id long, by long").parquet(f"{self.path}/superseded-{batch}")

    def drop_before(self, batch: int) -> None:
        """Removes the folders that no list from `batch` on names; older states can't be read any more."""
        used = {f.split("/")[0] for f, _ in self.live(batch).values()} | {str(batch)}
        for n in range(batch):
            if str(n) not in used:
                remove(self.spark, f"{self.path}/{n}")
            remove(self.spark, f"{self.path}/live-{n}")


def _taken_in(s, d) -> DataFrame:
    """The stand-in reports in four batches, as they might have come: by when the customer's order reached us."""
    store = Incidents(s, fresh_path(s, "incidents"))
    r = reports(s, d)
    lo, hi = r.agg(F.min("day"), F.max("day")).first()
    for k in range(4):
        # late reports of each quarter come with the next one
        arrived = F.col("day") + F.when(F.col("mentions") == 8, (hi - lo) // 4).otherwise(0)
        part = F.least(F.floor((arrived - lo) * 4 / (hi - lo + 1)), F.lit(3))
        store.add(k, r.where(part == k))
    return store.read(3).select("report_id", F.col("incident").alias("cluster"))


QUERIES = {"graph_incidents_kept": _taken_in}
ORACLES = {"graph_incidents_kept": ONE_RUN["graph_incident_clusters"]}
