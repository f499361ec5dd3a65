"""R8 and R10 on stored bitmaps: a table of (keys, day) with a measure and the set of its people, from which the distinct people, the active days and
the mean daily ratios of any period and any coarser key come without the people's names.

* ``<name>-names-<k>``: person -> number. Numbers are unique, dense within a task and put people of the same keys side by side, so that
  they share words.
* ``<name>-crew-<k>``: keys, day, word, measure, members. A set is stored as its non-zero words: 64 people of numbers 64 * word + bit, bit by bit in one
  long. ``bit_or`` unites them in hash aggregates (Spark's own bitmap aggregates sort, and move 4 kB for a set of three people), and a large set is
  spread over its words instead of lying in one row.

Both are mergeable: ``add`` appends the new names and the rows of a load as further parts under one commit; sets are united and measures added at
read time, so that late rows of an old day count right. A load that is known does nothing. Rows without a person count with their measure and add
nobody; a ratio over no people is null and stays out of the means.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import VersionedStore
from .dual import r2_col

BITS = 64  # people a word holds
NAMES_PER_TASK = 1_000_000


def _united(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("measure").alias("measure"), F.bit_or("members").alias("members"))


def _people() -> Column:
    return F.coalesce(F.sum(F.bit_count("members")), F.lit(0)).cast("long").alias("people")


class CrewTable:
    """The crews of one version of ``store``; make it with ``create`` and ``add``."""

    def __init__(self, store: VersionedStore, name: str, manifest: dict | None = None):
        self.store, self.name = store, name
        self.manifest = manifest or store.manifest()
        self.note = self.manifest["notes"][f"crews {name}"]

    @classmethod
    def create(cls, store: VersionedStore, name: str, keys: list[str], *, day: str, who: str, measure: str) -> CrewTable:
        """An empty table: ``keys`` and ``day`` are kept, ``who`` becomes a set, ``measure`` is summed."""
        taken = {"measure", "members", "word", "id"} & {*keys, day, who}
        if taken:
            raise ValueError(f"columns {sorted(taken)} are the table's own")
        base = store.manifest()
        store.commit({}, base, {f"crews {name}": {"keys": keys, "day": day, "who": who, "measure": measure, "loads": []}})
        return cls(store, name)

    def _parts(self, kind: str) -> DataFrame | None:
        tables = self.manifest["tables"]
        found = [self.store.full(tables[f"{self.name}-{kind}-{k}"]) for k in range(len(self.note["loads"]))]
        return self.store.spark.read.parquet(*found) if found else None

    def names(self) -> DataFrame | None:
        """person, number; None before the first load."""
        return self._parts("names")

    def rows(self) -> DataFrame:
        """keys, day, word, measure, members: a key, day and word may stand in several parts."""
        found = self._parts("crew")
        if found is None:
            raise ValueError(f"{self.name} has no load yet")
        return found

    def add(self, rows: DataFrame, load: str) -> CrewTable:
        """Append a load: one pass over ``who`` for the new names, one over the rows. The names' join is left to AQE, which measures both sides and
        splits a person with very many rows; the sets are built map-side before the shuffle on (keys, day, word)."""
        if load in self.note["loads"]:
            return self
        note, store, k = self.note, self.store, len(self.note["loads"])
        who, kept = note["who"], [*note["keys"], note["day"]]
        folders = {f"{self.name}-{kind}-{k}": store.new_folder(f"{self.name}-{kind}") for kind in ("names", "crew")}
        known = self.names()
        new = rows.where(F.col(who).isNotNull()).groupBy(who).agg(F.min(F.xxhash64(F.lit(0), *note["keys"])).alias("home"))
        start = 0
        if known is not None:
            new = new.join(known, who, "left_anti")
            start = ((known.agg(F.max("id")).first()[0] or 0) // BITS + 1) * BITS
        tasks = max(1, -(-new.count() // NAMES_PER_TASK))
        ordered = new.repartitionByRange(tasks, "home", who).sortWithinPartitions("home", who)
        numbered = ordered.select(who, (F.monotonically_increasing_id() + F.lit(start)).alias("id"))
        at = store.full(folders[f"{self.name}-names-{k}"])
        numbered.write.parquet(at)
        added = store.spark.read.schema(numbered.schema).parquet(at)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % BITS).cast("int"))
        placed = (rows.select(*kept, who, F.col(note["measure"]).alias("measure"))
                  .join(added if known is None else known.unionByName(added), who, "left")
                  .select(*kept, F.shiftright("id", 6).alias("word"), "measure", bit.alias("members")))
        _united(placed, *kept, "word").write.parquet(store.full(folders[f"{self.name}-crew-{k}"]))
        store.commit(folders, self.manifest, {f"crews {self.name}": {**note, "loads": [*note["loads"], load]}})
        return CrewTable(store, self.name)

    def productivity(self, keys: dict[str, Column], where: Column | None = None) -> DataFrame:
        """Per ``keys`` (expressions over the table's keys and day; none: one row): total, people, active_days, mean_people and mean_ratio
        (means over the days of the key, not rounded)."""
        rows = self.rows() if where is None else self.rows().where(where)
        day, names = F.col(self.note["day"]), list(keys)
        picked = rows.select(*[c.alias(n) for n, c in keys.items()], day.alias("__day"), "word", "measure", "members")
        return _measures(_united(picked, *names, "__day", "word"), names)

    def sections(self, sections: dict[str, Column], where: Column | None = None, conditions: dict[str, Column] | None = None) -> DataFrame:
        """Several sections, each of one key, from one scan: section, key (string) and the columns of ``productivity``. ``conditions`` limit a
        section's rows. The rows are united by all keys together before they meet the sections, so a set crosses the shuffle once a section and
        group, not once a stored row."""
        rows = self.rows() if where is None else self.rows().where(where)
        names, conditions = [f"__s{i}" for i in range(len(sections))], conditions or {}
        day = F.col(self.note["day"]).alias("__day")
        entries = [F.when(conditions.get(s, F.lit(True)), F.struct(F.lit(s).alias("section"), key.cast("string").alias("key")))
                   .alias(n) for n, (s, key) in zip(names, sections.items())]
        wide = _united(rows.select(*entries, day, "word", "measure", "members"), *names, "__day", "word")
        long = (wide.select(F.explode(F.array(*names)).alias("e"), "__day", "word", "measure", "members").where(F.col("e").isNotNull())
                .select("e.section", "e.key", "__day", "word", "measure", "members"))
        return _measures(_united(long, "section", "key", "__day", "word"), ["section", "key"])


def _measures(days: DataFrame, keys: list[str]) -> DataFrame:
    """From sets by (keys, day, word). Both branches use all columns, so that they share its exchange."""
    by_day = (days.groupBy(*keys, "__day").agg(F.sum("measure").alias("m"), _people())
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("active_days"), F.avg("people").alias("mean_people"),
                                  F.avg(F.when(F.col("people") != 0, F.col("m").cast("double") / F.col("people"))).alias("mean_ratio")))
    by_set = (_united(days, *keys, "word").groupBy(*keys)
              .agg(F.coalesce(F.sum("measure"), F.lit(0)).cast("long").alias("total"), _people()))
    both = by_set.unionByName(by_day, allowMissingColumns=True)
    out = ["total", "people", "active_days", "mean_people", "mean_ratio"]
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in out])


def two_decimals(df: DataFrame, *columns: str) -> DataFrame:
    """The named means as the dashboards show them: rounded, 0 where there is none."""
    return df.withColumns({c: F.coalesce(r2_col(F.col(c)), F.lit(0.0)) for c in columns})
