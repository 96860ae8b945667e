"""Splits that keep related records together: an incremental component table, merged by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policygrid.functions.text import NO_VALUE_BARE, NO_VALUE_EVEN, evened, evened_title, value_or_null
from policygrid.session import durable, file_system, release, require_columns, scratch

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Slots of the hash circle that new components are assigned by; so many counts reach the driver.
SLOTS = 4096
#: A component with at least this share of the rows is placed by itself; there can be at most 1 / share of them.
LARGE = 0.001


def record_keys(rows: DataFrame) -> DataFrame:
    """row_id, kind, key: the evened family id, family title and document id of each row; stand-ins join nothing."""
    require_columns(rows, "row_id", "family_id", "family_title", "document_id")
    kinds = {
        "family": value_or_null(evened(F.col("family_id"))),
        "title": value_or_null(evened_title(F.col("family_title")), NO_VALUE_BARE),
        "document": value_or_null(evened(F.col("document_id"))),
    }
    long = rows.select("row_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds.items()])).alias("x"))
    return long.select("row_id", "x.kind", "x.key").where(F.col("key").isNotNull() & ~F.col("key").isin(*NO_VALUE_EVEN))


def connect(edges: DataFrame) -> DataFrame:
    """node, label of every node of `edges` (u, v): the smallest node of its component.

    Each round takes the smallest label among the neighbours and then jumps: the
    label's own label replaces it, so a path halves per round. A round reads and
    writes tables in the shared folder; only a count reaches the driver. Rows of
    settled components leave the work.
    """
    both = durable(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v"), F.col("u"))).distinct(), "edges")
    labels = durable(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        # Hubs have many edges; the minimum is taken on the map side before the shuffle.
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        lower = durable(lower, "lower")
        jumped = lower.join(lower.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        after = durable(jumped.select("node", F.coalesce("far", "label").alias("label"), (F.col("moved") | (F.coalesce("far", "label") < F.col("label"))).alias("moved")), "labels")
        moved = after.where("moved").limit(1).count()
        release(lower)
        release(labels)
        labels = after
        if not moved:
            return labels.select("node", "label")


def components(rows: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """row_id, component of every row: the smallest row_id it is connected with through shared keys.

    Keys become the smallest row_id that has them; a row whose keys all have the
    same one needs no edge, so the graph that is iterated over is far smaller than
    the table. `state` is the persisted component table of earlier rows (kind, key,
    component): a key found there also links to its component.

    Rows without a usable key are their own component. Repeated rows share theirs;
    an empty table gives no rows.
    """
    long = durable(record_keys(rows), "keys")
    hub = long.groupBy("kind", "key").agg(F.min("row_id").alias("hub"))
    if state is not None:
        hub = hub.join(state.select("kind", "key", "component"), ["kind", "key"], "left")
    else:
        hub = hub.withColumn("component", F.lit(None).cast("long"))
    hub = hub.select("kind", "key", "hub", F.least("hub", F.coalesce("component", "hub")).alias("least"), "component")
    linked = long.join(hub, ["kind", "key"])
    per_row = durable(linked.groupBy("row_id").agg(F.array_compact(F.array_union(F.collect_set("least"), F.array_union(F.collect_set("hub"), F.collect_set("component")))).alias("hubs")), "hubs")
    edges = per_row.where(F.size("hubs") > 1).select(F.array_min("hubs").alias("v"), F.explode("hubs").alias("u")).where("u <> v")
    labels = connect(edges)
    release(long)
    first = rows.select("row_id").join(per_row.select("row_id", F.array_min("hubs").alias("node")), "row_id", "left").withColumn("node", F.coalesce("node", "row_id"))
    return first.join(labels, "node", "left").select("row_id", F.coalesce("label", "node").alias("component"))


def _fill(sizes: dict[str, float], shares: dict[str, float], total: float) -> str:
    """The split that is furthest below its share of `total`."""
    return max(shares, key=lambda s: (shares[s] * total - sizes[s], s))


def _place(size: DataFrame, have: dict[str, float], shares: dict[str, float], seed: int) -> DataFrame:
    """component, split of new components (component, n): they fill what `have` lacks of the shares.

    The few large ones are placed one by one, largest first, where most is lacking;
    the others by a hash circle of 4,096 slots cut where the shares are reached. Only
    the large components (at most 1,000) and the slots' counts reach the driver.
    """
    have = {s: float(have.get(s, 0.0)) for s in shares}
    placed = durable(size.withColumn("slot", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(SLOTS)).cast("int")), "components")
    total = sum(have.values()) + placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_large = F.col("n") >= max(2.0, LARGE * total)
    large: dict[int, str] = {}
    for r in sorted(placed.where(is_large).select("component", "n").collect(), key=lambda r: (-r["n"], r["component"])):
        large[r["component"]] = s = _fill(have, shares, total)
        have[s] += r["n"]
    slots: dict[int, str] = {}
    for r in sorted(placed.where(~is_large).groupBy("slot").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["slot"]):
        slots[r["slot"]] = s = _fill(have, shares, total)
        have[s] += r["n"]
    spark = size.sparkSession
    by_size = spark.createDataFrame(list(large.items()), "component long, chosen string")  # at most 1,000 rows
    by_slot = spark.createDataFrame(list(slots.items()), "slot int, cut string")  # at most 4,096 rows
    both = placed.join(F.broadcast(by_size), "component", "left").join(F.broadcast(by_slot), "slot", "left")
    return both.select("component", F.coalesce("chosen", "cut").alias("split"))


def assign_splits(member: DataFrame, shares: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """row_id, component, split, quarantined (never, as nothing was placed before) for the rows of components()."""
    split = _place(member.groupBy("component").agg(F.count(F.lit(1)).alias("n")), {}, shares or SPLITS, seed)
    return member.join(split, "component").select("row_id", "component", "split", F.lit(False).alias("quarantined"))


class ComponentTable:
    """The component table kept at `path` between runs; each update adds a version and rewrites none before.

    A version holds what its rows brought: `rows` (row_id, component) and `keys`
    (kind, key, component) as named then, `parts` (component, split, n_rows,
    quarantined) of the components it made or changed, and `names` (was, component):
    what each component that was ever merged into another is called now. `names`
    alone is written whole each time, as it has a row only per merged component. A
    version counts once its `rows`, written last, are complete. After
    `keep` versions the table is compacted into one, and those before are removed.
    """

    def __init__(self, spark, path: str, keep: int = 16) -> None:
        self.spark, self.path, self.keep = spark, path, keep

    def versions(self) -> list[int]:
        """Complete versions from the last compacted one on."""
        fs, root = file_system(self.spark, self.path)
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        done = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._there(f"{n}/rows/_SUCCESS"))
        whole = [v for v in done if self._there(f"v{v}/whole")]
        return [v for v in done if not whole or v >= whole[-1]]

    def _there(self, name: str) -> bool:
        fs, p = file_system(self.spark, f"{self.path}/{name}")
        return fs.exists(p)

    def _load(self, part: str, versions: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/v{v}/{part}" for v in versions])

    def _named(self, part: str, versions: list[int]) -> DataFrame:
        """A part of all versions, its components as they are called now."""
        names = self._load("names", versions[-1:]).select(F.col("was").alias("component"), F.col("component").alias("_now"))
        return self._load(part, versions).join(names, "component", "left").withColumn("component", F.coalesce("_now", "component")).drop("_now")

    def _parts(self, versions: list[int]) -> DataFrame:
        """component, split, n_rows, quarantined of the components there are now: of each its last version's entry."""
        last = self._load("parts", versions).groupBy("component").agg(F.max(F.struct("version", "split", "n_rows", "quarantined")).alias("x"))
        gone = self._load("names", versions[-1:]).select(F.col("was").alias("component"))
        return last.select("component", "x.split", "x.n_rows", "x.quarantined").join(gone, "component", "left_anti")

    def read(self) -> DataFrame | None:
        """row_id, component, split, quarantined of all rows so far; None before the first update."""
        v = self.versions()
        return self._named("rows", v).join(self._parts(v), "component").select("row_id", "component", "split", "quarantined") if v else None

    def update(self, rows: DataFrame, shares: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
        """Take in new rows; all rows so far with component and split. Rows that are known already are left as they are.

        Components that new rows connect are merged. A merged component keeps the
        split of the part with most rows; if its parts had different splits, or one
        was quarantined, all its rows are quarantined: they are related to rows of
        another split and must not be used. That stays so through later updates and
        merges until clear() is called. New components fill the deficits.
        """
        shares = shares or SPLITS
        v = self.versions()
        known = None
        if v:
            known = durable(self._named("keys", v).groupBy("kind", "key").agg(F.min("component").alias("component")), "known")
            rows = rows.join(self._load("rows", v).select("row_id"), "row_id", "left_anti")
        rows = durable(rows.select("row_id", "family_id", "family_title", "document_id"), "fresh")
        member = durable(components(rows, known), "member")
        fresh = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        keys = durable(record_keys(rows).join(member, "row_id").groupBy("kind", "key").agg(F.min("component").alias("component")), "new-keys")
        number = (v or [0])[-1] + 1
        to = f"{self.path}/v{number}"
        if v:
            parts = durable(self._parts(v), "parts")
            # The components the new rows meet, with what they are called from now on.
            met = durable(keys.join(known.withColumnRenamed("component", "was"), ["kind", "key"]).groupBy("was").agg(F.min("component").alias("component")), "met")
            held = met.join(parts.withColumnRenamed("component", "was"), "was")
            per_split = held.groupBy("component", "split").agg(F.sum("n_rows").alias("r"), F.max("quarantined").alias("q"))
            before = per_split.groupBy("component").agg(F.max(F.struct("r", "split"))["split"].alias("kept"), F.sum("r").alias("r"), ((F.count(F.lit(1)) > 1) | F.max("q")).alias("q"))
            sized = durable(fresh.join(before, "component", "full").select("component", F.coalesce("n", F.lit(0)).alias("n"), "kept", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("q", F.lit(False)).alias("q")), "sized")
            have = {r["split"]: r["n"] for r in parts.groupBy("split").agg(F.sum("n_rows").alias("n")).collect()}
            for r in sized.where("kept is not null").groupBy("kept").agg(F.sum("n").alias("n")).collect():
                have[r["kept"]] = have.get(r["kept"], 0) + r["n"]
            chosen = _place(sized.where("kept is null").select("component", "n"), have, shares, seed)
            part = sized.join(chosen, "component", "left").select("component", F.coalesce("kept", "split").alias("split"), (F.col("n") + F.col("r")).alias("n_rows"), F.col("q").alias("quarantined"))
            moved = met.where("was <> component")
            old = self._load("names", v[-1:]).join(moved.select(F.col("was").alias("component"), F.col("component").alias("_now")), "component", "left")
            names = old.select("was", F.coalesce("_now", "component").alias("component")).unionByName(moved.select("was", "component"))
        else:
            part = fresh.join(_place(fresh, {}, shares, seed), "component").select("component", "split", F.col("n").alias("n_rows"), F.lit(False).alias("quarantined"))
            names = self.spark.createDataFrame([], "was long, component long")
        keys.write.mode("overwrite").parquet(f"{to}/keys")
        part.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{to}/parts")
        names.write.mode("overwrite").parquet(f"{to}/names")
        member.write.mode("overwrite").parquet(f"{to}/rows")
        release(*([known, parts, met, sized] if v else []), rows, member, keys)
        if len(v) + 1 > self.keep:
            self.compact()
        return self.read()

    def clear(self, cleared: DataFrame) -> DataFrame:
        """Lift the quarantine of the components in `cleared` (component), once someone has decided that their split may stand."""
        v = self.versions()
        number = v[-1] + 1
        to = f"{self.path}/v{number}"
        self._parts(v).join(cleared.select("component").distinct(), "component", "left_semi").select("component", "split", "n_rows", F.lit(False).alias("quarantined"), F.lit(number).alias("version")).write.mode("overwrite").parquet(f"{to}/parts")
        self._load("names", v[-1:]).write.mode("overwrite").parquet(f"{to}/names")
        for part in ("keys", "rows"):
            self._load(part, v[-1:]).limit(0).write.mode("overwrite").parquet(f"{to}/{part}")
        return self.read()

    def compact(self) -> None:
        """All versions as one, the versions before removed once it is complete."""
        v = self.versions()
        number = v[-1] + 1
        to = f"{self.path}/v{number}"
        self._named("keys", v).groupBy("kind", "key").agg(F.min("component").alias("component")).write.mode("overwrite").parquet(f"{to}/keys")
        self._parts(v).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{to}/parts")
        self.spark.createDataFrame([], "was long, component long").write.mode("overwrite").parquet(f"{to}/names")
        fs, p = file_system(self.spark, f"{to}/whole")
        fs.create(p).close()
        self._named("rows", v).select("row_id", "component").write.mode("overwrite").parquet(f"{to}/rows")
        for old in v:
            fs.delete(file_system(self.spark, f"{self.path}/v{old}")[1], True)


def in_batches(rows: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """The component table of `rows` taken in as they came: those updated up to the median `updated_at` (or without one) first, then the later ones."""
    spark = rows.sparkSession
    table = ComponentTable(spark, scratch(spark, "components"))
    half = rows.agg(F.percentile_approx("updated_at", 0.5, 1000)).first()[0]
    late = F.coalesce(F.col("updated_at") > F.lit(half), F.lit(False))
    table.update(rows.where(~late), shares)
    return table.update(rows.where(late), shares)
