"""Items that appear together, kept as an incremental table of pair counts.

State: the bindings, the counts of items and the counts of pairs, each in buckets of a hash of its key, in a folder
all executors share. A change of bindings touches some baskets; only those emit signed pair and item deltas (new
minus old). Buckets that deltas fall into are written anew beside the old ones, the other files stay, and a list of
the buckets in force is written last; ``load`` is the change from nothing, ``open_table`` takes up a kept folder.
The scores of the touched pairs are computed anew: of all pairs, if the number of baskets changed, since every
ratio to chance depends on it.

Skew. With thresholds a pair is reported only if it is shared by ``least`` baskets or more. So up to ``least - 1``
baskets, the largest seen when they changed, are held out: they emit no pairs, each of their items is marked with
a bit for each, and their share in a pair's count is the number of common bits. Nothing is lost: a reported pair
shares at least one other basket and is found there. Items in fewer than ``least`` baskets or in so many that no
partner can reach ``ratio`` are left out of pair emission for the same reason, exactly. A basket that comes to be
held out or no more, and the baskets of an item that crosses one of these bounds, are touched by the change.
Baskets of many items are joined in blocks of items, so that no task holds a basket. Without thresholds every pair
is counted, and no basket is held out.

Defined cases: bindings with a null on either side don't count; repeated bindings count once; an empty table
gives no pairs; a change that removes a binding not present, or adds one present, changes nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.runtime import materialize, scratch_folder

LEAST, RATIO = 5, 8.0
BLOCK = 256  # items of a basket that are paired with one another in one step
ROWS_A_BUCKET, BUCKETS_LEAST, BUCKETS_MOST = 1_000_000, 8, 4096


def _bucket(n: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Buckets:
    """A table in buckets of a hash of its key: the folder of the files in force for each bucket that has rows."""

    spark: SparkSession
    schema: str
    key: tuple[str, ...]
    n: int
    folders: dict[int, str]

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all."""
        paths = sorted(f for b, f in self.folders.items() if only is None or b in only)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched_by(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with this table's key fall into: at most ``n`` numbers."""
        return sorted(r[0] for r in rows.select(_bucket(self.n, *self.key)).distinct().collect())

    def replaced(self, rows: DataFrame, touched: list[int], folder: str) -> "Buckets":
        """The table with ``rows`` in the place of the touched buckets, written to a new folder."""
        if not touched:
            return self
        placed = rows.withColumn("_b", _bucket(self.n, *self.key)).repartition(min(self.n, max(1, len(touched))), "_b")
        placed.write.partitionBy("_b").option("compression", "zstd").parquet(folder)
        name, files = _hadoop(self.spark, f"{folder}/_b=*")
        written = [int(f.getPath().getName().split("=")[1]) for f in files.globStatus(name) or []]
        return replace(self, folders={b: f for b, f in self.folders.items() if b not in touched} | {b: f"{folder}/_b={b}" for b in written})


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class PairTable:
    """bindings (basket, item); pairs (item_a, item_b, n) over the baskets not held out; items (item, n); big (basket, bit)
    held out; total baskets; the thresholds; and the folder and number of the version, None of a table counted at once."""

    bindings: DataFrame | Buckets
    pairs: DataFrame | Buckets
    items: DataFrame | Buckets
    total: int
    big: list[tuple]
    least: int
    ratio: float
    folder: str | None = None
    version: int = 0


def _read(part: DataFrame | Buckets) -> DataFrame:
    return part.read() if isinstance(part, Buckets) else part


def clean(bindings: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct ``(basket, item)`` without nulls."""
    return bindings.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct()


def emit_pairs(bindings: DataFrame) -> DataFrame:
    """``(basket, item_a, item_b)``, item_a < item_b, of each basket.

    Items are numbered in blocks within the basket by a hash; block pairs are joined by equality, so a basket
    of m items is spread over (m / BLOCK)^2 / 2 keys.
    """
    sizes = bindings.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(BLOCK))).cast("int")
    placed = bindings.join(sizes, "basket").where("size > 1").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    # an item of block k meets the keys (i, k) for i <= k and (k, j) for j >= k
    keys = F.transform(each, lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    keyed = placed.select("basket", "item", "block", F.explode(keys).alias("key")).select("basket", "item", "block", "key.i", "key.j")
    grouped = keyed.groupBy("basket", "i", "j").agg(F.sort_array(F.collect_list(F.struct("item", "block"))).alias("members"))
    first = grouped.select("basket", "i", "j", "members", F.posexplode("members").alias("at", "a"))
    later = F.slice("members", F.col("at") + 2, F.size("members"))
    paired = first.select("basket", "i", "j", "a", F.explode(later).alias("b"))
    # within an off-diagonal key only pairs across its two blocks count
    wanted = (F.col("i") == F.col("j")) | (F.col("a.block") != F.col("b.block"))
    return paired.where(wanted).select("basket", F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"))


def _useful(items: DataFrame, total: int, least: int, ratio: float) -> DataFrame:
    """Items that can be in a reported pair: n_ab <= min(n_a, n_b), so the ratio needs max(n_a, n_b) <= total / ratio."""
    return items.where((F.col("n") >= least) & (F.col("n") * ratio <= total)).select("item")


def _emitted(bindings: DataFrame, big: list[tuple], items: DataFrame, total: int, least: int, ratio: float) -> DataFrame:
    """``(item_a, item_b)`` of the baskets not held out and the items that can be in a reported pair."""
    light = bindings.where(~F.col("basket").isin([b for b, _ in big])) if big else bindings
    light = light.join(_useful(items, total, least, ratio), "item") if least > 1 or ratio > 0 else light
    return emit_pairs(light.select("basket", "item")).select("item_a", "item_b")


def build(bindings: DataFrame, least: int = LEAST, ratio: float = RATIO) -> PairTable:
    """The table over clean ``bindings``, counted at once and kept nowhere; for changes there is ``load``."""
    b = materialize(bindings, "bindings")
    sizes = b.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.count()
    big = _largest(sizes, least)
    items = materialize(b.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "items")
    pairs = materialize(_emitted(b, big, items, total, least, ratio).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n")), "pairs")
    return PairTable(b, pairs, items, total, big, least, ratio)


def load(bindings: DataFrame, least: int = 1, ratio: float = 0.0, folder: str | None = None) -> PairTable:
    """The table of clean ``bindings``, merged into an empty one as any later change is; of every pair unless thresholds are given.

    With ``folder`` the state is kept there; without, for the session only.
    """
    spark = bindings.sparkSession
    basket, item = (bindings.schema[c].dataType.simpleString() for c in ("basket", "item"))
    b = materialize(bindings.select("basket", "item").distinct(), "bindings")
    n = min(BUCKETS_MOST, max(BUCKETS_LEAST, -(-b.count() // ROWS_A_BUCKET)))
    empty = lambda schema, *key: Buckets(spark, schema, key, n, {})
    nothing = PairTable(
        empty(f"basket {basket}, item {item}", "basket"), empty(f"item_a {item}, item_b {item}, n bigint", "item_a", "item_b"), empty(f"item {item}, n bigint", "item"), 0, [], least, ratio, folder or scratch_folder(spark, "pair-table")
    )
    return _loaded(nothing, b)


def open_table(spark: SparkSession, folder: str) -> PairTable:
    """The latest version kept in a folder."""
    name, files = _hadoop(spark, f"{folder}/version-*")
    found = [int(f.getPath().getName().split("-")[1]) for f in files.globStatus(name) or []]
    if not found:
        raise FileNotFoundError(f"no pair table in {folder}")
    kept = json.loads(spark.read.text(f"{folder}/version-{max(found)}", wholetext=True).first()[0])
    parts = {c: Buckets(spark, p["schema"], tuple(p["key"]), p["n"], {int(b): f for b, f in p["folders"].items()}) for c, p in kept["parts"].items()}
    return PairTable(**parts, total=kept["total"], big=[tuple(x) for x in kept["big"]], least=kept["least"], ratio=kept["ratio"], folder=folder, version=max(found))


def _keep(table: PairTable) -> PairTable:
    """Write the list of the buckets in force; a version counts once it bears its name."""
    parts = {c: {"schema": p.schema, "key": p.key, "n": p.n, "folders": p.folders} for c, p in (("bindings", table.bindings), ("pairs", table.pairs), ("items", table.items))}
    text = json.dumps({"parts": parts, "total": table.total, "big": table.big, "least": table.least, "ratio": table.ratio})
    target, files = _hadoop(table.pairs.spark, f"{table.folder}/version-{table.version}")
    staged, _ = _hadoop(table.pairs.spark, f"{table.folder}/writing-{table.version}")
    out = files.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.rename(staged, target)
    return table


def _loaded(empty: PairTable, bindings: DataFrame) -> PairTable:
    """The change from nothing: all deltas are positive, every bucket is written, and nothing is read back."""
    rows = f"{empty.folder}/rows-1"
    every = list(range(empty.pairs.n))
    count = F.count(F.lit(1)).alias("n")
    items = empty.items.replaced(bindings.groupBy("item").agg(count), every, f"{rows}/items")
    sizes = materialize(bindings.groupBy("basket").agg(F.count(F.lit(1)).alias("size")), "sizes")
    total = sizes.count()
    big = _largest(sizes, empty.least)
    pairs = _emitted(bindings, big, items.read(), total, empty.least, empty.ratio).groupBy("item_a", "item_b").agg(count)
    return _keep(replace(empty, bindings=empty.bindings.replaced(bindings, every, f"{rows}/bindings"), pairs=empty.pairs.replaced(pairs, every, f"{rows}/pairs"), items=items, total=total, big=big, version=1))


def _largest(sizes: DataFrame, least: int, held: dict | None = None) -> list[tuple]:
    """``(basket, bit)`` of the ``least - 1`` largest baskets; those held out before keep their bit."""
    top = [r["basket"] for r in sizes.orderBy(F.desc("size"), "basket").limit(least - 1).collect()] if least > 1 else []
    kept = {b: k for b, k in (held or {}).items() if b in top}
    free = iter([k for k in range(least - 1) if k not in kept.values()])
    return [(b, kept[b] if b in kept else next(free)) for b in top]


def _marks(bindings: Buckets, big: list[tuple]) -> DataFrame:
    """``(item, big)``: a bit for each basket held out that the item is in; only their buckets are read."""
    spark = bindings.spark
    rows = spark.createDataFrame([(b, 1 << k) for b, k in big], f"basket {bindings.read([]).schema['basket'].dataType.simpleString()}, mask int")
    return bindings.read(bindings.touched_by(rows) if big else []).join(F.broadcast(rows), "basket").groupBy("item").agg(F.sum("mask").cast("int").alias("big"))


def _summed(old: DataFrame, deltas: DataFrame, *key: str) -> DataFrame:
    return old.unionByName(deltas.withColumnRenamed("d", "n")).groupBy(*key).agg(F.sum("n").alias("n")).where("n > 0")


def _changed(table: PairTable, changes: DataFrame) -> tuple[PairTable, DataFrame, DataFrame]:
    """The table after a change ``(basket, item, sign)``, and the signed deltas of pairs and of items it was made by."""
    if table.folder is None:
        raise ValueError("a table counted at once takes no changes; use load()")
    folder = f"{table.folder}/rows-{table.version + 1}"
    net = changes.where(F.col("basket").isNotNull() & F.col("item").isNotNull()).groupBy("basket", "item").agg(F.signum(F.sum("sign")).cast("int").alias("sign")).where("sign <> 0")
    net = materialize(net, "net-changes")
    near = table.bindings.touched_by(net)
    present = table.bindings.read(near).withColumn("_here", F.lit(1))
    real = materialize(net.join(present, ["basket", "item"], "left").where((F.col("sign") > 0) == F.col("_here").isNull()).select("basket", "item", "sign"), "changes")
    touched_buckets = table.bindings.touched_by(real)
    before = table.bindings.read(touched_buckets)
    gone, come = real.where("sign < 0").select("basket", "item"), real.where("sign > 0").select("basket", "item")
    bindings = table.bindings.replaced(before.join(gone, ["basket", "item"], "left_anti").unionByName(come), touched_buckets, f"{folder}/bindings")

    item_deltas = materialize(real.groupBy("item").agg(F.sum("sign").alias("d")).where("d <> 0"), "item-deltas")
    touched_items = table.items.touched_by(item_deltas)
    items = table.items.replaced(_summed(table.items.read(touched_items), item_deltas, "item"), touched_items, f"{folder}/items")

    baskets = real.select("basket").distinct()
    size = lambda part: part.read(touched_buckets).join(baskets, "basket", "left_semi").groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    sizes_after = materialize(size(bindings), "sizes")
    total = table.total + sizes_after.count() - size(table.bindings).count()

    # of the baskets held out and those of the change the largest are held out from now on, least - 1 at most
    held = {b: k for b, k in table.big}
    rows = table.pairs.spark.createDataFrame([(b,) for b in held], before.select("basket").schema)
    old_sizes = bindings.read(bindings.touched_by(rows) if held else []).join(F.broadcast(rows), "basket", "left_semi").groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    big = _largest(sizes_after.union(old_sizes).distinct(), table.least, held)
    top = [b for b, _ in big]
    moved = [b for b in {*held, *top} if not (b in held and b in top)]

    spark = table.pairs.spark
    touched = baskets.union(spark.createDataFrame([(b,) for b in moved], baskets.schema)) if moved else baskets
    if table.least > 1 or table.ratio > 0:
        was = _useful(table.items.read(), table.total, table.least, table.ratio).withColumn("was", F.lit(True))
        now = _useful(items.read(), total, table.least, table.ratio).withColumn("now", F.lit(True))
        flips = was.join(now, "item", "full_outer").where(F.col("was").isNull() | F.col("now").isNull()).select("item")
        # bindings that were there and are no more belong to touched baskets anyway
        touched = touched.union(bindings.read().join(flips, "item", "left_semi").select("basket"))
    touched = materialize(touched.distinct(), "touched-baskets")
    old = _emitted(table.bindings.read().join(touched, "basket", "left_semi"), table.big, table.items.read(), table.total, table.least, table.ratio).withColumn("d", F.lit(-1))
    new = _emitted(bindings.read().join(touched, "basket", "left_semi"), big, items.read(), total, table.least, table.ratio).withColumn("d", F.lit(1))
    pair_deltas = materialize(old.unionByName(new).groupBy("item_a", "item_b").agg(F.sum("d").alias("d")).where("d <> 0"), "pair-deltas")
    touched_pairs = table.pairs.touched_by(pair_deltas)
    pairs = table.pairs.replaced(_summed(table.pairs.read(touched_pairs), pair_deltas, "item_a", "item_b"), touched_pairs, f"{folder}/pairs")
    return _keep(replace(table, bindings=bindings, pairs=pairs, items=items, total=total, big=big, version=table.version + 1)), pair_deltas, item_deltas


def merge(table: PairTable, changes: DataFrame) -> tuple[PairTable, DataFrame]:
    """The table after a change ``(basket, item, sign)``, and the scores of the pairs whose count or whose items' counts it touched.

    If the number of baskets changed, these are all pairs. Equal to loading anew the changed bindings.
    """
    new, pair_deltas, item_deltas = _changed(table, changes)
    if new.total != table.total:
        return new, scores(new)
    by_item = item_deltas.select("item")
    pairs = new.pairs.read().select("item_a", "item_b")
    ends = pairs.join(by_item.withColumnRenamed("item", "item_a"), "item_a", "left_semi").unionByName(pairs.join(by_item.withColumnRenamed("item", "item_b"), "item_b", "left_semi"))
    touched = pair_deltas.select("item_a", "item_b").unionByName(ends).distinct()
    return new, scores(new).join(touched, ["item_a", "item_b"], "left_semi")


def scores(table: PairTable) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, baskets, lift)`` of the pairs in the table."""
    items = _read(table.items).select("item", "n")
    if table.big:
        marks = _marks(table.bindings, table.big) if isinstance(table.bindings, Buckets) else table.bindings.join(F.broadcast(_bits(table)), "basket").groupBy("item").agg(F.sum("mask").cast("int").alias("big"))
        items = items.join(marks, "item", "left").withColumn("big", F.coalesce("big", F.lit(0)))
    else:
        items = items.withColumn("big", F.lit(0))
    a = items.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"), F.col("big").alias("big_a"))
    b = items.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"), F.col("big").alias("big_b"))
    both = _read(table.pairs).select("item_a", "item_b", "n").join(a, "item_a").join(b, "item_b")
    n_ab = F.col("n") + F.bit_count(F.col("big_a").bitwiseAND(F.col("big_b")))
    return both.select("item_a", "item_b", n_ab.alias("n_ab"), "n_a", "n_b", F.lit(table.total).cast("bigint").alias("baskets")).withColumn("lift", F.col("n_ab") * F.col("baskets") / (F.col("n_a") * F.col("n_b")))


def _bits(table: PairTable) -> DataFrame:
    kind = table.bindings.schema["basket"].dataType.simpleString()
    return table.bindings.sparkSession.createDataFrame([(b, 1 << k) for b, k in table.big], f"basket {kind}, mask int")


def associated(table: PairTable, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """The scored pairs shared by ``least`` baskets and ``ratio`` times as often as by chance."""
    return scores(table).where((F.col("n_ab") >= least) & (F.col("n_ab") * F.col("baskets") >= F.lit(ratio) * F.col("n_a") * F.col("n_b")))
