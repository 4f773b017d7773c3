"""Workspaces as bundles of Parquet tables that can be taken in elsewhere under new ids, and stored objects that are read with a check.

    path/entities/<part>   the rows of a part, with a column id
    path/assets            (sha256, size, content), each content once
    path/owned             (part, id, role, sha256): whose contents these are
    path/manifest          (part, rows, fingerprint, columns), written last: without it there is no bundle
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.errors import FileError, require

OWNED, MANIFEST = "part string, id string, role string, sha256 string", "part string, rows long, fingerprint string, columns array<string>"


@dataclass(frozen=True)
class Links:
    """How parts refer to each other: columns that hold an id of a part, and columns of references (array of kind:id@version#hash) by kind."""

    ids: dict[tuple[str, str], str] = field(default_factory=dict)
    references: list[tuple[str, str]] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)


def _print(df: DataFrame) -> tuple[int, str]:
    """(rows, order-free fingerprint) of a table, in one pass."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
    n, *s = df.agg(F.count("*"), *sums).first()
    return n, "-".join(s)


def export_workspace(parts: dict[str, DataFrame], assets: DataFrame | None, path: str) -> None:
    """Writes parts (each with id) and assets (part, id, role, content) as a bundle. A content that several rows own is kept once."""
    spark = next(iter(parts.values())).sparkSession
    for name, df in parts.items():
        df.withColumn("id", F.col("id").cast("string")).write.parquet(f"{path}/entities/{name}")
    if assets is None:
        assets = spark.createDataFrame([], "part string, id string, role string, content binary")
    owned = assets.select("part", F.col("id").cast("string").alias("id"), "role", F.sha2("content", 256).alias("sha256"), F.col("content"))
    owned.drop("content").write.parquet(f"{path}/owned")
    # Who keeps a content is found on narrow rows; contents of the others aren't shuffled for it.
    keeper = spark.read.schema(OWNED).parquet(f"{path}/owned").groupBy("sha256").agg(F.min(F.struct("part", "id", "role")).alias("k")).select("sha256", "k.*")
    kept = owned.join(keeper, ["part", "id", "role", "sha256"], "left_semi")
    kept.select("sha256", F.octet_length("content").cast("long").alias("size"), "content").write.parquet(f"{path}/assets")
    rows = [(name, *_print(df), df.columns) for name in parts for df in [spark.read.parquet(f"{path}/entities/{name}")]]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def renewed(target: str, part: Column, old: Column) -> Column:
    """The id that a row has in the target workspace: shaped like a UUID, and the same each time, so a job may be run again."""
    h = F.sha2(F.concat_ws("\0", F.lit(target), part, old), 256)
    return F.when(old.isNotNull(), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


_REFERENCE = r"^([a-z]+):([^@#]+)(.*)$"


def import_workspace(spark: SparkSession, path: str, target: str, parts: list[str], links: Links, out: str) -> DataFrame:
    """Takes a bundle in below out, under new ids everywhere: (part, old, new).

    Nothing is written unless all holds: the bundle's parts are these (unsupported_schema), each as it was exported (entity_differs), no
    id twice in a part or null (duplicate_id), no id or reference to what isn't there (reference_missing), contents as their hashes
    say and owned by rows that are there (asset_differs, asset_owner_missing). New ids are a function of the old ones, so columns are
    changed where they stand; only the tests join. Null ids in columns refer to nothing, and references of other kinds stay.
    """
    manifest = {r.part: r for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()}
    require(set(manifest) == set(parts), "unsupported_schema", FileError)
    tables = {name: spark.read.parquet(f"{path}/entities/{name}") for name in parts}
    for name, df in tables.items():
        require((manifest[name].rows, manifest[name].fingerprint, list(manifest[name].columns)) == (*_print(df), df.columns), "entity_differs", FileError)
    ids = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("part"), "id")
        ids = one if ids is None else ids.unionByName(one)
    require(ids.groupBy("part", "id").count().where("count > 1 OR id IS NULL").isEmpty(), "duplicate_id", FileError)
    wanted = [tables[part].select(F.lit(to).alias("part"), F.col(f"`{c}`").cast("string").alias("id")).where("id IS NOT NULL") for (part, c), to in links.ids.items()]
    kind = F.create_map(*(F.lit(x) for pair in links.kinds.items() for x in pair)) if links.kinds else F.create_map().cast("map<string,string>")
    for part, c in links.references:
        each = tables[part].select(F.explode(F.col(f"`{c}`")).alias("r"))
        wanted.append(each.select(kind[F.regexp_extract("r", _REFERENCE, 1)].alias("part"), F.regexp_extract("r", _REFERENCE, 2).alias("id")).where("part IS NOT NULL"))
    for w in wanted:
        require(w.distinct().join(ids, ["part", "id"], "left_anti").isEmpty(), "reference_missing", FileError)
    owned, blobs = spark.read.schema(OWNED).parquet(f"{path}/owned"), spark.read.parquet(f"{path}/assets")
    require(owned.join(ids, ["part", "id"], "left_anti").isEmpty(), "asset_owner_missing", FileError)
    sound = blobs.where((F.sha2("content", 256) == F.col("sha256")) & (F.octet_length("content") == F.col("size"))).select("sha256")
    require(owned.where("sha256 IS NOT NULL").join(sound, "sha256", "left_anti").isEmpty() and blobs.select("sha256").join(sound, "sha256", "left_anti").isEmpty(), "asset_differs", FileError)

    def moved(r: Column) -> Column:
        of = kind[F.regexp_extract(r, _REFERENCE, 1)]
        return F.when(of.isNull(), r).otherwise(F.concat(F.regexp_extract(r, _REFERENCE, 1), F.lit(":"), renewed(target, of, F.regexp_extract(r, _REFERENCE, 2)), F.regexp_extract(r, _REFERENCE, 3)))

    for name, df in tables.items():
        new = {"id": renewed(target, F.lit(name), F.col("id"))}
        new |= {c: renewed(target, F.lit(to), F.col(f"`{c}`").cast("string")) for (part, c), to in links.ids.items() if part == name}
        new |= {c: F.transform(F.col(f"`{c}`"), moved) for part, c in links.references if part == name}
        df.withColumns(new).write.mode("overwrite").parquet(f"{out}/entities/{name}")
    owned.withColumn("id", renewed(target, F.col("part"), F.col("id"))).write.mode("overwrite").parquet(f"{out}/owned")
    blobs.write.mode("overwrite").parquet(f"{out}/assets")
    return ids.select("part", F.col("id").alias("old"), renewed(target, F.col("part"), F.col("id")).alias("new"))


def stored(spark: SparkSession, folder: str, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """(key, size, state, content) of wanted objects (key, sha256), keys being paths below folder: ready, missing, too_large or differs.

    Only an object that is as its hash says has its content; one of more than ``most`` bytes isn't read. Keys are unique.
    Spark's reader passes over objects without bytes, so those are missing.
    """
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.substring_index("path", f"{root.removeprefix('file://')}/", -1)
    small = files if most is None else files.where(F.col("length") <= most)
    read = small.select(below.alias("key"), F.col("content"), F.sha2("content", 256).alias("__is"))
    sizes = files.select(below.alias("key"), F.col("length").alias("size"))
    rows = wanted.join(sizes, "key", "left").join(read, "key", "left")
    state = F.when(F.col("size").isNull(), "missing").when(F.col("__is").isNull(), "too_large").when(F.col("__is") == F.col("sha256"), "ready").otherwise("differs")
    return rows.select("key", "size", state.alias("state"), F.when(state == "ready", F.col("content")).alias("content"))
