"""The vault as tables: known entities of all sessions, kept between runs, looked up by join and grown by union.

entities: (session, placeholder, entity_type, canonical, aliases array<string>, value double, created_turn, last_seen_turn), a
row per token of a session. Indexes are views of it and never stored, so they can't go stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions import grammar, taxonomy
from hushframe.operators import compaction, detect

COLUMNS = ("session", "placeholder", "entity_type", "canonical", "aliases", "value", "created_turn", "last_seen_turn")
#: Folders a stored vault is cut into by a hash of the session, so that a save rewrites only those it touches.
BUCKETS = 64


def prune(entities: DataFrame) -> DataFrame:
    """Without what stands for a token itself: aliases that hold one go, and entities whose canonical surface does."""
    clean = F.filter(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: (a != "") & ~a.rlike(grammar.PLACEHOLDER))
    return entities.filter(~F.col("canonical").rlike(grammar.PLACEHOLDER)).withColumn("aliases", clean)


def number_of(placeholder: Column) -> Column:
    return F.regexp_extract(placeholder, r"_(\d+)>>$", 1).cast("long")


def surfaces(entities: DataFrame, key: Column | None = None) -> DataFrame:
    """(session, surface, placeholder): every surface of a session and the token it stands for; of several the one created last.

    key: a function's column over `surface` by which surfaces count as equal, as the alias key does.
    """
    rows = entities.select("session", "placeholder", "created_turn", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("surface"))
    if key is not None:
        rows = rows.withColumn("surface", key)
    rows = rows.filter("surface <> ''")
    return rows.groupBy("session", "surface").agg(F.max_by("placeholder", F.struct("created_turn", number_of(F.col("placeholder")))).alias("placeholder"))


def lookup(asked: DataFrame, entities: DataFrame, surface: str = "surface", strict: str | None = None) -> DataFrame:
    """asked(session, surface, ...) with placeholder: by the surface itself, else by its alias key, else null.

    strict: a column that says of which surfaces the whole text counts, as it does of all numbers ($1,200.5 isn't $120.05); such
    entities of the vault have no alias key then.
    """
    named = entities if strict is None else entities.filter(~F.col("entity_type").isin(*sorted(taxonomy.COMPUTABLE)))
    exact = surfaces(entities).select(F.col("session").alias("_s"), F.col("surface").alias("_exact"), F.col("placeholder").alias("_p1"))
    loose = surfaces(named, grammar.alias_key(F.col("surface"))).select(F.col("session").alias("_s2"), F.col("surface").alias("_loose"), F.col("placeholder").alias("_p2"))
    key = grammar.alias_key(F.col(surface))
    df = asked.withColumn("_key", key if strict is None else F.when(~F.col(strict), key))
    df = df.join(exact, df["session"].eqNullSafe(F.col("_s")) & (F.col(surface) == F.col("_exact")), "left")
    df = df.join(loose, df["session"].eqNullSafe(F.col("_s2")) & (F.col("_key") == F.col("_loose")), "left")
    return df.withColumn("placeholder", F.coalesce("_p1", "_p2")).drop("_s", "_exact", "_p1", "_key", "_s2", "_loose", "_p2")


def register(entities: DataFrame, seen: DataFrame) -> DataFrame:
    """Entities after surfaces were seen again: new aliases are added, first and last turn follow. seen: (session, placeholder, surface, turn)."""
    news = seen.groupBy("session", "placeholder").agg(F.array_sort(F.collect_set("surface")).alias("_new"), F.min("turn").alias("_first"), F.max("turn").alias("_last"))
    news = news.withColumnsRenamed({"session": "_s", "placeholder": "_p"})
    df = entities.join(news, entities["session"].eqNullSafe(F.col("_s")) & (entities["placeholder"] == F.col("_p")), "left")
    none = F.array().cast("array<string>")
    more = F.array_union(F.array_union(F.array("canonical"), F.coalesce("aliases", none)), F.coalesce("_new", none))
    df = df.withColumn("aliases", more).withColumn("created_turn", F.coalesce("created_turn", "_first")).withColumn("last_seen_turn", F.coalesce(F.greatest("last_seen_turn", "_last"), "last_seen_turn", "_last"))
    return df.select(*entities.columns)


def set_values(entities: DataFrame, values: DataFrame) -> DataFrame:
    """Entities with the values of values(session, placeholder, value, order), the last one counting."""
    last = values.groupBy("session", "placeholder").agg(F.max_by("value", "order").alias("_v"))
    return entities.join(last, ["session", "placeholder"], "left").withColumn("value", F.coalesce("_v", "value")).select(*entities.columns)


def variables(entities: DataFrame) -> DataFrame:
    """(session, values map<string, double>): names that an expression may use, tokens without brackets, and their numbers."""
    named = entities.filter(F.col("value").isNotNull()).select("session", F.regexp_extract("placeholder", "<<(.*)>>", 1).alias("name"), "value")
    return named.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("values"))


def mint_into(found: DataFrame, entities: DataFrame) -> DataFrame:
    """New entities for surfaces(session, turn, detect_rank, entity_text, entity_type) that no entity of the session has.

    Numbers of a tag go on from the highest one of the session, in order of first appearance (turn, text of the turn by
    `_part` where there is one, longer first, rank). A surface that is a number has its value.
    """
    return numbered(met(found), entities)


def met(found: DataFrame) -> DataFrame:
    """(session, surface, first, last_seen_turn, first_turn, strict): each surface of found(session, turn, detect_rank, entity_text, entity_type) once, with where it came first."""
    part = F.col("_part") if "_part" in found.columns else F.lit(0)
    place = (F.col("turn").alias("turn"), part.alias("part"), (-F.length("entity_text")).alias("shorter"), F.col("detect_rank").alias("rank"))
    first = F.min(F.struct(*place, F.col("entity_type").alias("type"))).alias("first")
    strict = F.bool_or(F.col("entity_type").isin(*sorted(taxonomy.COMPUTABLE))).alias("strict")
    return found.groupBy("session", F.col("entity_text").alias("surface")).agg(first, F.max("turn").alias("last_seen_turn"), F.min("turn").alias("first_turn"), strict)


def numbered(fresh: DataFrame, entities: DataFrame | None) -> DataFrame:
    """Entities of surfaces as of `met`, numbered as `mint_into` does; entities: None where there are none yet."""
    news = fresh.withColumn("tag", taxonomy.tag_of(F.col("first.type")))
    if entities is None:
        news = news.withColumn("counter", F.lit(0).cast("long"))
    else:
        counters = compaction.counters(entities, "session").select(F.col("session").alias("_s"), F.col("tag").alias("_t"), "counter")
        news = news.join(counters, news["session"].eqNullSafe(F.col("_s")) & (F.col("tag") == F.col("_t")), "left")
    order = Window.partitionBy("session", "tag").orderBy("first.turn", "first.part", "first.shorter", "first.rank", "surface")
    number = F.coalesce("counter", F.lit(0)) + F.row_number().over(order)
    token = F.concat(F.lit("<<"), "tag", F.lit("_"), number.cast("string"), F.lit(">>"))
    columns = ("session", token.alias("placeholder"), F.col("first.type").alias("entity_type"), F.col("surface").alias("canonical"), F.array("surface").alias("aliases"))
    value = detect.number_value(F.col("surface"), F.col("first.type"))
    return news.select(*columns, value.alias("value"), F.col("first.turn").alias("created_turn"), "last_seen_turn")


def save(entities: DataFrame, path: str) -> None:
    """Store the entities of the sessions in `entities`; other sessions' folders stay as they are.

    A job's commit replaces whole folders, each holding all sessions of its hash, so `entities` has to hold all of a touched
    folder: `merged` gives that. Sessions of an ephemeral scope are not stored.
    """
    kept = entities.filter(~ephemeral(F.col("session"))).withColumn("bucket", bucket(F.col("session")))
    kept.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Stored entities, pruned. schema: of an empty vault, where nothing is stored yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if schema and not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return prune(spark.read.parquet(path).drop("bucket"))


def bucket(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """All entities of the folders that `new` touches: old ones with their news, and new ones. Of one token the new row counts."""
    touched = new.select(bucket(F.col("session")).alias("_b")).distinct()  # at most BUCKETS rows
    rest = old.withColumn("_b", bucket(F.col("session"))).join(F.broadcast(touched), "_b", "left_semi").drop("_b")
    return rest.join(new.select("session", "placeholder"), ["session", "placeholder"], "left_anti").unionByName(new)


def ephemeral(session: Column) -> Column:
    """Whether a scope's key marks state that ends with it: root#kind#id."""
    return session.rlike("^[^#]+#[^#]+#.+$")


def without_sessions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables (all with a column session) without some sessions and without the scopes below them."""
    keys = gone.select(F.col("session").alias("_gone")).distinct()
    return {name: df.join(keys, F.substring_index("session", "#", 1).eqNullSafe(F.col("_gone")), "left_anti") for name, df in tables.items()}
