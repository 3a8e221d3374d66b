"""Editing and reading a knowledge graph: relations put right, attributes merged, manual edges, one view of all nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relations that may have many targets, and one that has a single target.
MANY = ("ALIAS_OF", "PRODUCES", "OPERATES_DATA_CENTER_IN", "COMPETES_WITH", "PART_OF", "RELATED_TO")
ONE = ("HEADQUARTERS_IN",)


def fact_hash(fact: Column) -> Column:
    """Equal for facts that differ in case and outer white space alone; the empty fact's for null."""
    return F.sha2(F.lower(F.trim(F.coalesce(fact, F.lit("")))), 256)


def edge_key(source: Column, target: Column, name: Column, fact: Column) -> Column:
    return F.concat_ws("::", source, target, name, fact_hash(fact))


def put_right(relations: DataFrame) -> DataFrame:
    """Relations (source, target, name, qualifiers, confidence, polarity, cardinality) with confidence and polarity taken
    from the qualifiers where missing, and cardinality null where a relation may have many targets: by its name, by
    negative polarity, or because its source has several targets for it (but for names that have one)."""
    confidence = F.coalesce("confidence", F.try_element_at("qualifiers", F.lit("confidence")).cast("double"))
    polarity = F.coalesce("polarity", F.try_element_at("qualifiers", F.lit("polarity")).cast("int"))
    # least and greatest target tell whether there are several: no set of a hot source's targets is built
    targets = relations.groupBy("source", "name").agg((F.min("target") != F.max("target")).alias("_several"))
    out = relations.join(targets, ["source", "name"]).withColumn("confidence", confidence).withColumn("polarity", polarity)
    many = F.col("name").isin(*MANY) | F.coalesce(F.col("polarity") < 0, F.lit(False)) | (F.coalesce("_several", F.lit(False)) & ~F.col("name").isin(*ONE))
    return out.withColumn("cardinality", F.when(~many, F.col("cardinality"))).drop("_several")


def with_attributes(rows: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Rows whose ``attributes`` (a map) are merged with those found for their keys, of text in any case; found ones win."""
    plain = lambda c, t: F.lower(F.trim(c)) if dict(t)[c.split(".")[-1]] == "string" else F.col(c)
    new = found.select(*(plain(k, found.dtypes).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("attributes").alias("_new"))
    out = rows.join(new, [plain(k, rows.dtypes) == F.col(f"_k{i}") for i, k in enumerate(keys)], "left")
    new_map = F.coalesce("_new", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(new_map, k))
    return out.withColumn("attributes", F.map_concat(kept, new_map)).select(*rows.columns)


def linked_entities(links: DataFrame, asset: str, entity: str) -> DataFrame:
    """Of each asset: its entities, each once, sorted."""
    return links.groupBy(asset).agg(F.array_sort(F.collect_set(entity)).alias("entities"))


def edited(edges: DataFrame, edits: DataFrame, key: str, order: str) -> DataFrame:
    """Edges after edits (action, relation, description): of each edge the last edit counts. create and update set what
    they name, an update leaves null fields as they are and needs an edge that is there, delete removes."""
    last = edits.groupBy(key).agg(F.max_by(F.struct("action", "src", "dst", "relation", "description"), order).alias("_e"))
    out = edges.withColumn("_there", F.lit(True)).join(last, key, "full")
    action = F.col("_e.action")
    out = out.where(F.col("_e").isNull() | ((action != "delete") & (F.col("_there").isNotNull() | (action == "create"))))
    return out.select(key, *(F.coalesce(f"_e.{c}", c).alias(c) for c in ("src", "dst", "relation", "description")))


def view(documents: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents and entities (id, label): each node once, and no edge with a missing end."""
    nodes = documents.select("id", "label", F.lit("document").alias("kind")).unionByName(entities.select("id", "label", F.lit("entity").alias("kind")))
    nodes = nodes.groupBy("id").agg(F.min_by(F.struct("label", "kind"), "kind").alias("_n")).select("id", "_n.*")
    ends = nodes.select("id")
    kept = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, kept


def flat_properties(rows: DataFrame, key: str, properties: str) -> DataFrame:
    """One row for each property of a map, its name in lower case with underscores for all but letters and digits."""
    return rows.select(key, F.explode(properties).alias("name", "value")).withColumn("name", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_"))
