"""Episodes, entities and communities of a typed knowledge graph, and retrieval over it.

Vertices: episodes (episode, user, community, chunk, ...), entities (entity, user, name, description, labels, community).
Edges keep their kind in the table: mentions (episode, entity), related (src, dst, score), links (src, dst, fact).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import hop_score, k_hop


def found_entities(entities: DataFrame, text: str = "", community: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """Entities whose name or description holds ``text`` (any case), optionally of a community and with any of some labels."""
    out = entities
    if text:
        out = out.where(F.lower("name").contains(text.lower()) | F.coalesce(F.lower("description").contains(text.lower()), F.lit(False)))
    if community is not None:
        out = out.where(F.col("community") == community)
    if labels:
        out = out.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    return out


def mentioned(mentions: DataFrame, episodes: DataFrame, entities: DataFrame) -> DataFrame:
    return mentions.join(episodes, "episode").join(entities, "entity")


def related_episodes(related: DataFrame, episodes: DataFrame) -> DataFrame:
    """Of each episode ``src``: the episodes it is related to with their scores; ends that are gone are left out."""
    return related.join(episodes.select(F.col("episode").alias("dst")), "dst", "left_semi").join(episodes.select(F.col("episode").alias("src")), "src", "left_semi").select("src", "dst", "score")


def facts_of(links: DataFrame, direction: str = "both") -> DataFrame:
    """(entity, other, fact, direction) of every link: outgoing, incoming or both."""
    out = links.select(F.col("src").alias("entity"), F.col("dst").alias("other"), "fact", F.lit("outgoing").alias("direction"))
    come = links.select(F.col("dst").alias("entity"), F.col("src").alias("other"), "fact", F.lit("incoming").alias("direction"))
    return {"outgoing": out, "incoming": come}.get(direction, out.unionByName(come))


def community_stats(communities: DataFrame, episodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Episodes and entities of each community, none included. Both sides are counted before they are joined."""
    e = episodes.groupBy("community").agg(F.countDistinct("episode").alias("episodes"))
    n = entities.groupBy("community").agg(F.countDistinct("entity").alias("entities"))
    out = communities.join(e, "community", "left").join(n, "community", "left")
    return out.withColumn("episodes", F.coalesce("episodes", F.lit(0))).withColumn("entities", F.coalesce("entities", F.lit(0)))


def moved(episodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Episodes after moves (episode, community); at most one move for each."""
    return episodes.join(moves.select("episode", F.col("community").alias("_to")), "episode", "left").withColumn("community", F.coalesce("_to", "community")).drop("_to")


def upsert_edges(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Edges merged by their ends: an incoming edge's properties win, the first creation time stays."""
    first = current.select(*keys, F.col("created_at").alias("_first"))
    new = incoming.join(first, keys, "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(new)


def overridden(documents: DataFrame, overrides: DataFrame) -> DataFrame:
    """Documents as graph nodes, with label, description and tags from ``overrides`` where set."""
    o = overrides.select("document", F.col("label").alias("_l"), F.col("description").alias("_d"), F.col("tags").alias("_t"))
    out = documents.join(o, "document", "left")
    return out.withColumn("label", F.coalesce("_l", "label")).withColumn("description", F.coalesce("_d", "description")).withColumn("tags", F.coalesce("_t", "tags")).drop("_l", "_d", "_t")


def entities_in_queries(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, entity) for every entity whose name, of one to four words, stands in a query's text (any case).

    Names and word runs meet in an equi-join: neither side is paired with all of the other.
    """
    words = F.expr("filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> '')")
    runs = F.expr("flatten(transform(sequence(1, 4), n -> transform(filter(sequence(1, size(_w)), i -> i + n - 1 <= size(_w)), i -> array_join(slice(_w, i, n), ' '))))")
    asked = queries.withColumn("_w", words).where(F.size("_w") > 0).select("query", F.explode(F.array_distinct(runs)).alias("_run"))
    known = names.withColumn("_run", F.trim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " ")))
    return asked.join(known.select("entity", "_run"), "_run").select("query", "entity").distinct()


def by_entities(entity_documents: DataFrame, links: DataFrame, asked: DataFrame, hops: int) -> DataFrame:
    """Documents by their entities' least distance to asked entities: 1 at distance 0 and 0.5 for every further asked
    entity in the document, else 1 / (distance + 1). ``entity_documents``: entity, document; ``asked``: entity."""
    near = k_hop(links, asked.select(F.col("entity").alias("seed")), hops).groupBy(F.col("node").alias("entity")).agg(F.min("hop").alias("hop"))
    docs = entity_documents.distinct().join(near, "entity").groupBy("document").agg(F.min("hop").alias("hop"), F.count_if(F.col("hop") == 0).alias("_own"))
    return docs.withColumn("score", F.when(F.col("hop") == 0, 1 + 0.5 * (F.col("_own") - 1)).otherwise(hop_score(F.col("hop")))).drop("_own")


def blended(vectors: DataFrame, graph: DataFrame, key: str, graph_weight: float) -> DataFrame:
    """Vector hits with a share of the graph's score; hits of the graph alone don't count."""
    g = graph.select(key, F.col("score").alias("_g"))
    return vectors.join(g, key, "left").withColumn("score", (1 - graph_weight) * F.col("score") + graph_weight * F.coalesce("_g", F.lit(0.0))).drop("_g")


def event_graph(events: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Actors as vertices (session, actor, events, first) and one edge for every event, to the actor before it in its session."""
    actors = events.groupBy("session", "actor").agg(F.count(F.lit(1)).alias("events"), F.min(order[0]).alias("first"))
    before = F.lag("actor").over(Window.partitionBy("session").orderBy(*order))
    return actors, events.select("session", F.col("actor").alias("src"), before.alias("dst"), "kind", *order)


_ITEM = "source:string,source_name:string,src:string,target:string,target_name:string,dst:string,name:string,fact:string,confidence:double"
_ANSWER = "struct<" + ",".join(f"{k}:array<struct<{_ITEM}>>" for k in ("edges", "relationships", "relations")) + ">"


def relation_rows(response: Column) -> Column:
    """Relations in a JSON answer: edges, relationships or relations; each with both ends and a fact, names upper-cased."""
    parsed = F.from_json(response, _ANSWER)
    rows = F.coalesce(*(F.when(F.size(parsed[k]) > 0, parsed[k]) for k in ("edges", "relationships", "relations")))

    def first(r: Column, *names: str) -> Column:
        return F.trim(F.coalesce(*(F.when(r[n] != "", r[n]) for n in names), F.lit("")))

    def made(r: Column) -> Column:
        name = F.upper(F.trim(F.coalesce(F.when(r["name"] != "", r["name"]), F.lit("RELATED_TO"))))
        return F.struct(first(r, "source", "source_name", "src").alias("source"), first(r, "target", "target_name", "dst").alias("target"), name.alias("name"), first(r, "fact").alias("fact"), r["confidence"].alias("confidence"))

    return F.filter(F.transform(rows, made), lambda r: (r["source"] != "") & (r["target"] != "") & (r["fact"] != ""))
