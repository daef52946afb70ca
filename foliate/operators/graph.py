"""Knowledge graph: nodes, edges and their merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.functions.ids import prefixed, relation_id

#: Fixed values of the edges from an extracted entity to the block's own.
BELONGS_KEYWORDS, BELONGS_WEIGHT = "belongs_to,part_of,contained_in", 10.0


def capitalised(docs: DataFrame) -> DataFrame:
    """doc_id, entity: distinct words of ASCII letters that begin with a capital, a stand-in for an extracting model."""
    return docs.select("doc_id", F.explode(capitalised_words(F.col("text"))).alias("entity"))


def capitalised_words(text):
    """Those words of a text as an array."""
    named = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^[A-Z][a-z]{3,}[.,;:!?]*$"))
    return F.array_distinct(F.transform(named, lambda w: F.regexp_replace(w, r"[.,;:!?]+$", "")))


def belongs_to(entities: DataFrame, owner: str = "modal_entity") -> DataFrame:
    """Edges from each entity to the entity of the block that it was found in, never to itself."""
    e, o = F.col("entity"), F.col(owner)
    description = F.concat(F.lit("Entity "), e, F.lit(" belongs to "), o)
    edges = entities.where(e != o)
    return edges.select("doc_id", e.alias("src"), o.alias("tgt"), F.lit(BELONGS_KEYWORDS).alias("keywords"), F.lit(BELONGS_WEIGHT).alias("weight"), description.alias("description"), relation_id(e, o).alias("rel_id"), relation_text(F.lit(BELONGS_KEYWORDS), e, o, description).alias("content"))


def relation_text(keywords, src, tgt, description):
    """Text of a relation for its vector."""
    return F.concat(keywords, F.lit("\t"), src, F.lit("\n"), tgt, F.lit("\n"), description)


def main_nodes(items: DataFrame, name: str, order: str) -> DataFrame:
    """One node a name, the last written wins."""
    rest = [c for c in items.columns if c != name]
    return items.groupBy(name).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(prefixed("ent-", F.col(name)).alias("ent_id"), name, "r.*")


def merge_nodes(mentions: DataFrame, name: str, source: str) -> DataFrame:
    """Nodes by name with their number of mentions and of distinct sources; sets are counted, not gathered."""
    return mentions.groupBy(name).agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct(source).alias("n_sources")).withColumn("ent_id", prefixed("ent-", F.col(name).cast("string")))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges by (src, tgt): weights summed."""
    return edges.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def entity_names(entities: DataFrame) -> DataFrame:
    """doc_id, entity_names in order, count: a document's own set."""
    names = F.array_sort(F.collect_set("entity"))
    return entities.groupBy("doc_id").agg(F.array_join(names, ",").alias("entity_names"), F.countDistinct("entity").alias("n"))


def with_owner(found: DataFrame, owners: DataFrame, keys: list[str], owner: str = "modal_entity") -> DataFrame:
    """What was extracted from chunks, with the entity of the block that a chunk came from (null for other chunks).

    Of several owners of one key the last by ``ord`` wins; rows of ``found`` are neither lost nor multiplied.
    """
    last = owners.groupBy(*keys).agg(F.max_by(owner, "ord").alias(owner))
    return found.join(last, keys, "left")


def with_stored(found: DataFrame, stored: DataFrame) -> DataFrame:
    """doc_id, entity_names, n: the stored names of each document together with those that were found."""
    return entity_names(stored.select("doc_id", "entity").unionByName(found.select("doc_id", "entity")))


#: The schemas of a stored graph: a node by name, an edge by both ends, the lesser first. Each part is what one source told.
NODE_PARTS = "key string, name string, type string, description string, source_id string"
EDGE_PARTS = "key string, src string, tgt string, keywords string, description string, weight double, source_id string"


def node_parts(nodes: DataFrame) -> DataFrame:
    """What each source told of each node (name, type, description, source_id), keyed by both; a source that comes again tells it anew."""
    rows = nodes.where("name IS NOT NULL AND source_id IS NOT NULL")
    return rows.select(F.md5(F.to_json(F.struct("name", "source_id"))).alias("key"), "name", "type", "description", "source_id")


def edge_parts(edges: DataFrame) -> DataFrame:
    """What each source told of each edge (src, tgt, keywords, description, weight, source_id); weights that one source gives an edge in one batch are summed."""
    a, b = F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")
    rows = edges.where("src IS NOT NULL AND tgt IS NOT NULL AND source_id IS NOT NULL").select(a, b, "keywords", "description", "weight", "source_id")
    told = rows.groupBy("src", "tgt", "source_id").agg(F.max("keywords").alias("keywords"), F.max("description").alias("description"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    return told.select(F.md5(F.to_json(F.struct("src", "tgt", "source_id"))).alias("key"), "src", "tgt", "keywords", "description", "weight", "source_id")


def united_nodes(parts: DataFrame) -> DataFrame:
    """name, type (the most frequent, then the least), n_descriptions, n_sources of stored node parts: sets are counted, ``united_texts`` has them as rows."""
    kinds = parts.where("type IS NOT NULL").groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))
    kind = kinds.groupBy("name").agg(F.min_by("type", F.struct((-F.col("n")).alias("n"), "type")).alias("type"))
    sources = parts.groupBy("name").agg(F.count(F.lit(1)).alias("n_sources"))  # a part a source
    texts = united_texts(parts, ["name"]).groupBy("name").agg(F.count(F.lit(1)).alias("n_descriptions"))
    found = sources.join(kind, "name", "left").join(texts, "name", "left")
    return found.select("name", "type", F.coalesce("n_descriptions", F.lit(0).cast("long")).alias("n_descriptions"), "n_sources")


def united_edges(parts: DataFrame) -> DataFrame:
    """src, tgt, weight (summed), n_sources of stored edge parts."""
    return parts.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_sources"))


def united_texts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, description, n_sources: the distinct descriptions of each node or edge and how many sources told each, a row each."""
    told = parts.where(F.coalesce("description", F.lit("")) != "")
    return told.groupBy(*keys, "description").agg(F.count(F.lit(1)).alias("n_sources"))
