"""SimHash near-duplicate groups by pivot distance tables.

Every text gets a 64-bit fingerprint; fingerprints that differ in at most two bits are linked, and
the groups are the connected components. Copies with one fingerprint collapse first. The pivot
table holds each distinct fingerprint's Hamming distances to reference fingerprints. Two
fingerprints at distance d differ by d at most in every coordinate, so a candidate pair with a
larger coordinate difference is discarded without a look at the fingerprints; survivors are verified.

Candidates come without all-pairs work. Within two bits, one of three bands of bits is equal, so
equal bands give the candidates. Where a band's bucket holds more than ``BUCKET`` fingerprints
(large groups of near copies), its members are exactly and linearly joined instead through the
points at distance one: two fingerprints within two bits have a common point at distance one at
most, and no point has more than 65 such neighbours. Nothing is capped or dropped.

For texts that are similar to 0.8 or so in their 5-word shingles, 64 bits within two are too strict. ``similar`` adds
links of texts whose shingle sets are similar to 0.8 or more, each verified on the whole sets (see ``similar``);
the pipeline uses it. Texts with one fingerprint but different sets stay apart as nodes of those links.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows
and ties share a group; a null id keeps its row, and a group's id is its smallest id that is not
null (null if it has none); other columns are ignored. ``keep_one`` keeps the row with a group's smallest id
(rows without id come last; of one id the text with the least hash, then the row with the least hash); different texts that share an id are rows of their own.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm.common import as_text, durable, few, id_and_text, split_join, table
from foliate.llm.components import components
from foliate.llm.similar import keys, shingle_set, similar_links

SEED = 42
BITS = 64
RADIUS = 2
SHINGLE = 3
BUCKET = 32
N_PIVOTS = 16
#: Words of the shingles whose sets are compared.
SIMILAR_SHINGLE = 5
#: Bit bands (shift, width): one more than the differing bits allowed.
BANDS = ((0, 21), (21, 21), (42, 22))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def pivots(n: int = N_PIVOTS, seed: int = SEED) -> list[int]:
    """Reference fingerprints, drawn from a fixed seed."""
    draw = random.Random(seed)
    return [draw.getrandbits(BITS) for _ in range(n)]


def _hashes(text: str, shingle: int):
    """Number of shingles, and their hashes in stretches."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < 2:
        return n, [np.array([digest(joined, SEED)] * n, np.uint64)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))

    def stretches():
        for i in range(0, n, 1 << 16):
            a, b = starts[i : min(n, i + (1 << 16))].tolist(), ends[i + shingle - 1 : min(n, i + (1 << 16)) + shingle - 1].tolist()
            yield np.fromiter([digest(joined[x:y], SEED) for x, y in zip(a, b)], np.uint64, len(a))

    return n, stretches()


def _counts(h: np.ndarray) -> np.ndarray:
    """How many hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _word(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one whole text; words are split at ASCII white space, A-Z lower-cased."""
    n, stretches = _hashes(text, shingle)
    return _word(sum((_counts(h) for h in stretches), np.zeros(BITS, np.int64)), n)


def _lists(values: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))


def _all_hashes(text: str, shingle: int) -> np.ndarray:
    return np.concatenate(list(_hashes(text, shingle)[1]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row; and, if asked for, a hash of the text, and node and keys of its shingle set."""
    source = id_and_text(docs, id_col, text_col)
    if similar:
        source = source.withColumn("hash", F.xxhash64("text"))

    def with_keys(batch):
        hashes = [_all_hashes(t, shingle) for t in batch.column(1).to_pylist()]
        values = np.array([_word(_counts(h), len(h)) for h in hashes], np.uint64).view(np.int64)
        nodes = np.array([xxhash.xxh64_intdigest(shingle_set(h).tobytes(), SEED) for h in hashes], np.uint64).view(np.int64)
        columns = [batch.column(0), pa.array(values), batch.column(2), pa.array(nodes), _lists([keys(h) for h in hashes])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "hash", "node", "keys"])

    def run(batches):
        for batch in batches:
            if similar:
                for at in range(0, batch.num_rows, 1000):
                    yield with_keys(batch.slice(at, 1000))
            else:
                values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, fp long" + ", hash long, node long, keys array<long>" * similar)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, shingles (see ``similar``) of the rows (node, text), one row a node."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_set(_all_hashes(t, shingle)) for t in part.column(1).to_pylist()])], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<int>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fps: DataFrame, references: list[int]) -> DataFrame:
    """fp and its distances to the reference fingerprints, for distinct ``fps``."""
    return fps.select("fp", F.array(*[_differing(F.col("fp"), F.lit(_signed(p))).cast("byte") for p in references]).alias("far"))


def _gap() -> Column:
    """Largest difference of the pivot coordinates far and far2."""
    return F.aggregate(F.zip_with("far", "far2", lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda x, y: F.greatest(x, y))


def _surviving(pairs: DataFrame, radius: int) -> DataFrame:
    """Pairs (fp, far, fp2, far2) left by the pivot coordinates, then by the true distance."""
    return pairs.where(_gap() <= radius).where(_differing(F.col("fp"), F.col("fp2")) <= radius).select(F.col("fp").alias("u"), F.col("fp2").alias("v"))


def links(distinct: DataFrame, bucket: int = BUCKET, n_pivots: int = N_PIVOTS) -> DataFrame:
    """u, v: links that connect exactly the distinct fingerprints (column fp) within two bits of each other."""
    table_ = pivot_table(distinct, pivots(n_pivots))
    key = lambda at, width: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
    bands = durable(table_.select("fp", "far", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), key(*b).alias("key")) for i, b in enumerate(BANDS)])).alias("b")).select("fp", "far", "b.band", "b.key"))
    sizes = bands.groupBy("band", "key").count().where("count > 1")
    members = durable(split_join(bands, sizes, ["band", "key"], "fp"))
    few = members.where(F.col("count") <= bucket).groupBy("band", "key").agg(F.collect_list(F.struct("fp", "far")).alias("all"))
    pairs = few.select("all", F.explode("all").alias("a")).select(F.col("a.fp").alias("fp"), F.col("a.far").alias("far"), F.explode(F.filter("all", lambda x: x["fp"] < F.col("a.fp"))).alias("b")).select("fp", "far", F.col("b.fp").alias("fp2"), F.col("b.far").alias("far2"))
    crowded = members.where(F.col("count") > bucket).select("fp", "far").dropDuplicates(["fp"])
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    around = crowded.select("fp", "far", F.explode(points).alias("point")).groupBy("point").agg(F.collect_list(F.struct("fp", "far")).alias("all")).where(F.size("all") > 1)
    near = around.select(F.array_min("all").alias("least"), F.explode("all").alias("a")).where("a.fp <> least.fp").select(F.col("a.fp").alias("fp"), F.col("a.far").alias("far"), F.col("least.fp").alias("fp2"), F.col("least.far").alias("far2"))
    return _surviving(pairs.unionByName(near), RADIUS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, root, component_id for every row: root names the group, component_id is its smallest id."""
    rows = durable(fingerprints(docs, id_col, text_col, shingle))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = _named(distinct, "fp", components(links(distinct.select("fp"), bucket)))
    return split_join(rows, named, ["fp"], "doc_id", "left", least=64).select("doc_id", "fp", "root", "component_id")


def _named(distinct: DataFrame, node: str, groups: DataFrame) -> DataFrame:
    """node, root, component_id of distinct nodes with their least id: the least of their group."""
    linked = durable(distinct.join(groups.select(F.col("node").alias(node), "root"), node))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = split_join(linked, ids, ["root"], node).select(node, "root", "component_id")
    alone = distinct.join(linked.select(node), node, "left_anti").select(node, F.col(node).alias("root"), F.col("least").alias("component_id"))
    return durable(linked.unionByName(alone))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, hash (of the text), root, component_id for every row: groups by near fingerprints and by similar shingle sets."""
    rows = durable(fingerprints(docs, id_col, text_col, shingle, similar=True))
    # One text of each set, named by hashes of its id and of itself, has its shingles read again if the set is a candidate.
    one = F.min(F.struct(F.xxhash64("doc_id").alias("id_hash"), "hash")).alias("one")
    sets = durable(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least"), one, F.first("keys").alias("keys")))

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = few(sets.join(some, "node", "left_semi").select("node", "one.id_hash", "one.hash"))
        texts = id_and_text(docs, id_col, text_col).select(F.xxhash64("doc_id").alias("id_hash"), F.xxhash64("text").alias("hash"), "text")
        return shingle_sets(texts.join(wanted, ["id_hash", "hash"]), shingle)

    # Sets with one fingerprint hang below the least of them, which stands for the fingerprint.
    heads = durable(sets.groupBy("fp").agg(F.min("node").alias("head")))
    pairs = durable(links(heads.select("fp"), bucket))
    head = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head"))
    near = split_join(split_join(pairs, head("u"), ["u"], "v"), head("v"), ["v"], "u").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    same = split_join(sets.select("node", "fp"), heads, ["fp"], "node").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    known = durable(near.unionByName(same))
    found = similar_links(sets.select("node", "keys"), sets_of, known, bucket)
    named = _named(sets.select("node", "least"), "node", components(found))
    return split_join(rows.select("doc_id", "hash", "node"), named, ["node"], "doc_id", "left").select("doc_id", "hash", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept; see above for the choice."""
    named = similar_groups(docs, id_col, text_col, shingle, bucket)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash")
    kept = named.groupBy("root").agg(F.min(order).alias("k")).select(F.xxhash64("k.doc_id").alias("__foliate_id"), F.col("k.hash").alias("__foliate_text"))
    # The join and the window have the same keys, so the texts move once.
    key = ["__foliate_id", "__foliate_text"]
    hashed = docs.withColumn("__foliate_id", F.xxhash64(id_col)).withColumn("__foliate_text", F.xxhash64(as_text(F.col(text_col))))
    found = hashed.join(kept, key, "left_semi")
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*docs.columns)))
    return found.withColumn("__foliate_n", first).where("__foliate_n = 1").select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
