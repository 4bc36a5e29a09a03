"""Near duplicates by an exact Jaccard join on word shingles (operator 9).

A document's set holds its distinct shingles of ``SHINGLE`` words (A-Z in lower case). Two sets
link when ``100 * common >= PERCENT * union``. Sets are compared as 64-bit hashes of shingles.

1. *Sets.* One pass over the whole texts gives each row the size and the hash of its set; equal
   sets are one node from here on, so that copies cost nothing more.
2. *Candidates for candidates.* A set may have at most a fifth of shingles that nobody else has.
   Of the shingles whose hash lies in the lowest ``SAMPLE`` of the range, those that occur in one
   set only are counted; a set with more than a fifth of its size of them cannot link. As the
   others stay whatever their number, this loses nothing. Only the rest goes on.
3. *Rare-first prefixes.* Shingles are ordered by the number of sets they are in, then by hash. Two
   linked sets share a shingle within their first ``n - ceil(0.8 n) + 1``; those seen once lead the
   order and need no join. Length and position filters apply to each pair at a shared shingle.
4. *Stars.* For each shingle the sets of its list are paired with one of them (the same for most
   lists of a group), verified, and merged to components. Lists inside one component are done. So
   a group of copies costs as much as it has members, not pairs.
5. *The rest.* In lists that still hold several components, each set outside the list's largest
   component is paired with those of other components, once per pair: at the first shingle both
   prefixes share. Before a pair is made, its prefixes must agree enough (prefix and tail bound)
   and so must the numbers of its shingles in ``CLASSES`` classes (suffix filter). First each meets
   one in ``SOME`` of the others, by hash, which ties most of a group's stragglers to it; what is
   then still apart meets all the others.
6. Every pair is verified once, by the intersection of both sets.

What is lost is only a link inside a component that is known already, so components are exact.

Edge cases: null and empty texts and texts without words have no set, link with nothing and are
their own component. A text of fewer than five words has its whole sequence as its one shingle.
Rows with one id count as they are: the component's id is the least id of any row. A null id is
never a component's id unless all its ids are null. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.llm import wordspans
from cohortweave.llm.links import merged
from cohortweave.llm.rowmaps import add_columns, column, free_name, list_array
from cohortweave.operators.shared import written

SHINGLE = 5
PERCENT = 80
SAMPLE = 0.3  # share of the hash range that step 2 counts
CLASSES = 16
SOME = 32

_SAMPLE_BELOW = np.uint64(int(SAMPLE * 2**64))


def text_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    out: list[np.ndarray] = []
    for _, chunk in wordspans.chunks(wordspans.of_array(texts)):
        found = wordspans.words(chunk.lowered())
        hashes, first = wordspans.windows(found, SHINGLE)
        at = np.searchsorted(first, found.before)
        for i in range(len(chunk)):
            n = found.before[i + 1] - found.before[i]
            if n >= SHINGLE:
                out.append(np.unique(hashes[at[i] : at[i + 1]]))
            elif n:
                out.append(np.array([wordspans.sequence_hash(found.hashes[found.before[i] : found.before[i + 1]])], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _set_id(members: np.ndarray) -> int:
    """Hash of a set, from the sum of its members' mixed hashes."""
    total = np.add.reduce(wordspans.mix(members ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(wordspans.mix(np.array([total + np.uint64(len(members))], np.uint64)).view(np.int64)[0])


def _ids_and_sizes(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    return {
        "set_id": pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64()),
        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
    }


def _lists(parts: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return list_array(np.concatenate(parts or [np.empty(0, np.uint64)]).view(np.int64), bounds)


def _sampled(texts: pa.Array) -> dict[str, pa.Array]:
    sets = text_sets(texts)
    return _ids_and_sizes(sets) | {"low": _lists([s[: np.searchsorted(s, _SAMPLE_BELOW)] for s in sets])}


def _whole(texts: pa.Array) -> dict[str, pa.Array]:
    sets = text_sets(texts)
    classes = [np.bincount((s % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES).astype(np.int32) for s in sets]
    flat = np.concatenate(classes or [np.empty(0, np.int32)])
    return _ids_and_sizes(sets) | {"shingles": _lists(sets), "classes": list_array(flat, np.arange(len(sets) + 1) * CLASSES)}


_IDS = [T.StructField("set_id", T.LongType()), T.StructField("n_shingles", T.LongType())]
_LONGS = T.ArrayType(T.LongType())


def _may_link(sets: DataFrame) -> DataFrame:
    """``set_id`` of the sets that step 2 cannot rule out."""
    rows = sets.where("set_id IS NOT NULL").select("set_id", F.explode("low").alias("h"))
    alone = rows.groupBy("h").agg(F.min("set_id").alias("set_id"), F.max("set_id").alias("_to")).where("set_id = _to")
    counted = alone.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_alone"))
    sizes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.max("n_shingles").alias("n"))
    return (
        sizes.join(counted, "set_id", "left")
        .where(F.coalesce("n_alone", F.lit(0)) <= F.floor(F.col("n") * (100 - PERCENT) / 100))
        .select("set_id")
    )


def _prefix_length(n: str) -> str:
    """How many first shingles of a set of ``n`` hold one of every partner."""
    return f"({n} - floor(({PERCENT} * {n} + 99) / 100) + 1)"


def _needed(n: str, m: str) -> str:
    """The least overlap of linked sets of these sizes."""
    return f"ceil({PERCENT} * ({n} + {m}) / {100 + PERCENT}D)"


def _prefixes(full: DataFrame) -> DataFrame:
    """Per set its first shared shingles, in the order of all: ``set_id, n, n_alone, prefix``."""
    rows = full.select("set_id", F.explode("shingles").alias("h"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = (
        rows.join(shared, "h")
        .groupBy("set_id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("_order"))
    )  # a list is bounded by its document
    return (
        full.select("set_id", F.col("n_shingles").alias("n"), "classes")
        .join(ordered, "set_id")
        .withColumn("n_alone", F.col("n") - F.size("_order"))
        .withColumn("_take", F.expr(f"CAST(greatest({_prefix_length('n')} - n_alone, 0) AS INT)"))
        .where("_take > 0")
        .select("set_id", "n", "n_alone", "classes", F.expr("transform(slice(_order, 1, _take), x -> x.h)").alias("prefix"))
    )


def _fits(a: str, b: str) -> Column:
    """Length and position filter of two entries of a list."""
    length = f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n)"
    position = f"least({a}.n - {a}.at, {b}.n - {b}.at) >= {_needed(f'{a}.n', f'{b}.n')}"
    return F.expr(f"{length} AND {position}")


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets link. Each pair must come once."""
    left = full.select(F.col("set_id").alias("a"), F.col("shingles").alias("_x"))
    right = full.select(F.col("set_id").alias("b"), F.col("shingles").alias("_y"))
    common = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("_x").alias("_n"), F.size("_y").alias("_m"), F.size(F.array_intersect("_x", "_y")).alias("_common"))
    return common.where(f"100L * _common >= {PERCENT}L * (_n + _m - _common)").select("a", "b")


def _labelled(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return entries.withColumn("label", F.col("set_id"))
    known = roots.select(F.col("node").alias("set_id"), F.col("root").alias("_root"))
    return entries.join(known, "set_id", "left").withColumn("label", F.coalesce("_root", "set_id")).drop("_root")


def _star_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of one set of each list with the others of it, where they are in different components."""
    first = F.min(F.struct(F.xxhash64("set_id").alias("r"), "set_id", "n", "at", "label"))
    lists = entries.groupBy("h").agg(first.alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    open_lists = lists.where("lo <> hi").select("h", "p")
    met = entries.alias("e").join(open_lists.select("h", "p.*").alias("p"), F.expr("e.h = p.h AND e.label <> p.label") & _fits("e", "p"))
    return met.selectExpr("least(e.set_id, p.set_id) AS a", "greatest(e.set_id, p.set_id) AS b").distinct()


def _rest_pairs(entries: DataFrame, prefixes: DataFrame, of: int) -> DataFrame:
    """Pairs of different components that no filter rules out, each once; with one set in ``of`` on one side, all for 1."""
    counted = entries.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"))
    lists = counted.groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("k"))
    open_entries = entries.join(lists.where("k > 1").select("h", "main"), "h")
    wide = written(open_entries.join(prefixes.select("set_id", "prefix", "classes", "n_alone"), "set_id"), "open-lists")
    some = F.lit(True) if of == 1 else F.pmod(F.xxhash64("set_id", F.lit(of)), F.lit(of)) == 0
    few, many = wide.where("label <> main").alias("e"), wide.where(some).alias("p")
    earlier = "NOT arrays_overlap(slice(e.prefix, 1, CAST(e.at - e.n_alone AS INT)), slice(p.prefix, 1, CAST(p.at - p.n_alone AS INT)))"
    agreed = "size(array_intersect(e.prefix, p.prefix))"
    tail = f"greatest(e.n - least(e.n, {_prefix_length('e.n')}), p.n - least(p.n, {_prefix_length('p.n')}))"
    classes = "aggregate(zip_with(e.classes, p.classes, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
    needed = _needed("e.n", "p.n")
    return (
        few.join(
            many,
            F.expr("e.h = p.h AND e.label <> p.label" + (" AND (p.label = p.main OR e.set_id < p.set_id)" if of == 1 else ""))
            & _fits("e", "p")
            & F.expr(f"{classes} >= {needed} AND {agreed} + {tail} >= {needed} AND {earlier}"),
        )
        .selectExpr("least(e.set_id, p.set_id) AS a", "greatest(e.set_id, p.set_id) AS b")
        .distinct()
    )


def linked_sets(docs: DataFrame, sets: DataFrame, key: str, text: str) -> DataFrame:
    """``node, root`` of the sets that link with others; ``sets`` as ``document_sets`` writes them."""
    chosen = written(_may_link(sets), "may-link")
    carriers = sets.join(chosen, "set_id", "left_semi").groupBy("set_id").agg(F.min("_key").alias("_key"))
    ids = carriers.select("_key").distinct().alias("i")
    rows = docs.select(column(key).alias("_key"), column(text).cast("string").alias("_text")).alias("d")
    texts = rows.join(ids, F.expr("d._key <=> i._key"), "left_semi")
    schema = T.StructType([*_IDS, T.StructField("shingles", _LONGS), T.StructField("classes", T.ArrayType(T.IntegerType()))])
    full = add_columns(texts, "_text", _whole, schema, []).where("set_id IS NOT NULL")
    full = written(full.dropDuplicates(["set_id"]), "shingle-sets")
    prefixes = written(_prefixes(full), "prefixes")
    entries = prefixes.select("set_id", "n", "n_alone", F.posexplode("prefix").alias("_p", "h"))
    entries = written(entries.select("h", "set_id", "n", (F.col("n_alone") + F.col("_p")).alias("at")), "entries")

    roots = None
    for of in (None, SOME, 1):
        labelled = _labelled(entries, roots)
        pairs = _star_pairs(labelled) if of is None else _rest_pairs(labelled, prefixes, of)
        roots = merged(roots, written(_verified(pairs, full), "verified"))
    return roots


def document_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Row by row ``_key, set_id, n_shingles`` and the sampled shingles, written once."""
    keyed = docs.select(column(key).alias("_key"), column(text).alias("_text"))
    schema = T.StructType([*_IDS, T.StructField("low", _LONGS)])
    return written(add_columns(keyed, "_text", _sampled, schema, ["_key"]), "sampled-sets")


def set_components(docs: DataFrame, sets: DataFrame, key: str, text: str) -> DataFrame:
    """Per set its component's ``least`` (least id, and the set which has it)."""
    roots = linked_sets(docs, sets, key, text).select(F.col("node").alias("set_id"), "root")
    known = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("_key").alias("_key"))
    known = known.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    # A null id comes last, so it leads only where there is no other.
    least = known.groupBy("root").agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "set_id")).alias("least"))
    return known.join(least, "root").select("set_id", "least")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``n_shingles`` and ``component_id``, the least id it is linked with by any path."""
    sets = document_sets(docs, key, text)
    groups = set_components(docs, sets, key, text)
    return sets.join(groups, "set_id", "left").select(
        F.col("_key").alias(key),
        "n_shingles",
        F.when(F.col("set_id").isNull(), F.col("_key")).otherwise(F.col("least._key")).alias("component_id"),
    )


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of its least id, and every row without words.

    Rows which share both id and set are one; which of them stays is open.
    """
    names = {c: free_name(docs, f"_doc{i}") for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[column(c).alias(n) for c, n in names.items()])
    sets = document_sets(docs, key, text)
    lead = written(set_components(docs, sets, key, text).where("set_id = least.set_id").select(F.col("set_id").alias("_lead"), F.col("least._key").alias("_key")), "leads")
    schema = T.StructType([T.StructField("_set", T.LongType())])
    rows = add_columns(renamed, names[text], lambda texts: {"_set": _ids_and_sizes(text_sets(texts))["set_id"]}, schema)
    own = [F.col(n).alias(c) for c, n in names.items()]
    kept = rows.join(lead, (F.col("_set") == F.col("_lead")) & column(names[key]).eqNullSafe(F.col("_key")), "left_semi")
    once = kept.dropDuplicates([names[key], "_set"])
    return once.select(*own).unionByName(rows.where("_set IS NULL").select(*own))


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP9_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
t AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
shared AS MATERIALIZED (SELECT t.doc_id, t.n, t.g FROM t JOIN (SELECT g FROM t GROUP BY g HAVING count(*) > 1) USING (g)),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
linked AS MATERIALIZED (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT x AS doc_id, x AS r FROM linked UNION SELECT reach.doc_id, linked.y FROM reach JOIN linked ON reach.r = linked.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles,
  least(s.doc_id, coalesce(m.c, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""
