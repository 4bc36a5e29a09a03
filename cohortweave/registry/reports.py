"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.functions.text import description_flags
from cohortweave.operators import reports as rp
from cohortweave.operators import samples as sm
from cohortweave.operators.shared import new_path
from cohortweave.registry.base import SERIES_SQL, query, series, slices, table
from cohortweave.sources.text import typed_description_counts

_FILES_SQL = SERIES_SQL + """,
files AS (SELECT description, time_point, series_id, STRUCT_PACK(family := patient_id) AS name
          FROM lineitem JOIN series ON l_orderkey = series_id)"""


def files(spark, sf_dir):
    """One row per image file; the patient is a field of a nested name."""
    ids = series(spark, sf_dir).select(
        "series_id", "description", "time_point", F.struct(F.col("patient_id").alias("family")).alias("name")
    )
    rows = slices(spark, sf_dir).select("series_id").join(ids, "series_id")
    return rows.select("series_id", "description", "time_point", F.col("name.family").alias("patient_id"))


def id_list(spark, sf_dir):
    """Series that are listed by id: those whose order is not pending."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P")
    return rows.select(F.col("o_orderkey").alias("series_id"))


_COUNTS_SQL = f"""WITH {_FILES_SQL}, counts AS (
  SELECT description, count(DISTINCT name.family) AS num FROM files
  WHERE time_point = 'T1' AND series_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY description)"""


@query("patients_by_description", f"{_COUNTS_SQL} SELECT * FROM counts")
def patients_by_description(spark, sf_dir):
    return rp.patients_by_description(files(spark, sf_dir), id_list(spark, sf_dir), "T1")


@query("patients_by_description_total", f"{_COUNTS_SQL} SELECT CAST(sum(num) AS BIGINT) AS total FROM counts")
def patients_by_description_total(spark, sf_dir):
    return rp.total(patients_by_description(spark, sf_dir))


@query(
    "description_ranking",
    """WITH counts AS (SELECT concat(p_name, ', ', p_type) AS description, count(*) AS num FROM part GROUP BY 1)
    SELECT description, num, row_number() OVER (ORDER BY num DESC, description) AS rank,
           concat(replace(description, ',', ' '), ', ', num) AS line FROM counts""",
)
def description_ranking(spark, sf_dir):
    """Counts as a JSON result gives them, with numbers as text, typed and ranked."""
    text = F.concat("p_name", F.lit(", "), "p_type")
    counts = table(spark, sf_dir, "part").groupBy(text.alias("SeriesDescription")).agg(
        F.count(F.lit(1)).cast("string").alias("num")
    )
    return rp.description_ranking(typed_description_counts(counts))


@query(
    "description_ranking_ascending",
    """WITH counts AS (SELECT upper(translate(p_name, '.- ,', '____')) AS description, count(*) AS num FROM part GROUP BY 1)
    SELECT description, num, row_number() OVER (ORDER BY num, description) AS rank,
           concat(description, ', ', num) AS line FROM counts""",
)
def description_ranking_ascending(spark, sf_dir):
    flag = F.get(description_flags(F.col("p_name")), F.lit(0))
    counts = table(spark, sf_dir, "part").groupBy(flag.alias("description")).agg(F.count(F.lit(1)).alias("num"))
    return rp.description_ranking(counts, descending=False)


@query(
    "patients_sketched",
    f"""WITH {_FILES_SQL} SELECT description, count(DISTINCT name.family) AS num, TRUE AS near, count(*) AS n_files
    FROM files WHERE time_point = 'T1' GROUP BY description""",
)
def patients_sketched(spark, sf_dir):
    """Sketches of two halves of the files, written and put together, next to the exact counts."""
    path = new_path(spark, "patient-sketches")
    rows = files(spark, sf_dir)
    for half in (0, 1):
        rp.patient_sketches(rows.where(F.col("series_id") % 2 == half)).write.mode("append").parquet(path)
    sketches = rp.merged_sketches(spark.read.parquet(path))
    exact = rp.patients_by_description(rows, time_point="T1").withColumnRenamed("num", "exact")
    counted = sketches.where("time_point = 'T1'").select("description", "n_files")
    joined = rp.sketched_patients(sketches, "T1").join(exact, "description").join(counted, "description")
    return joined.select("description", F.col("exact").alias("num"), (F.abs(F.col("num") - F.col("exact")) <= 1 + 0.06 * F.col("exact")).alias("near"), "n_files")


@query(
    "label_distribution",
    "SELECT CAST(label AS INT) AS class_id, count(*) AS n FROM embeddings GROUP BY label",
)
def label_distribution(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(sm.one_hot(F.col("label") + 1, 10).alias("label"))
    return rp.label_distribution(rows)


@query(
    "pixel_histogram",
    """WITH v AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
    ends AS (SELECT min(value) AS low, max(value) AS high FROM v)
    SELECT CAST(greatest(least(floor((value - low) / (high - low) * 30), 29), 0) AS BIGINT) AS bin, count(*) AS n
    FROM v, ends GROUP BY 1""",
)
def pixel_histogram(spark, sf_dir):
    return rp.pixel_histogram(table(spark, sf_dir, "embeddings"), "embedding")


@query(
    "pixel_histogram_sketched",
    """WITH v AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
    ends AS (SELECT min(value) AS low, max(value) AS high FROM v),
    binned AS (SELECT CAST(greatest(least(floor((value - low) / (high - low) * 30), 29), 0) AS BIGINT) AS bin FROM v, ends)
    SELECT bin, count(*) AS n, TRUE AS near FROM binned GROUP BY bin""",
)
def pixel_histogram_sketched(spark, sf_dir):
    """Sketches per class put together, next to the exact counts."""
    images = table(spark, sf_dir, "embeddings")
    sketch = rp.merged_pixel_sketches(rp.pixel_sketch(images, "label", pixels="embedding"))
    exact = rp.pixel_histogram(images, "embedding").withColumnRenamed("n", "exact")
    total = images.select(F.size("embedding").alias("n")).agg(F.sum("n").alias("total"))
    joined = exact.join(rp.sketched_histogram(sketch), "bin", "left")
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("exact")) <= 0.02 * total.scalar()
    return joined.select("bin", F.col("exact").alias("n"), near.alias("near"))


@query(
    "metadata_distribution",
    """SELECT 'lang' AS column_name, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL
    SELECT 'source', source, count(*) FROM documents GROUP BY source""",
)
def metadata_distribution(spark, sf_dir):
    return rp.metadata_distribution(table(spark, sf_dir, "documents"), ["lang", "source"])
