"""Series queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.functions import pixels as px
from cohortweave.functions.text import description_flags
from cohortweave.functions.values import typed_list
from cohortweave.operators import series as sr
from cohortweave.operators import tags as tg
from cohortweave.registry.base import MERGED_SQL, SERIES_SQL, SLICES_SQL, query, slice_tags, slices, table, tagged_slices
from cohortweave.schemas import TAG_TYPES
from cohortweave.sources.files import MetadataError, decode_files


@query(
    "slice_order",
    f"WITH {SLICES_SQL} SELECT series_id, path, n_slices, reason, sort_source, z_index FROM placed",
)
def slice_order(spark, sf_dir):
    return sr.slice_order(slices(spark, sf_dir)).drop("sort_key")


@query(
    "middle_slice",
    f"WITH {SLICES_SQL} SELECT series_id, path, n_slices, z_index FROM placed WHERE z_index = n_slices // 2 AND reason IS NULL",
)
def middle_slice(spark, sf_dir):
    return sr.middle_slices(slices(spark, sf_dir))


@query(
    "stack_volume",
    f"""WITH {SLICES_SQL}, cells AS (SELECT *, unnest(range(4)) AS p FROM placed WHERE reason IS NULL)
    SELECT series_id, CAST(z_index * n_rows * n_cols + p AS BIGINT) AS voxel, CAST(pixels[p + 1] AS DOUBLE) AS value
    FROM cells""",
)
def stack_volume(spark, sf_dir):
    # Blocks so small that most volumes have several.
    blocks = sr.volume_blocks(slices(spark, sf_dir), max_voxels=8)
    first = F.col("z_start") * F.get("shape", F.lit(1)) * F.get("shape", F.lit(2))
    return blocks.select("series_id", first.alias("_first"), F.posexplode("voxels").alias("_at", "_value")).select(
        "series_id", (F.col("_first") + F.col("_at")).cast("bigint").alias("voxel"), F.col("_value").cast("double").alias("value")
    )


@query(
    "z_bounds",
    f"""WITH {SLICES_SQL} SELECT series_id, count(*) AS n_slices,
      CASE WHEN count(*) < 2 THEN 0.0 ELSE min(slice_location) END AS z_lo,
      CASE WHEN count(*) < 2 THEN 0.0 ELSE max(slice_location) END AS z_hi FROM slices GROUP BY series_id""",
)
def z_bounds(spark, sf_dir):
    return sr.z_bounds(slices(spark, sf_dir)).select(
        "series_id", "n_slices", F.col("z_bound.lo").alias("z_lo"), F.col("z_bound.hi").alias("z_hi")
    )


@query(
    "tensor_shape",
    f"""WITH {SLICES_SQL}, {SERIES_SQL}, {MERGED_SQL}
    SELECT series_id, array_to_string(list_filter([n_slices, n_rows, n_cols], lambda d: d <> 1), 'x') AS shape,
      CAST(n_slices * n_rows * n_cols AS BIGINT) AS n_voxels FROM merged""",
)
def tensor_shape(spark, sf_dir):
    series = sr.series_metadata(tagged_slices(spark, sf_dir))
    return series.select(
        "series_id",
        F.array_join(px.squeezed_shape(F.col("shape")).cast("array<string>"), "x").alias("shape"),
        px.voxel_count(F.col("shape")).alias("n_voxels"),
    )


@query(
    "metadata_keys",
    """SELECT DISTINCT l_orderkey AS series_id, unnest(CASE WHEN l_returnflag = 'N'
      THEN ['Clinical Trial Time Point ID', 'Modality']
      ELSE ['Clinical Trial Time Point ID', 'Modality', 'Laterality'] END) AS tag FROM lineitem""",
)
def metadata_keys(spark, sf_dir):
    return sr.metadata_keys(slice_tags(spark, sf_dir))


@query(
    "metadata_map",
    """SELECT event_id, u.tag, json_extract_string(props, '$.' || u.tag) AS value,
      TRY_CAST(json_extract_string(props, '$.' || u.tag) AS DOUBLE) AS number
    FROM events, (SELECT unnest(json_keys(props))) AS u(tag) WHERE u.tag <> 'Pixel Data'""",
)
def metadata_map(spark, sf_dir):
    tags = sr.metadata_map(table(spark, sf_dir, "events"), "event_id", "props")
    return tags.select("event_id", F.explode("meta").alias("tag", "value")).withColumn(
        "number", F.get(typed_list(F.array("value"), "double"), F.lit(0))
    )


def _nested_tags(spark, sf_dir):
    """Events as sets of tags: text and numbers mixed, lists, sequences in sequences, a tag that is no number."""
    json = F.concat(
        F.lit('{"Instance Number":"'), "event_id", F.lit('","Slice Location":'), "user_id", F.lit('.5,"Pixel Data":"AA==","Note":null,"Props":'),
        "props", F.lit(',"Rows":'), F.when(F.col("event_id") % 10 == 0, '"none"').otherwise((F.col("event_id") % 7).cast("string")),
        F.lit(',"Referenced Series Sequence":[{"Series Instance UID":'), "user_id", F.lit(',"Frames":[1,"2",'), F.col("event_id") % 5,
        F.lit(']},{"Item":{"Deep":[{"Image Position (Patient)":["0.5",'), F.col("event_id") % 3, F.lit(",2]}]}}"),
        F.when(F.col("event_id") % 4 == 0, ",7").otherwise(""), F.lit("]}"),
    )
    return table(spark, sf_dir, "events").select("event_id", json.alias("tags"))


_NESTED_TYPES = TAG_TYPES | {"Frames": "bigint"}


@query(
    "typed_tags",
    """SELECT event_id, 'Instance Number' AS path, 'Instance Number' AS tag, FALSE AS is_list, CAST(event_id AS VARCHAR) AS i,
             NULL::VARCHAR AS halves, NULL::VARCHAR AS s FROM events UNION ALL
    SELECT event_id, 'Slice Location', 'Slice Location', FALSE, NULL, CAST(user_id * 2 + 1 AS VARCHAR), NULL FROM events UNION ALL
    SELECT event_id, concat('Props/', u.tag), u.tag, FALSE, json_extract_string(props, '$.' || u.tag), NULL, NULL
      FROM events, (SELECT unnest(json_keys(props))) AS u(tag) UNION ALL
    SELECT event_id, 'Rows', 'Rows', FALSE, CAST(event_id % 7 AS VARCHAR), NULL, NULL FROM events WHERE event_id % 10 <> 0 UNION ALL
    SELECT event_id, 'Referenced Series Sequence[0]/Series Instance UID', 'Series Instance UID', FALSE, NULL, NULL, CAST(user_id AS VARCHAR)
      FROM events UNION ALL
    SELECT event_id, 'Referenced Series Sequence[0]/Frames', 'Frames', TRUE, concat('1,2,', event_id % 5), NULL, NULL FROM events UNION ALL
    SELECT event_id, 'Referenced Series Sequence[1]/Item/Deep[0]/Image Position (Patient)', 'Image Position (Patient)', TRUE, NULL,
      concat('1,', event_id % 3 * 2, ',4'), NULL FROM events""",
)
def typed_tags(spark, sf_dir):
    tags = tg.typed_tags(_nested_tags(spark, sf_dir), "event_id", "tags", _NESTED_TYPES)
    return tags.select(
        "event_id",
        "path",
        "tag",
        "is_list",
        F.array_join(F.col("value.i").cast("array<string>"), ",").alias("i"),
        F.array_join(F.transform("value.f", lambda x: (x * 2).cast("bigint").cast("string")), ",").alias("halves"),
        F.array_join("value.s", ",").alias("s"),
    )


@query(
    "tag_faults",
    """SELECT event_id, 'Rows' AS path, 'Rows' AS tag, 'not_bigint' AS reason FROM events WHERE event_id % 10 = 0 UNION ALL
    SELECT event_id, 'Referenced Series Sequence[2]', 'Referenced Series Sequence', 'not_tags' FROM events WHERE event_id % 4 = 0""",
)
def tag_faults(spark, sf_dir):
    return tg.tag_faults(_nested_tags(spark, sf_dir), "event_id", "tags", _NESTED_TYPES)


@query(
    "representative_values",
    f"""WITH {SLICES_SQL}, tags AS (
      SELECT series_id, 'Clinical Trial Time Point ID' AS tag, tag_time AS value FROM slices UNION ALL
      SELECT series_id, 'Modality', tag_modality FROM slices UNION ALL
      SELECT series_id, 'Laterality', tag_laterality FROM slices)
    SELECT series_id, tag, min(value) AS value, count(DISTINCT value) AS n_distinct FROM tags
    WHERE value <> '' GROUP BY series_id, tag""",
)
def representative_values(spark, sf_dir):
    return sr.representative_values(slice_tags(spark, sf_dir))


@query(
    "tag_columns",
    f"WITH {SLICES_SQL} SELECT path, tag_time AS time_point, tag_modality AS modality, nullif(tag_laterality, '') AS laterality FROM slices",
)
def tag_columns(spark, sf_dir):
    return sr.tag_columns(slice_tags(spark, sf_dir)).select("path", "time_point", "modality", "laterality")


@query(
    "series_metadata",
    f"""WITH {SLICES_SQL}, {SERIES_SQL}, {MERGED_SQL}
    SELECT series_id, patient_id, study_id, time, flags, laterality, modality, slice_spacing,
      pixel_spacing[1] AS dx, pixel_spacing[2] AS dy, position[3] AS z, orientation[1] AS o1, z_lo, z_hi,
      CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols, n_slices, status FROM merged""",
)
def series_metadata(spark, sf_dir):
    series = sr.series_metadata(tagged_slices(spark, sf_dir))
    at = lambda c, i: F.get(c, F.lit(i))
    return series.select(
        "series_id",
        "patient_id",
        "study_id",
        "time",
        F.array_join("flags", "_").alias("flags"),
        "laterality",
        "modality",
        "slice_spacing",
        at("pixel_spacing", 0).alias("dx"),
        at("pixel_spacing", 1).alias("dy"),
        at("position", 2).alias("z"),
        at("orientation", 0).alias("o1"),
        F.col("z_bound.lo").alias("z_lo"),
        F.col("z_bound.hi").alias("z_hi"),
        at("shape", 1).alias("n_rows"),
        at("shape", 2).alias("n_cols"),
        "n_slices",
        "status",
    )


@query(
    "description_flags",
    """SELECT p_partkey, upper(translate(replace(concat(p_name, ', ', p_brand, '.', p_type), 'ACRIN_6657/', ''),
      '.- ,', '____')) AS flag FROM part""",
)
def description_flags_of_parts(spark, sf_dir):
    text = F.concat("p_name", F.lit(", "), "p_brand", F.lit("."), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.get(description_flags(text), F.lit(0)).alias("flag"))


@query(
    "series_features",
    f"""WITH {SLICES_SQL}, {SERIES_SQL}, {MERGED_SQL}
    SELECT patient_id, series_id, concat('time', substr(time, 2), '/', flags, '/') AS feature_name,
      concat(study_id, '/', series_id, '/') AS dicom_id, pixel_spacing[1] AS dx, pixel_spacing[2] AS dy,
      slice_spacing AS dz, CAST(modality = 'SEG' AS INT) AS is_seg, CAST(laterality = 'R' AS INT) AS "right"
    FROM merged WHERE status = 'ok'""",
)
def series_features(spark, sf_dir):
    features = sr.series_features(sr.series_metadata(tagged_slices(spark, sf_dir)))
    return features.select(
        "patient_id", "series_id", "feature_name", "dicom_id", "dx", "dy", "dz", "is_seg", "right"
    )


_FEATURE_SQL = f"""WITH {SLICES_SQL}, {SERIES_SQL}, {MERGED_SQL},
named AS (SELECT *, concat('time', substr(time, 2), '/', flags, '/') AS name FROM merged WHERE status = 'ok'),
cells AS (
  SELECT patient_id, series_id, concat(name, 'image') AS feature_name, 0 AS place, NULL::BIGINT AS i, NULL::DOUBLE AS f,
         CAST(series_id AS VARCHAR) AS s FROM named UNION ALL
  SELECT patient_id, series_id, concat(name, 'dicom_id'), 0, NULL, NULL, concat(study_id, '/', series_id, '/') FROM named UNION ALL
  SELECT patient_id, series_id, concat(name, 'dx'), 0, NULL, pixel_spacing[1], NULL FROM named UNION ALL
  SELECT patient_id, series_id, concat(name, 'dy'), 0, NULL, pixel_spacing[2], NULL FROM named UNION ALL
  SELECT patient_id, series_id, concat(name, 'dz'), 0, NULL, slice_spacing, NULL FROM named UNION ALL
  SELECT patient_id, series_id, concat(name, 'is_seg'), 0, CAST(modality = 'SEG' AS BIGINT), NULL, NULL FROM named UNION ALL
  SELECT patient_id, series_id, concat(name, 'right'), 0, CAST(laterality = 'R' AS BIGINT), NULL, NULL FROM named UNION ALL
  SELECT patient_id, series_id, concat(name, 'shape'), p, [n_slices, n_rows, n_cols][p + 1], NULL, NULL
    FROM (SELECT *, unnest(range(3)) AS p FROM named) UNION ALL
  SELECT patient_id, series_id, concat(name, 'Image Position (Patient)'), p, NULL, position[p + 1], NULL
    FROM (SELECT *, unnest(range(3)) AS p FROM named) UNION ALL
  SELECT patient_id, series_id, concat(name, 'Image Orientation (Patient)'), p, NULL, orientation[p + 1], NULL
    FROM (SELECT *, unnest(range(6)) AS p FROM named) UNION ALL
  SELECT patient_id, series_id, concat(name, 'z_bound'), p, NULL, [z_lo, z_hi][p + 1], NULL
    FROM (SELECT *, unnest(range(2)) AS p FROM named))
SELECT patient_id, series_id, feature_name, CAST(place AS INT) AS place, i, f, s FROM cells"""


@query("feature_long", _FEATURE_SQL)
def feature_long(spark, sf_dir):
    long = sr.feature_long(sr.series_features(sr.series_metadata(tagged_slices(spark, sf_dir))))
    i, f, s = F.col("value.i"), F.col("value.f"), F.col("value.s")
    cells = F.when(i.isNotNull(), F.transform(i, lambda x: F.struct(x.alias("i"), F.lit(None).cast("double").alias("f"))))
    cells = cells.when(f.isNotNull(), F.transform(f, lambda x: F.struct(F.lit(None).cast("bigint").alias("i"), x.alias("f"))))
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("f")))
    return long.select(
        "patient_id", "series_id", "feature_name", s.alias("s"), F.posexplode(cells.otherwise(none)).alias("place", "v")
    ).select("patient_id", "series_id", "feature_name", "place", "v.i", "v.f", "s")


def _title_decoder(path: str, content: bytes) -> dict:
    """A stand-in for an image decoder: the bytes of a page and where its title starts."""
    at = content.find(b"<title>")
    if at < 0:
        raise MetadataError("no title")
    return {"n_bytes": len(content), "title_at": at}


@query(
    "slice_ingest_status",
    """SELECT url AS path, CASE WHEN contains(html, '<title>') THEN octet_length(encode(html)) END AS n_bytes,
      CASE WHEN contains(html, '<title>') THEN octet_length(encode(html[:strpos(html, '<title>') - 1])) END AS title_at,
      CASE WHEN contains(html, '<title>') THEN 'ok' ELSE 'metadata_error' END AS status FROM pages""",
)
def slice_ingest_status(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("title_at", T.LongType())])
    return decode_files(pages, _title_decoder, schema).drop("reason")


@query(
    "series_quarantine",
    f"WITH {SLICES_SQL} SELECT series_id, n_slices, reason FROM facts WHERE reason IS NOT NULL",
)
def series_quarantine(spark, sf_dir):
    return sr.series_quarantine(slices(spark, sf_dir))
