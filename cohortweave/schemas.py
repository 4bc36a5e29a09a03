"""Fixed values and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These names must be spelled exactly so for results to agree.
# ---------------------------------------------------------------------------

# Columns of the outcome file, by position.
OUTCOME_COLUMNS = [
    "SUBJECTID",
    "DataExtractDt",
    "sstat",
    "survDtD2 (tx)",
    "RFS",
    "rfs_ind",
    "PCR",
    "RCBClass",
]

# Columns of the clinical file, by position.
CLINICAL_COLUMNS = [
    "SUBJECTID",
    "DataExtractDt",
    "age",
    "race_id",
    "ERpos",
    "PgRpos",
    "HR Pos",
    "Her2MostPos",
    "HR_HER2_CATEGORY",
    "HR_HER2_STATUS",
    "BilateralCa",
    "Laterality",
    "MRI LD Baseline",
    "MRI LD 1-3dAC",
    "MRI LD InterReg",
    "MRI LD PreSurg",
]

# Series descriptions kept by default.
IMAGE_DESCRIPTIONS = [
    "2-FSE-Sagittal",
    "T2 right breast",
    "ACRIN_6657/FL3D_T1_SAG_CA_",
    "T2 left breast",
    "T1 right breast",
    "T1 left breast",
    "uni sag t2 fse_L",
    "RT IR-SPGR SAG",
    "ACRIN_6657/FSE_T2_SAG_NO_F",
    "ACRIN_6657/FSE_T2_SAG_FS_C",
    "LT Sag T1",
    "RT Sag T1",
    "RT Sag FSE T2 - FatSat",
    "T2-FSE-Unilat.-Sagittal",
    "LT IR-SPGR SAG",
    "LT Sag FSE T2 - FatSat",
    "fl3d_sag_uni_R",
    "uni sag t2 fse",
    "ACRIN_6657/FL3D_T1_SAG_CA",
]

# Segmentations added when whole patients are batched.
SEGMENTATION_DESCRIPTIONS = [
    "Breast Tissue Segmentation",
    "VOI Breast Tissue Segmentation",
]

# Image features a simplified record must have.
REQUIRED_FEATURES = [
    "time1/MRI_DCE/image",
    "time1/SEG_VOI/image",
    "time1/Tissue_SEG/image",
]

# Image features a sample may be taken from, best first.
PREFERRED_FEATURES = [
    "time1/FSE_T2_SAG_NO_F/image",
    "time1/FL3D_T1_SAG_CA/image",
    "time1/2_FSE_SAGITTAL/image",
    "time1/T2_LEFT_BREAST/image",
    "time1/LT_SAG_T1/image",
    "time1/T2_FSE_UNILAT__SAGITTAL/image",
    "time1/LT_SAG_FSE_T2___FATSAT/image",
    "time1/FSE_T2_SAG_FS_C/image",
    "time1/FL3D_SAG_UNI_R/image",
    "time1/T1_LEFT_BREAST/image",
    "time1/RT_SAG_T1/image",
    "time1/T1_RIGHT_BREAST/image",
    "time1/FL3D_T1_SAG_CA_/image",
    "time1/RT_SAG_FSE_T2___FATSAT/image",
    "time1/UNI_SAG_T2_FSE/image",
    "time1/UNI_SAG_T2_FSE_L/image",
    "time1/T2_RIGHT_BREAST/image",
    "time1/LT_IR_SPGR_SAG/image",
    "time1/RT_IR_SPGR_SAG/image",
]

# Site prefix removed from a description, and the marks that become "_".
DESCRIPTION_PREFIX = "ACRIN_6657/"
DESCRIPTION_MARKS = ".- ,"

# Tags of an image file.
TAG_TIME = "Clinical Trial Time Point ID"
TAG_DESCRIPTION = "Series Description"
TAG_STUDY = "Study Instance UID"
TAG_SERIES = "Series Instance UID"
TAG_SUBJECT = "Clinical Trial Subject ID"
TAG_LATERALITY = "Laterality"
TAG_MODALITY = "Modality"
TAG_PIXELS = "Pixel Data"

# Types of tags whose values are numbers, or ids made of digits.
TAG_TYPES = {
    "Slice Location": "double",
    "Spacing Between Slices": "double",
    "Slice Thickness": "double",
    "Pixel Spacing": "double",
    "Image Position (Patient)": "double",
    "Image Orientation (Patient)": "double",
    "Instance Number": "bigint",
    "Series Number": "bigint",
    "Rows": "bigint",
    "Columns": "bigint",
    "Study Instance UID": "string",
    "Series Instance UID": "string",
    "Clinical Trial Subject ID": "string",
    "Clinical Trial Time Point ID": "string",
}

# Defaults of absent values in the outputs.
MISSING = -1
DEFAULT_TIME = "t-1"
DEFAULT_SUBJECT = "UNKNOWN"
DEFAULT_POSITION = [-1.0, -1.0, -1.0]
DEFAULT_ORIENTATION = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
ABSENT_IMAGE_VALUE = -10000.0

# Sample preparation.
SAMPLE_HEIGHT = 256
SAMPLE_WIDTH = 256
RESPONSE_GROUPS = 3
CHANNEL_MEANS = [123.68, 116.779, 103.939]
MAX_ROTATION = 0.2
NOISE_STDDEV = 0.2

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

SLICES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("study_id", T.StringType()),
        T.StructField("series_id", T.StringType()),
        T.StructField("patient_id", T.StringType()),
        T.StructField("slice_location", T.DoubleType()),
        T.StructField("position", T.ArrayType(T.DoubleType())),
        T.StructField("orientation", T.ArrayType(T.DoubleType())),
        T.StructField("pixel_spacing", T.ArrayType(T.DoubleType())),
        T.StructField("slice_spacing", T.DoubleType()),
        T.StructField("rows", T.IntegerType()),
        T.StructField("cols", T.IntegerType()),
        T.StructField("pixels", T.ArrayType(T.FloatType())),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("status", T.StringType()),
    ]
)

DESCRIPTION_COUNTS = T.StructType(
    [
        T.StructField("SeriesDescription", T.StringType()),
        T.StructField("num", T.StringType()),
    ]
)
