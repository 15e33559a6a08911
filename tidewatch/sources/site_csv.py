"""The published CSV of site/venue pairs."""

from __future__ import annotations

import csv
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import blank_to_null, strip

# The served columns of the published file, by how their cells are read.
TEXT, NUMBER, INTEGER, COUNT, LIST, DOCUMENTS, FLAG = (
    "text", "number", "integer", "count", "list", "documents", "flag",
)
COLUMNS = {
    "site_id": TEXT,
    "site_name": TEXT,
    "postcode": TEXT,
    "local_authority_code": TEXT,
    "local_authority_name": TEXT,
    "ownership_type_group": TEXT,
    "site_lat": NUMBER,
    "site_lng": NUMBER,
    "ap_facility_count": INTEGER,
    "oa_location_names": LIST,
    "oa_lat": NUMBER,
    "oa_lng": NUMBER,
    "oa_dataset_urls": LIST,
    "oa_publisher_names": LIST,
    "oa_postal_codes": LIST,
    "oa_kinds": LIST,
    "oa_opportunity_count": COUNT,
    "oa_location_json": DOCUMENTS,
    "distance_metres": NUMBER,
    "match_method": TEXT,
    "name_similarity": NUMBER,
    "spatial_match": FLAG,
    "postcode_match": FLAG,
    "is_primary_for_venue": FLAG,
    "is_mutual_best": FLAG,
}

_CSV = {"multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_WHOLE = r"^\s*[+-]?\d+\s*$"
# A piece between pipes, where pipes inside a JSON string do not separate.
_DOCUMENT = r'(?s)((?:[^"|]++|"(?:[^"\\]++|\\.)*+(?:"|$))++)'


def _non_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda part: F.length(part) > 0)


def _list_or_empty(parts: Column) -> Column:
    return F.coalesce(_non_empty(parts), F.array().cast("array<string>"))


def read_cell(cell: Column, how: str) -> Column:
    """One text cell as its typed value; blank gives null, an empty array or false."""
    text = blank_to_null(cell)
    if how == NUMBER:
        return F.when(text.rlike(_DECIMAL), text.try_cast("double"))
    if how in (INTEGER, COUNT):
        return F.when(text.rlike(_WHOLE), text.try_cast("int" if how == INTEGER else "bigint"))
    if how == FLAG:
        return F.coalesce(F.lower(strip(text)) == "true", F.lit(False))
    if how == LIST:
        return _list_or_empty(F.split(text, r"\|"))  # split without a pattern, unlike [|]
    if how == DOCUMENTS:
        return _list_or_empty(F.regexp_extract_all(text, F.lit(_DOCUMENT), F.lit(1)))
    return text


def site_mappings_from_text(cells: DataFrame) -> DataFrame:
    """Typed pairs from a frame of text columns; absent columns are empty, idless rows go."""
    missing = F.lit(None).cast("string")
    present = set(cells.columns)
    return cells.select(
        *[
            read_cell(F.col(name) if name in present else missing, how).alias(name)
            for name, how in COLUMNS.items()
        ]
    ).where(F.col("site_id").isNotNull())


def _columns(header: str) -> list[str]:
    """Column names of a header line: any case, stray blanks allowed, the first of repeats wins."""
    names: list[str] = []
    for position, cell in enumerate(next(csv.reader([header]), [])):
        name = cell.lstrip("\ufeff").strip().lower()
        names.append(name if name and name not in names else f"_ignored_{position}")
    if "site_id" not in names:
        raise ValueError(f"a site mapping CSV has no site_id column; its header is: {header}")
    return names


def read_headers(spark: SparkSession, path: str) -> dict[str, str]:
    """The first line of each CSV file, or of all files of a folder, that is not blank; files without one are left out.

    The files are listed without being read, and of each no more than the beginning: the one task that looks for its
    header stops at the first line it finds.
    """
    files = spark.read.format("binaryFile").load(path).select("path").collect()  # a row a file
    found = {r.path: spark.read.text(r.path).where(F.btrim("value") != "").first() for r in files}
    return {file: row.value for file, row in found.items() if row is not None}


def load_site_mappings(spark: SparkSession, path: str, headers: Mapping[str, str] | None = None) -> DataFrame:
    """Read the CSV file, or all CSV files of a folder, by header name.

    The header lines (one line each, without line breaks in their cells) name the columns; a caller who knows them
    gives them by file, else they are read.  Files of one header are read together, and the rows themselves by
    Spark.  A file is one task, since its cells may hold line breaks.
    """
    files: dict[str, list[str]] = {}
    for file, header in (read_headers(spark, path) if headers is None else headers).items():
        files.setdefault(header, []).append(file)
    if not files:
        empty = T.StructType([T.StructField(name, T.StringType()) for name in COLUMNS])
        return site_mappings_from_text(spark.createDataFrame([], empty))
    parts = []
    for header, paths in sorted(files.items()):
        schema = T.StructType([T.StructField(name, T.StringType()) for name in _columns(header)])
        cells = spark.read.options(header=True, enforceSchema=True, **_CSV).schema(schema).csv(sorted(paths))
        parts.append(site_mappings_from_text(cells))
    return reduce(DataFrame.unionByName, parts)
