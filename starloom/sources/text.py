"""Text sources: one file per population, read together in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.operators.ordered import forward_fill

# Layout of the catalogue and match files.
CATALOGUE_GLOB = "*.AHF_halos"
MATCH_GLOB = "*_croco"
INDEX_SUFFIX = r"\(\d+\)$"
HEADER_RENAMES = {"ID": "halo_id"}
INTEGER_COLUMNS = frozenset({
    "halo_id",
    "hostHalo",
    "numSubStruct",
    "npart",
    "nbins",
    "n_gas",
    "n_star",
    "n_star_excised",
})
MATCH_SCHEMA = T.StructType([
    T.StructField("simulation_pair_id", T.StringType()),
    T.StructField("wdm_halo_id", T.LongType()),
    T.StructField("wdm_npart", T.LongType()),
    T.StructField("cdm_halo_id", T.LongType()),
    T.StructField("cdm_npart", T.LongType()),
    T.StructField("n_shared", T.LongType()),
    T.StructField("merit", T.DoubleType()),
])


def plain_path(path: Column) -> Column:
    """Local file URIs without their scheme; other paths unchanged."""
    return F.regexp_replace(path, "^file:/+", "/")


def metadata_path() -> Column:
    """Path of the file of a row as it is written, without the URL encoding of the metadata column."""
    return plain_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def strict(cell: Column, kind: str, what: str) -> Column:
    """A trimmed cell as a number; blank cells are NULL, and what is no number raises."""
    text = F.trim(cell)
    value = text.try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"{what} is no {kind}: "), text)).cast(kind)
    return F.when(text == "", F.lit(None).cast(kind)).when(text.isNotNull() & value.isNull(), wrong).otherwise(value)


def one_file_each(spark: SparkSession, directories: dict[str, str], glob: str) -> dict[str, str]:
    """The single file matching the pattern in every directory.

    Only names are listed, no content is read. The list is as long as the configured populations.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(list(dict.fromkeys(directories.values())))
        .select(plain_path(F.col("path")).alias("path"))
        .groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    )
    wanted = spark.createDataFrame(
        [(k, v.rstrip("/")) for k, v in directories.items()], "id string, directory string"
    ).withColumn("directory", plain_path(F.col("directory")))
    found = wanted.join(listed, "directory", "left").collect()
    missing = sorted(r["directory"] for r in found if not r["n"])
    if missing:
        raise FileNotFoundError(f"no {glob} file in {missing}")
    several = sorted(r["directory"] for r in found if r["n"] > 1)
    if several:
        raise ValueError(f"more than one {glob} file in {several}")
    return {r["id"]: r["path"] for r in found}


def tag_by_path(df: DataFrame, files: dict[str, str], path: str, name: str) -> DataFrame:
    """Replace a file path column by the population id that owns the file, as first column.

    A row of a file without an owner raises. The owners are as many as the configured populations.
    """
    owners = F.create_map(*(x for k, p in files.items() for x in (plain_path(F.lit(p)), F.lit(k))))
    owner = owners[plain_path(F.col(path))]
    unknown = F.raise_error(F.concat(F.lit("no population owns the file "), F.col(path))).cast("string")
    return df.select(F.when(owner.isNull(), unknown).otherwise(owner).alias(name), *[c for c in df.columns if c != path])


def clean_header_name(token: Column) -> Column:
    """Header token without its index suffix; a suffix followed by a blank stays."""
    name = F.trim(F.regexp_replace(token, INDEX_SUFFIX, ""))
    for raw, renamed in HEADER_RENAMES.items():
        name = F.when(name == raw, F.lit(renamed)).otherwise(name)
    return name


def header_names(line: Column) -> Column:
    """Array of column names in a ``#`` header line; empty tokens are dropped."""
    body = F.regexp_replace(line, r"^#+\s*|\s+$", "")
    tokens = F.filter(F.split(body, "\t"), lambda t: F.trim(t) != "")
    return F.transform(tokens, clean_header_name)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file; the scan stops at the first header line."""
    lines = spark.read.text(path).where(F.col("value").startswith("#"))
    row = lines.select(header_names(F.col("value")).alias("names")).limit(1).first()
    if row is None:
        raise ValueError(f"no header line in {path}")
    return row["names"]


def schema_of(names: Sequence[str], integers: frozenset[str] = INTEGER_COLUMNS) -> T.StructType:
    return T.StructType([
        T.StructField(n, T.LongType() if n in integers else T.DoubleType()) for n in names
    ])


def check_headers(spark: SparkSession, files: dict[str, str]) -> list[str]:
    """The header that all files share. Each file is read up to its first header line only."""
    names: list[str] = []
    for path in files.values():
        own = read_header(spark, path)
        if names and own != names:
            raise ValueError(f"expected a header of {names} in {path}, found {own}")
        names = own
    return names


def read_catalogue(spark: SparkSession, files: dict[str, str], id_column: str = "simulation_id") -> DataFrame:
    """All catalogue files in one typed scan, tagged by population.

    Lines are split, checked and cast in one pass. Blank-padded numbers are trimmed, a trailing tab is
    ignored and a blank cell is NULL; a short row, a cell that is no number, and a row of a file without
    an owner raise.
    """
    names = check_headers(spark, files)
    lines = spark.read.text(list(files.values())).select(metadata_path().alias("__path"), "value")
    data = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = data.select("__path", F.split("value", "\t").alias("__cells"))
    short = F.raise_error(F.concat(
        F.lit(f"expected rows of {len(names)} columns, found "), F.size("__cells").cast("string"), F.lit(" in "), F.col("__path")
    )).cast("array<string>")
    cells = cells.withColumn("__cells", F.when(F.size("__cells") >= len(names), F.col("__cells")).otherwise(short))
    kinds = {f.name: f.dataType.simpleString() for f in schema_of(names)}
    rows = cells.select(
        "__path", *[strict(F.get("__cells", F.lit(i)), kinds[n], n).alias(n) for i, n in enumerate(names)]
    )
    return tag_by_path(rows, files, "__path", id_column)


def read_matches(spark: SparkSession, files: dict[str, str], id_column: str = "simulation_pair_id") -> DataFrame:
    """Two-level match files as one row per (parent, child).

    A child line is indented by two blanks and belongs to the latest unindented line before it.
    Comments and blank lines are ignored, as are children before any parent. Large files are
    filled per file split, with the last parent of each split carried into the next.
    """
    if not files:
        return spark.createDataFrame([], MATCH_SCHEMA)
    lines = (
        spark.read.text(list(files.values()))
        .select(
            metadata_path().alias("__path"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__line"),
            "value",
        )
        .where(~F.col("value").startswith("#") & F.col("value").rlike(r"\S"))
        .withColumn("__child", F.col("value").startswith("  "))
    )
    # what is sorted is narrow: the id of the file and not its path, numbers of parents, and the text of children only
    lines = tag_by_path(lines, files, "__path", id_column)
    tokens = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    token = lambda i, kind: strict(F.get(tokens, F.lit(i)), kind, f"token {i}")
    parent = ~F.col("__child")
    lines = lines.withColumns({
        "wdm_halo_id": F.when(parent, token(0, "bigint")),
        "wdm_npart": F.when(parent, token(1, "bigint")),
        "value": F.when(F.col("__child"), F.col("value")),
    })
    filled = forward_fill(
        lines, {c: F.col(c) for c in ("wdm_halo_id", "wdm_npart")}, parent, [id_column], ["__line"], ["__block"]
    )
    return filled.where(F.col("__child") & F.col("wdm_halo_id").isNotNull()).select(
        id_column,
        "wdm_halo_id",
        "wdm_npart",
        token(1, "bigint").alias("cdm_halo_id"),
        token(2, "bigint").alias("cdm_npart"),
        token(0, "bigint").alias("n_shared"),
        token(3, "double").alias("merit"),
    )
