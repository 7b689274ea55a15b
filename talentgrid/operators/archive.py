"""Validation of archive manifests: one row per entry in, one verdict per archive out.

A manifest has upload_id, entry_no (1, 2, … in archive order), entry_name, is_directory, size_bytes.
Single rules read the whole manifest. Only the verdict drops entries in the scan: an archive is rejected at the
latest by the entry after ``max_entries``, so entries beyond that one never change it, and its groups are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions.paths import UNSAFE, is_cv_name, normalize_path, parents
from talentgrid.functions.text import is_blank
from talentgrid.operators.ordered import running
from talentgrid.settings import ArchiveLimits

# The messages of a rejected upload.
EMPTY_UPLOAD = "Uploaded file must not be empty"
NOT_A_ZIP_NAME = "Only ZIP archives are supported"
TOO_MANY = "ZIP contains too many entries"
INVALID_NAME = "ZIP contains an invalid entry name"
INVALID_PATH = "ZIP contains an invalid path"
UNSAFE_PATH = "ZIP contains an unsafe path"
BAD_EXTENSION = "ZIP may contain only PDF and DOCX files"
DUPLICATE = "ZIP contains duplicate file paths"
TOO_LARGE_FILE = "A CV exceeds the maximum allowed size"
TOO_LARGE_TOTAL = "ZIP expands beyond the maximum allowed size"
NO_FILES = "ZIP does not contain any supported CV files"
CORRUPT = "Uploaded file is not a valid ZIP archive"
CANNOT_EXTRACT = "Failed to extract ZIP archive"
ENTRY_REASONS = (
    TOO_MANY,
    INVALID_NAME,
    INVALID_PATH,
    UNSAFE_PATH,
    BAD_EXTENSION,
    DUPLICATE,
    CANNOT_EXTRACT,
    TOO_LARGE_FILE,
    TOO_LARGE_TOTAL,
)

ENTRY = ("upload_id", "entry_no", "entry_name", "is_directory", "size_bytes")


def upload_request_error(filename: Column, size_bytes: Column) -> Column:
    named_zip = F.coalesce(F.lower(filename).endswith(".zip"), F.lit(False))
    return F.when(F.coalesce(size_bytes, F.lit(0)) <= 0, EMPTY_UPLOAD).when(
        ~named_zip, NOT_A_ZIP_NAME
    )


def validate_upload_request(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("error", upload_request_error(F.col("original_filename"), F.col("size_bytes")))


def name_error(name: Column, norm: Column) -> Column:
    return (
        F.when(name.isNull() | is_blank(name), INVALID_NAME)
        .when(F.contains(name, F.lit("\0")), INVALID_PATH)
        .when(norm == UNSAFE, UNSAFE_PATH)
    )


def zip_entry_count(manifest: DataFrame, limits: ArchiveLimits) -> DataFrame:
    return manifest.filter(F.col("entry_no") > limits.max_entries)


def zip_safe_path(manifest: DataFrame) -> DataFrame:
    named = manifest.withColumn("norm_path", normalize_path(F.col("entry_name")))
    return named.withColumn("error", name_error(F.col("entry_name"), F.col("norm_path")))


def zip_allowed_extension(manifest: DataFrame) -> DataFrame:
    files = zip_safe_path(manifest).filter(~F.col("is_directory") & F.col("error").isNull())
    return files.filter(~is_cv_name(F.col("norm_path"))).drop("error")


def zip_duplicate_path(manifest: DataFrame) -> DataFrame:
    """Files whose path an earlier entry of the archive has, as a file or as a folder."""
    named = zip_safe_path(manifest).filter(F.col("error").isNull() & (F.col("norm_path") != ""))
    own = F.when(F.col("is_directory"), F.array("norm_path")).otherwise(F.array().cast("array<string>"))
    folders = named.select("upload_id", "entry_no", F.explode(F.concat(own, parents(F.col("norm_path")))).alias("path"))
    files = named.filter(~F.col("is_directory"))
    claims = folders.unionByName(files.select("upload_id", "entry_no", F.col("norm_path").alias("path")))
    first = claims.groupBy("upload_id", "path").agg(F.min("entry_no").alias("first_no"))
    owned = files.join(first.withColumnRenamed("path", "norm_path"), ["upload_id", "norm_path"])
    return owned.filter("first_no < entry_no").select("upload_id", "entry_no", "entry_name", "norm_path")


def zip_single_file_size(manifest: DataFrame, limits: ArchiveLimits) -> DataFrame:
    return manifest.filter(~F.col("is_directory") & (F.col("size_bytes") > limits.max_single_bytes))


def with_bytes_before(entries: DataFrame) -> DataFrame:
    """Bytes of the files before each entry; call on examined entries, whose groups are bounded."""
    before = (
        Window.partitionBy("upload_id").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    size = F.when(~F.col("is_directory"), F.col("size_bytes"))
    return entries.withColumn("bytes_before", F.coalesce(F.sum(size).over(before), F.lit(0)))


def zip_total_size(manifest: DataFrame, limits: ArchiveLimits) -> DataFrame:
    """Files at which the bytes of the archive so far exceed the limit."""
    size = F.when(~F.col("is_directory"), F.col("size_bytes")).otherwise(0)
    counted = running(manifest, ["upload_id"], ["entry_no"], sums={"total_bytes": size})
    return counted.filter(~F.col("is_directory") & (F.col("total_bytes") > limits.max_total_bytes))


def zip_has_files(archives: DataFrame, manifest: DataFrame) -> DataFrame:
    counts = manifest.groupBy("upload_id").agg(F.count_if(~F.col("is_directory")).alias("file_count"))
    joined = archives.select("upload_id").join(counts, "upload_id", "left")
    return joined.filter(F.coalesce("file_count", F.lit(0)) == 0).select("upload_id")


def entry_error(limits: ArchiveLimits) -> Column:
    """First rule an entry breaks by itself or by the bytes before it, in the order the rules apply."""
    room = F.lit(limits.max_total_bytes) - F.col("bytes_before")
    too_large = F.col("size_bytes") > limits.max_single_bytes
    over_total = F.col("size_bytes") > room
    is_file = ~F.col("is_directory")
    return (
        F.when(F.col("entry_no") > limits.max_entries, TOO_MANY)
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(is_file & ~is_cv_name(F.col("norm_path")), BAD_EXTENSION)
        .when(is_file & too_large & (~over_total | (room >= limits.max_single_bytes)), TOO_LARGE_FILE)
        .when(is_file & over_total, TOO_LARGE_TOTAL)
    )


def _place(reason: Column) -> Column:
    """Entry and reason in one number: the least one of an archive tells its first broken rule."""
    return F.col("entry_no").cast("long") * 16 + F.array_position(F.array(*[F.lit(r) for r in ENTRY_REASONS]), reason)


def path_claims(entries: DataFrame, limits: ArchiveLimits) -> DataFrame:
    """The paths that each entry claims: (upload_id, entry_no, claim, place, corrupt, files, bytes).

    A file claims its own path and every folder above it; a folder entry claims all of them as folders. The first
    claim of an entry, or its only row where it has none, also carries what the verdict needs of the entry.
    """
    checked = zip_safe_path(entries).withColumn("_place", _place(entry_error(limits)))
    own = F.struct(F.col("norm_path").alias("path"), F.col("is_directory").alias("folder"))
    above = F.transform(
        parents(F.col("norm_path")), lambda p: F.struct(p.alias("path"), F.lit(True).alias("folder"))
    )
    claimed = F.when(F.col("error").isNull() & (F.col("norm_path") != ""), F.concat(F.array(own), above))
    size = F.when(~F.col("is_directory"), F.col("size_bytes"))
    rows = checked.select(
        "upload_id", "entry_no", "corrupt", "_place", (~F.col("is_directory")).alias("_file"), size.alias("_size"),
        F.posexplode_outer(claimed).alias("_pos", "claim"),
    )
    first = F.coalesce("_pos", F.lit(0)) == 0
    return rows.select(
        "upload_id", "entry_no", "claim",
        F.when(first, F.col("_place")).alias("place"),
        F.when(first, F.col("corrupt")).alias("corrupt"),
        F.when(first & F.col("_file"), 1).alias("files"),
        F.when(first, F.col("_size")).alias("bytes"),
    )


def zip_verdict(archives: DataFrame, manifest: DataFrame, limits: ArchiveLimits) -> DataFrame:
    """(upload_id, accepted, reason, file_count, total_bytes) for every archive.

    One shuffle on upload_id brings an archive's examined entries together: their bytes are summed in archive order,
    claims of one path are read in that order, and the least place of a broken rule is the archive's.
    """
    # An unreadable archive has a row with archive_error and no entry_no, which only says why.
    told = "archive_error" in manifest.columns
    corrupt = F.col("archive_error") if told else F.lit(None).cast("string")
    wanted = F.col("entry_no").isNull() | (F.col("entry_no") <= limits.max_entries + 1)
    entries = manifest.filter(wanted).select(*ENTRY, corrupt.alias("corrupt"))
    claims = path_claims(with_bytes_before(entries), limits)
    # The groups lie within an archive, so neither this window nor the grouping moves rows again.
    earlier = Window.partitionBy("upload_id", "claim.path").orderBy("entry_no")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    folder = F.col("claim.folder")
    met = claims.select(
        "*",
        F.min("entry_no").over(before).alias("_first"),
        F.min(F.when(~folder, F.col("entry_no"))).over(before).alias("_first_file"),
    )
    number = F.col("entry_no")
    clash = F.when(~folder & (F.col("_first") < number), _place(F.lit(DUPLICATE))).when(
        folder & (F.col("_first_file") < number), _place(F.lit(CANNOT_EXTRACT))
    )
    per_archive = met.groupBy("upload_id").agg(
        F.least(F.min("place"), F.min(clash)).alias("place"),
        F.max("corrupt").alias("corrupt"),
        F.count("files").alias("files"),
        F.sum("bytes").alias("bytes"),
    )
    # element_at over literals does not give null for a null index, hence the test.
    reasons = F.array(*[F.lit(r) for r in ENTRY_REASONS])
    first = F.when(F.col("place").isNotNull(), F.element_at(reasons, (F.col("place") % 16).cast("int")))
    per_archive = per_archive.withColumn("reason", first)
    joined = archives.select("upload_id").join(per_archive, "upload_id", "left")
    reason = F.coalesce(
        "reason",
        "corrupt",
        F.when(F.coalesce("files", F.lit(0)) == 0, NO_FILES),
    )
    judged = joined.withColumn("reason", reason)
    accepted = F.col("reason").isNull()
    return judged.select(
        "upload_id",
        accepted.alias("accepted"),
        "reason",
        F.when(accepted, F.col("files")).alias("file_count"),
        F.when(accepted, F.col("bytes")).alias("total_bytes"),
    )
