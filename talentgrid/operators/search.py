"""Candidate and failure searches: filters, total sort order, pages, envelopes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions.text import CONTROL_AND_SPACE, trim_argument
from talentgrid.operators.ordered import running
from talentgrid.settings import JOB_TYPES, MAX_PAGE_SIZE, SORT_FIELDS, CandidateLost, InvalidQuery, UploadNotFound

TOP_ROWS = 100_000
RESPONSE = (
    "id",
    "upload_id",
    "full_name",
    "years_of_experience",
    "preferred_location",
    "preferred_job_type",
    "skills",
    "source_filename",
)


@dataclass(frozen=True)
class Criteria:
    """Optional filters. Blank text counts as absent; bounds are checked when the object is made."""

    upload_id: str | None = None
    skill: str | None = None
    location: str | None = None
    job_type: str | None = None
    min_experience: int | None = None
    max_experience: int | None = None

    def __post_init__(self):
        for name in ("skill", "location"):
            object.__setattr__(self, name, trim_argument(getattr(self, name)))
        if self.job_type is not None and self.job_type not in JOB_TYPES:
            raise InvalidQuery(f"unknown job type: {self.job_type}")
        low, high = self.min_experience, self.max_experience
        if low is not None and low < 0:
            raise InvalidQuery("minExperience must not be negative")
        if high is not None and high < 0:
            raise InvalidQuery("maxExperience must not be negative")
        if low is not None and high is not None and low > high:
            raise InvalidQuery("minExperience must be less than or equal to maxExperience")

    def conditions(self) -> list[Column]:
        tests = {
            "upload_id": lambda v: F.col("upload_id") == v,
            "skill": lambda v: has_skill(F.col("skills"), v),
            "location": lambda v: F.lower("preferred_location") == v.lower(),
            "job_type": lambda v: F.col("preferred_job_type") == v,
            "min_experience": lambda v: F.col("years_of_experience") >= v,
            "max_experience": lambda v: F.col("years_of_experience") <= v,
        }
        return [test(getattr(self, n)) for n, test in tests.items() if getattr(self, n) is not None]


def has_skill(skills: Column, skill: str) -> Column:
    wanted = skill.strip(CONTROL_AND_SPACE).lower()
    return F.coalesce(F.exists(skills, lambda s: F.lower(s) == wanted), F.lit(False))


def filter_criteria(candidates: DataFrame, criteria: Criteria) -> DataFrame:
    return reduce(DataFrame.filter, criteria.conditions(), candidates)


def filter_skill_bridge(candidates: DataFrame, bridge: DataFrame, skill: str) -> DataFrame:
    """Skill filter when the skills are rows of a bridge table; each candidate comes once."""
    wanted = bridge.filter(F.lower("skill") == skill.strip(CONTROL_AND_SPACE).lower()).select("candidate_id")
    return candidates.join(wanted, F.col("id") == F.col("candidate_id"), "left_semi")


def sort_order(sort_by: str | None = None, direction: str | None = None, strict: bool = False) -> list[Column]:
    """Sort columns with nulls last ascending and first descending, then id.

    Searches trim the arguments and have defaults; exports (``strict``) take them as they are.
    """
    if not strict:
        sort_by = trim_argument(sort_by) or "fullName"
        direction = trim_argument(direction) or "asc"
    if sort_by not in SORT_FIELDS:
        raise InvalidQuery(f"unsupported sort field: {sort_by}")
    if direction is None or direction.lower() not in ("asc", "desc"):
        raise InvalidQuery("direction must be 'asc' or 'desc'")
    column = F.col(SORT_FIELDS[sort_by])
    first = column.asc_nulls_last() if direction.lower() == "asc" else column.desc_nulls_first()
    return [first, F.col("id").asc()]


def sort_candidates(
    candidates: DataFrame, sort_by: str | None = None, direction: str | None = None
) -> DataFrame:
    return candidates.orderBy(*sort_order(sort_by, direction))


def check_page(page: int, size: int) -> None:
    if page < 0:
        raise InvalidQuery("page must not be negative")
    if size < 1:
        raise InvalidQuery("size must be at least 1")
    if size > MAX_PAGE_SIZE:
        raise InvalidQuery(f"size must not exceed {MAX_PAGE_SIZE}")


def page_rows(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of ``df``. Deep pages number the rows in slices instead of one long top-k."""
    check_page(page, size)
    offset = page * size
    if offset + size <= TOP_ROWS:
        return df.orderBy(*order).offset(offset).limit(size)
    numbered = running(df, [], order, number="_row")
    wanted = F.col("_row").between(offset + 1, offset + size)
    return numbered.filter(wanted).orderBy("_row").drop("_row")


def page_candidates(
    candidates: DataFrame,
    page: int = 0,
    size: int = 20,
    sort_by: str | None = None,
    direction: str | None = None,
) -> DataFrame:
    return page_rows(candidates, sort_order(sort_by, direction), page, size)


def page_envelope(
    content: DataFrame, matches: DataFrame, page: int, size: int, order: Sequence[Column] = ()
) -> DataFrame:
    """One row: content, page, size and totals. ``content`` has at most one page of rows.

    Count and page meet in one small union and one aggregate, so there is no join.
    """
    check_page(page, size)
    row = F.struct(*[F.col(c) for c in content.columns])
    # At most one page of rows, so one task may number them.
    place = F.row_number().over(Window.orderBy(*order)) if order else F.lit(1)
    placed = content.withColumn("_row", place)
    items = placed.select(F.lit(0).cast("long").alias("n"), F.struct("_row", row.alias("item")).alias("x"))
    counted = matches.agg(F.count(F.lit(1)).alias("n"))
    both = items.unionByName(counted, allowMissingColumns=True)
    total = both.agg(F.max("n").alias("total_elements"), F.sort_array(F.collect_list("x")).alias("xs"))
    pages = F.ceil(F.col("total_elements") / size).cast("int")
    return total.select(
        F.transform("xs", lambda x: x["item"]).alias("content"),
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        "total_elements",
        pages.alias("total_pages"),
        F.lit(page == 0).alias("first"),
        (F.lit(page + 1) >= pages).alias("last"),
    )


def total_pages(total: int, size: int) -> int:
    return math.ceil(total / size)


def hydrate_candidates(
    ids: DataFrame, candidates: DataFrame, uploads: DataFrame, bridge: DataFrame
) -> DataFrame:
    """Full rows for a list of ids: upload by inner join, skills by left join. Spark chooses the joins by size."""
    wanted = ids.select("id").distinct()
    rows = candidates.drop("skills").join(wanted, "id")
    owners = uploads.select(F.col("id").alias("upload_id"), "original_filename")
    with_upload = owners.join(rows, "upload_id")
    skills = bridge.join(wanted.withColumnRenamed("id", "candidate_id"), "candidate_id")
    lists = skills.groupBy("candidate_id").agg(F.collect_set("skill").alias("skills"))
    joined = with_upload.join(lists, F.col("id") == F.col("candidate_id"), "left").drop("candidate_id")
    return joined.withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


def lost_ids(page_ids: DataFrame, hydrated: DataFrame) -> DataFrame:
    """Ids of the page that hydration did not return; a caller treats any row as an error."""
    return page_ids.select("id").join(hydrated.select("id"), "id", "left_anti")


def distinct_ignoring_case(skills: Column) -> Column:
    """Skills sorted ignoring case, the first spelling of each kept."""
    ordered = sort_ignoring_case(skills)
    lowered = F.transform(ordered, lambda s: F.lower(s))
    return F.filter(ordered, lambda s, i: F.array_position(lowered, F.lower(s)) == i + 1)


def sort_ignoring_case(skills: Column) -> Column:
    keyed = F.transform(skills, lambda s: F.struct(F.lower(s).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def project_candidate(candidates: DataFrame, *keep: str) -> DataFrame:
    skills = distinct_ignoring_case(F.col("skills")).alias("skills")
    return candidates.select(*keep, *[skills if c == "skills" else F.col(c) for c in RESPONSE])


def search_candidates(
    candidates: DataFrame,
    criteria: Criteria = Criteria(),
    page: int = 0,
    size: int = 20,
    sort_by: str | None = None,
    direction: str | None = None,
) -> DataFrame:
    """The page of matching candidates; filters and column choice reach the scan."""
    found = filter_criteria(candidates, criteria).select(*RESPONSE)
    return project_candidate(page_candidates(found, page, size, sort_by, direction))


#: Where the reader of a file source can tell a row's file.
_FILE = "_metadata.file_path"


def search_hydrated(
    tables: Mapping[str, DataFrame],
    criteria: Criteria = Criteria(),
    page: int = 0,
    size: int = 20,
    sort_by: str | None = None,
    direction: str | None = None,
) -> DataFrame:
    """A page in two steps over the stored tables: its ids from narrow columns, then the full rows of those ids alone.

    The first step reads the columns that filter and sort, and its at most MAX_PAGE_SIZE ids come to the driver. The
    second reads the files that hold them, where upload and id are pushed into the scan, with the upload by inner and the
    skills by left join. A row that is gone by then fails the query by its id (CandidateLost's message). `position`
    is the place in the page.
    """
    candidates = tables["candidate"]
    order = sort_order(sort_by, direction)
    keys = dict.fromkeys(["id", "upload_id", SORT_FIELDS[trim_argument(sort_by) or "fullName"]])
    narrow = filter_criteria(candidates, criteria)
    filed = _tells_files(candidates)
    told = narrow.select(*keys, *([F.col(_FILE).alias("_file")] if filed else []))
    found = page_rows(told, order, page, size).collect()
    spark = candidates.sparkSession
    placed = spark.createDataFrame([(i, r.id) for i, r in enumerate(found, 1)], "position int, page_id string")

    ids, owners = [r.id for r in found], sorted({r.upload_id for r in found})
    rows = candidates.drop("skills").filter(F.col("upload_id").isin(owners) & F.col("id").isin(ids))
    if filed:
        rows = rows.filter(F.col(_FILE).isin(sorted({r._file for r in found})))
    uploads = tables["cv_upload"].filter(F.col("id").isin(owners)).select(F.col("id").alias("upload_id"), "original_filename")
    skills = tables["candidate_skill"].filter(F.col("candidate_id").isin(ids))
    lists = skills.groupBy("candidate_id").agg(F.collect_set("skill").alias("skills"))
    full = uploads.join(rows, "upload_id").join(lists, F.col("id") == F.col("candidate_id"), "left")
    met = placed.join(full, F.col("page_id") == F.col("id"), "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    lost = F.raise_error(F.concat(F.lit(CandidateLost.__name__ + ": "), F.col("page_id"))).cast("string")
    sure = met.withColumn("id", F.when(F.col("id").isNull(), lost).otherwise(F.col("id")))
    out = project_candidate(sure.select("position", "original_filename", *RESPONSE), "position", "original_filename")
    return out.orderBy("position")


def _tells_files(df: DataFrame) -> bool:
    try:
        return df.select(_FILE).columns != []
    except AnalysisException:
        return False


#: Years in one bin of the range join; the last bin is open.
BIN_YEARS, LAST_BIN = 5, 20
_CRITERIA = ("skill", "location", "job_type", "min_experience", "max_experience")


def normalize_criteria(criteria: DataFrame) -> DataFrame:
    """Rows of criteria trimmed, blank text absent, with `error` as `Criteria` would raise it."""
    trimmed = criteria.withColumns({c: _trimmed(F.col(c)) for c in ("skill", "location")})
    low, high = F.col("min_experience"), F.col("max_experience")
    error = (
        F.when(~F.col("job_type").isin(*JOB_TYPES), F.concat(F.lit("unknown job type: "), "job_type"))
        .when(low < 0, "minExperience must not be negative")
        .when(high < 0, "maxExperience must not be negative")
        .when(low > high, "minExperience must be less than or equal to maxExperience")
    )
    return trimmed.withColumn("error", error)


def _trimmed(text: Column) -> Column:
    return F.nullif(F.btrim(text, F.lit(CONTROL_AND_SPACE)), F.lit(""))


def _bin(years: Column) -> Column:
    return F.least(F.floor(years / BIN_YEARS), F.lit(LAST_BIN)).cast("int")


def count_matches(candidates: DataFrame, criteria: DataFrame) -> DataFrame:
    """(criteria_id, error, matches) for a table of criteria, searched at once.

    Candidates of one profile (years, job type, location, skills) and criteria that ask for the same are counted once.
    They meet in bins of years: a range of years is in each bin that it touches, and criteria without bounds are in a bin
    of their own, which every profile has too. No pair of rows without a common bin is looked at.
    """
    checked = normalize_criteria(criteria)
    lower = {c: F.lower(c) for c in ("skill", "location")}
    asked = checked.filter("error is null").withColumns(lower).groupBy(*_CRITERIA).agg(F.count(F.lit(1)).alias("_asked"))
    bounded = F.col("min_experience").isNotNull() | F.col("max_experience").isNotNull()
    first = _bin(F.coalesce("min_experience", F.lit(0)))
    last = F.coalesce(_bin(F.col("max_experience")), F.lit(LAST_BIN))
    bins = F.when(bounded, F.sequence(first, last)).otherwise(F.array(F.lit(-1)))
    wanted = asked.drop("_asked").withColumn("_bin", F.explode(bins))

    profile = {
        "_years": F.col("years_of_experience"),
        "_job": F.col("preferred_job_type"),
        "_place": F.lower("preferred_location"),
        "_skills": F.array_sort(F.array_distinct(F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.lower(s)))),
    }
    profiles = candidates.select(*[v.alias(k) for k, v in profile.items()]).groupBy(*profile).agg(F.count(F.lit(1)).alias("_n"))
    own = F.array_compact(F.array(F.lit(-1), _bin(F.col("_years"))))
    met = profiles.withColumn("_bin", F.explode(own)).join(wanted, "_bin").filter(
        (F.col("skill").isNull() | F.array_contains("_skills", F.col("skill")))
        & (F.col("location").isNull() | (F.col("location") == F.col("_place")))
        & (F.col("job_type").isNull() | (F.col("job_type") == F.col("_job")))
        & (F.col("min_experience").isNull() | (F.col("_years") >= F.col("min_experience")))
        & (F.col("max_experience").isNull() | (F.col("_years") <= F.col("max_experience")))
    )
    counts = met.groupBy(*_CRITERIA).agg(F.sum("_n").alias("_matches"))
    renamed = counts.select(*[F.col(c).alias(f"_{c}") for c in _CRITERIA], "_matches")
    same = reduce(lambda a, b: a & b, [(lower.get(c, F.col(c))).eqNullSafe(F.col(f"_{c}")) for c in _CRITERIA])
    told = checked.join(renamed, same, "left")
    matches = F.when(F.col("error").isNull(), F.coalesce("_matches", F.lit(0)))
    return told.select("criteria_id", "error", matches.cast("long").alias("matches"))


def search_response(
    candidates: DataFrame,
    criteria: Criteria = Criteria(),
    page: int = 0,
    size: int = 20,
    sort_by: str | None = None,
    direction: str | None = None,
) -> DataFrame:
    """The page and its totals as one row."""
    rows = search_candidates(candidates, criteria, page, size, sort_by, direction)
    matches = filter_criteria(candidates, criteria)
    return page_envelope(rows, matches, page, size, sort_order(sort_by, direction))


def candidates_of_upload(candidates: DataFrame, upload_id: str) -> DataFrame:
    return candidates.filter(F.col("upload_id") == upload_id)


def candidate_exists(candidates: DataFrame, upload_id: str, filename: str) -> bool:
    same = (F.col("upload_id") == upload_id) & (F.col("source_filename") == filename)
    return not candidates.filter(same).isEmpty()


def existing_candidates(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add ``found`` to a list of (upload_id, source_filename)."""
    keys = ["upload_id", "source_filename"]
    known = candidates.select(*keys).distinct().withColumn("found", F.lit(True))
    joined = wanted.join(known, keys, "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


STATUS = (
    "id",
    "original_filename",
    "status",
    "total_files",
    "processed_files",
    "failed_files",
    "created_at",
    "completed_at",
)


def upload_status(uploads: DataFrame, upload_id: str) -> DataFrame:
    found = uploads.filter(F.col("id") == upload_id).select(*STATUS)
    if found.isEmpty():
        raise UploadNotFound(upload_id)
    return found


def project_failure(failures: DataFrame) -> DataFrame:
    return failures.select("filename", "error_code", "error_message", "created_at")


def page_failures(
    failures: DataFrame, uploads: DataFrame, upload_id: str, page: int = 0, size: int = 20
) -> DataFrame:
    """Failures of an upload, newest first, then by name; id makes the order total."""
    check_page(page, size)
    if uploads.filter(F.col("id") == upload_id).isEmpty():
        raise UploadNotFound(upload_id)
    mine = failures.filter(F.col("upload_id") == upload_id)
    order = [F.col("created_at").desc(), F.col("filename").asc(), F.col("id").asc()]
    return project_failure(page_rows(mine, order, page, size))
