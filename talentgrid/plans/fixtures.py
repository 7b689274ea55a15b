"""Résumé-shaped tables derived from the supplied tables.

Each one is a SELECT over whole supplied tables, written once and rendered for Spark and for the SQL
oracle. ``LIST(..)``, ``ELEM(list, i)``, ``UNIQUE(list)`` and ``SHA(x)`` stand for the functions whose
names differ between the two.
"""

from __future__ import annotations

import re
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.functions.patterns import KNOWN_SKILLS
from talentgrid.operators.ordered import running
from talentgrid.schemas import TABLES as STORED
from talentgrid.session import staging_folder
from talentgrid.settings import DOCX_TYPE, PDF_TYPE
from talentgrid.sources.tables import load_tables, store_tables

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

_FIRST = "LIST('Ada','Grace','Alan','Linus','Anne-Marie','Omar','Mei','Ravi','Zoe','Ivan','Lena','Tom')"
_LAST = "LIST('Lovelace','Hopper','O''Neil','Smith','Garcia','Khan','Chen','Patel','St. Clair','Novak','Weber','Lee')"
_TITLE = "LIST('Senior Software Engineer','Backend Developer','Data Analyst','QA Tester','DevOps Lead')"
_SKILLS = "LIST(" + ",".join(f"'{s}'" for s in KNOWN_SKILLS) + ")"
_NAME = (
    f"ELEM({_FIRST}, cast(c_custkey % 12 as int) + 1) || ' ' ||"
    f" ELEM({_LAST}, cast(floor(c_custkey / 12) as int) % 12 + 1)"
)


def _skill(step: int) -> str:
    return f"ELEM({_SKILLS}, cast((c_custkey * {step}) % 24 as int) + 1)"


def _upload(key: str) -> str:
    return f"'u' || lpad(cast({key} as string), 8, '0')"


SQL = {
    "cv_upload": f"""
        SELECT {_upload('o_orderkey')} AS id,
            {_upload('o_orderkey')} || '.zip' AS original_filename,
            CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED'
                WHEN o_orderstatus = 'P' THEN 'COMPLETED_WITH_ERRORS'
                WHEN o_orderkey % 3 = 0 THEN 'UPLOADED'
                WHEN o_orderkey % 3 = 1 THEN 'PROCESSING' ELSE 'FAILED' END AS status,
            cast(1 + o_orderkey % 9 as int) AS total_files,
            cast(CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 0
                ELSE floor((1 + o_orderkey % 9) / 2) END as int) AS processed_files,
            cast(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END as int) AS failed_files,
            o_orderdate AS created_at,
            CASE WHEN o_orderstatus <> 'O' OR o_orderkey % 3 = 2
                THEN o_orderdate + cast(o_orderkey % 20 as int) * interval '1' day END AS completed_at,
            o_orderpriority AS priority
        FROM orders""",
    "upload_storage_cleanup": """
        SELECT id AS upload_id, completed_at + 8 * interval '1' day AS cleaned_at
        FROM cv_upload WHERE status = 'COMPLETED' AND priority = '1-URGENT'""",
    "zip_entries": f"""
        SELECT upload_id, entry_name, entry_name LIKE '%/' AS is_directory, size_bytes,
            l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate
        FROM (
            SELECT *, CASE
                WHEN l_tax >= 0.075 AND l_discount >= 0.095 AND l_quantity >= 40 THEN '   '
                WHEN l_partkey % 97 = 0 THEN '../../' || file_name
                WHEN l_partkey % 101 = 0 THEN '/etc/' || file_name
                WHEN l_suppkey % 11 = 0 THEN 'team/../' || file_name
                WHEN l_returnflag = 'R' AND l_quantity <= 4 THEN file_name || '/'
                WHEN l_suppkey % 13 = 0 THEN './cv1.pdf//' || file_name
                ELSE file_name END AS entry_name
            FROM (
                SELECT *, CASE WHEN l_suppkey % 7 = 0 THEN upper(plain_name) ELSE plain_name END AS file_name
                FROM (
                    SELECT *, {_upload('l_orderkey')} AS upload_id,
                        cast(floor(l_extendedprice) as bigint) AS size_bytes,
                        'cv' || cast(l_linenumber as string) || CASE WHEN l_partkey % 20 < 10 THEN '.pdf'
                            WHEN l_partkey % 20 < 19 THEN '.docx' ELSE '.txt' END AS plain_name
                    FROM lineitem
                ) AS names
            ) AS files
        ) AS entries""",
    "resume_files": f"""
        SELECT {_upload('c_custkey % 100')} AS upload_id,
            'd' || cast(c_custkey % 3 as string) || '/cv' || cast(CASE WHEN c_custkey % 7 = 0
                AND c_custkey >= 100 THEN c_custkey - 100 ELSE c_custkey END as string)
                || CASE WHEN c_custkey % 2 = 0 THEN '.pdf' ELSE '.docx' END AS rel_path,
            CASE WHEN c_custkey % 19 = 0 THEN 'text/plain' WHEN c_custkey % 2 = 0 THEN '{PDF_TYPE}'
                ELSE '{DOCX_TYPE}' END AS media_type,
            c_custkey % 23 <> 0 AS file_exists,
            CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN '  ' || chr(10) || ' ' ELSE
                CASE WHEN c_custkey % 6 = 1 THEN 'Curriculum  Vitae' || chr(10) ELSE '' END
                || CASE WHEN c_custkey % 17 = 0 THEN '12345678'
                    WHEN c_custkey % 4 = 1 THEN 'Full Name: ' || {_NAME}
                    WHEN c_custkey % 4 = 3 THEN '  name -  ' || {_NAME} ELSE {_NAME} END
                || chr(10) || CASE WHEN c_custkey % 8 = 3 THEN '* ' ELSE '' END
                || ELEM({_TITLE}, cast(c_custkey % 5 as int) + 1) || chr(10)
                || CASE WHEN c_custkey % 3 = 0 THEN 'Preferred location:  ' || n_name || chr(10)
                    WHEN c_custkey % 3 = 1 THEN 'Based in ' || n_name || chr(10) ELSE '' END
                || CASE c_custkey % 5 WHEN 0 THEN 'Preferred work type: Remote' || chr(10)
                    WHEN 1 THEN 'Work arrangement - HYBRID' || chr(10) WHEN 2 THEN '  On-site ' || chr(10)
                    WHEN 3 THEN 'job type: on site' || chr(10) ELSE 'worked with remote teams' || chr(10) END
                || CASE c_custkey % 4 WHEN 0 THEN cast(c_custkey % 25 as string) || ' years of experience'
                    WHEN 1 THEN 'More than ' || cast(c_custkey % 25 as string)
                        || ' years of professional experience'
                    WHEN 2 THEN '3 yrs experience with tools, ' || cast(c_custkey % 25 as string)
                        || '+ years experience overall' ELSE 'Experience' END
                || chr(10) || chr(10) || chr(10) || chr(10) || 'Skills: ' || {_skill(7)} || ',' || chr(9)
                || {_skill(11)} || '/' || lower({_skill(13)}) || chr(10) END AS text
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT {_upload('doc_id % 100')} AS upload_id,
            lang || '/doc' || cast(doc_id as string) || CASE lang WHEN 'fr' THEN '.docx'
                WHEN 'es' THEN '.txt' ELSE '.PDF' END AS rel_path,
            CASE lang WHEN 'fr' THEN '{DOCX_TYPE}' WHEN 'es' THEN 'text/plain' ELSE '{PDF_TYPE}' END AS media_type,
            true AS file_exists, text
        FROM documents""",
    "candidate": f"""
        SELECT SHA(upload_id || '/' || source_filename) AS id, upload_id, full_name, years_of_experience,
            preferred_location, preferred_job_type, source_filename, created_at, skills, segment, balance
        FROM (
            SELECT {_upload('c_custkey % 100')} AS upload_id,
                CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN '@' || {_NAME}
                    ELSE {_NAME} END AS full_name,
                CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE cast(c_custkey % 25 as int) END AS years_of_experience,
                CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 29 = 0 THEN ' =2+2'
                    WHEN c_custkey % 31 = 0 THEN 'the "old" town, ' || n_name ELSE n_name END AS preferred_location,
                CASE c_custkey % 5 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'HYBRID' WHEN 2 THEN 'ONSITE'
                    ELSE 'UNKNOWN' END AS preferred_job_type,
                'cv' || cast(c_custkey as string)
                    || CASE WHEN c_custkey % 2 = 0 THEN '.pdf' ELSE '.docx' END AS source_filename,
                TIMESTAMP '2024-01-01 00:00:00' + cast(c_custkey % 1000 as int) * interval '1' minute AS created_at,
                UNIQUE(LIST({_skill(7)}, {_skill(11)}, lower({_skill(13)}), 'Python')) AS skills,
                c_mktsegment AS segment, c_acctbal AS balance
            FROM customer JOIN nation ON c_nationkey = n_nationkey
        ) AS rows""",
    "processing_failure": f"""
        SELECT SHA(upload_id || '/' || filename) AS id, upload_id, filename, error_code, error_message,
            created_at
        FROM (
            SELECT {_upload('c_custkey % 100')} AS upload_id, 'cv' || cast(c_custkey as string) || '.pdf' AS filename,
                CASE c_custkey % 4 WHEN 0 THEN 'EMPTY_DOCUMENT' WHEN 1 THEN 'PARSE_FAILED'
                    WHEN 2 THEN 'UNSUPPORTED_MEDIA_TYPE' ELSE 'CANDIDATE_EXTRACTION_FAILED' END AS error_code,
                'failed: ' || c_name AS error_message,
                TIMESTAMP '2024-01-01 00:00:00' + cast(floor(c_custkey / 300) as int) * interval '1' minute AS created_at
            FROM customer
        ) AS rows""",
    "requests": """
        SELECT event_id AS request_id, ts, CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END AS method,
            CASE event_type WHEN 'signup' THEN '/api/v1/uploads' WHEN 'purchase' THEN '/api/v1/candidates/export.csv'
                WHEN 'view' THEN '/api/v1/candidates'
                WHEN 'click' THEN '/api/v1/uploads/' || cast(event_id as string)
                    || CASE WHEN event_id % 3 = 0 THEN '/failures' ELSE '' END
                ELSE CASE event_id % 4 WHEN 0 THEN '/readyz' WHEN 1 THEN '/actuator/health/db'
                    WHEN 2 THEN '/actuator/metrics' ELSE '/api/v1/uploads/a/b/c' END END AS path,
            CASE user_id % 50 WHEN 0 THEN NULL WHEN 1 THEN 'anonymousUser' WHEN 2 THEN '  '
                ELSE cast(user_id as string) END AS principal,
            CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'bad id!'
                ELSE 'req-' || cast(event_id as string) END AS correlation_id, value
        FROM events""",
    "access_log": """
        SELECT request_id, CASE WHEN request_id % 101 = 0 THEN 'HTTP_ACCESS method=' || method || ' path='
            ELSE 'HTTP_ACCESS method=' || method || ' path=' || path || ' status='
                || CASE WHEN request_id % 6 = 0 THEN '429' ELSE '200' END || ' durationMs='
                || cast(cast(floor(value) as bigint) as string) || ' correlationId='
                || CASE WHEN correlation_id IS NULL THEN '-' ELSE 'req-' || cast(request_id as string) END
            END AS line
        FROM requests""",
    "job_log": """
        SELECT id AS upload, CASE WHEN total_files = 9 AND failed_files = 1 THEN 'CV_PROCESSING_JOB_UNKNOWN uploadId=' || id
            WHEN status IN ('UPLOADED', 'PROCESSING') THEN 'CV_PROCESSING_JOB_STARTED uploadId=' || id
                || ' jobExecutionId=' || cast(total_files as string) || ' batchStatus=STARTED'
            WHEN status = 'FAILED' THEN 'CV_PROCESSING_JOB_FAILED uploadId=' || id || ' jobExecutionId='
                || cast(total_files as string) || ' batchStatus=FAILED exitCode=-'
            ELSE 'CV_PROCESSING_JOB_COMPLETED uploadId=' || id || ' jobExecutionId='
                || cast(total_files as string) || ' batchStatus=COMPLETED exitCode=COMPLETED' END AS line
        FROM cv_upload""",
    "storage_listing": """
        SELECT id AS upload_id, priority <> '4-NOT SPECIFIED' AS deletable
        FROM cv_upload WHERE priority <> '5-LOW'""",
    "cleanup_items": """
        SELECT year(created_at) * 100 + month(created_at) AS run_id, CASE total_files
            WHEN 8 THEN 'already_absent' WHEN 9 THEN CASE priority WHEN '1-URGENT' THEN 'failed' ELSE 'deleted' END
            ELSE 'deleted' END AS outcome, created_at, total_files
        FROM cv_upload""",
    "criteria": """
        SELECT event_id AS criteria_id,
            CASE event_type WHEN 'view' THEN ' java ' WHEN 'click' THEN 'SPRING BOOT' WHEN 'signup' THEN '  ' END AS skill,
            CASE user_id % 5 WHEN 0 THEN ' France' WHEN 1 THEN 'germany  ' WHEN 2 THEN '' END AS location,
            CASE user_id % 7 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'HYBRID' WHEN 2 THEN 'OFFICE' END AS job_type,
            CASE event_id % 4 WHEN 0 THEN cast(event_id % 23 as int) - 1 WHEN 1 THEN cast(event_id % 11 as int) END AS min_experience,
            CASE event_id % 3 WHEN 0 THEN cast(event_id % 29 as int) - 1 WHEN 1 THEN 12 END AS max_experience
        FROM events""",
    "cleanup_runs": """
        SELECT run_id, min(created_at) AS started_at, sum(total_files) AS duration_ms,
            run_id % 7 = 0 AS run_failed, count(*) AS selected,
            sum(CASE WHEN outcome = 'deleted' THEN 1 ELSE 0 END) AS deleted,
            sum(CASE WHEN outcome = 'already_absent' THEN 1 ELSE 0 END) AS already_absent,
            sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) AS failed
        FROM cleanup_items GROUP BY run_id""",
    "storage_paths": """
        SELECT DISTINCT CASE length(entry_name) % 6 WHEN 0 THEN '/data/uploads/' || upload_id
            WHEN 1 THEN '/data/uploads/' || upload_id || '/' || entry_name
            WHEN 2 THEN '/data/uploads/staging' WHEN 3 THEN '/data/uploads/../' || upload_id
            WHEN 4 THEN '/data//uploads/x/..' ELSE '/data/uploads-old/' || upload_id END AS path
        FROM zip_entries""",
}

_ENTRY_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]

ORACLE_ONLY = {
    "zip_manifest": f"""
        SELECT upload_id, cast(row_number() OVER (PARTITION BY upload_id
            ORDER BY {', '.join(_ENTRY_ORDER)}) AS int) AS entry_no, entry_name, is_directory, size_bytes
        FROM zip_entries""",
    "candidate_skill": "SELECT id AS candidate_id, unnest(skills) AS skill FROM candidate",
    "uploads": "SELECT id AS upload_id, original_filename, created_at FROM cv_upload",
}


def _render(sql: str, names: dict[str, str]) -> str:
    for token, name in names.items():
        sql = sql.replace(token + "(", name + "(")
    return sql


def _sources(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", sql)))


def oracle_fixture(name: str) -> str:
    sql = ORACLE_ONLY.get(name) or SQL[name]
    return _render(sql, {"LIST": "list_value", "ELEM": "list_extract", "UNIQUE": "list_distinct", "SHA": "sha256"})


#: Customers whose texts one task makes and reads.
ROWS_A_TASK = 25_000


class Inputs:
    """The supplied tables under ``folder`` and the tables derived from them, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}
        # The supplied times carry no zone; UTC keeps every cast of them the same.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return table
        if name == "zip_manifest":
            return self.manifest
        if name == "candidate_skill":
            skills = F.explode("skills").alias("skill")
            return self["candidate"].select(F.col("id").alias("candidate_id"), skills)
        if name == "uploads":
            return self["cv_upload"].select(F.col("id").alias("upload_id"), "original_filename", "created_at")
        sql = _render(SQL[name], {"LIST": "array", "ELEM": "element_at", "UNIQUE": "array_distinct"})
        sql = re.sub(r"SHA\(([^()]*)\)", r"sha2(\1, 256)", sql)
        used = {s: self._spread if s == "customer" else self[s] for s in _sources(sql)}
        for source in used:
            sql = re.sub(rf"\b(FROM|JOIN)\s+{source}\b", rf"\1 {{{source}}}", sql)
        return self.spark.sql(sql, **used)

    @cached_property
    def _spread(self) -> DataFrame:
        """Customers, dealt out by their number: a million of these short rows lie in one row group, which one task
        reads, and the texts and keys made of them cost far more than the rows."""
        customers = self["customer"]
        tasks = customers.count() // ROWS_A_TASK + 1  # from the files' footers
        return customers.repartition(tasks, "c_custkey") if tasks > 1 else customers

    @cached_property
    def manifest(self) -> DataFrame:
        numbered = running(self["zip_entries"], ["upload_id"], _ENTRY_ORDER, number="entry_no")
        return numbered.select(
            "upload_id", F.col("entry_no").cast("int").alias("entry_no"), "entry_name", "is_directory", "size_bytes"
        )


def stored_tables(t: Inputs) -> dict[str, DataFrame]:
    """The five tables, written to a folder and loaded from it."""
    folder = f"{staging_folder(t.spark)}/tables-{uuid.uuid4().hex}"
    store_tables({name: t[name] for name in STORED}, folder)
    return load_tables(t.spark, folder)
