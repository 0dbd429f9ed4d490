"""Explicit schemas of the data model and its status values; columns are added by mergeSchema and dropped by select."""

from __future__ import annotations

from pyspark.sql.types import StructType

USERS = "id string, username string, email string, password_hash string, created_at timestamp, updated_at timestamp"
REFRESH_TOKENS = "id string, user_id string, token string, expires_at timestamp, created_at timestamp"
REPOS = "id string, name string, repo_url string, status string, chunks_indexed int, error_message string, created_at timestamp, updated_at timestamp"
USER_REPOS = "id string, user_id string, repo_id string, created_at timestamp"
JOBS = (
    "id string, repo_id string, status string, total_files int, fetched_files int, processed_files int, stored_files int, progress int, "
    "error_message string, started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp"
)
FILE_METADATA = (
    "repo_id string, file_path string, file_hash string, imports array<string>, exports array<string>, skeleton array<string>, "
    "summary string, chunks_indexed int, status string, updated_at timestamp"
)
QUESTIONS = (
    "id string, user_id string, repo_id string, question string, answer string, "
    "source array<struct<file: string, name: string, type: string, start_line: int, end_line: int>>, created_at timestamp"
)
CHUNK = "name string, parent_scope string, code string, language string, file string, type string, start_line int, end_line int"
POINTS = f"repo_id string, point_id string, {CHUNK}, vector array<float>"
#: Messages between the stages of ingestion.
FETCH_MESSAGE = "repo_url string, job_id string, repo_id string, retries int"
PROCESS_MESSAGE = "repo_id string, job_id string, repo_url string, file_path string, language string, content string, retries int"
STORE_MESSAGE = (
    "repo_id string, job_id string, file_path string, chunks_indexed int, "
    "embedded_chunks array<struct<point_id: string, name: string, parent_scope: string, code: string, language: string, file: string, type: string, start_line: int, end_line: int, vector: array<float>>>, "
    "file_metadata struct<path: string, imports: array<string>, exports: array<string>, language: string, skeleton: array<string>, file_hash: string, summary: string>, retries int"
)
DEAD_LETTER = "payload string, stream_origin string, error string, reason string, failed_at timestamp"

#: The states a repository, job and file go through, in order; ``failed`` may follow any but the last.
REPO_STATES = ("placed", "queued", "fetching", "processing", "storing", "completed", "failed")
JOB_STATES = ("queued", "processing", "completed", "failed")
FILE_STATES = ("pending", "completed")
#: States in which a repository is not queued again.
BUSY_OR_DONE = ("queued", "fetching", "processing", "storing", "completed")


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
