"""Schemas of the tables that the operators work on."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


SOURCES = _table("id string, tenant_id string, name string, metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz, archived_at timestamp_ntz")
DOCUMENTS = _table("id string, source_id string, title string, status string, metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz, archived_at timestamp_ntz")
CHUNKS = _table("id string, source_id string, document_id string, rank int, heading string, content string, token_count int")
CHUNK_VECTORS = _table("chunk_id string, embedding array<float>")
EVENTS = _table("id string, source_id string, document_id string, chunk_id string, rank int, title string, summary string, content string, category string, status string, title_vector array<float>, content_vector array<float>, created_at timestamp_ntz, deleted_at timestamp_ntz")
ENTITIES = _table("id string, source_id string, type string, name string, normalized_name string, description string, vector array<float>")
EVENT_ENTITIES = _table("event_id string, entity_id string, description string, weight double")
FOLDERS = _table("id string, source_id string, root string, whitelist array<string>, max_bytes bigint, enabled boolean, last_scan_at timestamp_ntz, last_scan_status string, metadata map<string,string>")
MANIFEST = _table("folder_id string, rel_path string, document_id string, size_bytes bigint, mtime_ms bigint, inode bigint, sha1 string, last_event string, last_error string, sync_started_at timestamp_ntz, last_seen_at timestamp_ntz")
RUNS = _table("id string, folder_id string, trigger string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, stats_added int, stats_updated int, stats_deleted int, stats_failed int, error string")
MESSAGES = _table("id string, session_id string, role string, content string, created_at timestamp_ntz")
AUDIT = _table("id string, tenant_id string, actor string, action string, target string, details map<string,string>, created_at timestamp_ntz")
