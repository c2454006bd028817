"""Schemas of the inventory and of the library's tables."""

from __future__ import annotations

INVENTORY = (
    "path string, filename string, extension string, size_bytes long, created string, modified string, md5 string, sha256 string, "
    "mime_type string, file_type string, date_taken string, camera_make string, camera_model string, lens_model string, iso int, "
    "shutter_speed string, aperture string, focal_length string, gps_latitude double, gps_longitude double, duration double, "
    "codec string, width int, height int, fps double, bitrate long, creation_time string"
)

OPERATION = (
    "operation_id string, original_path string, new_path string, original_filename string, new_filename string, hash_before string, "
    "hash_after string, timestamp string, status string, file_size long, error string, rolled_back boolean, checkpoint_id string"
)

MANIFEST = (
    "metadata struct<created:string, version:string, total_operations:long, scope:string, source_drive:string, description:string, task_id:string>, "
    f"operations array<struct<{OPERATION.replace(' ', ':').replace(',:', ', ')}>>, "
    "checkpoints struct<enabled:boolean, directory:string, auto_save_interval:int, rollback_enabled:boolean>"
)

CHECKPOINT_STATE = (
    "last_completed_op_id string, last_completed_index long, total_ops long, success_count long, fail_count long, "
    "start_time string, last_checkpoint_time string, checkpoint_file string"
)

RENAME_PLAN = "old_path string, new_path string, reason string, conflict_check string"

TRANSFER_LOG = (
    "timestamp string, operation_id string, source string, destination string, filename string, size_bytes long, hash_before string, "
    "hash_after string, status string, attempts int, error string"
)

# The relational tables, as Parquet. Flags are booleans and times are timestamps.
TABLES = {
    "assets": (
        "id long, file_path string, file_name string, extension string, file_size_bytes long, md5_hash string, sha256_hash string, "
        "mime_type string, created_date timestamp, modified_date timestamp, ingested_date timestamp, asset_type string, folder_path string, "
        "year int, month int, is_duplicate boolean, lightroom_catalog_id long, backup_verified boolean, last_verified_date timestamp"
    ),
    "exif_data": (
        "id long, asset_id long, date_taken string, camera_make string, camera_model string, lens_model string, iso int, "
        "shutter_speed string, aperture string, focal_length string, gps_latitude double, gps_longitude double, gps_altitude double, "
        "orientation int, color_space string"
    ),
    "video_metadata": (
        "id long, asset_id long, duration_seconds double, codec_name string, width int, height int, frame_rate double, bit_rate long, "
        "audio_codec string, creation_time string"
    ),
    "duplicates": (
        "id long, asset_id_1 long, asset_id_2 long, duplicate_type string, similarity_score double, detected_date timestamp, "
        "action_taken string, action_date timestamp"
    ),
    "transfers": (
        "id long, source_path string, dest_path string, file_size_bytes long, md5_hash string, sha256_hash string, transfer_date timestamp, "
        "transfer_status string, verification_status string, retry_count int, error_message string, ingestion_id long"
    ),
    "backups": (
        "id long, asset_id long, backup_location string, backup_path string, sha256_hash string, backup_date timestamp, "
        "verified_date timestamp, verification_status string, backup_size_bytes long"
    ),
    "lightroom_catalog": (
        "id long, catalog_path string, asset_id long, catalog_file_path string, catalog_entry_date timestamp, rating int, "
        "color_label string, keywords string, is_missing boolean, last_sync_date timestamp"
    ),
    "ingestion_logs": (
        "id long, drive_path string, drive_label string, project_name string, start_time timestamp, end_time timestamp, total_files long, "
        "total_size_bytes long, duplicates_found long, files_transferred long, files_failed long, status string, report_path string, "
        "error_message string"
    ),
    "rename_history": (
        "id long, asset_id long, old_path string, new_path string, rename_date timestamp, rename_reason string, pattern_applied string"
    ),
    "integrity_checks": (
        "id long, check_date timestamp, check_type string, sample_size long, files_checked long, files_passed long, files_failed long, "
        "mismatches long, status string, report_path string"
    ),
    "execution_logs": (
        "task_id string, task_type string, status string, progress_pct double, started_at timestamp, completed_at timestamp, "
        "last_heartbeat timestamp, pid long, log_path string, status_message string, metadata_json string, error_message string"
    ),
    "drives": (
        "id long, serial_number string, nickname string, model string, capacity_bytes long, filesystem string, first_seen_at timestamp, "
        "last_seen_at timestamp, is_active boolean, notes string, mount_path string"
    ),
    "duplicate_groups": (
        "id long, sha256_hash string, group_created_at timestamp, reviewed boolean, action_taken string, action_taken_at timestamp, notes string"
    ),
    "duplicate_group_members": "id long, group_id long, asset_id long, is_original boolean, keep_reason string",
    "settings": "key string, value string, updated_at timestamp",
}

HEARTBEAT = "event_id long, task_id string, ts timestamp, progress_pct double, status string, status_message string, metadata_json string"
READING = "event_id long, drive string, ts timestamp, temperature double"
