"""Canonical table schemas."""

from __future__ import annotations

VIDEO_COLUMNS = [
    "video_id", "platform", "title", "author", "url", "thumbnail", "media_type", "download_url",
    "search_source", "duration_sec", "views", "likes", "comments", "shares", "published_at",
]
STRING_FIELDS = ["title", "author", "url", "thumbnail", "download_url", "search_source"]
COUNTER_FIELDS = ["views", "likes", "comments", "shares"]

VIDEO_FIELDS = (
    "video_id string, platform string, title string, author string, url string, thumbnail string, "
    "media_type string, download_url string, search_source string, duration_sec bigint, views bigint, "
    "likes bigint, comments bigint, shares bigint, published_at timestamp"
)
VIDEOS = "seq bigint, " + VIDEO_FIELDS

JSONL_ROW = (
    "bvid string, title string, description string, owner_name string, duration_seconds bigint, "
    "view_count bigint, reply_count bigint, share_count bigint, like_count bigint, pubdate bigint, "
    "cover_url string, url string"
)

SEARCH_ITEM = (
    "struct<aweme_id: string, desc: string, create_time: bigint, author: struct<nickname: string>, "
    "statistics: struct<play_count: bigint, digg_count: bigint, comment_count: bigint, share_count: bigint>, "
    "video: struct<duration: bigint, cover: struct<url_list: array<string>>>>"
)
SEARCH_PAGE = f"status_code bigint, status_msg string, data array<struct<type: int, aweme_info: {SEARCH_ITEM}>>"

METADATA = (
    "id string, title string, uploader string, channel string, thumbnail string, duration double, "
    "view_count bigint, like_count bigint, comment_count bigint, timestamp bigint, upload_date string, "
    "formats array<string>, thumbnails array<struct<url: string>>"
)

ADDRESS = "struct<uri: string, url_list: array<string>>"
BIT_RATES = (
    f"array<struct<bit_rate: bigint, play_addr: {ADDRESS}, play_addr_h264: {ADDRESS}, play_addr_265: {ADDRESS}>>"
)
MEDIA = f"bit_rate {BIT_RATES}, play_addr {ADDRESS}, play_addr_h264 {ADDRESS}, play_addr_265 {ADDRESS}"

JOB_VIDEO = "id string, platform string, title string, url string, likes bigint"
LOCALIZATION = (
    "detectedLanguage string, segments int, skippedReason string, timings map<string,double>, cacheHits array<string>"
)
JOB_ROW = (
    "job_id string, status string, video_json string, mode string, aspect string, outputs_json string, "
    "attempts int, subtitle_revision int, localization_json string, error string, created_ns bigint, updated_ns bigint"
)

SEGMENT_JSON = (
    "struct<start: double, end: double, text: string, bbox: array<double>, bboxRegions: array<array<double>>, "
    "cleanupRegions: array<array<double>>, placement: string, bboxConfidence: double>"
)
SEGMENT_FILE = f"segments array<{SEGMENT_JSON}>"

BOX = "struct<x: double, y: double, w: double, h: double>"
RSS_ITEM = "title string, link string, description string"
