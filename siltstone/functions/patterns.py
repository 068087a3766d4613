"""Pattern catalogue of media links and titles, for engines that read \\w as ASCII (Java, RE2, Python over bytes). Order matters: it decides which match wins in deduplication."""

from __future__ import annotations

# Name, pattern (group 1 is the 11-character id), priority (confidence = priority / 10).
LINK_PATTERNS: tuple[tuple[str, str, int], ...] = (
    ("standard", r"https?://(?:www\.)?youtube\.com/watch\?v=([\w-]{11})(?:[&?][^\s]*)?", 10),
    ("short", r"https?://youtu\.be/([\w-]{11})(?:\?[^\s]*)?", 10),
    ("embed", r"https?://(?:www\.)?youtube\.com/embed/([\w-]{11})(?:\?[^\s]*)?", 9),
    ("v_slash", r"https?://(?:www\.)?youtube\.com/v/([\w-]{11})", 8),
    ("shorts", r"https?://(?:www\.)?youtube\.com/shorts/([\w-]{11})(?:\?[^\s]*)?", 10),
    ("live", r"https?://(?:www\.)?youtube\.com/live/([\w-]{11})", 9),
    ("mobile", r"https?://m\.youtube\.com/watch\?v=([\w-]{11})(?:[&?][^\s]*)?", 9),
    ("gaming", r"https?://gaming\.youtube\.com/watch\?v=([\w-]{11})", 8),
    ("music", r"https?://music\.youtube\.com/watch\?v=([\w-]{11})", 8),
    ("studio", r"https?://studio\.youtube\.com/video/([\w-]{11})/edit", 7),
    ("kids", r"https?://www\.youtubekids\.com/watch\?v=([\w-]{11})", 7),
    ("nocookie", r"https?://www\.youtube-nocookie\.com/embed/([\w-]{11})", 8),
    ("attribution", r"attribution_link\?.*v[=/]([\w-]{11})", 6),
    ("google_redirect", r"google\.com/url\?.*youtube.*v[=/]([\w-]{11})", 6),
    ("user_attribution", r"feature=player_embedded.*v=([\w-]{11})", 6),
    ("app_indexing", r"android-app://com\.google\.android\.youtube/http/www\.youtube\.com/watch\?v=([\w-]{11})", 7),
    ("v_param", r"[?&]v=([\w-]{11})(?:[&#\s]|$)", 6),
    ("playlist_video", r"youtube\.com/watch\?.*v=([\w-]{11}).*&list=", 8),
    ("video_id_json", r"[\"']video_id[\"']\s*:\s*[\"']([\w-]{11})[\"']", 5),
    ("data_video_id", r"data-video-id=[\"']([\w-]{11})[\"']", 5),
    ("meta_content", r"<meta itemprop=\"videoId\" content=\"([\w-]{11})\">", 6),
)

# What may stand near a link, in any case.
NEEDLES = r"youtube\.com|youtu\.be|video_id|video-id|v=|/v/|embed/|shorts/"

# Title patterns, first that gives an acceptable title wins.
TITLE_PATTERNS: tuple[str, ...] = (
    r"<title>(.*?)(?:\s*-\s*YouTube)?</title>",
    r"\"title\"\s*:\s*\"((?:[^\"\\]|\\.)*)\"",
    r"<meta name=\"title\" content=\"((?:[^\"\\]|\\.)*)\">",
    r"\"videoTitle\"\s*:\s*\"((?:[^\"\\]|\\.)*?)\"",
    r"data-video-title=\"((?:[^\"\\]|\\.)*)\"",
    r"<h1[^>]*>(.*?)</h1>",
)

#: Bytes of context before and after a needle, and around a match for its title.
BEFORE, AFTER, TITLE_CONTEXT = 100, 50, 1000
ID = r"^[A-Za-z0-9_-]{11}$"
# Endings of the files of one media item, the first that fits goes.
MEDIA_ENDINGS = (".info.json", ".en.vtt", ".ru.vtt", ".vtt", ".srt", ".webp", ".jpg", ".mp4", ".mkv", ".webm")
