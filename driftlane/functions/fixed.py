"""Fixed values.

Everything in this module is data, not logic: constants, labels, word lists and
formats that define the results. Dictionaries with more entries (category
phrases, relation edges) are parameters and are read by ``driftlane.sources``.
"""

# Confidence weights.
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.8, "low": 0.5, "unknown": 0.2}
OTHER_CONFIDENCE_WEIGHT = 0.2

# Snapshot sources and the surface each one feeds.
SURFACE_OF_SOURCE = {
    "youtube_home": "home",
    "youtube_up_next": "up_next",
    "youtube_subscriptions": "subscriptions",
}

# Surface weights of a session and of a day.
SESSION_SURFACE_WEIGHT = {"home": 0.62, "up_next": 0.38}
BOTH_SURFACES_BONUS = 1.08
SURFACE_PRIOR = {"home": 0.53, "up_next": 0.32, "subscriptions": 0.15}

# Decay windows (largest age in days, half life in days, keep age 0).
WINDOWS = {
    "today": (0, 1.0, True),
    "w7d": (6, 3.5, True),
    "w30d": (29, 14.0, True),
    "long": (None, 60.0, True),
    "prev7d": (7, 3.5, False),
}
COMPOSITE_WEIGHT = {"today": 0.50, "w7d": 0.30, "w30d": 0.15, "long": 0.05}
PRESENCE_THRESHOLD = 0.012

# Momentum per trend state, for one profile and for the community.
PROFILE_MOMENTUM = {
    "rising": 1.0, "emerging": 0.90, "revived": 0.85, "stable": 0.62,
    "cooling": 0.28, "dormant": 0.10, "baseline": 0.55,
}
COMMUNITY_TREND_VALUE = {
    "rising": 1.0, "emerging": 0.85, "revived": 0.80, "stable": 0.55,
    "baseline": 0.50, "cooling": 0.20, "dormant": 0.05,
}
COMMUNITY_TREND_OTHER = 0.45
POSITIVE_TRENDS = ["rising", "emerging", "revived"]
NEGATIVE_TRENDS = ["cooling", "dormant"]
BRIDGE_TRENDS = ["rising", "stable", "emerging", "revived", "baseline"]

# Evidence weights of the phrase classifier.
KIND_WEIGHT = {"entity": 6.0, "anchor": 4.0, "support": 1.0}
OFFICIAL_WEIGHT = 7.0
SOURCE_WEIGHT = {
    "title": 1.0, "channel": 0.6, "tags": 0.9, "description": 0.45, "youtube_topics": 0.65,
}
TARGET_SOURCE_WEIGHT = {
    "title": 0.55, "channel": 0.15, "tags": 1.0, "description": 0.50, "youtube_topics": 0.45,
}
INTENT_SOURCE_WEIGHT = {"title": 1.0, "description": 0.35, "tags": 0.65}
INTENT_PHRASE_WEIGHT = 2.0
KEYWORD_SOURCE_WEIGHT = {"title": 5.0, "channel": 0.5, "description": 1.5, "tags": 2.5}
KEYWORD_OFFICIAL_WEIGHT = 8.0

# Phrases that do not count for a category inside an idiom.
SUPPRESSIONS = [
    ("education", "lịch sử", r"(?:hay|cháy|lớn|đỉnh|tệ|mạnh)\s+nhất\s+lịch\s+sử"),
]

# A news phrase too weak to carry an intent alone.
WEAK_NEWS_PHRASE = "ngày"

# Event types with their score, and the event contract.
EVENT_SCORE = {
    "video_open": 0.25, "like": 1.0, "unlike": -1.0,
    "dislike": -1.0, "undislike": 1.0, "comment_submit": 1.0,
}
EVENT_PLATFORMS = ["browser", "android"]
SUBSCRIPTION_STATES = ["subscribed", "not_subscribed", "unknown"]
SCHEMA_VERSION = "1.0.0"
SCORE_MODEL = "natural_interaction_v1"
EVENT_SOURCE = "natural_user_action"
FORBIDDEN_EVENT_KEYS = ["body", "comment_body", "comment_text", "message", "text", "typed_text"]

# Submission contract.
SUBMISSION_PLATFORMS = ["browser", "android", "other"]
FORBIDDEN_SUBMISSION_KEYS = [
    "authorization_header", "cookie", "cookies", "email", "google_email",
    "items", "password", "raw_items", "subscription_channels",
]
PROFILE_KEY_PREFIX = "community-profile-"

# Device snapshot contract.
DEVICE_PACKAGE = "com.google.android.youtube"
DEVICE_EXTRACTION_MODE = "android_accessibility_node_tree_read_only"
MAX_NODES = 450
MAX_NODE_DEPTH = 18

# Snapshot caps per day.
DEVICE_DAILY_CAP = {"home": 4, "watch": 24, "subscriptions": 4, "shorts": 12, "search": 8, "unknown": 6}
BROWSER_DAILY_CAP = {"home": 2, "up_next": 8, "subscriptions": 1, "channels": 1}

# Tokens that point to a surface, with the weight of one hit.
SURFACE_TOKENS = [
    ("watch", ["comments", "bình luận", "share", "chia sẻ", "save", "lưu", "autoplay", "tự động phát"], 0.16),
    ("subscriptions", ["subscriptions", "kênh đăng ký"], 0.34),
    ("home", ["home", "trang chủ"], 0.34),
    ("shorts", ["shorts"], 0.42),
    ("search", ["search", "tìm kiếm"], 0.38),
]

# Label patterns of clicks.
DISLIKE_LABEL = "(dislike|không thích)"
LIKE_LABEL = r"(^|\s)(like|thích)(\s|$|video)"
BROWSER_COMMENT_LABEL = "(comment|bình luận|post|gửi)"
DEVICE_COMMENT_LABELS = [
    "send comment", "post comment", "submit comment",
    "gửi bình luận", "đăng bình luận", "comment submit",
]
BLANK_TITLE_LABELS = "^(xem|watch|live|trực tiếp)$"
DURATION_TITLE = r"^\d{1,2}:\d{2}(?::\d{2})?$"
VIDEO_ID = "^[A-Za-z0-9_-]{11}$"

# Intent labels in profile names and in the one-snapshot report.
INTENT_LABEL = {
    "tutorial": "Tutorial Learner",
    "review": "Review Researcher",
    "news": "News Seeker",
    "livestream": "Live Event Follower",
    "compilation": "Playlist / Compilation Explorer",
    "documentary": "Documentary Learner",
    "entertainment": "Entertainment Explorer",
    "analysis": "Analysis / Commentary Seeker",
}
OTHER_INTENT_LABEL = "Explorer"
INTENT_NAME = {
    "tutorial": "Hướng dẫn",
    "review": "Đánh giá/Review",
    "news": "Tin tức",
    "livestream": "Phát trực tiếp",
    "compilation": "Tổng hợp/Playlist",
    "documentary": "Tài liệu",
    "entertainment": "Giải trí/Show",
    "analysis": "Phân tích/Bình luận",
}

# Title patterns per intent; the empty key holds the default.
TITLE_PATTERNS = {
    "tutorial": [
        "{primary}: Hướng Dẫn {secondary} Từ A–Z",
        "Cách {primary} Với {secondary} — Quy Trình Cho Người Mới",
        "{primary} Thực Tế: Từ {secondary} Đến Kết Quả",
    ],
    "review": [
        "{primary} Có Đáng Dùng? Review {secondary} Thực Tế",
        "{primary} vs {secondary}: Nên Chọn Gì?",
        "Trải Nghiệm {primary}: Điểm Mạnh, Điểm Yếu, Ai Nên Dùng",
    ],
    "analysis": [
        "{primary}: Phân Tích {secondary} Và Điều Đáng Chú Ý",
        "Vì Sao {primary} Đang Gắn Với {secondary}?",
        "{primary} Qua Lăng Kính {secondary}: Điều Gì Đang Xảy Ra?",
    ],
    "news": [
        "{primary}: Cập Nhật {secondary} Và Những Điểm Cần Biết",
        "Có Gì Mới Với {primary}? {secondary} Được Giải Thích",
        "{primary} Mới Nhất: Điều Gì Thay Đổi Với {secondary}?",
    ],
    "livestream": [
        "LIVE {primary}: {secondary}",
        "Trực Tiếp {primary} — Theo Dõi {secondary}",
        "{primary} LIVE: Diễn Biến {secondary}",
    ],
    "compilation": [
        "{primary} · {secondary} | Tuyển Chọn Theo Mood",
        "{primary} Playlist Cho {secondary}",
        "{primary} Mix — {secondary} Liên Tục",
    ],
    "documentary": [
        "Câu Chuyện {primary}: Từ {secondary} Đến Hiện Tại",
        "{primary} Được Hình Thành Như Thế Nào? {secondary}",
        "Bên Trong {primary}: Câu Chuyện Về {secondary}",
    ],
    "entertainment": [
        "Thử {primary} Với {secondary}: Chuyện Gì Xảy Ra?",
        "{primary} Nhưng Có Thêm {secondary}",
        "Một Ngày Với {primary}: {secondary} Có Khác Gì?",
    ],
    "": [
        "{primary}: {secondary} Và Những Điều Cần Biết",
        "{primary} Cho Người Quan Tâm {secondary}",
        "Khám Phá {primary} Qua {secondary}",
    ],
}
