"""Fixed values that results depend on: word lists, maps, patterns, limits."""

# File suffixes by class.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".heic", ".cr2", ".cr3", ".arw", ".nef", ".dng", ".raf")
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".m4v", ".wmv")
RAW_SUFFIXES = (".cr2", ".cr3", ".arw", ".nef", ".dng", ".raf", ".orf")
PHOTO_SUFFIXES = (".arw", ".jpg", ".jpeg", ".nef", ".cr2", ".cr3", ".dng", ".heic", ".png")
TEMPLATE_SUFFIXES = (
    ".jpg", ".jpeg", ".png", ".heic", ".cr2", ".cr3", ".arw", ".nef", ".dng", ".raf", ".tif", ".tiff",
)
CATALOG_SUFFIXES = (".jpg", ".jpeg", ".png", ".cr2", ".cr3", ".arw", ".nef", ".dng", ".raf", ".mp4", ".mov")

# Camera names and their short forms.
CAMERA_SHORT = {
    "Nikon D850": "D850",
    "Canon EOS R5": "R5",
    "Sony ILCE-7M3": "A7III",
    "Sony ILCE-7RM4": "A7RIV",
    "Sony ILCE-7M4": "A7M4",
    "Sony ILCE-7RM4A": "A7RIVA",
    "Fujifilm X-T4": "XT4",
    "DJI Mavic 3": "Mavic3",
    "GoPro HERO11 Black": "GoPro11",
    "Apple iPhone 14 Pro": "iPhone14Pro",
    "Apple iPhone 15 Pro Max": "iPhone15ProMax",
    "NIKON D750": "D750",
}

# Resolution and device shorthand.
RESOLUTION_SHORT = {"1920x1080": "1080", "2560x1440": "1440", "3840x2160": "4K", "5120x2880": "5K", "7680x4320": "8K"}
DEVICE_SHORT = {
    "DJI Mavic 3": "Drone",
    "GoPro HERO11 Black": "ActionCam",
    "Nikon D850": "Camera",
    "Canon EOS R5": "Camera",
    "Sony ILCE-7M3": "Camera",
}

# Document types, first match wins.
DOCUMENT_WORDS = {
    "invoice": ("invoice", "receipt", "payment", "bill"),
    "contract": ("contract", "agreement", "terms"),
    "id_document": ("passport", "license", "id", "card"),
    "medical": ("medical", "prescription", "lab", "report"),
    "tax": ("tax", "return", "1099", "w2", "t4"),
    "insurance": ("insurance", "policy", "claim"),
    "legal": ("legal", "court", "filing", "petition"),
}
DOCUMENT_DEFAULT = "Document"

# Screenshot devices by pattern, first match wins.
SCREENSHOT_DEVICES = {
    "Screenshot.*iPhone": "iPhone",
    "Screenshot.*iPad": "iPad",
    "Screenshot.*Mac": "Mac",
    "Screenshot.*Windows": "Windows",
    "Screenshot.*Android": "Android",
}
SCREENSHOT_DEFAULT = "Unknown"

# Naming patterns chosen by words in the path, first match wins.
PATTERN_BY_WORDS = (
    (("wedding", "marriage"), "{YYYY}-{MM}-{DD}_{couple_names}_{camera_model}_{sequence}"),
    (("real_estate", "property", "listing"), "{YYYY}-{MM}-{DD}_{property_address}_{sequence}"),
    (("product", "ecommerce", "shop"), "{YYYY}-{MM}-{DD}_{product_sku}_{sequence}"),
)
PATTERN_WITH_GPS = "{YYYY}-{MM}-{DD}_{location}_{camera_model}_{sequence}"
PATTERN_DEFAULT = "{YYYY}-{MM}-{DD}_{HH}-{MM}-{SS}_{camera_model}_{sequence}"

# Characters replaced in file names, and the greatest name length.
NAME_REPLACEMENTS = {
    " ": "_", "/": "-", "\\": "-", ":": "-", "*": "-", "?": "-", '"': "-", "<": "-", ">": "-", "|": "-",
}
NAME_MAX_LENGTH = 200

# Backup include and exclude globs.
BACKUP_INCLUDE = (
    "**/*.arw", "**/*.cr2", "**/*.nef", "**/*.raf", "**/*.jpg", "**/*.jpeg", "**/*.png",
    "**/*.mp4", "**/*.mov", "**/*.mkv", "**/*.xmp", "**/*.lrcat", "**/*.lrdata",
)
BACKUP_EXCLUDE = ("**/.*", "**/__pycache__/", "**/node_modules/", "**/.git/", "**/*.tmp", "**/*.bak")

# Path markers and their keep priority (1 is kept first; no marker is 5).
KEEP_PRIORITY = (("/01_PHOTOS/", 1), ("/02_VIDEOS/", 1), ("/DCIM/", 2), ("/PRIVATE/", 3))
KEEP_PRIORITY_ROOT = 4
KEEP_PRIORITY_OTHER = 5

# Library folders.
PHOTOS_ROOT = "01_PHOTOS"
VIDEOS_ROOT = "02_VIDEOS"
PROJECTS_ROOT = "03_PROJECTS"
UNKNOWN_DATE_FOLDER = "UNKNOWN_DATE"
SCREENSHOTS_FOLDER = "SCREENSHOTS"

# Allowed values of the base tables, and ranges.
ALLOWED_VALUES = {
    ("assets", "asset_type"): ("photo", "video", "audio", "document", "other"),
    ("duplicates", "duplicate_type"): ("exact", "similar", "near_duplicate"),
    ("duplicates", "action_taken"): ("none", "archived", "deleted", "kept", "pending"),
    ("transfers", "transfer_status"): ("pending", "in_progress", "completed", "failed", "retry"),
    ("transfers", "verification_status"): ("not_verified", "verified", "mismatch", "failed"),
    ("backups", "verification_status"): ("not_verified", "verified", "failed"),
    ("ingestion_logs", "status"): ("in_progress", "completed", "failed", "partial"),
    ("integrity_checks", "check_type"): ("full", "sample", "hash_verification", "backup_verification"),
    ("integrity_checks", "status"): ("in_progress", "completed", "failed", "partial"),
}
RATING_RANGE = (0, 5)

# Default application settings.
DEFAULT_SETTINGS = {
    "schema_version": "1.0",
    "last_backup_check": "never",
    "last_integrity_audit": "never",
    "asset_count": "0",
    "duplicate_count": "0",
}

# Task log states and limits.
ACTIVE_STATES = ("STARTING", "RUNNING", "PAUSED")
TERMINAL_STATES = ("COMPLETED", "FAILED", "CANCELLED")
STALE_MINUTES = 5
STALE_MESSAGE = "Heartbeat timeout - no update for 5 minutes"
PAUSE_CELSIUS = 55.0
RESUME_CELSIUS = 45.0
HISTORY_LENGTH = 1000
EXIF_DRIFT_SECONDS = 7200
NEAR_DUPLICATE_BITS = 10
NEAR_DUPLICATE_SIMILARITY = 0.85
PAIR_SECONDS = 5
BURST_GAP_SECONDS = 1
BURST_MIN_FILES = 3
PHASE_DAYS = (365, 1095)
RETENTION = {"day": 7, "week": 4, "month": 12}
ARCHIVE_DAYS = 30
AUDIT_SAMPLE_SHARE = 0.05
AUDIT_SAMPLE_MIN = 100
SPACE_MARGIN = 1.5
CAMERA_TIME_ZONE = "America/Edmonton"
