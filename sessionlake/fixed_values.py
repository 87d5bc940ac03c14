"""Fixed values.

Everything in this module is a value of the transcript format or of the
published decision rules, and has to be spelled exactly like this for results
to agree with data written by other tools.  Nothing here is logic.
"""

# Row types that carry conversation messages; every other type is kept raw.
MESSAGE_ROW_TYPES = ("user", "assistant")
# Vocabulary of a normalised message.
ROLES = ("user", "assistant", "system", "tool")
MESSAGE_TYPES = ("text", "thinking", "tool_use", "tool_result")
SCHEMA_VERSION = 1
SNAPSHOT_VERSION = 1
HASH_PREFIX = "session-v1\n"
SYNTHETIC_MODEL = "<synthetic>"

# Integrity classes, best first (their rank is their position; unknown = 9).
INTEGRITY_CLASSES = ("ok", "truncated", "empty", "damaged", "unreadable")
UNKNOWN_RANK = 9
UNUSABLE = ("damaged", "unreadable")
USABLE = ("ok", "truncated")

# Size limits in bytes.
STUB_BYTES = 2 * 1024
HUGE_BYTES = 256 * 1024 * 1024
TAIL_SCAN_BYTES = 2 * 1024 * 1024
MAX_CONFIG_BYTES = 32 * 1024 * 1024
# A parsed row holds at most so many bytes.
MAX_ROW_BYTES = 128 * 1024 * 1024

# Row limits.
HEAD_ROWS = 40
TAIL_ROWS = 8
SAMPLE_ROWS = 250
DEDUPE_WINDOW_IDS = 64
ERRORS_KEPT = 200
AUDIT_ROWS = 200
MESSAGE_ROWS_SHOWN = 400
CANDIDATES_SHOWN = 5
DIFF_CONTEXT = 3

# Clipping of text for display, in characters.
CLIP_DIFF = 400
CLIP_DETAIL = 4000
CLIP_SUMMARY = 200

# Project directory names longer than this are cut and get a hash suffix.
PROJECT_DIR_MAX = 200
# Directory birth times closer than this belong to one operation.
BIRTH_TOLERANCE_MS = 2000

UUID_SHAPE = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
UUID_LOOSE = "^[0-9a-fA-F-]{36}$"

# White space as ECMAScript defines it (what trim() removes).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Kinds of planned actions.
COPY = "copy"
CONFLICT = "conflict"
BLOCKED = "blocked"
ALREADY_EVERYWHERE = "already-everywhere"
ALREADY_PRESENT = "already-present"
TOMBSTONED = "tombstoned"
REMOVE = "remove"
NOT_PRESENT = "not-present"
WRITE = "write"
SKIP_IDENTICAL = "skip-identical"
REPAIR = "repair"
CREATE = "create"

# Relations between two copies of a session.
IDENTICAL = "identical"
PREFIX = "prefix"
DIVERGED = "diverged"
UNRELATED = "unrelated"
EMPTY = "empty"

# Resolutions of a conflict.
SKIP = "skip"
KEEP_EXISTING = "keep-existing"
KEEP_INCOMING = "keep-incoming"
KEEP_NEWER = "keep-newer"
KEEP_BOTH = "keep-both"

# Title match tiers, best first: (kind, which title, exact?).
TITLE_TIERS = (
    ("custom", "custom", True),
    ("custom~", "custom", False),
    ("ai", "ai", True),
    ("ai~", "ai", False),
    ("former", "former", True),
    ("former~", "former", False),
)
# The pairwise match ranks exact matches of either kind before loose ones.
PAIR_TIERS = (("custom", True), ("ai", True), ("custom~", False), ("ai~", False))
