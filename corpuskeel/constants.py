"""Fixed values.

Everything below is a value that has to be equal to the published one for results to agree: digest
tags, sentinels, thresholds, frequency pairs. None of it is logic.
"""

# Digest tags (ASCII, followed by one zero byte in every digest).
TAG_TEXT_GROUP = "b3-prompt-group-v1"
TAG_PART_RANK = "b3-diffusiondb-part-v1"
TAG_GROUP_RANK = "b3-diffusiondb-source-group-v1"
TAG_MEMBER_RANK = "b3-diffusiondb-source-member-v1"
TAG_CANDIDATE_RANK = "b3-coco-source-candidate-v1"
TAG_RAW_GROUP = "b3-raw-byte-group-v1"
TAG_BYTE_TEXT_COMPONENT = "b3-observed-byte-prompt-component-v1"
TAG_RESERVATION = "b3-development-reservation-v1"
TAG_PRODUCER = "b4-private-producer-v1"
TAG_TEXT_SEED = "b4-prompt-seed-v1"
TAG_COMPONENT = "b4-observed-component-v1"
TAG_LEAKAGE_GROUP = "b4-observed-group-v1"
TAG_SPLIT_RANK = "b4-split-rank-v1"
TAG_SPLIT_TIE = "b4-split-tie-v1"
TAG_REPRESENTATIVE = "b4-primary-representative-v1"
TAG_PIXELS = "b5-rgb8-srgb-v1"
TAG_OWNER_BUCKET = "a4-owner-v1"
TAG_SEED = "a4-seed-v1"
TAG_COHORT = "a4-t1-cohort-v1"
TAG_NOISE = "a4-t1-noise-v1"
TAG_SIGNATURE_SEMANTIC = "a5-ws-v1"
TAG_SIGNATURE_INSTANCE = "a5-wi-v1"
TAG_PROJECTION = "a5-semproj-v1"
TAG_TEMPLATE = "a5-template-v1"
TAG_PAYLOAD = "b2-trustmark-q-bch5-payload-v1"

# Revision that binds the source orders (hex).
SOURCE_REVISION = "fb620fbe49fa4420e0734bd9c0df11f51176b61f"

# Eligibility: scores at or above the ceiling and sides below the minimum are excluded.
SCORE_CEILING = 0.10
SCORE_SENTINEL = 2.0
MIN_SIDE = 64

# Producer names that stand for "unknown", the misspelt one included.
UNKNOWN_PRODUCERS = ("deleted_account", "deleted_acount")
STATUS_UNKNOWN_PRODUCER = "unknown-or-deleted"
STATUS_KNOWN_PRODUCER = "known-hash"
UNKNOWN_COHORT_KEY = "one-unresolved-cohort"

# Canonical statuses.
STATUS_PASS = "canonical_pass"
STATUS_REJECT = "canonical_rejected_coverage_failure"

# Near rule: all three limits are inclusive.
NEAR_HAMMING = 6
NEAR_COLOUR_MAE = 4
NEAR_ASPECT_PERCENT = 5
COLOUR_BYTES = 192

# Splits in their fixed order.
SPLITS = ("development", "validation", "test")

# Owner buckets.
OWNER_BUCKETS = 16

# Calibration grid: threshold j is (j - 50) / 50 for j in 0..100.
GRID_POINTS = 101
GRID_CENTRE = 50
POSITIVE_CONDITION = "C1"
NEGATIVE_CONDITIONS = ("C0-source", "C0-reconstruction", "C2")
ONE_SIDED_ALPHA = 0.05
POSITIVE_FLOOR = 0.80
NEGATIVE_CEILING = 0.01
VETO_MARGIN = -3.0

# Code lengths of the radius-one search.
SEMANTIC_BITS = 12
INSTANCE_BITS = 32
PAYLOAD_BITS = 61

# (vertical, horizontal) 8x8 DCT frequencies that carry the two components.
SEMANTIC_FREQUENCIES = ((1, 2), (2, 1), (2, 2), (1, 3))
INSTANCE_FREQUENCIES = ((3, 1), (2, 3), (3, 2), (1, 4))
LUMA_WEIGHTS = (0.299, 0.587, 0.114)

# Secret patterns (group 1 is kept).
BEARER_PATTERN = r"(?i)(bearer\s+)[\w.\-]+"
ASSIGNMENT_PATTERN = r"(?i)((?:api[_-]?key|token|password|secret)\s*[=:]\s*)[^\s,;]+"

# Format patterns, applied to the whole value.
PATTERN_SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]*\z"
PATTERN_IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}\z"
PATTERN_HEX64 = r"^[0-9a-f]{64}\z"
PATTERN_POSITIVE_DECIMAL = r"^[1-9][0-9]*\z"
PATTERN_UUID4_PNG = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\.png\z"

# States of a cell of the sample-size report.
STATUS_SHORT_CELL = "conditional_actual_N_shortfall"
STATUS_FULL_CELL = "conditional_actual_N_matches_plan"
