"""Constants of the alignment engine."""

from __future__ import annotations

# Thresholds. Both similarities are strict lower bounds of candidate generation.
COSINE_THRESHOLD = 0.75
JACCARD_THRESHOLD = 0.90
REPORT_THRESHOLDS = (1.0, 0.99, 0.9375, 0.875, 0.8125, 0.75)
EPSILON = 1e-6  # confidences this close to 1 are exact

# Semantic tags of acceptable targets ("" is a label without a tag).
ACCEPTABLE_DOMAINS = ("disorder", "finding", "morphologic abnormality", "")

# Validity code, step that gives it, and the reason named in review prompts (none for code 0).
VALIDITY = (
    (0, "1", None),
    (1, "2", "HIERARCHY_REVERSAL_ANCHOR"),
    (2, "2b", "HIERARCHY_REVERSAL_EXACT_LEXICAL"),
    (3, "2c", "HIERARCHY_REVERSAL_HPO_XREF"),
    (4, "3", "HIERARCHY_REVERSAL_UMLS_BRIDGE"),
    (5, "4", "HIERARCHY_REVERSAL_UMLS_CUI"),
    (6, "5", "HIERARCHY_REVERSAL_JACCARD_COSINE"),
    (7, "6", "HIERARCHY_REVERSAL_JACCARD_ONLY"),
    (8, "7", "BEST_CANDIDATE_FALLBACK"),
    (9, "8", "LAST_RESORT"),
    (10, None, "ACCEPTED"),
)
ACCEPTED = 10
# Names of the steps in reports, in processing order.
STEP_LABELS = (
    ("1", "1 Domain filter"),
    ("2", "2 Anchors"),
    ("2b", "3 Exact label match"),
    ("2c", "4 Remaining HPO xrefs"),
    ("3", "5 HPO → UMLS → SCT"),
    ("4", "6 Shared CUI"),
    ("5", "7 Jaccard = 1 and cosine = 1"),
    ("6", "8 Jaccard = 1 only"),
    ("7", "9 Best-candidate fallback"),
    ("8", "10 Last-resort fallback"),
)
# Codes of the fallback steps, depth buckets of reports, and the bucket of pairs without a distance.
FALLBACK_CODES = (8, 9)
DEPTH_BUCKETS = ((0, 2), (3, 5), (6, 9), (10, 14), (15, None))
UNMEASURED = "gold_not_in_sct"
STEP_CODE = {step: code for code, step, _ in VALIDITY if step}
REVIEW_REASON = {code: reason for code, _, reason in VALIDITY if reason}

# Methods in their order of generation.
METHODS = ("hpo_sct", "hpo_umls_sct", "umls_hpo_sct", "jaccard", "embedding", "exact_lexical")
REFERENCE_METHODS = METHODS[:3]

# The review's highest confidence, children shown in a prompt, the open distance bucket, thresholds of a sweep.
CONFIDENCE_MAX = 5
CHILDREN_SHOWN = 10
DISTANCE_CAP = 5
SWEEP_POINTS = 50

# Rows shown of examples and of rejected pairs.
EXAMPLES_SHOWN = 10
REJECTS_SHOWN = 20

# Sets of pairs that the stages are compared by, in order.
STAGES = ("generated", "filtered", "auto", "llm", "final")
