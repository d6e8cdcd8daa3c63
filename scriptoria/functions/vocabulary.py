"""Word lists, patterns, weights and thresholds that results depend on."""

from __future__ import annotations

# Search aliases, key and expansion.
SEARCH_ALIASES = (
    ("doi", "digital object identifier"),
    ("pmid", "pubmed identifier"),
    ("orcid", "open researcher contributor id"),
    ("supp", "supplement supplementary material"),
    ("preprint", "manuscript arxiv"),
)

# Greek letters and their names.
GREEK_NAMES = (("ψ", "psi"), ("Ψ", "psi"), ("ρ", "rho"), ("Ρ", "rho"), ("γ", "gamma"), ("Γ", "gamma"), ("λ", "lambda"), ("Λ", "lambda"))

# Card sections and their types.
SECTION_TYPES = {
    "research question": "research_question",
    "methods": "method",
    "equations and conventions": "equation_or_convention",
    "main results": "result",
    "limitations": "limitation",
    "project role": "project_role",
}

# Weights of full-text columns.
PAPER_WEIGHTS = {"title": 8.0, "authors": 4.0, "tags": 3.0, "body": 1.0, "aliases": 0.5}
CLAIM_WEIGHTS = {"type": 2.0, "section": 2.0, "text": 7.0, "evidence": 3.0}

# Statuses that a formal result may have.
FORMAL_STATUSES = ("evidence_verified", "needs_attention")

# Candidate kinds in order, with their caps.
CANDIDATE_CAPS = {
    "section": 32,
    "equation": 24,
    "figure": 16,
    "table": 16,
    "citation": 24,
    "research_question": 16,
    "method": 16,
    "result": 16,
    "limitation": 16,
    "assumption": 16,
}

# Headings that name a common section.
COMMON_HEADINGS = (
    "abstract",
    "acknowledgments",
    "appendix",
    "conclusion",
    "conclusions",
    "discussion",
    "introduction",
    "limitations",
    "materials and methods",
    "method",
    "methods",
    "references",
    "results",
)

# Phrases that signal a kind of sentence.
SIGNALS = {
    "research_question": (
        "aim of this",
        "central question",
        "goal of this",
        "motivated by",
        "open question",
        "purpose of this",
        "we ask",
        "we examine",
        "we explore",
        "we investigate",
        "we study",
        "whether",
    ),
    "method": (
        "algorithm",
        "dataset",
        "experiment",
        "method",
        "model",
        "numerical",
        "simulation",
        "we compute",
        "we employ",
        "we measure",
        "we solve",
        "we use",
    ),
    "result": (
        "consistent with",
        "demonstrate",
        "decreases",
        "indicate",
        "increases",
        "our results",
        "we find",
        "we observe",
        "we show",
    ),
    "limitation": (
        "approximation",
        "cannot",
        "caveat",
        "does not",
        "future work",
        "however",
        "limitation",
        "restricted",
        "uncertain",
    ),
    "assumption": (
        "assuming",
        "for simplicity",
        "is assumed",
        "under the assumption",
        "we adopt",
        "we assume",
        "we consider only",
        "we neglect",
        "we restrict",
    ),
}

# Words in a section's name that support a kind of candidate.
SECTION_SUPPORT = {
    "research_question": ("abstract", "introduction", "motivation"),
    "method": ("method", "methods", "methodology", "simulation"),
    "result": ("result", "results", "discussion", "conclusion", "conclusions"),
    "limitation": ("limitation", "limitations", "discussion", "conclusion", "conclusions"),
    "assumption": ("method", "methods", "model", "theory"),
    "equation": ("method", "methods", "model", "theory"),
    "figure": ("result", "results", "discussion"),
    "table": ("result", "results", "method", "methods"),
    "citation": ("introduction", "discussion", "references"),
}

# Patterns of anchors and headings.
NUMBERED_HEADING = r"(?i)^(?:(?:\d+(?:\.\d+)*)|(?:[IVXLC]+))[.)]?\s+\S+"
FIGURE_ANCHOR = r"(?i)\bfig(?:ure)?s?\.?\s*\d+[a-z]?\b"
TABLE_ANCHOR = r"(?i)\btables?\.?\s*\d+[a-z]?\b"
CITATION_ANCHORS = (r"\[\s*\d+(?:\s*[-,]\s*\d+)*\s*\]", r"\([A-Z][A-Za-z'`-]+(?:\s+et\s+al\.)?,?\s+(?:19|20)\d{2}[a-z]?\)")
EQUATION_OPERATORS = ("=", "≈", "∝", "≤", "≥", "∫", "∑", "∇", "±")

# Patterns of identifiers.
DOI_PREFIX, DOI = r"(?i)^https?://(?:dx\.)?doi\.org/", r"^10\.\d{4,9}/\S+$"
ARXIV = r"(?i)^(?:https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/)?((?:\d{4}\.\d{4,5}|[A-Za-z.\-]+/\d{7})(?:v\d+)?)(?:\.pdf)?/?$"
SHA256 = "^[a-f0-9]{64}$"

# Scores that each component of a relation may have, and weights of its confidence.
RUBRIC = {
    "directDependency": (0, 12, 24, 35),
    "coreQuestion": (0, 8, 16, 25),
    "methodContinuity": (0, 7, 14, 20),
    "resultRelationship": (0, 7, 14, 20),
}
CONFIDENCE_WEIGHTS = {"sourceCoverage": 0.40, "locatorPrecision": 0.35, "crossConfirmation": 0.25}

# Thresholds of formal and of candidate relations (strength, confidence), and routing weights.
FORMAL, CANDIDATE = (60, 75), (40, 50)
ROUTING_WEIGHTS = {"verified": 1.0, "candidate": 0.72, "suggestion": 0.12, "unscored": 0.3}
TAG_SHARE, RELATION_SHARE = 0.62, 0.38

# Screening of new documents.
COSINE_SHARE, COVERAGE_SHARE, LOW_FIT, LOW_FIT_DOCS, CONSISTENCY = 0.72, 0.28, 60, 4, 70

# Kinds and states of project memory.
MEMORY_TYPES = (
    "project_context",
    "goal",
    "convention",
    "decision",
    "assumption",
    "finding",
    "open_question",
    "exclusion",
    "next_step",
    "code",
    "experiment",
)
MEMORY_STATES = ("active", "superseded", "retired")
EVIDENCE_STATES = ("user_declared", "provisional", "supported", "contradicted")
PROVENANCE = ("user", "paperEvidence", "computationArtifact", "aiInference")
MEMORY_EVENTS = (
    "project_initialized",
    "project_metadata_updated",
    "memory_recorded",
    "memory_retired",
    "task_started",
    "task_completed",
    "handoff_built",
)

# States of a stored paper.
PAPER_STATES = ("imported", "extracted", "needs_ocr", "card_draft", "evidence_verified", "needs_attention", "source_missing")

# Memory that is always relevant to a preview.
ALWAYS_RELEVANT = ("goal", "convention", "decision", "assumption")

# Placeholders and forms of evidence locators.
LOCATOR_PLACEHOLDER = r"(?i)\b(?:todo|unknown|unspecified|none|n/?a)\b|\?"
LOCATOR_FORMS = (
    r"(?i)\b(?:p|pp)\.?\s*[1-9]\d*(?:\s*[–—-]\s*[1-9]\d*)?\b",
    r"(?i)\bpages?\s*[:.]?\s*[1-9]\d*(?:\s*[–—-]\s*[1-9]\d*)?\b",
    r"(?i)\bsec(?:tion)?s?\.?\s*(?:[A-Z0-9][A-Z0-9_.:()–—-]*)",
    r"(?i)\b(?:abstract|introduction|methods?|results?|discussion|conclusions?|appendix(?:\s+[A-Z0-9][A-Z0-9_.:()–—-]*)?)\b",
    r"(?i)\beq(?:uation)?s?\.?\s*\(?[A-Z0-9][A-Z0-9_.:–—-]*\)?",
    r"(?i)\bfig(?:ure)?s?\.?\s*[A-Z0-9][A-Z0-9_.:()–—-]*",
    r"(?i)\btables?\.?\s*[A-Z0-9][A-Z0-9_.:()–—-]*",
    "第\\s*[1-9]\\d*\\s*页",
    "第\\s*[一二三四五六七八九十百零0-9]+\\s*节",
    "(?i)(?:公式|方程|图|表)\\s*[（(]?[A-Z0-9一二三四五六七八九十]+[）)]?",
)

# Files and folders that a backup may hold.
BACKUP_FILES = ("workspace.json", "library.json", "research-information.json", "user-annotations.json", "workspace-inbox.jsonl", "codex-inbox.jsonl")
BACKUP_FOLDERS = ("Graph/", "Knowledge/", "Usage/", "Projects/", "Tasks/", "Provenance/", "Planning/", "generated/", "user-notes/")

# Patterns of formulas and code in prose.
MARKED_SEGMENT = r"(\$\$[\s\S]*?\$\$|\\\[[\s\S]*?\\\]|\$[^$\n]+\$|\\\([^\n]*?\\\)|`[^`\n]+`)"
BARE_FORMULA = r"(^|[^\w])((?:\\[A-Za-z]+|[A-Za-z][A-Za-z0-9]*)(?:_\{[^}\n]+\}|_[A-Za-z0-9]+|\^\{[^}\n]+\}|\^[A-Za-z0-9+-]+)+(?:\([^\n)]*\))?)"

# The camera and footprint of the layout, and weights of a centre's score.
CAMERA = {
    "rotationX": -0.08,
    "rotationY": -0.22,
    "zoom": 1.08,
    "focalLength": 10,
    "worldScale": 0.115,
    "verticalCenter": 0.51,
    "regionRadius": 1.55,
    "footprintX": 1.06,
    "footprintY": 0.86,
}
VIEWPORT, INSETS = (1320, 820), {"left": 40, "right": 70, "top": 132, "bottom": 32}
FOOTPRINT = (
    (0, 0, 5),
    (-0.38, 0, 3),
    (0.38, 0, 3),
    (0, -0.38, 3),
    (0, 0.38, 3),
    (-0.64, -0.34, 2),
    (0.64, -0.34, 2),
    (-0.64, 0.34, 2),
    (0.64, 0.34, 2),
    (-0.82, 0, 1),
    (0.82, 0, 1),
    (0, -0.82, 1),
    (0, 0.82, 1),
)
EDGE_WEIGHT, OVERLAP_WEIGHT, SEPARATION_WEIGHT, SEPARATION_SCALE = 2.2, 2.8, 0.08, (3.8, 2.55, 0.95)

# Statuses of work that is open, ready, or a draft to be set up.
QUEUE_PENDING = ("pending_codex", "processing", "needs_attention")
QUEUE_READY = ("ready_to_refresh",)
RESEARCH_OPEN = ("pending_setup", "pending_update")
# Statuses that a scored relation may be published with.
REVIEW_STATUSES = ("suggestion", "candidate", "verified")
REVIEW_SCORING = "scored_v1"

# States in which queued work may begin, and what may become of it.
QUEUE_WAITING = ("pending_codex", "needs_attention")
DISPOSITIONS = ("added", "merged", "duplicate", "no-link")

# Kinds of candidates in a review packet, in the order of review.
CANDIDATE_KINDS = ("research_question", "method", "result", "limitation", "assumption", "equation", "figure", "table", "section", "citation")
CANDIDATE_ID = r"^rp2-(?:candidate|anchor)-[a-f0-9]{64}$"

# States of extraction and metadata, and how many macro regions a published state has at most.
EXTRACTION_STATES = ("pending", "extracted", "needs_ocr", "failed")
METADATA_STATES = ("provisional", "official_verified", "source_verified")
MOST_MACROS = 10

# Where partition proposals keep their truths and snapshots, and decisions their ledger.
PROPOSAL_TRUTHS, PROPOSAL_SNAPSHOTS, DECISIONS = "Planning/partition-proposals/", "Planning/partition-snapshots/", "Planning/partition-decisions.jsonl"

# Tags that are written in capitals, and tags that name no cluster.
ACRONYMS = ("fdm", "uldm", "sfdm", "sidm", "smbh", "gpp", "gppe", "vlbi", "ggsl", "sp", "amr", "bec")
GENERIC_TAGS = ("review", "simulation", "numerical methods", "analytic model", "structure formation")
