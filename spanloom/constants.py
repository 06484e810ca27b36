"""Fixed values of the span rules."""

AD_THRESHOLD = 0.75
UNCERTAIN = 0.40
CONTEXT_SEGMENTS = 12
MAX_SPAN_MS = 240_000
MAX_AD_FRACTION = 0.35
DEGENERATE = 0.60
MIN_SEGMENTS = 10
RAW_TRUNCATE = 2000
EVIDENCE_TRUNCATE = 300
MAX_REJECTIONS = 200
DIALOGUE_DENSITY = 0.20
QUOTE_OVERLAP = 0.70
MERGE_GAP = 1
BREAK_GAP_MS = 500
TURN_GAP_MS = 1000
CHAPTER_GAP_MS = 500
POSTROLL_MS = 2000
GATE_LOSS_MS, GATE_RECALL, GATE_BOUNDARY_MS = 5000, 0.70, 3000

KINDS = ("preroll", "midroll", "postroll", "house", "section")
#: kind: (category, form, position)
KIND_MAP = {
    "preroll": ("sponsor", "host_read", "preroll"),
    "midroll": ("sponsor", "host_read", "midroll"),
    "postroll": ("sponsor", "host_read", "postroll"),
    "house": ("selfpromo", "host_read", "unknown"),
    "section": ("sponsor", "sponsorship_credit", "unknown"),
}
OTHER_KIND = ("sponsor", "unknown", "unknown")
NEVER_SKIP = ("selfpromo", "interaction", "intro", "outro", "preview", "program")
LABELS = {"sponsor": "Ad", "selfpromo": "Promo", "crosspromo": "Cross-promo", "intro": "Intro", "outro": "Outro", "preview": "Preview", "interaction": "Reminder", "program": "Program"}
SPONSORBLOCK = {"sponsor": "Sponsor", "selfpromo": "Unpaid/Self Promotion", "interaction": "Interaction Reminder", "intro": "Intermission/Intro Animation", "outro": "Endcards/Credits", "preview": "Preview/Recap"}
STATES = ("ad", "uncertain", "content")
ACTIONS = ("skip", "prompt", "none")
PROFILE = "spans/1.0"
EXIT_CODES = {"ok": 0, "error": 1, "failed": 2, "exists": 3, "offline": 4, "unreadable": 5, "gate": 6}
