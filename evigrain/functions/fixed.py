"""Word lists, patterns, messages and limits that results depend on.

Patterns are written for Python, Java and RE2 alike; ``java`` adds the flags that
make Java's classes and case folding Unicode-aware.
"""

# --- Fixed values: page cleaning -------------------------------------------------
BOUNDARY_LINES = 3
PAGE_NUMBER_EDGE_LINES = 2
REPEATED_RATIO = 0.20
REPEATED_LEAST_PAGES = 3
LOW_TEXT_CHARS = 150
HYPHENS = "‐‑‒–—−"
PAGE_NUMBER_MARK = " <PAGE_NUMBER>"

# --- Fixed values: chunking --------------------------------------------------------
TOKEN_FACTOR = 1.15
HEADING_PREFIXES = ("section ", "annexure", "key recommendation", "full guideline", "background document", "table of contents")
HARD_HEADING_PREFIXES = ("section ", "annexure", "full guideline")
HEADING_MIN_CHARS, HEADING_MAX_CHARS = 3, 140
HEADING_MIN_LETTERS, HEADING_UPPER_SHARE = 8, 0.85
FIRST_SECTION = "Document overview"
PARAGRAPH_FLUSH_CHARS = 120
NUMBERED_PARAGRAPH = r"^(?:\d+(?:\.\d+)+\.?|\([a-z0-9ivx]+\)|[•●▪])\s+"
NUMBERED_HEADING = r"^\d+(?:\.\d+)*\s*:\s+\S"
SENTENCE_BOUNDARY = r"(?<=[.!?])\s+(?=[A-Z0-9(])"
DOSAGE_AMOUNT = r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|ug|g|ml|units?|iu)\b"
DOSAGE_LANGUAGE = r"\b(?:doses?|dosages?|dosing|titration|once daily|twice daily)\b"
EMERGENCY_LANGUAGE = r"\b(?:emergency|emergencies|life-threatening|urgent referral)\b"
SAFETY_TAGS = ("dosage_content", "emergency_content")

# --- Fixed values: sources -----------------------------------------------------------
MANIFEST_REQUIRED = ("title", "publisher", "document_date", "version", "license_status", "status")
MAX_FILE_BYTES = 25 * 1024 * 1024
PDF_MAGIC = "%PDF"
ALLOWED_HOSTS = ("clinicalestablishments.mohfw.gov.in", "www.clinicalestablishments.mohfw.gov.in", "ncvbdc.mohfw.gov.in")
URL_MARK, KEY_MARK = "[url-redacted]", "[key-redacted]"
KEY_PATTERN = r"(?:AIza|AQ\.)[0-9A-Za-z._-]+"

# --- Fixed values: retrieval ---------------------------------------------------------
QUERY_STOPWORDS = ("a", "an", "and", "are", "be", "can", "for", "how", "in", "is", "of", "should", "the", "to", "what", "when", "which", "with")
MAX_QUERY_CHARS = 500
MAX_QUERY_TERMS = 30
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6

# --- Fixed values: input guardrails ----------------------------------------------------
PERSONALIZED_REFUSAL = "I can explain information contained in the indexed MOHFW guidelines, but I cannot diagnose a condition or recommend personalized treatment, medication, or dosage. Please consult a qualified healthcare professional."
EMERGENCY_REFUSAL = "I cannot assess or manage medical emergencies. Please contact your local emergency service or seek immediate help from a qualified healthcare professional."
OUT_OF_SCOPE_REFUSAL = "I don't have enough information in the indexed MOHFW guidelines to answer that question."
INVALID_INPUT_REFUSAL = "Please enter a medical-guideline question of 500 characters or fewer."
PERSONAL_CONTEXT = r"\b(?:i|i'm|i've|me|my|mine|we|our|my child|my baby|my mother|my father|my husband|my wife|my patient)\b"
IMMEDIATE_PERSON = r"\b(?:someone|this person|the patient)\s+(?:is|has|cannot|can't)\b"
EMERGENCY_SIGNAL = r"\b(?:cannot breathe|can't breathe|struggling to breathe|not breathing|unconscious|collapsed|seizure|severe bleeding|bleeding heavily|overdose|suicidal|chest pain|medical emergency)\b"
DIAGNOSIS_REQUEST = r"\b(?:do i have|have i got|diagnose me|what (?:disease|condition) do i have|is this (?:dengue|hypertension|an infection)|am i (?:infected|diabetic))\b"
SYMPTOM_OR_RESULT = r"\b(?:fever|rash|pain|vomiting|bleeding|dizzy|dizziness|swelling|ulcer|blood pressure|bp|lab result|test result|platelet|glucose|symptoms?)\b"
DOSAGE_REQUEST = r"\b(?:doses?|dosages?|dosing|how many tablets?|how much (?:medicine|medication)|what strength|which strength)\b"
TREATMENT_REQUEST = r"\b(?:should|can|may|must)\s+i\s+(?:take|use|start|stop|change|increase|decrease)\b|\b(?:which|what)\s+(?:medicine|medication|drug|treatment)\s+should\s+i\b"
PERSONAL_RECORD = r"\b(?:my|our)\s+(?:prescription|medical record|lab report|test report|scan|blood report|doctor's note)\b"
NONMEDICAL_TOPIC = r"\b(?:weather forecast|stock price|share price|cricket score|football score|movie review|write (?:python|javascript) code|cooking recipe)\b"
ABBREVIATIONS = {
    "BP": "blood pressure",
    "CBC": "complete blood count",
    "DBP": "diastolic blood pressure",
    "HCT": "hematocrit",
    "HTN": "hypertension",
    "PAD": "peripheral artery disease",
    "SBP": "systolic blood pressure",
}

# --- Fixed values: grounding and output safety -------------------------------------------
CLAIM_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")
CLAIM_MIN_TOKEN = 3
MAX_CLAIMS, MAX_CLAIM_CHARS = 12, 600
DOSAGE_OUTPUT = r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|ug|g|ml|iu|units?)(?:\s*/\s*kg)?\b"
DOSAGE_CONTEXT_CHARS = 80
LIFESTYLE_CONTEXT = r"\b(?:alcohol|body mass index|bmi|coffee|diet(?:ary)?|salt|sodium|weight)\b"
MEDICATION_CONTEXT = r"\b(?:administer|capsule|dose|drug|inject|medicine|medication|prescribe|syrup|tablet|take)\b"
PERSONALIZED_OUTPUT = r"\b(?:you\s+(?:have|may have|likely have|are suffering from|should|must|need to)|take this|start taking|stop taking|increase your|decrease your)\b"
EMERGENCY_OUTPUT = r"\b(?:call (?:an ambulance|emergency services)|go to (?:an? )?emergency|seek immediate (?:care|medical attention)|dial \d{3})\b"
HIGH_CONFIDENCE, MODERATE_CONFIDENCE = 0.8, 0.5
DISCLAIMER = "This assistant provides information from indexed official guidelines only and does not provide personalized medical advice."
# --- end of fixed values ------------------------------------------------------------------


def java(pattern: str) -> str:
    """Unicode-aware classes and case folding in Java."""
    return "(?iU)" + pattern


def re2(pattern: str) -> str:
    """The same pattern for DuckDB, as the inside of a SQL literal."""
    return "(?i)" + pattern.replace("'", "''")
