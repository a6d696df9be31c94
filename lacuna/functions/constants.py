"""Word lists, look-up tables and patterns that results depend on. They are data, not logic."""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------------------------------------

NAME_STOP_BIOMED = (
    "algorithm", "analysis", "biomarker", "cell", "clinical trial", "comorbidity", "dermatology", "disease", "disorder", "effect", "epidemiology", "expression", "function", "gene",
    "in vitro", "in vivo", "machine learning", "mechanism", "medicine", "meta analysis", "model", "pathology", "patient", "phenomenon", "process", "protein", "review", "study",
    "syndrome", "system", "systematic review", "treatment",
)
NAME_STOP_GENERAL = ("analysis", "approach", "context", "method", "model", "review", "study", "system")
HOMONYM_BIOMED = (
    "album", "archaeology", "band", "city", "company", "film", "fungus", "genus", "geology", "given name", "insect", "journal", "mathematics", "mycology", "novel", "plant",
    "programming language", "software", "surname", "tv series",
)
HOMONYM_GENERAL = ("company", "film", "journal", "novel", "software")
GENERIC_TOKENS_BIOMED = ("a", "acute", "an", "and", "chronic", "disease", "disorder", "in", "of", "primary", "s", "secondary", "syndrome", "the")
GENERIC_TOKENS_GENERAL = ("a", "an", "and", "in", "of", "s", "the")
ROOT_FIELDS = (
    "art", "biology", "business", "chemistry", "computer science", "economics", "engineering", "environmental science", "geography", "geology", "history", "materials science",
    "mathematics", "medicine", "philosophy", "physics", "political science", "psychology", "sociology",
)
TOPIC_STOP = ("a", "an", "and", "disease", "disorder", "of", "s", "syndrome", "the")
TREE_CATEGORIES = {
    "A": "Anatomy", "B": "Organisms", "C": "Diseases", "D": "Chemicals & Drugs", "E": "Techniques & Equipment", "F": "Psychiatry & Psychology", "G": "Phenomena & Processes",
    "H": "Disciplines & Occupations", "I": "Anthropology & Social Sciences", "J": "Technology & Food", "K": "Humanities", "L": "Information Science", "M": "Named Groups",
    "N": "Health Care", "V": "Publication Characteristics", "Z": "Geographicals",
}
TARGET_PRESETS = {
    "any": None, "drug": ("D",), "chemical": ("D",), "compound": ("D",), "disease": ("C",), "condition": ("C",), "anatomy": ("A",), "organism": ("B",), "technique": ("E",),
    "intervention": ("E",), "psychology": ("F",), "phenomenon": ("G",), "process": ("G",),
}
TITLE_STOP = (
    "a", "an", "the", "and", "or", "of", "in", "on", "for", "with", "to", "from", "by", "via", "using", "based", "study", "studies", "review", "meta", "analysis", "clinical", "trial",
    "patients", "patient", "human", "humans", "mouse", "mice", "model", "models", "effect", "effects", "role", "novel", "new", "potential", "early", "late", "stage", "stages",
)
INTERVENTION = r"\b(?:drug|drugs|therapy|therapies|treatment|inhibitor|agonist|antagonist|supplement|vitamin|steroid|peptide|antibody|vaccine|repurposing|lanosterol|n-acetylcarnosine|carnosine|metformin|statins?)\b"
PHRASE_IN_PARENTHESES = r"\(([A-Za-z][\w\-]+(?:\s[\w\-]+){0,3})\)"
PHRASE_BEFORE_MARKER = r"(?i)([A-Za-z][\w\-]+(?:\s[A-Za-z][\w\-]+){0,2})\s+(?:therapy|treatment|drug|inhibitor|supplement|vaccine)s?"
NOISE_WORDS = ("medicine", "government", "perspective", "key")
NOISE_SUFFIXES = ("(linguistics)", "(graphical)")

# --- end of fixed values ------------------------------------------------------------------------------------------
