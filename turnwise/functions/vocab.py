"""Closed vocabularies and cue patterns. Results depend on these exact strings."""

from __future__ import annotations

ENTITY_TYPES = ("Symptom", "Drug", "Drug_Category", "Medical_Examination", "Operation")
BIO_LABELS = ("O", *(f"{prefix}-{kind}" for kind in ENTITY_TYPES for prefix in ("B", "I")))
SYMPTOM_TYPES = ("0", "1", "2")
ACT_TOPICS = ("Symptom", "Etiology", "Basic_Information", "Existing_Examination_and_Treatment", "Drug_Recommendation", "Medical_Advice", "Precautions")
DIALOGUE_ACTS = (*(f"{kind}-{topic}" for topic in ACT_TOPICS for kind in ("Request", "Inform")), "Diagnose", "Other")

# Annotation fields and their values.
ANNOTATION_FIELDS = {
    "target_binding": ("DIRECT_TARGET", "TARGET_FACET", "OTHER_SUBJECT", "HISTORICAL_HYPOTHESIS", "UNSUPPORTED"),
    "question_facet": ("existence", "severity", "frequency", "duration", "course", "trigger", "location", "radiation", "character", "associated_feature", "treatment_response", "temporality", "subject", "diagnostic_hypothesis", "unclear"),
    "answer_stance": ("affirm", "deny", "mixed", "uncertain", "revise", "no_answer"),
    "subject": ("patient", "caregiver", "family_other", "unknown"),
    "temporality": ("current", "historical", "mixed", "unknown"),
    "context_requirement": ("ANSWER_SUFFICIENT", "QUESTION_REQUIRED", "LONG_CONTEXT_REQUIRED", "INSUFFICIENT"),
    "existence_effect": ("SET_PRESENT", "SET_ABSENT", "KEEP_PRESENT", "MOVE_TO_HISTORY", "REOPEN", "NO_EXISTENCE_CHANGE", "HOLD"),
    "facet_effect": ("UPDATE_CURRENT_FACET", "UPDATE_HISTORICAL_FACET", "NO_FACET_UPDATE", "HOLD"),
}
STUDENT_FIELDS = ("question_facet", "answer_stance", "temporality", "existence_effect", "facet_effect")

# Values of proposed propositions.
PROPOSITION_FIELDS = {
    "facet": ("existence", "severity", "duration", "frequency", "onset", "course", "trigger", "location", "radiation", "associated_feature", "treatment_response", "diagnostic_status", "other"),
    "assertion": ("positive", "negative", "uncertain", "not_applicable"),
    "temporality": ("current", "historical", "mixed", "unknown"),
    "subject": ("patient", "family", "other", "unknown"),
    "revision_operation": ("ASSERT_EXISTENCE", "RETRACT_EXISTENCE", "UPDATE_FACET", "RESOLVE", "RECUR", "IMPROVE", "WORSEN", "HOLD"),
}

PRESENT_OPERATIONS = ("ASSERT_EXISTENCE", "RECUR", "IMPROVE", "WORSEN")
NLI_FACETS = ("existence", "severity", "duration", "frequency", "course", "trigger", "treatment_response")

#: Reasons that hold a packet back; the first list is the one whose names the card stage emits.
BLOCKING_BOUNDED = ("temporality_scope", "subject_resolution_required", "disjunction_or_hypothesis", "patient_question_or_hypothesis", "attributed_diagnosis_requires_facet", "treatment_indication_scope", "uncertain_proposition", "unresolved_normalization", "low_ner_confidence")
BLOCKING_AUTHORITY = ("family_or_other_subject", "historical_context", "uncertain_or_hypothetical", "unresolved_normalization", "low_ner_confidence", "attributed_diagnosis", "treatment_indication_context")

#: Demo cues for English text: (reason, pattern, only in the words of this speaker). Patterns avoid lookaround and are read as RE2
#: reads them (``text.java``); give a table of your own for another language.
DEMO_CUES = (
    ("negation_scope", r"(?i)\b(no|not|never|none)\b", None),
    ("temporality_scope", r"(?i)\b(was|were|before|ago)\b", None),
    ("uncertain_proposition", r"(?i)\b(maybe|perhaps|might)\b", None),
    ("disjunction_or_hypothesis", r"(?i)\bor\b", None),
    ("patient_question_or_hypothesis", r"\?", "patient"),
    ("facet_resolution_required", r"(?i)\b(often|always|since)\b", None),
)

#: Facet hints, first match wins; demo patterns as above.
DEMO_FACETS = (("course", r"(?i)\b(better|worse|again)\b"), ("duration", r"(?i)\b(since|hours|days)\b"), ("frequency", r"(?i)\b(often|always|never)\b"))
