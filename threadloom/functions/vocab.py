"""Controlled vocabularies: fixed values that results depend on."""

from __future__ import annotations

# ---- fixed values: artifact types, each with the metadata fields that it keeps
METADATA_FIELDS = {
    "problem_statement": ("problem_kind", "affected_area", "user_or_system_impact"),
    "proposed_solution": ("solution_kind", "target_area", "expected_benefit"),
    "alternative_solution": ("alternative_to", "differentiator", "comparison_focus"),
    "design_decision": ("decision_status", "chosen_option", "rejected_options"),
    "trade_off_argument": ("options_compared", "comparison_axes", "preferred_option"),
    "rationale": ("supports_artifact_type", "reasoning_kind", "impact_scope"),
    "constraint": ("constraint_type", "scope", "severity"),
    "assumption": ("assumption_scope", "confidence", "failure_mode"),
    "implementation_detail": ("component", "lifecycle_stage", "implementation_action"),
    "code_snippet": ("language", "snippet_kind", "intended_use"),
    "algorithm_approach": ("approach_name", "target_problem", "scale_or_complexity_notes"),
    "api_design": ("interface_kind", "api_surface", "compatibility_impact"),
    "data_structure_choice": ("data_structure", "workload", "motivation"),
    "configuration_choice": ("parameter", "selected_value", "config_scope"),
    "benchmark_result": ("metric", "baseline", "candidate", "environment"),
    "performance_claim": ("metric_focus", "claim_direction", "workload"),
    "test_case": ("test_level", "coverage_target", "expected_outcome"),
    "bug_reproduction_steps": ("environment", "prerequisites", "determinism"),
    "edge_case": ("trigger", "impact", "rarity"),
    "empirical_evidence": ("evidence_type", "sample_source", "reliability"),
    "question": ("question_kind", "target_area", "urgency"),
    "answer_clarification": ("target_question_topic", "certainty", "resolution_status"),
    "agreement": ("target", "strength", "justification"),
    "disagreement": ("target", "contention_point", "severity"),
    "suggestion": ("target_area", "expected_improvement", "urgency"),
    "critique": ("target", "critique_dimension", "severity"),
    "task_assignment": ("assignee", "deliverable", "due_context"),
    "status_update": ("status_kind", "progress_state", "blocking"),
    "priority_discussion": ("priority_level", "compared_against", "scope"),
    "blocking_issue": ("blocker_type", "blocking_target", "unblock_condition"),
    "dependency": ("dependency_type", "dependency_target", "relationship"),
}
ARTIFACT_TYPES = tuple(METADATA_FIELDS)

# ---- fixed values: allowed tags
ALLOWED_TAGS = tuple(
    """
    bug regression flaky_test ci_failure build_failure runtime_error compile_error assertion_failure performance_issue
    memory_issue security_issue data_corruption incorrect_behavior edge_case compatibility_issue race_condition
    non_determinism timestamp_issue floating_point_error off_by_one null_pointer uninitialized_state state_sync_issue
    logic_bug api_misuse config_issue dependency_issue version_mismatch platform_specific overflow_underflow unit_test
    integration_test e2e_test functional_test test_framework_issue test_flakiness test_timeout test_infra_issue networking
    filesystem database api cli ui backend frontend distributed_system p2p consensus mempool rpc serialization crypto
    validation scheduler training inference data_pipeline tokenization linux macos windows arm x86 docker ci_environment
    gpu low_memory build_time startup runtime shutdown deployment crash hang timeout incorrect_output missing_output
    extra_output log_error performance_degradation workaround fix_proposed fix_merged refactor test_adjustment
    relax_assertion
    """.split()
)

# ---- fixed values: text that gives a tag, in order
TAG_RULES = (
    ("regression", "regression"), ("flaky", "flaky_test"), ("ci", "ci_failure"), ("build", "build_failure"),
    ("runtime error", "runtime_error"), ("compile", "compile_error"), ("assert", "assertion_failure"),
    ("performance", "performance_issue"), ("memory", "memory_issue"), ("security", "security_issue"),
    ("corrupt", "data_corruption"), ("edge case", "edge_case"), ("compat", "compatibility_issue"),
    ("race", "race_condition"), ("non-determin", "non_determinism"), ("timestamp", "timestamp_issue"),
    ("float", "floating_point_error"), ("off by one", "off_by_one"), ("state", "state_sync_issue"), ("logic", "logic_bug"),
    ("api", "api"), ("config", "config_issue"), ("dependency", "dependency_issue"), ("version", "version_mismatch"),
    ("linux", "linux"), ("macos", "macos"), ("darwin", "macos"), ("windows", "windows"), ("arm", "arm"), ("x86", "x86"),
    ("docker", "docker"), ("gpu", "gpu"), ("network", "networking"), ("filesystem", "filesystem"), ("database", "database"),
    ("cli", "cli"), ("frontend", "frontend"), ("backend", "backend"), ("rpc", "rpc"), ("serialization", "serialization"),
    ("crypto", "crypto"), ("validation", "validation"), ("scheduler", "scheduler"), ("training", "training"),
    ("inference", "inference"), ("pipeline", "data_pipeline"), ("token", "tokenization"), ("crash", "crash"),
    ("hang", "hang"), ("timeout", "timeout"), ("incorrect", "incorrect_output"), ("missing", "missing_output"),
    ("extra output", "extra_output"), ("error:", "log_error"), ("workaround", "workaround"), ("fix", "fix_proposed"),
    ("merged", "fix_merged"), ("refactor", "refactor"), ("test", "unit_test"),
)

# ---- fixed values: roles by author association; all others are external
ROLES = {"OWNER": "owner", "MEMBER": "member", "COLLABORATOR": "collaborator", "CONTRIBUTOR": "contributor", "FIRST_TIME_CONTRIBUTOR": "first-time contributor", "FIRST_TIMER": "first-timer"}

# ---- fixed values: file extensions that make a bare name a file
FILE_EXTENSIONS = (
    "c|cc|cpp|cxx|h|hh|hpp|hxx|py|rs|java|js|jsx|ts|tsx|go|rb|php|cs|swift|kt|kts|scala|m|mm|sh|bash|zsh|fish|ps1|toml|yaml|yml|"
    "json|jsonl|md|txt|ini|cfg|conf|xml|html|css|scss|sql|proto|capnp|bzl"
)

# ---- fixed values: keyword rules of discussion comments
QUESTION_START = r"^\s*(?:who|what|when|where|why|how|could|can|would|should|is|are|do|does|did|will)\b"
STATUS_WORDS = r"\b(?:released|landed|merged|fixed in|available in|cherry-?picked|backported|rc\d+|ready for testing)\b"
SUGGESTION_WORDS = r"\b(?:suggest|recommend|try|workaround|you can|consider|enable|disable)\b"
SOLUTION_WORDS = r"\b(?:fix(?:ed|es|ing)?|solution|move|add|remove|change|rename|avoid|prevent|don't trim|do not trim)\b"
PROBLEM_WORDS = r"\b(?:bug|regression|error|errors|fail(?:ed|ing)?|failure|conflict|crash|hang|timeout|broken|issue)\b"
TASK_WORDS = r"\b(?:assign(?:ed|ing)?|take this|for @[\w-]+|cc @[\w-]+)\b"
PRIORITY_WORDS = r"\b(?:priority|prioritiz(?:e|ing)|backport|fork)\b"
DONE_WORDS = r"\b(?:merged|released|fixed)\b"
BLOCK_WORDS = r"\bblock(?:ed|ing|er)?\b"

# ---- fixed values: leaderboard components and the report each stands in
COMPONENTS = ("type_f1", "tag_f1", "metadata_f1", "metadata_soft_f1", "summary_bertscore_f1", "summary_bleurt_score", "summary_codebert_cosine")


def topic(kind: str) -> str:
    """The display topic of a type: its words in capitals, with the few that are written otherwise."""
    odd = {"trade_off_argument": "Trade-off Argument", "algorithm_approach": "Algorithm / Approach", "api_design": "API Design", "answer_clarification": "Answer / Clarification"}
    return odd.get(kind) or " ".join(w.capitalize() for w in kind.split("_"))


TOPICS = tuple(topic(t) for t in ARTIFACT_TYPES)
