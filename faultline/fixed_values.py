"""These must equal the published protocol for results to match.

Word lists, patterns, prompt texts and constants only; no logic lives here.
"""

# --- enumerations -----------------------------------------------------------
SUBSETS = ["alg", "hc"]
TYPE_NORMS = ["plan", "delegate", "execute", "final", "unknown"]
TYPE_SOURCES = ["parsed", "classified"]
COORDINATION = ["plan", "delegate"]
FLAG_MISMATCH = "agent_step_mismatch"
FLAG_OUT_OF_RANGE = "mistake_step_out_of_range"
FLAG_EMPTY = "empty_step_content"
KNOWN_FLAGS = [FLAG_MISMATCH, FLAG_OUT_OF_RANGE, FLAG_EMPTY]
ANOMALY_FLAGS = [FLAG_OUT_OF_RANGE, FLAG_EMPTY]
CONFIG_AXES = [
    "subset", "judge", "readout", "policy", "with_gt", "use_types",
    "subtask_pointer", "peer_corroboration", "prefix_window", "lookahead",
]

# --- source column aliases --------------------------------------------------
ID_KEYS = ["question_ID", "question_id", "id", "file_id"]
HISTORY_KEYS = ["history", "steps", "messages", "conversation", "trajectory"]
QUERY_KEYS = ["question", "query", "task", "problem"]
TRUTH_KEYS = ["ground_truth", "groundtruth", "answer", "gt", "final_answer"]
AGENT_KEYS = ["mistake_agent", "agent"]
STEP_KEYS = ["mistake_step", "step"]
REASON_KEYS = ["mistake_reason", "reason"]
CONTENT_KEYS = ["content", "output", "message"]
TEXT_KEYS = ["text", "content", "output", "message"]

# --- agent and role vocabulary ----------------------------------------------
ORCHESTRATOR_NAMES = ["manager", "chat_manager", "coordinator", "supervisor"]
WORKERS = ["websurfer", "assistant", "filesurfer", "coder", "computerterminal", "executor"]
QUALIFIER_TYPES = {
    "thought": "plan",
    "thinking": "plan",
    "plan": "plan",
    "planning": "plan",
    "final answer": "final",
    "final": "final",
    "answer": "final",
    "termination condition met": "final",
}
TOOL_ROLES = ["tool", "function", "tool_call", "observation"]
PLAN_JSON_KEYS = [
    "analyst_task", "verifier_task", "subtasks", "sub_tasks", "plan", "steps",
    "task_assignment", "assignments", "next_agent", "next_speaker",
]

# --- step typing patterns (case-insensitive unless noted) ---------------------
RE_COMPOUND = r"^\s*([^()]+?)\s*(?:\(\s*(.*?)\s*\))?\s*$"
RE_ROLE_ARROW = r"^->\s*(.+)$"
RE_ANSWER = (
    r"(?:^|\b)(?:final\s+answer|the\s+answer\s+is|answer\s*:|\\?boxed\{|"
    r"therefore,?\s+the\s+answer)"
)
RE_TERMINATE = r"\bTERMINATE\b|\bTASK[_ ]COMPLETE\b"
RE_BARE_CHOICE = r"^\s*[\(\[]?([A-Ea-e1-9])[\)\].]?\s*$"  # case as written
RE_HANDOFF = (
    r"\b(?:next\s+speaker|hand(?:s|ing)?\s*off\s+to|delegat(?:e|ing)\s+to|"
    r"assign(?:ing|ed)?\s+(?:this\s+)?to|please\s+(?:proceed|take\s+over|go\s+ahead)|"
    r"over\s+to\s+you)|@[A-Za-z_][A-Za-z0-9_]*\s*[,:]"
)
RE_ARROW = r"->\s*([A-Za-z_][A-Za-z0-9_ ]*)"
RE_ADDRESSED = r"^\s*([A-Z][A-Za-z0-9_]{2,})\s*,\s+[a-z]"  # case as written
RE_PLAN = (
    r"(?:^|\n)\s*(?:here(?:'s| is)\s+(?:the|my)\s+plan|plan\s*:|"
    r"i\s+will\s+(?:first|now)\b|step\s*1\s*[:.]|to\s+solve\s+this,?\s+we\s+(?:will|need))"
)
RE_TOOL_OUTPUT = (
    r"(?:^|\n)\s*(?:exitcode\s*:|Traceback \(most recent call last\)|"
    r"```(?:python|bash|sh|output)|Address:\s*http|Viewport position|"
    r"Here is a screenshot|The web browser is open|File .*? line \d+)"
)

# --- response patterns ------------------------------------------------------
RE_THINK = r"<think>.*?</think>"
RE_NUMBER = r"(\d+(?:\.\d+)?)\s*%?"
RE_SPLIT_ANSWER = r"\b(PLAN|DELEGATE)\b"
RE_FREE_STEP = r"step\s*(?:index\s*)?[:#]?\s*(\d+)"
RE_FREE_AGENT = r"agent\s*[:#]?\s*([A-Za-z_][\w \-]*)"
RE_LABEL_AGENT = r"Agent\s*(?:Name|Identification)\s*\**\s*:\s*\**\s*(.+)"
RE_LABEL_STEP = r"Step\s*(?:Number|Index)?\s*\**\s*:\s*\**\s*(-?\d+)"
RE_NUMBERED_AGENT = r"^\s*1[\.\)]\s*\**\s*(.+)$"
RE_NUMBERED_STEP = r"^\s*2[\.\)]\s*\**\s*(-?\d+)"
RE_PROSE_STEP = r"step\s*(?:number)?\s*(?:is|:)?\s*\**\s*(\d+)"
RE_BOLD = r"\*\*([^*]{2,60})\*\*"
RE_PRED_BLOCK = r"Prediction for ([^:]+\.json):(.*?)(?=Prediction for|\z)"
RE_PRED_AGENT = r"Agent Name:\s*([\w_]+)"
RE_PRED_STEP = r"Step Number:\s*(\d+)"

# --- evidence constants -----------------------------------------------------
NEAR_EMPTY_CHARS = 16
MAX_STEP_CHARS = 4000
HEADER_CHARS = 120
MAX_POINTER_CHARS = 800
PREFIX_BUDGET_CHARS = 90_000
RETAIN_TARGET = 0.8
RESP_CAP = 2
DELEG_CAP = 5
PTRUE_STEP_CHARS = 2000
PTRUE_PREFIX_CHARS = 60_000
SEARCH_PREFIX_CHARS = 80_000
FREEFORM_STEP_CHARS = 1500
PREMISE_STEPS = 5
COHERENCE_CHARS = 2000
NOT_RECORDED = "(not recorded)"
OMITTED = "…[content omitted for length]…"

RUBRIC = {
    "plan": (
        "This step is a PLAN. It is appropriate if the decomposition is sound, "
        "covers the task, and assigns work the named agents can do."
    ),
    "delegate": (
        "This step is a DELEGATION. It is appropriate if the chosen agent is "
        "right for the outstanding subtask and the handoff carries what that "
        "agent needs."
    ),
    "execute": (
        "This step is an EXECUTION. It is correct if the work performed is "
        "accurate and advances the subtask this agent was assigned."
    ),
    "final": (
        "This step is a FINAL ANSWER emission. It is correct if the answer "
        "follows from the transcript and is well-formed for the task."
    ),
    "unknown": (
        "The act type of this step could not be determined. Judge whether it is "
        "a correct and appropriate contribution given the transcript so far."
    ),
}
INSTRUCTION = {
    "ptrue": "Answer with a single word, True or False.\nAnswer:",
    "binary": "Answer with a single word, True or False.\nVerdict:",
    "verbalized": (
        "Reply with only your confidence that it is correct, as a probability "
        "between 0.00 and 1.00.\nConfidence:"
    ),
}
SPLITTER_PROMPT = """You are labelling one step from a multi-agent system transcript.

The step was produced by a coordinating agent. Decide which of two acts it is:

PLAN — the coordinator is reasoning, tracking state, or laying out what to do:
inner monologue, a ledger or status update, a decomposition of the task.
DELEGATE — the coordinator is handing work to a named agent right now: an
instruction addressed to that agent, expecting them to act next.

A step that names another agent is not automatically a delegation; coordinators
name agents while planning too. Ask who is meant to act on this message.

Task: {query}

Preceding step ({prev_agent}, {prev_type}): {prev}

Step under review, by '{agent}':
{content}

Answer with one word, PLAN or DELEGATE.
Answer:"""
SPLITTER_QUERY_CHARS = 600
SPLITTER_PREV_CHARS = 400
SPLITTER_CONTENT_CHARS = 1500

# --- statistics -------------------------------------------------------------
TYPE_GATE = 0.90
AUDIT_CHARS = 1200
MIN_PER_TYPE_N = 50
MIN_SD = 1e-3
SATURATION_EPS = 1e-3
SATURATION_FRACTION = 0.95
DEGENERATE_SD = 1e-3
MIN_CELL_N = 20
MIN_SEG = 2
MIN_CONTRAST = 1.0
CONTRAST_SD_FLOOR = 1e-6
NO_VARIATION_SD = 1e-12
RELATIVE_K = 2.0
RELATIVE_K_SWEEP = [1.5, 2.0, 2.5]
PRIOR_POSITION = 0.33
N_BOOT = 2000
RECALL_KS = [1, 2, 3, 5]
COVERAGE_FRACTIONS = [0.2, 0.4, 0.6, 0.8, 1.0]
LENGTH_BINS = [(0, 10, "short (<10)"), (10, 40, "medium (10-39)"), (40, None, "long (40+)")]
EXPECTED_COUNTS = {"alg": (126, 3), "hc": (58, 3)}
EXPECTED_TOTAL_STEPS = 4092
